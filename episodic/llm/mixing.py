"""Mixing sources to target weights: Sainte-Laguë apportionment of equal blocks of words.

1. Count the words of every document (one scan, no shuffle of texts) and add them up by source.
2. Targets: sources share all words by weight; a target stops at ``most`` times its source's
   words, and what is left over is shared again by weight until none is above.
3. The mix is a whole number of blocks of ``block`` words.  Sources get blocks by the highest
   quotients target / (2k + 1), and the shards of a source divide its blocks the same way by
   their words.  Only quotients near the cut are listed: with the total of n seats and s
   members, nobody's seats differ from its share by more than a part s / 2n of it and one, so
   about 2s quotients decide, whatever n is.
4. A shard lays its documents out in seeded order and cuts them into blocks.  Its quota takes
   the whole shard as often as it goes round; the blocks of the rest are spread evenly over the
   shard from a seeded start, and what is less than a block is the head of the first block (or
   of the shorter last one) that is still free.  So a document's part follows from its place
   alone, and a shard gives exactly its quota, or ``most`` times its words if that is less.

A shard holds about ``shard_docs`` documents of one source, chosen by hash; so a source with a
third of all rows is many shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodic.llm.common import ranked, table, written

#: Words of a block.
BLOCK = 32
#: Documents of a shard, about.
SHARD_DOCS = 512
#: A source, and a document, is taken that often at most.
MOST = 3
#: Weights of the sources in their order; they repeat.
WEIGHTS = (5, 2, 1)
SEED = 17

_BIG = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def seeded(seed: int, *keys: str) -> Column:
    """60 bits of md5 over ``seed|key1|key2...``; a null key reads ``null``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (size, weight) with ``target``: its share of all sizes by weight, at most
    ``most`` times its size; the excess is shared again by weight.  A round collects two sums."""
    def above(num: int, den: int) -> Column:
        return F.col("weight").cast(_BIG) * F.lit(num).cast(_BIG) > F.col("size").cast(_BIG) * F.lit(most * den).cast(_BIG)

    total, den = sources.agg(F.sum(F.col("size").cast(_BIG)), F.sum(F.col("weight").cast(_BIG))).first()
    total, den = int(total or 0), int(den or 1)
    num = total
    while True:
        full, rest = sources.agg(F.sum(F.when(above(num, den), F.col("size").cast(_BIG) * most)),
                                 F.sum(F.when(~above(num, den), F.col("weight").cast(_BIG)))).first()
        nxt = (total - int(full or 0), int(rest or 1))
        if nxt == (num, den):
            break
        num, den = nxt
    share = (F.col("weight").cast(_BIG) * F.lit(num).cast(_BIG)).cast("double") / F.lit(float(den))
    return sources.withColumn("target", F.when(above(num, den), (F.col("size") * most).cast("double")).otherwise(share))


def sainte_lague(members: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """(group, key, quota): the ``seats`` of each group go to its members by the highest quotients
    weight / (2k + 1); ties to the smaller key.  Members without weight get none.

    ``seats`` is the same for all rows of a group.  Quotients are ranked over all groups at once
    in ranges, so no task holds a group.
    """
    live = members.where(F.col(weight) > 0).select(*group, key, F.col(weight).cast("double").alias("_w"), F.col(seats).cast("bigint").alias("_m"))
    total = live.groupBy(*group).agg(F.sum("_w").alias("_all"), F.count(F.lit(1)).cast("double").alias("_s"), F.max("_m").alias("_m"))
    if group:
        live = live.drop("_m").join(total, group)
    else:
        live = live.drop("_m").withColumns({c: total.select(c).scalar() for c in ("_all", "_s", "_m")})
    # between these two bounds lies every member's number of seats
    share, slack = F.col("_w") * F.col("_m") / F.col("_all"), F.col("_w") * F.col("_s") / F.col("_all") / 2
    live = live.withColumns({"_lo": F.greatest(F.floor(share - slack + 0.5) - 1, F.lit(0)), "_hi": F.floor(share + slack + 0.5) + 1})
    live = written(live.select(*group, key, "_w", "_m", "_lo", "_hi"))
    given = live.groupBy(*group).agg((F.max("_m") - F.sum("_lo")).alias("_open"))
    near = live.withColumn("_k", F.explode(F.sequence("_lo", F.col("_hi") - 1))).select(*group, key, (F.col("_w") / (2 * F.col("_k") + 1)).alias("_q"))
    near = ranked(near, [*[F.col(c) for c in group], F.col("_q").desc(), F.col(key)], "_rank")
    if group:
        start = near.groupBy(*group).agg(F.min("_rank").alias("_first")).join(given, group)
        won = near.join(start, group).where("_rank - _first < _open")
    else:
        won = near.where(F.col("_rank") < given.select("_open").scalar())
    more = won.groupBy(*group, key).agg(F.count(F.lit(1)).alias("_more"))
    return live.join(more, [*group, key], "left").select(*group, key, (F.col("_lo") + F.coalesce("_more", F.lit(0))).alias("quota"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, most: int = MOST, seed: int = SEED,
                shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, source_size, target, quota, taken.

    ``taken`` counts the words the mix takes of the row, repeats included; it is at most ``most``
    times its size.  ``quota`` is the number of blocks of the row's shard.  Sources are ordered by
    code point, null last, and take the weights in turn.  Null text has no words; a source
    without words has target 0.  Repeated rows count one by one.  The result depends on the rows
    and the seed alone, not on their order or partitions.  An empty table gives no rows.  Other
    columns are not read.
    """
    rows = written(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), n_words(F.col(text_col)).alias("_size"))
                   .withColumn("_h", seeded(seed, "_id", "_size")))
    sources = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("_docs"))
    sources = ranked(sources, [F.col("_source").asc_nulls_last()], "_no")
    turn = F.lit(list(weights))[(F.col("_no") % len(weights)).cast("int")]
    sources = with_targets(written(sources.withColumn("weight", turn.cast("bigint"))), most)
    sources = written(sources.withColumn("_shards", F.ceil(F.col("_docs") / shard_docs)))
    blocks = sources.agg(F.coalesce(F.round(F.sum(F.col("size").cast("double")) / block), F.lit(0.0)).cast("bigint").alias("m"))
    quotas = sainte_lague(sources.withColumn("_blocks", blocks.scalar()), [], "_no", "target", "_blocks")
    sources = written(sources.join(quotas, "_no", "left").withColumn("quota", F.coalesce("quota", F.lit(0))))

    # a written table: Spark knows its bytes and broadcasts it only where it is small
    placed = rows.join(sources.select(F.col("_source").alias("_of"), "_no", "_shards", F.col("size").alias("source_size"), "target"), F.col("_source").eqNullSafe(F.col("_of")))
    placed = placed.select("_id", "_size", "_h", "_no", "source_size", "target", F.expr("_h % _shards").alias("_shard"))
    shards = written(placed.groupBy("_no", "_shard").agg(F.sum("_size").alias("_words")).join(
        sources.select("_no", F.col("quota").alias("_seats")), "_no"))
    taken = sainte_lague(shards, ["_no"], "_shard", "_words", "_seats")
    shards = shards.join(taken, ["_no", "_shard"]).withColumn("_give", F.least(F.col("quota") * block, F.col("_words") * most))
    shards = shards.selectExpr("_no", "_shard", "quota", "_give div _words AS _full", f"_words div {block} AS _n", f"(_give % _words) div {block} AS _r", f"(_give % _words) % {block} AS _head")
    shards = shards.withColumn("_u", seeded(seed, "_no", "_shard") % F.greatest("_n", F.lit(1)))
    shards = shards.withColumn("_free", F.expr(f"{block} * if(_r < _n, _u div (_n - _r), _n)"))  # where the first free block starts
    order = Window.partitionBy("_no", "_shard").orderBy("_h", F.col("_id"), "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.join(shards, ["_no", "_shard"], "left").withColumn("_end", F.sum("_size").over(order))

    def before(x: str) -> Column:
        """Words taken before place x; of the whole blocks before block j, (j * r + u) div n are."""
        j, n = f"least({x} div {block}, _n)", "greatest(_n, 1)"
        whole = f"(({j} * _r + _u) div {n})"
        inside = f"if({x} < _n * {block}, ({x} % {block}) * ((({j} + 1) * _r + _u) div {n} - {whole}), 0)"
        return F.expr(f"_full * {x} + {block} * {whole} + {inside} + least(greatest({x} - _free, 0), _head)")

    part = before("_end") - before("(_end - _size)")
    return placed.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
                         F.coalesce("quota", F.lit(0)).alias("quota"), F.coalesce(part, F.lit(0)).cast("bigint").alias("taken"))


#: Lists every quotient that can win and every block that is taken, one by one.
OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
h AS (
  SELECT *, ('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR)), 1, 15))::BIGINT AS h FROM d),
s AS (
  SELECT source, sum(size)::HUGEINT AS z, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(no % 3) + 1] AS w FROM s),
t AS (SELECT sum(z) AS total, round(sum(z)::DOUBLE / {BLOCK})::BIGINT AS blocks FROM w),
c AS (  -- at the weight where source k reaches its cap, do the shares together stay below the total?
  SELECT k.*, (SELECT sum(CASE WHEN j.z * k.w <= k.z * j.w THEN 3 * j.z * k.w ELSE 3 * k.z * j.w END) FROM w j) < (SELECT total FROM t) * k.w AS capped FROM w k),
g AS (
  SELECT no, source, z, docs, CASE WHEN capped THEN (3 * z)::DOUBLE ELSE
    (w * ((SELECT total FROM t) - (SELECT coalesce(sum(3 * z), 0) FROM c WHERE capped)))::DOUBLE / (SELECT sum(w) FROM c WHERE NOT capped)::DOUBLE END AS target FROM c),
q AS (
  SELECT no, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, no) AS r FROM g,
    LATERAL (SELECT unnest(generate_series(0, (target / {BLOCK} + 2 + target * (SELECT count(*) FROM g) / greatest((SELECT total FROM t), 1))::BIGINT)) AS k) WHERE target > 0),
seats AS (SELECT no, count(*) AS seats FROM q WHERE r <= (SELECT blocks FROM t) GROUP BY no),
p AS (
  SELECT h.*, g.no, g.z, g.target, h.h % ceil(g.docs / {SHARD_DOCS}.0)::BIGINT AS shard FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source),
sh AS (SELECT p.no, shard, sum(size)::BIGINT AS words, coalesce(max(seats), 0) AS seats FROM p LEFT JOIN seats USING (no) GROUP BY ALL),
sq AS (
  SELECT no, shard, seats, row_number() OVER (PARTITION BY no ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard) AS r FROM sh,
    LATERAL (SELECT unnest(generate_series(0, seats)) AS k) WHERE words > 0),
sn AS (
  SELECT sh.no, sh.shard, words, least({BLOCK} * coalesce(quota, 0), 3 * words) AS give, words // {BLOCK} AS n,
    ('0x' || substr(md5(concat_ws('|', '{SEED}', sh.no::VARCHAR, sh.shard::VARCHAR)), 1, 15))::BIGINT AS u
  FROM sh LEFT JOIN (SELECT no, shard, count(*) AS quota FROM sq WHERE r <= seats GROUP BY ALL) x USING (no, shard)),
bl AS (  -- the whole blocks of a shard that its rest takes, by number
  SELECT no, shard, j, ((j + 1) * ((give % words) // {BLOCK}) + u % n) // n > (j * ((give % words) // {BLOCK}) + u % n) // n AS hit
  FROM sn, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS j) WHERE n > 0),
fr AS (  -- start and length of the rest that is less than a block
  SELECT sn.no, sn.shard, words, give // words AS whole, {BLOCK} * coalesce(min(j) FILTER (NOT hit), any_value(n)) AS head, (give % words) % {BLOCK} AS tail
  FROM sn LEFT JOIN bl USING (no, shard) WHERE words > 0 GROUP BY sn.no, sn.shard, words, give),
e AS (
  SELECT p.no, p.shard, row_number() OVER () AS row, doc_id, size, z, target, sum(size) OVER (PARTITION BY p.no, p.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM p),
hit AS (SELECT row, sum(least(b, {BLOCK} * (j + 1)) - greatest(b - size, {BLOCK} * j))::BIGINT AS w
  FROM e JOIN bl USING (no, shard) WHERE hit AND {BLOCK} * j < b AND {BLOCK} * (j + 1) > b - size GROUP BY row)
SELECT doc_id, size, z::BIGINT AS source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE whole * size + coalesce(w, 0) + greatest(0, least(b, head + tail) - greatest(b - size, head)) END)::BIGINT AS taken
FROM e LEFT JOIN fr USING (no, shard) LEFT JOIN hit USING (row)
"""


def op12_source_mixing(spark, sf_dir: str) -> DataFrame:
    """``mix_sources`` of ``documents`` with the weights 5, 2, 1 and a cap of three times."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
