"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

*Signatures.*  Every element (a hash of five consecutive words) owns a region [0, weight) x
[0, infinity) of weights and ranks.  Hashed darts fall into it as a Poisson process of rate one,
generated cell by cell: weights in dyadic intervals, ranks in cells that hold one dart on average.
A dart has a coordinate below ``k``; the signature keeps each coordinate's earliest dart, so two
documents agree in a coordinate with probability of their weighted Jaccard similarity.  A
document of n elements looks at about n + k log k darts instead of n * k hashes.

*Candidates.*  ``rows`` coordinates form a band; documents with an equal band share a bucket.
Exact copies (equal element sets) are merged first.  In each bucket only links to a leader are
tried; each document takes the leader it shares most buckets with.  Links that hold merge
documents to components.  Then the pairs of a bucket that are still in different components are
looked at, in blocks of ``BLOCK`` members: each is tried in the first bucket it shares, unless
its signatures agree in so few coordinates that the wanted similarity is 3.5 standard deviations
away.  This is done twice: the first time only with the likeliest pairs that would link a block's
components, so that few pairs are left for the second.  So each pair of a bucket is compared, linked through others, or excluded by its
signatures; none is dropped for the size of its group.

*Verification* computes the exact similarity from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodic.llm import kernel as K
from episodic.llm.common import parts, table, written
from episodic.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 6  # a pair at 0.8 shares a bucket with probability 0.9998
STARS = 1
#: Members of a bucket that are compared at once.
BLOCK = 512

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: (text, hash, count), sorted by text and hash.

    Words stand between ASCII white space.  A text of fewer words than ``size`` has one shingle,
    all its words; a text without words has none.
    """
    s, e, woffs = K.words(buf, offs, ~K.SPACE)
    t = K.word_hashes(buf, s, e)
    h = K.prefix_hash(t)
    n = np.diff(woffs)
    num = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    text = np.repeat(np.arange(len(n)), num)
    start = woffs[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(num) - num, num)
    end = np.minimum(start + size, woffs[1:][text])
    key = K.span_hash(h, start, end)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))) if len(key) else np.zeros(0, np.int64)
    return text[new], key[new], np.diff(np.append(new, len(key)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_minhash(text: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) signatures of the weighted sets given by text, element key and weight (sorted by
    text); 0 in rows of empty sets."""
    sig = np.zeros((n, k), np.uint64)
    total = np.bincount(text, weights=weight, minlength=n)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[todo] = k * (np.log(k) + 3.0) / total[todo]  # all coordinates are hit with probability 0.95
    while len(todo):
        mine = np.zeros(n, dtype=bool)
        mine[todo] = True
        own = np.flatnonzero(mine[text])
        t, h, w = text[own], key[own], weight[own].astype(np.float64)
        # weight cells [0, 1), [1, 2), [2, 4), ...
        cells = 1 + np.maximum(0, np.ceil(np.log2(np.maximum(w, 1.0)))).astype(np.int64)
        rep = np.repeat(np.arange(len(t)), cells)
        nu = np.arange(len(rep)) - np.repeat(np.cumsum(cells) - cells, cells)
        low = np.where(nu == 0, 0.0, 2.0 ** (nu - 1))
        width = np.where(nu == 0, 1.0, low)
        # rank cells of one dart on average, up to the text's reach
        blocks = np.ceil(reach[t[rep]] * width).astype(np.int64)
        which = np.repeat(np.arange(len(rep)), blocks)
        block = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        x = K.mix(h[rep][which] + (nu[which].astype(np.uint64) << np.uint64(56)) + block.astype(np.uint64) * _GOLD)
        at = np.zeros(len(which))
        darts = []
        while len(which):
            x = K.mix(x + _GOLD)
            at = at - np.log(_unit(x))
            live = at < 1.0
            which, block, x, at = which[live], block[live], x[live], at[live]
            r, y = rep[which], K.mix(x ^ np.uint64(0x94D049BB133111EB))
            rank = (block + at) / width[which]
            inside = (rank < reach[t[r]]) & (low[which] + width[which] * _unit(K.mix(y + _GOLD)) <= w[r])
            darts.append((t[r[inside]] * k + (y[inside] % np.uint64(k)).astype(np.int64), rank[inside], x[inside]))
        slot, rank, dart = (np.concatenate(c) for c in zip(*darts, strict=True))
        order = np.argsort(-rank)
        flat = np.zeros(n * k, np.uint64)
        flat[slot[order]] = dart[order] | np.uint64(1)  # the earliest dart is written last
        flat = flat.reshape(n, k)
        full = todo[(flat[todo] != 0).all(axis=1)]
        sig[full] = flat[full]
        todo = np.setdiff1d(todo, full, assume_unique=True)
        reach[todo] *= 2.0
    return sig


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, counts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, bands, sketch): element count (their total weight with ``counts``), a 128-bit
    digest of the weighted set, a hash of each band, and 16 bits of each coordinate; a text
    without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.buffer_of(batch.column("_text"))
            for i, j in K.slices(offs, 1 << 19):
                text, key, count = shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                weight = count if counts else np.ones(len(key), np.int64)
                sig = dart_minhash(text, key, weight, j - i, bands * rows)
                edge = np.searchsorted(text, np.arange(j - i + 1))
                part = K.mix(key + weight.astype(np.uint64) * _GOLD)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64))) for v in (part, K.mix(part))]
                digest = np.stack([v[edge[1:]] - v[edge[:-1]] for v in sums], axis=1)
                total = np.bincount(text, weights=weight, minlength=j - i).astype(np.int64)
                band = np.zeros((j - i, bands), np.uint64)
                for r in range(rows):
                    band = K.mix(band * _GOLD + sig[:, r::rows])
                band = K.mix(band + np.arange(1, bands + 1, dtype=np.uint64) * _GOLD).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(total > 0, bands, 0)))).astype(np.int32)), pa.array(band[total > 0].reshape(-1)))
                raw, width = digest.tobytes(), 2 * bands * rows
                short = (sig >> np.uint64(40)).astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(total),
                                                  pa.array([raw[16 * q : 16 * q + 16] for q in range(j - i)], pa.binary()), lists,
                                                  pa.array([short[width * q : width * q + width] for q in range(j - i)], pa.binary())], names=["id", "n", "digest", "bands", "sketch"])

    src = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, "id bigint, n bigint, digest binary, bands array<bigint>, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, counts: bool = False) -> DataFrame:
    """The ``pairs`` (a, b) whose texts (id, text) have at least ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                n = len(part)
                sides = []
                for c in ("ta", "tb"):
                    buf, offs = K.buffer_of(part.column(c))
                    found = [(t + i, k, w) for i, j in K.slices(offs) for t, k, w in [shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]]
                    sides.append([np.concatenate(x) for x in zip(*found, strict=True)])
                text = np.concatenate([s[0] for s in sides])
                key = np.concatenate([s[1] for s in sides])
                weight = np.concatenate([s[2] for s in sides]) if counts else np.ones(len(key), np.int64)
                order = np.lexsort((key, text))
                text, key, weight = text[order], key[order], weight[order]
                same = np.flatnonzero((text[1:] == text[:-1]) & (key[1:] == key[:-1]))
                common = np.bincount(text[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=n)
                union = np.bincount(text, weights=weight, minlength=n) - common
                good = common >= similarity * union - 1e-9
                yield part.select(["a", "b"]).filter(pa.array(good & (union > 0)))

    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with ``_key``: the id, or, where rows of one id have different texts, a hash of id
    and text; and whether there are such ids."""
    mine = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    several = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_of")).agg(F.min(mine).alias("lo"), F.max(mine).alias("hi"))
    several = written(several.where("lo <> hi").select("_of"))
    if several.isEmpty():
        return docs.withColumn("_key", F.col(id_col).cast("bigint")), False
    both = docs.join(several, F.col(id_col).cast("bigint") == F.col("_of"), "left")
    key = F.when(F.col("_of").isNull(), F.col(id_col).cast("bigint")).otherwise(F.xxhash64(F.col("_of"), mine))
    return both.withColumn("_key", key).drop("_of"), True


def _kept(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """``docs`` with ``_component``, the smallest id of the row's class, and ``_stays``: is the row
    the one of its class with that id?"""
    keyed, several = _keyed(docs, id_col, text_col)
    found = written(_linked(keyed.where("_key IS NOT NULL").select(F.col("_key").alias("id"), F.col(text_col).alias("text")), **how).distinct())
    if several:  # keys are no ids: the member with the smallest id stands for its class
        ids = keyed.where("_key IS NOT NULL").select(F.col("_key").alias("id"), F.col(id_col).cast("bigint").alias("own")).distinct().join(found, "id")
        first = ids.groupBy("component_id").agg(F.min(F.struct("own", "id")).alias("f"))
        found = ids.join(first, "component_id").select("id", F.col("f.own").alias("component_id"), (F.col("id") == F.col("f.id")).alias("_stays"))
    else:
        found = found.withColumn("_stays", F.col("id") == F.col("component_id"))
    found = found.select(F.col("id").alias("_key"), F.col("component_id").alias("_component"), "_stays")
    return keyed.join(found, "_key", "left").drop("_key").withColumn("_stays", F.coalesce("_stays", F.lit(True)))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, stars: int = STARS,
                    counts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id, kept) of every row: the smallest id that links of at least
    ``similarity`` reach, and whether the row is the one that stays.  With ``counts`` shingles weigh
    as often as they occur, else once.

    Null text counts as empty; texts without words are linked with nothing.  Repeated rows are
    marked alike.  Rows of one id with different texts are documents of their own, each in the
    class of its text; of a class whose smallest id has several, one stays.  Rows with a null id
    are their own class (component_id null) and stay.  Other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    done = _kept(own, "id", "text", similarity=similarity, bands=bands, rows=rows, stars=stars, counts=counts)
    return done.select("id", F.coalesce("_component", "id").alias("component_id"), F.col("_stays").alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, one text of each class, with all columns; see
    ``near_duplicates``."""
    names = [f"_c{k}" for k in range(len(docs.columns))]  # columns may be called anything
    at = dict(zip(docs.columns, names, strict=True))
    done = _kept(docs.toDF(*names), at[id_col], at[text_col], **how).where("_stays")
    return done.select(*[F.col(n).alias(c) for c, n in at.items()])


def _linked(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, stars: int = STARS,
            counts: bool = False, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row; rows that share an id have one text."""
    src = docs.where(F.col(id_col).isNotNull())
    sig = written(signatures(src, bands, rows, counts, id_col, text_col))
    # documents with equal element sets: the smallest id stands for all
    classes = sig.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"))
    member = written(sig.where("n > 0").select("id", "digest").join(classes, "digest").select("id", "rep"))
    reps = sig.where("n > 0").join(member.where("id = rep").select("id").distinct(), "id").dropDuplicates(["id"])
    exploded = reps.select("id", "n", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band")
    buckets = written(exploded.join(shared, "band"))
    involved = buckets.select("id").distinct()
    texts = written(src.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
                    .join(involved, "id").dropDuplicates(["id"]))

    close = F.least("n", "m") >= similarity * F.greatest("n", "m")
    links = tried = None
    for star in range(stars):
        now = _with_component(buckets, links)
        order = F.struct(F.xxhash64("id", F.lit(star)).alias("p"), F.col("id").alias("leader"), F.col("c").alias("lc"), F.col("n").alias("m"))
        leaders = now.groupBy("band").agg(F.min(order).alias("l"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band", "l.*")
        pairs = now.join(leaders, "band").where((F.col("c") != F.col("lc")) & close).groupBy("id", "leader").agg(F.count(F.lit(1)).alias("k"))
        if tried is not None:
            pairs = pairs.join(tried.select(F.col("a").alias("id"), F.col("b").alias("leader")), ["id", "leader"], "left_anti")
        best = pairs.groupBy("id").agg(F.max(F.struct("k", "leader")).alias("l")).select(F.col("id").alias("a"), F.col("l.leader").alias("b"))
        best = written(best)
        tried = best if tried is None else tried.unionByName(best)
        found = written(verified(best, texts, similarity, counts))
        links = found if links is None else links.unionByName(found)
    # then the pairs of a bucket that are not linked yet: first the likeliest that would link
    # each block's components, then all that are still between components, compared in place
    for last in (False, True):
        now = written(_with_component(buckets, links))
        open_ = now.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("band", "size")
        pairs = _likely_pairs(now.join(open_, "band"), sig, similarity, bands * rows, texts if last else None, counts).distinct()
        if last:
            found = written(pairs)
        else:
            pairs = written(pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")) if tried is not None else written(pairs)
            found = written(verified(pairs, texts, similarity, counts))
        links = found if links is None else links.unionByName(found)

    comp = components(links).withColumnRenamed("id", "rep")
    rep = member.select("id", "rep").distinct().join(comp, "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"))
    return ids.join(rep, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))


def _with_component(buckets: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return buckets.withColumn("c", F.col("id"))
    comp = components(links)
    return buckets.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs that link components not yet linked by those before them."""
    head: dict[int, int] = {}

    def find(x: int) -> int:
        while head.setdefault(x, x) != x:
            head[x] = x = head[head[x]]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            head[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


class _Shingled:
    """Sorted shingles of a few texts, by row; ``similar`` compares pairs of rows exactly."""

    def __init__(self, column: pa.ChunkedArray, counts: bool):
        buf, offs = K.buffer_of(column)
        found = [(t + i, k, w) for i, j in K.slices(offs) for t, k, w in [shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]]
        text, self.key, weight = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(text, kind="stable")
        text, self.key = text[order], self.key[order]
        self.weight = weight[order] if counts else np.ones(len(text), np.int64)
        self.at = np.searchsorted(text, np.arange(len(offs)))
        self.total = np.diff(np.concatenate(([0], np.cumsum(self.weight)))[self.at])

    def similar(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        good = np.zeros(len(a), dtype=bool)
        size = np.diff(self.at)
        for i in range(0, len(a), 128):
            both = np.concatenate((a[i : i + 128], b[i : i + 128]))
            half, n = len(both) // 2, size[both]
            pair = np.repeat(np.tile(np.arange(half), 2), n)
            take = np.repeat(self.at[both] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            key, weight = self.key[take], self.weight[take]
            order = np.lexsort((key, pair))
            pair, key, weight = pair[order], key[order], weight[order]
            same = np.flatnonzero((pair[1:] == pair[:-1]) & (key[1:] == key[:-1]))
            common = np.bincount(pair[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=half)
            union = self.total[both[:half]] + self.total[both[half:]] - common
            good[i : i + 128] = (common >= similarity * union - 1e-9) & (union > 0)
        return good


def _likely_pairs(rows: DataFrame, sig: DataFrame, similarity: float, k: int, texts: DataFrame | None = None, counts: bool = False) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that may have ``similarity``: of each two
    blocks the likeliest that together link the same components.  With ``texts`` every such pair
    is compared where its blocks meet, and only those that link components come out, so no row
    is made of a pair that is no link.  ``rows`` are bucket members (band, id, n, c, size).

    A bucket's members are dealt to blocks of about ``BLOCK``; every two blocks of a bucket, and
    each block with itself, meet somewhere: two large ones by themselves, small buckets together.
    """
    groups = 4 * parts(rows.sparkSession)
    least = similarity - 3.5 * (similarity * (1 - similarity) / k) ** 0.5
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id", "band"), blocks).cast("int")
    meet = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    rows = rows.withColumn("mine", mine).select("band", "id", "n", "c", "size", "mine", F.explode(meet).alias("at"))
    involved = rows.select("id").distinct()
    rows = rows.join(sig.join(involved, "id").dropDuplicates(["id"]).select("id", "bands", "sketch"), "id")
    cell = F.xxhash64("band", "at.i", "at.j")
    g = F.when(F.col("size") > 64, cell).otherwise(F.pmod(cell, F.lit(groups)))
    rows = rows.select(g.alias("g"), "band", "at.i", "at.j", "mine", "id", "n", "c", "bands", "sketch")
    compared = texts is not None
    if compared:
        rows = rows.join(texts, "id")

    def compare(t: pa.Table) -> pa.Table:
        band, i, j, mine, ids, n, c = (t.column(x).to_numpy() for x in ("band", "i", "j", "mine", "id", "n", "c"))
        every = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(t.num_rows, -1)
        order = np.lexsort((ids, j, i, band))
        key = np.stack((band, i, j))[:, order]
        cut = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [t.num_rows]))
        left, right = [], []
        if compared:
            _, one, row = np.unique(ids, return_index=True, return_inverse=True)
            exact = _Shingled(t.column("text").take(pa.array(one)), counts)
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            m = order[x:y]
            if i[m[0]] == j[m[0]]:
                p, q = np.triu_indices(len(m), 1)
                p, q = m[p], m[q]
            else:
                p, q = m[mine[m] == i[m[0]]], m[mine[m] == j[m[0]]]
                p, q = np.repeat(p, len(q)), np.tile(q, len(p))
            fits = (c[p] != c[q]) & (np.minimum(n[p], n[q]) >= similarity * np.maximum(n[p], n[q]))
            p, q = p[fits], q[fits]
            found = []
            for at in range(0, len(p), 20_000):
                a, b = p[at : at + 20_000], q[at : at + 20_000]
                agree = (sketch[a] == sketch[b]).mean(axis=1)
                good = agree >= least
                a, b, agree = a[good], b[good], agree[good]
                first = np.take_along_axis(every[a], np.argmax(every[a] == every[b], axis=1)[:, None], axis=1)[:, 0] if len(a) else a
                mine_too = first == band[m[0]]
                found.append((a[mine_too], b[mine_too], agree[mine_too]))
            a, b, agree = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (p, q, p)
            if compared:
                good = exact.similar(row[a], row[b], similarity)
                a, b, agree = a[good], b[good], agree[good]
            if len(a) > 1:
                best = np.argsort(-agree, kind="stable")
                best = best[_forest(c[a[best]], c[b[best]])]
                a, b = a[best], b[best]
            left.append(ids[a])
            right.append(ids[b])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("g").applyInArrow(compare, "a bigint, b bigint")


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "component_id", "kept")
