"""Ranked lexical search by length-ordered impact vectors (inner-product search after LEMP).

A score is an inner product: the item's vector has sqrt(w) at each of its terms, a document's
has sqrt(w) * impact, cut to the terms of the items at hand; no other coordinate counts.

1. One scan of the texts gives every document's number of terms and its counts of the items'
   terms; df, N and L are sums over that table.
2. Impacts and lengths are computed, and the vectors are written in falling order of length.
   A bucket is a run of that order (one batch).
3. Rounds go from the longest vectors to the shortest.  Each one starts from the k-th best
   score an item has so far, its threshold:
   * Cauchy-Schwarz on the bucket's greatest length leaves out whole buckets,
   * inside, the item's heaviest coordinates are taken until what is left cannot reach the
     threshold alone; so only documents with one of those are looked at, and their partial
     product plus Cauchy-Schwarz on the rest must reach it as well,
   * survivors are scored again from all terms in 64-bit integers.
   A task keeps k documents for an item, and its threshold rises as it goes.

Items are taken in blocks, bounded by their bytes and number; each block is one search over all
documents.  The driver and the tasks hold one block's terms and thresholds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodic.llm import kernel as K
from episodic.llm.common import table, text_or_empty, written

#: Best documents of an item.
TOP = 10
#: Items, and bytes of their texts, that one search over the documents takes along.
ITEMS, ITEM_BYTES = 1024, 1 << 22
#: Bytes of texts that are split at once; a longer text is split at its separators.
SLICE = 1 << 22
#: Shares of the vectors, longest first, that the rounds go through.
ROUNDS = (1 / 64, 1 / 8)
#: Bounds are computed in doubles and raised by this much.
SAFE = 1 + 1e-9

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str | None) -> set[bytes]:
    """Distinct terms of a text, A-Z lower-cased."""
    return set(_TERM.findall((text or "").encode("utf-8", "surrogatepass").lower()))


def _pieces(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of slices of whole texts; of a long text, parts between separators."""
    for i, j in K.slices(offs, SLICE):
        part = buf[offs[i] : offs[j]]
        at = 0
        while j == i + 1 and len(part) - at > 2 * SLICE:
            cut = at + SLICE
            gap = np.flatnonzero(~K.ALNUM[part[cut : cut + SLICE]])
            if not len(gap):
                break
            cut += int(gap[0])
            yield i, part[at:cut], np.array([0, cut - at])
            at = cut
        yield i, part[at:], np.append(offs[i:j] - offs[i], len(part) - at) if at == 0 else np.array([0, len(part) - at])


def _counted(batch: pa.RecordBatch, vocabulary: pa.Array) -> pa.RecordBatch:
    """Number of terms of every text, and its vocabulary terms with their counts."""
    buf, offs = K.buffer_of(batch.column("_text"))
    size = len(vocabulary)
    total = np.zeros(batch.num_rows, np.int64)
    seen: list[np.ndarray] = [np.zeros(0, np.int64)]
    times: list[np.ndarray] = [np.zeros(0, np.int64)]
    for i, part, o in _pieces(buf, offs):
        start, end, woffs = K.words(part, o, K.ALNUM)
        n = np.diff(woffs)
        total[i : i + len(n)] += n
        inside = K.LOWER[part[K.ALNUM[part]]]
        ends = np.concatenate(([0], np.cumsum(end - start)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(inside)])
        term = pc.index_in(words, value_set=vocabulary)
        hit = term.is_valid().to_numpy(zero_copy_only=False)
        key = np.repeat(np.arange(i, i + len(n)), n)[hit] * size + term.drop_null().to_numpy(zero_copy_only=False)
        key, count = np.unique(key, return_counts=True)
        seen.append(key)
        times.append(count)
    key, tf = np.concatenate(seen), np.concatenate(times)
    if len(key):  # parts of one long text come together
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, tf = key[first], np.add.reduceat(tf, first)
    offsets = np.searchsorted(key, np.arange(batch.num_rows + 1) * size).astype(np.int32)
    out = pa.RecordBatch.from_pydict({
        "_id": batch.column("_id"), "n": pa.array(total),
        "terms": pa.ListArray.from_arrays(pa.array(offsets), pa.array((key % max(size, 1)).astype(np.int32))),
        "tf": pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int64)))})
    return out.filter(pa.array(total > 0))


def _impact(batch: pa.RecordBatch, weight: np.ndarray, big_n: int, big_l: int) -> pa.RecordBatch:
    """Impacts of a document's terms and the length of its vector; documents without any go."""
    n = batch.column("n").to_numpy()
    offs, terms = _lists(batch.column("terms"))
    tf = _lists(batch.column("tf"))[1].astype(np.int64)
    m = np.repeat(10 + (90 * n * big_n) // max(big_l, 1), np.diff(offs))
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
    squares = np.append(weight[terms] * impact.astype(np.float64) ** 2, 0.0)
    length = np.sqrt(np.where(np.diff(offs) > 0, np.add.reduceat(squares, offs[:-1]), 0.0))
    out = pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "length": pa.array(length), "terms": batch.column("terms"),
                                      "impact": pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(impact.astype(np.int32)))})
    return out.filter(pc.greater(out.column("length"), 0.0))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of a list column."""
    offs = column.offsets.to_numpy()
    return (offs - offs[0]).astype(np.int64), column.flatten().to_numpy()


class Search:
    """The items of a block against buckets of documents, with rising thresholds."""

    def __init__(self, items: list[np.ndarray], weight: np.ndarray, threshold: np.ndarray, top: int):
        self.weight, self.threshold, self.top = weight, threshold.astype(np.float64).copy(), top
        # heaviest coordinates first; rest[j]: length of the coordinates from j on
        self.items = [t[np.argsort(-weight[t], kind="stable")] for t in items]
        self.rest = [np.sqrt(np.append(np.cumsum(weight[t][::-1].astype(np.float64))[::-1], 0.0)) for t in self.items]
        self.whole = np.array([r[0] for r in self.rest])
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]

    def bucket(self, ids: np.ndarray, length: np.ndarray, offs: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> None:
        most = float(length.max())
        docs = np.repeat(np.arange(len(ids)), np.diff(offs))
        size = len(self.weight)
        key = docs * size + terms
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, docs, terms, impact = key[order], docs[order], terms[order], impact[order]
        by = np.argsort(terms, kind="stable")
        cut = np.searchsorted(terms[by], np.arange(size + 1))
        at, value = docs[by], impact[by].astype(np.float64)
        for q in np.flatnonzero(self.whole * most * SAFE >= self.threshold):
            mine, rest, least = self.items[q], self.rest[q], self.threshold[q]
            focus = int(np.argmax(rest * most * SAFE < least)) if rest[-1] * most * SAFE < least else len(mine)
            spans = [(cut[t], cut[t + 1], float(self.weight[t])) for t in mine[:focus].tolist() if cut[t] < cut[t + 1]]
            if not spans:
                continue
            which = np.concatenate([at[a:b] for a, b, _ in spans])
            found = np.concatenate([value[a:b] for a, b, _ in spans])
            heavy = np.repeat([w for _, _, w in spans], [b - a for a, b, _ in spans])
            part = np.bincount(which, heavy * found, len(ids))
            used = np.bincount(which, heavy * found * found, len(ids))
            near = part + rest[focus] * np.sqrt(np.maximum(length * length * SAFE - used, 0.0))
            left = np.flatnonzero((part > 0) & (near * SAFE >= least))
            if len(left):
                self._keep(q, ids[left], self._score(left, mine, key, impact, size))

    def _score(self, left: np.ndarray, mine: np.ndarray, key: np.ndarray, impact: np.ndarray, size: int) -> np.ndarray:
        want = left[:, None] * size + mine[None, :]
        place = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where(key[place] == want, impact[place].astype(np.int64) * self.weight[mine][None, :], 0).sum(axis=1)

    def _keep(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate((self.best[q][0], ids)), np.concatenate((self.best[q][1], score))
        order = np.lexsort((ids, -score))
        order = order[score[order] > 0][: self.top]
        self.best[q] = ids[order], score[order]
        if len(order) == self.top:
            self.threshold[q] = max(self.threshold[q], float(score[order[-1]]))


def _searched(vectors: DataFrame, items: list[np.ndarray], weight: np.ndarray, threshold: np.ndarray, top: int) -> DataFrame:
    """(item number, id, score): what each task keeps of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, weight, threshold, top)
        for b in batches:
            if b.num_rows:
                offs, terms = _lists(b.column("terms"))
                ids = b.column("_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                search.bucket(ids, b.column("length").to_numpy(), offs, terms.astype(np.int64), _lists(b.column("impact"))[1])
        for q, (ids, score) in enumerate(search.best):
            if len(ids):
                yield pa.RecordBatch.from_pydict({"_q": pa.array(np.full(len(ids), q, np.int32)), "_id": pa.array(ids, mask=ids == -(1 << 63)), "score": pa.array(score)})

    return vectors.select("_id", "length", "terms", "impact").mapInArrow(run, "_q int, _id bigint, score bigint")


def _best(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.desc("score"), F.col("_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _block(texts: DataFrame, items: list[tuple[int | None, set[bytes]]], top: int) -> DataFrame | None:
    """(_q, _id, score, rank): the best documents of one block of items."""
    words = sorted(set().union(*[t for _, t in items]))
    if not words:
        return None
    vocabulary = pa.array(words, pa.large_binary())
    counted = written(texts.mapInArrow(lambda batches: (_counted(b, vocabulary) for b in batches), "_id bigint, n bigint, terms array<int>, tf array<bigint>"))
    big_n, big_l = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)  # a number for each term of the block
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * big_n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    vectors = counted.mapInArrow(lambda batches: (_impact(b, weight, big_n, big_l) for b in batches if b.num_rows), "_id bigint, length double, terms array<int>, impact array<int>")
    spread = [F.desc("length"), F.xxhash64("_id", "terms")]
    vectors = written(vectors.repartitionByRange(*spread).sortWithinPartitions(*spread))
    number = {w: k for k, w in enumerate(words)}
    mine = [np.array(sorted(k for k in map(number.__getitem__, t) if weight[k] > 0), np.int64) for _, t in items]

    cuts = vectors.agg(F.percentile_approx("length", [1 - r for r in ROUNDS], 1000)).first()[0] or []
    bounds = [math.inf, *sorted(set(cuts), reverse=True), 0.0]
    threshold, best = np.zeros(len(items)), None
    for high, low in zip(bounds, bounds[1:], strict=False):
        some = vectors.where((F.col("length") < F.lit(high)) & (F.col("length") >= F.lit(low)))
        found = _searched(some, mine, weight, threshold, top)
        best = written(_best(found if best is None else best.drop("rank").unionByName(found), top))
        for r in best.groupBy("_q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == top).collect():
            threshold[r["_q"]] = r["least"]  # a number for each item of the block
    return best


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", most_items: int = ITEMS, most_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item, rank, id, score) of the ``top`` best documents of every item, scores above 0 only.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased; null text has none, and documents without terms count nowhere.  Equal scores
    go by ascending id, null first.  Repeated rows are documents of their own.  Rows of one item
    id are one item with the terms of all.  Items without terms, or whose terms no document
    holds, give no rows; neither do empty tables.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).alias("_text"))
    wanted = items.select(F.col(item_col).cast("bigint").alias("_item"), text_or_empty(item_text).alias("_t")).groupBy("_item").agg(F.collect_set("_t").alias("_t"))
    out = spark.createDataFrame([], "_item bigint, rank int, _id bigint, score bigint")

    def search(block: list[tuple[int | None, set[bytes]]]) -> DataFrame:
        best = _block(texts, block, top)
        if best is None:
            return out
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "_q int, _item bigint")
        return out.unionByName(best.join(F.broadcast(names), "_q").select("_item", "rank", "_id", "score"))

    block: list[tuple[int | None, set[bytes]]] = []
    size = 0
    for r in wanted.toLocalIterator():
        block.append((r["_item"], set().union(*[terms_of(t) for t in r["_t"]])))
        size += sum(map(len, block[-1][1]))
        if len(block) >= most_items or size >= most_bytes:
            out, block, size = search(block), [], 0
    if block:
        out = search(block)
    return out.select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """``ranked_search`` of all ``documents`` for every ``benchmark`` item, ten each."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term),
i AS (SELECT c.doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part FROM c JOIN d USING (doc_id) JOIN w USING (term), s),
r AS (
  SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r
QUALIFY rank <= 10
"""
