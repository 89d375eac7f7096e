"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training takes a bounded sample of the labelled documents (``sample`` rows, the ones with the
smallest id hashes) in one task; per-coordinate learning rates and the L1 threshold leave a few
thousand non-zero weights, which are broadcast.  Scoring is one pass without a shuffle over all
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodic.llm import kernel as K
from episodic.llm.common import table

BITS = 20
#: Bytes of the stems that longer words add as features.
STEMS = (4, 5, 6)
#: Most labelled documents that training reads.
SAMPLE = 8000


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def _features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, word pair and pair with one word skipped; of longer words
    also their stems, since inflected languages rarely repeat a whole word."""
    s, e, woffs = K.words(buf, offs, K.ALNUM)
    h = K.prefix_hash(K.LOWER[buf])
    t = K.span_hash(h, s, e)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(woffs))
    shift = np.uint64(64 - BITS)
    found = [(doc, K.mix(t ^ np.uint64(0x51)) >> shift)]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        both = doc[:-gap] == doc[gap:]
        found.append((doc[:-gap][both], (K.mix(t[:-gap] * np.uint64(salt) + t[gap:]) >> shift)[both]))
    for stem in STEMS:
        longer = np.flatnonzero(e - s > stem)
        found.append((doc[longer], K.mix(K.span_hash(h, s[longer], s[longer] + stem) ^ np.uint64(0x5E)) >> shift))
    return np.concatenate([d for d, _ in found]), np.concatenate([b for _, b in found]).astype(np.int64)


def _distinct(doc: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, bucket) once: bucket array and offsets by text."""
    u = np.unique((doc << BITS) | bucket)
    return u & ((1 << BITS) - 1), np.searchsorted(u >> BITS, np.arange(n + 1))


def ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 2.0,
         l2: float = 0.1, epochs: int = 6, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal with one learning rate per coordinate; binary features.
    Returns the non-zero buckets, their weights, and the bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    order = np.random.default_rng(seed)

    def weight(zi, ni):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            idx, y = rows[k]
            zi, ni = z[idx], n[idx]
            w = weight(zi, ni)
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] = zi + g - sigma * w
            n[idx] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    w = weight(z, n)
    nz = np.flatnonzero(w)
    return nz, w[nz], float(-zb / ((beta + np.sqrt(nb)) / alpha))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", keep: Column | None = None) -> dict:
    """Weights from at most ``sample`` labelled documents (rows of ``labels`` where ``keep``).

    A document with several labels counts as positive if one of them is.  Null labels and
    labels without a document are left out.  Without any label the model scores every text by
    a prior of one in a hundred.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    picked = picked if keep is None else picked.where(keep)
    picked = picked.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(picked), "_id")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[int, np.ndarray, int]] = []
        for batch in batches:
            buf, offs = K.buffer_of(batch.column("_text"))
            ids, ys = batch.column("_id").to_pylist(), batch.column("_y").to_pylist()
            for i, j in K.slices(offs):
                doc, bucket = _features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                idx, at = _distinct(doc, bucket, j - i)
                examples += [(ids[i + k], idx[at[k] : at[k + 1]].astype(np.int32), ys[i + k]) for k in range(j - i)]
        examples.sort(key=lambda x: x[0])  # the order in which rows arrive does not matter
        nz, w, b = ftrl([(x, y) for _, x, y in examples])
        yield pa.RecordBatch.from_pydict({"bucket": [nz.tolist()], "weight": [w.tolist()], "bias": [b], "n": [len(examples)]}, schema=schema)

    schema = pa.schema([("bucket", pa.list_(pa.int64())), ("weight", pa.list_(pa.float64())), ("bias", pa.float64()), ("n", pa.int64())])
    # at most ``sample`` documents meet in this one task
    got = rows.repartition(1).mapInArrow(fit, "bucket array<bigint>, weight array<double>, bias double, n bigint").collect()
    model = got[0].asDict() if got else {"bucket": [], "weight": [], "bias": 0.0, "n": 0}
    return model if model["n"] else {"bucket": [], "weight": [], "bias": float(-np.log(99.0)), "n": 0}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, score) of every row -- with ``carry`` all columns and the score (a column of that name
    is replaced); null text counts as empty and gets the bias alone.  Repeated rows are scored
    one by one."""
    sc = docs.sparkSession.sparkContext
    weights = sc.broadcast((np.array(model["bucket"], np.int64), np.array(model["weight"], np.float64), model["bias"]))
    kept = [c for c in docs.columns if c != "score"] if carry else [id_col]
    names = [f"_c{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nz, w, bias = weights.value
        dense = np.zeros(1 << BITS)
        dense[nz] = w
        live = dense != 0
        for batch in batches:
            buf, offs = K.buffer_of(batch.column("_text"))
            total = np.full(len(offs) - 1, bias)
            for i, j in K.slices(offs):
                doc, bucket = _features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                hit = live[bucket]
                idx, at = _distinct(doc[hit], bucket[hit], j - i)
                sums = np.concatenate(([0.0], np.cumsum(dense[idx])))
                total[i:j] += sums[at[1:]] - sums[at[:-1]]
            p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            cols = [batch.column("_text" if c == text_col else n) for c, n in zip(kept, names, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p)], names=[*names, "score"])

    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True) if c != text_col], F.col(text_col).cast("string").alias("_text"))
    kinds = ["string" if c == text_col else docs.schema[c].dataType.simpleString() for c in kept]
    out = rows.mapInArrow(run, ", ".join([*[f"{n} {k}" for n, k in zip(names, kinds, strict=True)], "score double"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], "score")


def scored(spark, docs: DataFrame, sf_dir: str, carry: bool = False) -> DataFrame:
    """Scores of ``docs`` by a model from the labels that are not held out and all documents of the folder."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=~held_out())
    return score(docs, model, carry=carry)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return scored(spark, table(spark, sf_dir, "documents"), sf_dir).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
