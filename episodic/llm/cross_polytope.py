"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

A hash rotates the vector by three rounds of random signs and a fast Hadamard transform and takes
the signed axis with the largest coordinate.  ``HASHES`` of them name a bucket; each of ``TABLES``
tables files every vector once and looks it up once plus in the ``PROBES`` buckets that follow
when one hash takes its second largest axis (closest calls first).  Candidate pairs are compared
exactly, in double precision.

Equal vectors are merged before hashing and stand as one with a multiplicity, so a vector that a
third of all rows share costs one bucket entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodic.llm import kernel as K
from episodic.llm.common import table, written
from episodic.llm.components import components

COSINE = 0.9
TABLES, HASHES, PROBES = 16, 3, 3  # finds 0.998 of the pairs at a cosine of exactly 0.9 in 64 dimensions


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d)


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """(n, tables, 1 + probes) bucket keys of the unit rows of ``x``; the first is the own one."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - d)))
    rng = np.random.default_rng([seed, d])
    rows = np.arange(n)
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        first, second, cost = (np.zeros((n, hashes), k) for k in (np.int64, np.int64, np.float64))
        for j in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size)) / np.sqrt(size)
            a = np.abs(y)
            two = np.argpartition(-a, 1, axis=1)[:, :2]
            top = a[rows[:, None], two]
            swap = top[:, 1] > top[:, 0]
            two[swap], top[swap] = two[swap][:, ::-1], top[swap][:, ::-1]
            axis = 2 * two + (y[rows[:, None], two] < 0)
            first[:, j], second[:, j], cost[:, j] = axis[:, 0], axis[:, 1], top[:, 0] - top[:, 1]
        # probes: subsets of hashes that take their second axis, cheapest sum of gaps first
        sets = np.array([[(m >> j) & 1 for j in range(hashes)] for m in range(1 << hashes)], dtype=bool)
        order = np.argsort(cost @ sets.T, axis=1, kind="stable")[:, : 1 + probes]
        for p in range(order.shape[1]):
            codes = np.where(sets[order[:, p]], second, first)
            key = np.full(n, t + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d)
            for j in range(hashes):
                key = K.mix(key * np.uint64(0xD6E8FEB86659FD93) + codes[:, j].astype(np.uint64) + np.uint64(1))
            out[:, t, p] = key
    return out


def _matrix(col: pa.Array) -> np.ndarray:
    raw = b"".join(v.as_py() for v in col)
    return np.frombuffer(raw, "<f8").reshape(len(col), -1)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
    vectors of different length neither.  Equal vectors link with each other; repeated rows count
    one by one.  A null id takes part like any other id smaller than all.  Other columns are not
    read.
    """
    ids = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.col(id_col).isNull().alias("null_id"),
                         F.col(vector_col).cast("array<double>").alias("v"))
    # by component, as sums of squares leave the range of doubles
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0.0)
    good = ids.where(ok).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    # salted, then merged: one row for each distinct vector
    salted = good.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = written(salted.groupBy("v").agg(F.min("rep").alias("rep"), F.sum("n").alias("n")))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            for i in range(0, len(batch), 2048):
                part = lists.slice(i, 2048)
                rep = batch.column("rep").slice(i, 2048).to_numpy()
                size = part.value_lengths().to_numpy()
                flat, at = part.flatten().to_numpy(), np.concatenate(([0], np.cumsum(size)))
                for d in np.unique(size).tolist():
                    mine = np.flatnonzero(size == d)
                    x = flat[at[mine][:, None] + np.arange(d)]
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    key = buckets(x, tables, hashes, probes).view(np.int64)
                    n, t, p = key.shape
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep[mine], t * p)), pa.array(key.reshape(-1)),
                                                      pa.array(np.tile(np.arange(p) == 0, n * t))], names=["id", "bucket", "own"])

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([np.asarray(v.as_py(), "<f8").tobytes() for v in batch.column("v")], pa.binary())], names=["id", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                size = np.array([len(v.as_py()) for v in part.column("va")])
                for d in np.unique(size).tolist():
                    one = part.take(pa.array(np.flatnonzero(size == d)))
                    a, b = (_matrix(one.column(c)) for c in ("va", "vb"))
                    a, b = (m / np.abs(m).max(axis=1, keepdims=True) for m in (a, b))
                    cos = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
                    yield one.select(["a", "b"]).filter(pa.array(cos >= cosine))

    filed = written(classes.select("rep", "v").mapInArrow(file, "id bigint, bucket bigint, own boolean"))
    # buckets that only look-ups or one vector reach give no pair
    owners = filed.where("own").select(F.col("id").alias("other"), "bucket")
    met = filed.join(owners, "bucket").where((F.col("id") < F.col("other")) | (~F.col("own") & (F.col("id") != F.col("other"))))
    pairs = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    unit_rows = written(classes.select("rep", "v").mapInArrow(unit, "id bigint, v binary"))
    both = pairs.join(unit_rows.select(F.col("id").alias("a"), F.col("v").alias("va")), "a") \
        .join(unit_rows.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b").where(F.length("va") == F.length("vb"))
    links = written(both.select("a", "b", "va", "vb").mapInArrow(compare, "a bigint, b bigint"))
    size = classes.select(F.col("rep").alias("id"), "n")
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("id")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("id")))
    partners = ends.join(size, "id").groupBy("rep").agg(F.sum("n").alias("linked"))
    comp = components(links).withColumnRenamed("id", "rep")
    found = classes.select("v", "rep", "n").join(partners, "rep", "left").join(comp, "rep", "left").select(
        "v", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.select("id", "null_id", "v").join(found, "v").select("id", "null_id", "n_links", "component_id")
    alone = ids.where(~F.coalesce(ok, F.lit(False))).select("id", "null_id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.when(~F.col("null_id"), F.col("id")).alias("id"), "n_links", "component_id")


def op9_cross_polytope_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
