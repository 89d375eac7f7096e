"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The fit list holds every distinct vector once, as integers, in a written table.  X is its matrix
with the mean taken off, row by row, in exact integers before the one division.  The process
builds orthonormal right vectors v_j, left vectors u_j and an upper bidiagonal matrix B with
X V = U B:

    alpha_j u_j = X v_j - beta_{j-1} u_{j-1},      beta_j v_{j+1} = X' u_j - alpha_j v_j

A left vector has one entry a row, so it is never gathered: it is X w_j for a short vector w_j,
which is all the driver keeps of it.  One pass over the rows computes X w for the next w, its
products with all earlier left vectors, and X' of it: d + j sums a partition.  Both sides are
reorthogonalised against all earlier vectors, twice.  Where a beta vanishes (equal singular
values, or the rank is reached) the process goes on from a new vector orthogonal to the rest.
The singular value decomposition of B gives components and deviations; the process ends when the
wanted ones stand still, or with the dimension.

The driver holds short vectors only (dimension x steps).  A pass is a map over the written table
with sums in the order of its partitions, so a lost executor costs a recomputation and reruns
agree to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodic.llm.common import table, written

#: Components of the query.
COMPONENTS = 16
#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this are set to it.
LARGEST = 1 << 52
#: A component whose deviation is below this part of the largest counts as none.
TINY = 1e-10
#: Change of the wanted values, relative to the largest, at which the process ends.
STILL = 1e-15


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite entries; null is False."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def integers(vector: Column) -> Column:
    """Entries as integers: floor(64 * entry) + 1000000."""
    return F.transform(vector.cast("array<double>"), lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)) + SHIFT)


def rows_of(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, _x): the rows with a finite vector of the most frequent length (ties: the longest)."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).where(finite(F.col("_v")))
    rows = written(rows.select("_id", integers(F.col("_v")).alias("_x")))
    sizes = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("_x") == (sizes["d"] if sizes else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


class Fit:
    """Passes over the fit list: exact sums, and sums over rows of functions of centred rows."""

    def __init__(self, rows: DataFrame):
        distinct = written(rows.select("_x").distinct())
        first = distinct.first()
        self.d = d = len(first["_x"]) if first else 0
        got = distinct.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]).first()
        self.n = n = got["n"]
        self.sums = sums = [int(got[f"s{i}"]) for i in range(d)] if n else []

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    c = np.ascontiguousarray(centred(_matrix(b.column(0), d), n, sums))
                    offs = np.arange(b.num_rows + 1, dtype=np.int64) * 8 * d
                    yield pa.RecordBatch.from_pydict({"c": pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offs), pa.py_buffer(c)]).cast(pa.binary())})

        # a centred row is the bytes of its d doubles: the passes read them as they are
        self.rows = written(distinct.mapInArrow(pack, "c binary")) if d and n > 1 else None

    def total(self, of, size: int) -> np.ndarray:
        """Sum over all rows of ``of(centred block)``, an array of ``size`` numbers."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    col = b.column(0)
                    out += of(np.frombuffer(col.buffers()[2], "<f8", b.num_rows * d, col.offset * 8 * d).reshape(b.num_rows, d))
            yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId()], pa.int32()), "s": pa.array([out.tolist()], pa.list_(pa.float64()))})

        got = sorted((r["p"], r["s"]) for r in self.rows.mapInArrow(run, "p int, s array<double>").collect())
        return np.array([fsum(x) for x in zip(*[s for _, s in got], strict=True)]) if got else np.zeros(size)


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in exact integers: 64-bit where they fit, else Python's."""
    if len(x) and n * int(np.abs(x).max()) + max(abs(s) for s in sums) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * np.int64(n) - np.array([int(s) for s in sums], np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return scaled(x, n, sums).astype(np.float64) / n


def bidiagonalise(fit: Fit, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(deviations, components by column) of the ``wanted`` largest singular values of the centred
    rows, as far as they are not zero."""
    d = fit.d
    rng = np.random.default_rng(seed)

    def orthogonal(x: np.ndarray, to: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - to @ (to.T @ x)
        return x

    def fresh(to: np.ndarray) -> np.ndarray:
        x = orthogonal(rng.standard_normal(d), to)
        x = orthogonal(x / np.linalg.norm(x), to)
        return x / np.linalg.norm(x)

    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v_j, w_j and X'u_j as columns
    alphas: list[float] = []
    betas: list[float] = []
    v, before, size = fresh(right), None, 0.0
    for step in range(d):
        right = np.column_stack((right, v))
        w = v if step == 0 else v - betas[-1] * left[:, -1]

        def products(x: np.ndarray, left=left, w=w) -> np.ndarray:
            u = x @ w
            return np.concatenate(([u @ u], (x @ left).T @ u, x.T @ u))

        def reorthogonalised(w: np.ndarray, left=left, back=back):
            got = fit.total(lambda x: products(x, left, w), 1 + left.shape[1] + d)
            square, cross, xu = got[0], got[1 : 1 + left.shape[1]], got[1 + left.shape[1] :]
            return w - left @ cross, max(square - cross @ cross, 0.0), xu - back @ cross, np.abs(cross).max(initial=0.0), square

        new, square, xu, loss, whole = reorthogonalised(w)
        if square < 0.25 * whole or loss > 1e-8 * np.sqrt(max(whole, 1e-300)):  # much was taken off: once more
            new, square, xu, *_ = reorthogonalised(new)
        alpha = float(np.sqrt(square))
        size = max(size, alpha, *betas[-1:])
        if alpha <= TINY * 1e-3 * size or alpha == 0.0:  # v_j adds nothing to the range of X: a zero row of B
            alpha, new, xu = 0.0, np.zeros(d), np.zeros(d)
        else:
            new, xu = new / alpha, xu / alpha
        left, back = np.column_stack((left, new)), np.column_stack((back, xu))
        alphas.append(alpha)
        if step == d - 1:
            break
        rest = orthogonal(xu - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        if beta <= TINY * 1e-3 * size or beta == 0.0:
            beta, v = 0.0, fresh(right)
        else:
            v = orthogonal(rest / beta, right)
            v /= np.linalg.norm(v)
        if step >= 2 * wanted and step % 4 == 0:
            s = np.linalg.svd(_bidiagonal(alphas, betas), compute_uv=False)[:wanted]
            now = _residuals(alphas, betas, beta, wanted)
            if before is not None and np.abs(s - before).max() <= STILL * s[0] and now <= 1e-14 * s[0]:
                break
            before = s
        betas.append(beta)
    _, s, vt = np.linalg.svd(_bidiagonal(alphas, betas[: len(alphas) - 1]))
    keep = s[:wanted] > TINY * s[0] if len(s) and s[0] > 0 else np.zeros(min(wanted, len(s)), bool)
    found = (right @ vt.T)[:, :wanted][:, keep]
    found *= np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return s[:wanted][keep], found


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + (np.diag(betas[: len(alphas) - 1], 1) if len(alphas) > 1 else 0.0)


def _residuals(alphas: list[float], betas: list[float], beta: float, wanted: int) -> float:
    """Largest part of the wanted vectors that the next step could still move."""
    u, _, _ = np.linalg.svd(_bidiagonal(alphas, betas))
    return float(beta * np.abs(u[-1, :wanted]).max())


def whitened(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each kept row and component: id, component (from 1, by falling eigenvalue), n,
    deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are left out, and so are those
    of another length than the most frequent one (ties: the longest).  Entries become
    floor(64 * entry) + 1000000, beyond +-2^52 that bound; every distinct vector counts once in
    sums and covariance (divisor n), so copies do not.  ``deviation`` is the sum over dimensions
    of (n * x - S)^2, exact; null where it exceeds 64 bits.  ``whitened`` is the centred row on
    the component over its deviation; ``identity_error`` one number, the largest entry of the
    whitened fit list's covariance less the identity.  Components without deviation do not
    appear: a table of equal vectors, of one, or none gives no rows.  Of equal eigenvalues any
    orthonormal components may come, the same for all rows; the largest entry of a component is
    positive.  Repeated rows and null ids each keep their rows.  Other columns are not read.
    """
    spark: SparkSession = df.sparkSession
    rows = rows_of(df, id_col, vec_col)
    fit = Fit(rows)
    sigma, basis = bidiagonalise(fit, min(components, fit.d)) if fit.d and fit.n > 1 else (np.zeros(0), np.zeros((fit.d, 0)))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not len(sigma):
        return spark.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    k, n, sums, d = len(sigma), fit.n, fit.sums, fit.d
    turn = basis / (sigma / np.sqrt(n))
    got = fit.total(lambda x: np.concatenate(([np.einsum("ij,ij->", x, x)], (x @ turn).sum(axis=0), ((x @ turn).T @ (x @ turn)).ravel())), 1 + k + k * k)
    explained = (sigma**2 / got[0]).tolist()
    mean = got[1 : 1 + k] / n
    error = float(np.abs(got[1 + k :].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("_x"), d)
            exact = scaled(x, n, sums)
            if exact.dtype == object or len(exact) and float(np.abs(exact).max()) ** 2 * d >= 2.0**62:
                wide = [int(v) for v in (exact.astype(object) ** 2).sum(axis=1)]
                deviation = pa.array([v if v < 1 << 63 else None for v in wide], pa.int64())
            else:
                deviation = pa.array((exact * exact).sum(axis=1), pa.int64())
            out = (exact.astype(np.float64) / n) @ turn
            again = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_pydict({
                "_id": b.column("_id").take(pa.array(again)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                "n": pa.array(np.full(len(again), n)), "deviation": deviation.take(pa.array(again)), "whitened": pa.array(out.ravel()),
                "explained": pa.array(explained * b.num_rows), "identity_error": pa.array(np.full(len(again), error))})

    return rows.mapInArrow(project, schema).withColumnRenamed("_id", id_col)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """``whitened`` of ``embeddings``: up to 16 components of every row."""
    return whitened(table(spark, sf_dir, "embeddings"))
