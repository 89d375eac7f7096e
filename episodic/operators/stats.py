"""A1/A2 dataset statistics.

Per (dataset, field, dim): mean, population std, max, min, q01, q99 (linear
interpolation, as numpy's default), plus per dataset num_transitions / num_trajectories.

Scale design.  A dataset is a hot group (one may hold a third of all rows), so no
statistic may gather a group into one task:
* mean/std/min/max/count are algebraic -> partial (map-side) aggregation.
* Exact quantiles are order statistics found by iterated selection (``selection``): the pass
  that gives the moments also brackets each rank with a mergeable sketch, brackets of huge
  groups are narrowed inside themselves, and one scan collapses everything outside to counts.
  The last window runs over a bounded number of values, however large the group, and a bracket
  that misses its rank is widened, so no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodic.operators import selection
from episodic.session import materialize

QUANTILES = (("q01", 0.01), ("q99", 0.99))
GROUP = ["dataset_name", "field", "dim"]


def long_values(df: DataFrame, fields: Sequence[str] = ("action", "proprio"), key: str = "dataset_name") -> DataFrame:
    """Explode array fields to (dataset_name, field, dim, x).  A missing proprio is
    zeros of the action's shape (as in the reference)."""
    parts = []
    for f in fields:
        src = f if f in df.columns else None
        if src is None and f == "proprio":
            arr = F.transform("action", lambda v: F.lit(0.0))
        elif src is None:
            continue
        else:
            arr = F.col(src)
        parts.append(F.struct(F.lit(f).alias("field"), arr.alias("arr")))
    ex = df.select(F.col(key).alias("dataset_name"), F.explode(F.array(*parts)).alias("fa"))
    ex = ex.select("dataset_name", F.col("fa.field").alias("field"), F.posexplode("fa.arr").alias("dim", "x"))
    return ex.select("dataset_name", "field", F.col("dim").cast("int").alias("dim"), F.col("x").cast("double").alias("x"))


def _pass_a(long: DataFrame, group: Sequence[str], value: str, quantiles, accuracy: int) -> DataFrame:
    """One aggregation: count, moments and the sketch probes bracketing each quantile."""
    d = 2.0 / accuracy
    probes = []
    for _, q in quantiles:
        probes += [max(q - d, 0.0), min(q + d, 1.0), q]
    return long.groupBy(*group).agg(
        F.count(value).alias("_n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
        F.percentile_approx(value, probes, accuracy).alias("_probe"),
    )


def exact_quantiles(
    long: DataFrame, group: Sequence[str], value: str, quantiles=QUANTILES, accuracy: int = 10_000,
    summary: DataFrame | None = None, limit: int = selection.LIMIT,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group without holding a group in memory.

    ``summary`` (pass A) gives n and a first bracket per quantile; the two neighbouring order
    statistics of every quantile are selected from it and interpolated."""
    group = list(group)
    if summary is None:
        summary = materialize(_pass_a(long, group, value, quantiles, accuracy))
    at = [F.lit(q) * (F.col("_n") - 1) for _, q in quantiles]
    ranks = [r for p in at for r in (F.floor(p), F.least(F.floor(p) + 1, F.col("_n") - 1))]
    lo, hi = ([F.col("_probe")[3 * (k // 2) + side] for k in range(len(ranks))] for side in (0, 1))
    state = selection.first_brackets(summary.select(*group, "_n", "_probe"), ranks, lo, hi, F.col("_n") * 4.0 / accuracy)
    got = selection.order_statistics(long.where(F.col(value).isNotNull()), state.drop("_probe"), group, value, len(ranks), limit)

    def between(k: int, p: Column) -> Column:
        low, high, part = F.col("_value")[2 * k], F.col("_value")[2 * k + 1], p - F.floor(p)
        return F.when(part > 0, low + part * (high - low)).otherwise(low)

    return got.select(*group, *[between(k, p).alias(name) for k, ((name, _), p) in enumerate(zip(quantiles, at, strict=True))])


def dataset_stats(
    df: DataFrame,
    fields: Sequence[str] = ("action", "proprio"),
    exact: bool = True,
    accuracy: int = 10_000,
    key: str = "dataset_name",
) -> DataFrame:
    """A1 in long form: (dataset_name, field, dim, mean, std, max, min, q01, q99)."""
    long = long_values(df, fields, key)
    summary = materialize(_pass_a(long, GROUP, "x", QUANTILES, accuracy))
    moments = summary.select(*GROUP, "mean", "std", "max", "min")
    if exact:
        qs = exact_quantiles(long, GROUP, "x", QUANTILES, accuracy, summary=summary)
    else:
        qs = summary.select(*GROUP, *[F.col("_probe")[3 * i + 2].alias(n) for i, (n, _) in enumerate(QUANTILES)])
    return moments.join(qs, GROUP, "left")


def dataset_counts(df: DataFrame, key: str = "dataset_name", traj: str = "traj_id") -> DataFrame:
    """A2: num_transitions and num_trajectories per dataset.

    Distinct trajectories are counted as a two-level aggregation (distinct
    (dataset, traj) pairs first, partial-aggregated), which is what Catalyst plans for
    count(distinct) as well; no group is gathered in one task.
    """
    trans = df.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("num_transitions"))
    trajs = df.select(key, traj).distinct().groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("num_trajectories"))
    return trans.join(trajs, key, "inner").withColumnRenamed(key, "dataset_name")


def stats_struct(stats_long: DataFrame, mask: Sequence[bool] | None = None) -> DataFrame:
    """Pack long stats into one struct of arrays per (dataset_name, field), dims in order.
    ``mask`` (P10) attaches ``action_normalization_mask`` to the action field; without it a
    ``mask`` column of the statistics (a loaded file) is kept."""
    stored = ["mask"] if mask is None and "mask" in stats_long.columns else []
    packed = stats_long.groupBy("dataset_name", "field").agg(
        F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "max", "min", "q01", "q99", *stored))).alias("s")
    )
    fields = ["mean", "std", "max", "min", "q01", "q99"]
    def getter(name):
        return lambda e: e[name]

    cols = [F.transform("s", getter(f)).alias(f) for f in fields]
    if mask is not None:
        m = F.array(*[F.lit(bool(b)) for b in mask])
        check = F.when(F.size("s") == len(mask), m).otherwise(
            F.raise_error(F.lit(f"the normalization mask has {len(mask)} entries, the action another number"))
        )
        mcol = F.when(F.col("field") == "action", check).otherwise(F.lit(None).cast("array<boolean>")).alias("mask")
    elif stored:
        mcol = F.when(F.exists("s", lambda e: e["mask"].isNotNull()), F.transform("s", getter("mask"))).alias("mask")
    else:
        mcol = F.lit(None).cast("array<boolean>").alias("mask")
    return packed.select("dataset_name", "field", F.struct(*cols, mcol).alias("stats"))
