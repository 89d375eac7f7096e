"""Evaluation aggregates: success rates, running success, interval loss, latest checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodic.operators.frames import running_totals

TOTAL = "__total__"


def success_rate(rollouts: DataFrame, by: str = "task") -> DataFrame:
    """Episodes, successes and rate per task plus the overall total (``rollup``)."""
    agg = rollouts.rollup(by).agg(
        F.count(F.lit(1)).cast("bigint").alias("episodes"),
        F.sum(F.col("success").cast("bigint")).alias("successes"),
        F.avg(F.col("success").cast("double")).alias("rate"),
        F.grouping(by).alias("_g"),
    )
    return agg.withColumn(by, F.when(F.col("_g") == 1, F.lit(TOTAL)).otherwise(F.col(by))).drop("_g")


def running_success(rollouts: DataFrame, order: str = "episode", by: str = "task") -> DataFrame:
    """Cumulative episodes / successes / rate in evaluation order, per task and overall."""
    df = rollouts.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_s", F.col("success").cast("bigint"))
    per = running_totals(df, [by], [order], ["_one", "_s"], "_task")
    tot = running_totals(per, [], [order], ["_one", "_s"], "_all")
    return tot.select(
        by, order,
        F.col("_one_task").alias("task_episodes"), F.col("_s_task").alias("task_successes"),
        (F.col("_s_task") / F.col("_one_task")).alias("task_rate"),
        F.col("_one_all").alias("total_episodes"), F.col("_s_all").alias("total_successes"),
        (F.col("_s_all") / F.col("_one_all")).alias("total_rate"),
    )


def interval_loss(metrics: DataFrame, freq: int, step: str = "step", loss: str = "loss") -> DataFrame:
    """At every ``freq``-th step the summed loss since the last checkpoint / ``freq``
    (incomplete trailing intervals are not written, as in the reference)."""
    interval = F.ceil(F.col(step) / freq)
    agg = metrics.groupBy(interval.alias("_i")).agg(F.sum(loss).alias("_sum"), F.max(step).alias("_max"))
    return agg.filter(F.col("_max") >= F.col("_i") * freq).select(
        (F.col("_i") * freq).cast("bigint").alias("steps"), (F.col("_sum") / F.lit(float(freq))).alias("train_loss")
    )


def latest_step(names: DataFrame, name: str = "name", by: str | None = None) -> DataFrame:
    """A10: among names fully matching ``steps_<n>``, the one with the largest n."""
    n = F.regexp_extract(name, r"^steps_(\d+)$", 1)
    ok = names.filter(n != "").withColumn("_n", n.cast("bigint"))
    keys = [by] if by else []
    return ok.groupBy(*keys).agg(F.max_by(name, "_n").alias("latest"), F.max("_n").alias("latest_step"),
                                 F.count(F.lit(1)).cast("bigint").alias("n_checkpoints"))
