"""J1 attach statistics, M1-M4 normalize, M5 un-normalize on step DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodic.functions import vector as V
from episodic.session import bounded_broadcast

# Stats rows are one per (dataset, field): their number is bounded by the mixture
# configuration, but it is still checked before broadcasting.
MAX_STATS_ROWS = 100_000


def attach_stats(df: DataFrame, stats_struct: DataFrame, key: str | None = None,
                 fields=("action", "proprio")) -> DataFrame:
    """Attach ``<field>_stats`` structs by dataset name.

    ``key`` (the un-normalization key) selects one dataset's stats for every row; it may be
    omitted only when the stats hold exactly one dataset.  A row whose dataset has no stats
    raises.
    """
    wide = stats_struct.groupBy("dataset_name").pivot("field", list(fields)).agg(F.first("stats"))
    stype = stats_struct.schema["stats"].dataType
    for f in fields:
        if f not in wide.columns:
            wide = wide.withColumn(f, F.lit(None).cast(stype))
        wide = wide.withColumnRenamed(f, f + "_stats")
    wide = bounded_broadcast(wide, MAX_STATS_ROWS)
    if key is None and "dataset_name" not in df.columns:
        names = [r[0] for r in wide.select("dataset_name").limit(2).collect()]
        if len(names) != 1:
            raise ValueError("statistics of several datasets: name the one to use")
        key = names[0]
    if key is not None:
        if wide.filter(F.col("dataset_name") == key).limit(1).count() == 0:
            raise ValueError(f"no statistics under the name {key!r}")
        # every row uses the keyed dataset: its stats structs are scalar subqueries (one row)
        one = wide.filter(F.col("dataset_name") == key)
        out = df
        for f in fields:
            out = out.withColumn(f + "_stats", one.select(f + "_stats").scalar())
        return out
    out = df.join(wide, "dataset_name", "left")
    first = fields[0] + "_stats"
    missing = F.raise_error(F.concat(F.lit("no statistics for dataset "), F.col("dataset_name").cast("string")))
    return out.withColumn(first, F.when(F.col(first).isNull(), missing).otherwise(F.col(first)))


def normalize(df: DataFrame, stats_struct: DataFrame, kind: str = "bounds_q99",
              fields=("action", "proprio")) -> DataFrame:
    """M1-M4 on every present field (``proprio`` is optional)."""
    present = [f for f in fields if f in df.columns]
    out = attach_stats(df, stats_struct, fields=tuple(fields))
    for f in present:
        out = out.withColumn(f, V.normalize(f, f + "_stats", kind))
    return out.drop(*[f + "_stats" for f in fields])


def unnormalize(df: DataFrame, stats_struct: DataFrame, col: str = "action", key: str | None = None,
                apply_mask: bool = False) -> DataFrame:
    """M5: map [-1, 1] predictions back with q01/q99 of the keyed dataset."""
    out = attach_stats(df, stats_struct, key=key, fields=("action",))
    return out.withColumn(col, V.unnormalize(col, "action_stats", apply_mask)).drop("action_stats")
