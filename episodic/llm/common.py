"""Shared helpers of the text operators: tables, lineage cuts and column defaults."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodic.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` under the session's shared checkpoint folder and read it back: one pass,
    no lineage, and it outlives any executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:16]}"
    (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session; shard and salt counts follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the rank of each row in ``order``, from 0: ranges of the order are written and
    counted, and a row's rank is that of its range plus its place there.  Ties need an order
    that tells rows apart where the rank matters."""
    cut = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))  # at most one row a partition
    before = counts.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return cut.withColumn(name, place.cast("bigint") - 1).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
