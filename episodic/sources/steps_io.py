"""Step tables on disk -- one directory per dataset, episodes clustered inside files.

``write_steps`` partitions by ``dataset_name`` (a handful of directories, not one per
episode) and clusters rows by ranges of (dataset, episode, t): a short episode sits in one
file, a long one is as many files as its size asks for, and the files' min/max statistics let an
episode filter skip the others.  ``read_steps`` reads with an explicit schema (no inference),
prunes to the configured columns and, given a dataset, reads only that dataset's directory
(partition pruning).

``save_steps_table`` keeps the steps as a table bucketed by (dataset, episode, block), the key of
all episode windows and joins, so those need no exchange of the steps when they read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodic.operators.episodes import BLK, EPISODE, block_rows

#: Rows of a file at most.
FILE_ROWS = 4_000_000


def write_steps(df: DataFrame, path: str, mode: str = "overwrite", file_rows: int = FILE_ROWS, files: int | None = None) -> None:
    """Ranges of (dataset, episode, t), ``files`` of them (the session's shuffle partitions,
    which AQE merges by size if None), each in files of at most ``file_rows`` rows."""
    key = ["dataset_name", "traj_id", "t"]
    ranges = df.repartitionByRange(*key) if files is None else df.repartitionByRange(files, *key)
    ranges.sortWithinPartitions(*key).write.mode(mode).option("maxRecordsPerFile", file_rows).partitionBy("dataset_name").parquet(path)


def read_steps(spark: SparkSession, path: str, dataset: str | None = None, columns: Sequence[str] | None = None,
               schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    if dataset is not None:
        df = df.filter(F.col("dataset_name") == dataset)
    if columns:
        keep = ["dataset_name", "traj_id", "t", *[c for c in columns if c not in ("dataset_name", "traj_id", "t")]]
        df = df.select(*keep)
    return df


def save_steps_table(df: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Save the steps as ``table`` in ``buckets`` buckets of (dataset, episode, block), sorted by
    step.  A long episode's blocks are in different buckets.  The block size is that of the
    session and is kept as a table property; ``steps_table`` checks it."""
    b = block_rows(df)
    rows = df if BLK in df.columns else df.withColumn(BLK, F.floor(F.col("t") / b).cast("int"))
    # one task and file a bucket
    rows = rows.repartition(buckets, *EPISODE, BLK)
    rows.write.mode(mode).option("episodic.blockRows", str(b)).bucketBy(buckets, *EPISODE, BLK).sortBy(*EPISODE, "t").saveAsTable(table)


def steps_table(spark: SparkSession, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The steps of ``save_steps_table`` with their block; ``with_block`` adds no exchange to them."""
    df = spark.read.table(table)
    stored = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Storage Properties'").first()
    if stored is not None and f"episodic.blockRows={block_rows(df)}" not in stored["data_type"].replace(" ", ""):
        raise ValueError(f"{table} has another block size: {stored['data_type']}")
    return df.select(*EPISODE, BLK, "t", *[c for c in columns if c not in (*EPISODE, BLK, "t")]) if columns else df
