"""Sinks: rollout arrays per episode (S8), appended JSON summaries (S9), scratch paths.

Paths default to a fresh folder under the session's shared checkpoint dir (never a
machine-local temp folder on a cluster).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from episodic.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_rollouts(df: DataFrame, path: str, partition_by: str = "task", episode: str = "episode") -> None:
    """Persist per-step arrays of rollouts.

    The reference writes one file per episode; at scale that is millions of tiny files,
    so episodes are clustered instead: directories by a low-cardinality column, rows in ranges
    of (episode, t), so a short episode sits in one file with tight parquet min/max statistics
    (an episode filter prunes row groups) and a long one is several files."""
    key = [partition_by, episode, "t"]
    (df.repartitionByRange(*key).sortWithinPartitions(*key)
       .write.mode("overwrite").partitionBy(partition_by).parquet(path))


def append_summary(df: DataFrame, path: str) -> None:
    """Append one JSON line per checkpoint interval; the files are as many as the tasks of
    ``df`` (AQE merges small ones)."""
    df.write.mode("append").json(path)
