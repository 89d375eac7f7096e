"""Session helpers: building a local session for tests and reading cluster settings.

On a cluster the session is created by the platform; we only *read* its settings
(checkpoint dir, shuffle partitions).  A checkpoint dir is set here only when the
session has none, which is the local/test case.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins/aggregations at runtime
# (coalescing small partitions, splitting skewed join partitions).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "episodic") -> SparkSession:
    """Local session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("EPISODIC_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only when
    neither is set -- local tests -- a scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="episodic-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table in the session's shared checkpoint
    folder and reading it back.

    One pass (an RDD checkpoint computes its input twice unless cached), survives executor
    loss (unlike a local checkpoint), and gives Spark exact size statistics for later
    join planning."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex[:16]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Rows and bytes (as JSON text) up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, materialized: bool = False, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after checking its rows and bytes; otherwise leave the join to Spark.

    ``df`` is materialized first (unless the caller already did), so one cheap scan measures it
    and the data is not recomputed per consumer.
    """
    from pyspark.sql import functions as F

    m = df if materialized else materialize(df)
    rows, size = m.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in m.columns])))), F.lit(0))).first()
    return F.broadcast(m) if rows <= max_rows and size <= max_bytes else m
