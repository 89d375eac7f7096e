"""Statistics persistence: save (S5), load (S4), content-hash cache (S6), synthetic steps.

On disk a statistics file holds one JSON object per dataset:
``{"dataset_name", "action": {mean,std,max,min,q01,q99[,mask]}, "proprio": {...},
"num_transitions", "num_trajectories"}``.  ``load_stats`` also reads the reference's
single-object layout ``{dataset: {...}}`` (one multi-line JSON document).
"""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodic.functions.rand import u01
from episodic.operators.stats import dataset_counts, dataset_stats
from episodic.session import materialize

STAT_FIELDS = ["mean", "std", "max", "min", "q01", "q99"]
FIELD_TYPE = "struct<mean:array<double>,std:array<double>,max:array<double>,min:array<double>,q01:array<double>,q99:array<double>,mask:array<boolean>>"
ENTRY_TYPE = f"struct<action:{FIELD_TYPE},proprio:{FIELD_TYPE},num_transitions:bigint,num_trajectories:bigint>"


def stats_document(stats_long: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per dataset with nested per-field arrays (dims in order); a ``mask`` column of the
    statistics becomes the fields' mask (a field without one has none)."""
    names = [*STAT_FIELDS, *(["mask"] if "mask" in stats_long.columns else [])]
    packed = stats_long.groupBy("dataset_name", "field").agg(
        F.array_sort(F.collect_list(F.struct("dim", *names))).alias("s")
    )

    def getter(name):
        return lambda e: e[name]

    packed = packed.select("dataset_name", "field", F.struct(
        *[F.transform("s", getter(f)).alias(f) for f in STAT_FIELDS],
        *[F.when(F.exists("s", lambda e: e["mask"].isNotNull()), F.transform("s", getter("mask"))).alias("mask") for _ in names[len(STAT_FIELDS):]]).alias("v"))
    wide = packed.groupBy("dataset_name").pivot("field", ["action", "proprio"]).agg(F.first("v"))
    return wide.join(counts, "dataset_name", "left")


def save_stats(stats_long: DataFrame, counts: DataFrame, path: str) -> None:
    """Write the statistics document, one row per dataset with statistics, mask and counts."""
    stats_document(stats_long, counts).write.mode("overwrite").json(path)


def _explode_doc(doc: DataFrame) -> DataFrame:
    parts = []
    for fld in ("action", "proprio"):
        z = F.arrays_zip(*[F.col(f"{fld}.{s}").alias(s) for s in STAT_FIELDS], F.col(f"{fld}.mask").alias("mask"))
        # a field without mask still has its dimensions
        bare = F.arrays_zip(*[F.col(f"{fld}.{s}").alias(s) for s in STAT_FIELDS], F.transform(F.col(f"{fld}.mean"), lambda v: F.lit(None).cast("boolean")).alias("mask"))
        parts.append(F.struct(F.lit(fld).alias("field"), F.coalesce(z, bare).alias("z")))
    counts = ["num_transitions", "num_trajectories"]
    ex = doc.select("dataset_name", *counts, F.explode(F.array(*parts)).alias("p")).filter(F.col("p.z").isNotNull())
    ex = ex.select("dataset_name", *counts, F.col("p.field").alias("field"), F.posexplode("p.z").alias("dim", "e"))
    return ex.select("dataset_name", "field", F.col("dim").cast("int").alias("dim"), *[F.col("e." + s).alias(s) for s in STAT_FIELDS], F.col("e.mask").alias("mask"), *counts)


def load_stats(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Statistics in long form from either layout (``lines`` = ours, ``object`` = a
    single ``{dataset: {...}}`` document), with the mask of each dimension (null where the file
    has none) and the dataset's counts."""
    if layout == "object":
        txt = spark.read.text(path, wholetext=True)
        m = txt.select(F.from_json("value", f"map<string,{ENTRY_TYPE}>").alias("m"))
        doc = m.select(F.explode("m").alias("dataset_name", "e")).select("dataset_name", "e.*")
    else:
        doc = spark.read.schema(f"dataset_name string, action {FIELD_TYPE}, proprio {FIELD_TYPE}, "
                                "num_transitions bigint, num_trajectories bigint").json(path)
    return _explode_doc(doc)


def stats_key(*deps: str) -> str:
    """Cache key: SHA-256 of the concatenated dependency strings (configuration text)."""
    return hashlib.sha256("".join(deps).encode("utf-8")).hexdigest()


def _committed(spark: SparkSession, path: str) -> str | None:
    """Folder of the statistics that are committed under ``path``; of several the least name."""
    try:
        names = spark.read.schema("data string").json(f"{path}/commit").agg(F.min("data")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return names and f"{path}/{names}"


def _store(stats_long: DataFrame, counts: DataFrame, path: str) -> str:
    """Write the statistics into a folder of their own, then one row that names it: a reader sees
    all of it or nothing, and writers that work at the same time leave one result that counts."""
    spark = stats_long.sparkSession
    name = f"data-{uuid.uuid4().hex[:16]}"
    save_stats(stats_long, counts, f"{path}/{name}")
    spark.createDataFrame([(name,)], "data string").coalesce(1).write.mode("append").json(f"{path}/commit")
    return f"{path}/{name}"


def cached_stats(df: DataFrame, deps: tuple[str, ...], root: str, fallback: str | None = None, **kw) -> tuple[DataFrame, bool]:
    """Reuse statistics stored under ``root/dataset_statistics_<sha256(deps)>``, or under the
    same name in ``fallback``; compute and store them when absent, in ``fallback`` where ``root``
    cannot be written.  Returns (long stats, hit)."""
    spark = df.sparkSession
    paths = [f"{r.rstrip('/')}/dataset_statistics_{stats_key(*deps)}" for r in (root, fallback) if r]
    for path in paths:
        found = _committed(spark, path)
        if found:
            return load_stats(spark, found), True
    stats, counts = materialize(dataset_stats(df, **kw)), materialize(dataset_counts(df))
    for path in paths:
        try:
            _store(stats, counts, path)
            break
        except (PySparkException, Py4JError):
            if path == paths[-1]:
                raise
    return load_stats(spark, _committed(spark, path)), False


def synthetic_steps(base: DataFrame, seed: int, key: str = "event_id", dims: int = 7) -> DataFrame:
    """One synthetic example per row of ``base``: a uniform 7-D action, a fixed
    instruction and 'no-op' statistics (q01 = 0, q99 = 1)."""
    action = F.array(*[u01(seed, key, F.lit(d)) for d in range(dims)])
    return base.select(
        F.col(key),
        action.alias("action"),
        F.lit("move the red block to the left").alias("language_instruction"),
        F.lit("dummy_dataset").alias("dataset_name"),
    )
