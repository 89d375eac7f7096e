"""Structured Streaming operators (R1-R6) over the ``events`` step stream.

Each builder takes a streaming DataFrame and returns a streaming DataFrame; ``run_*``
helpers drive a stream with ``Trigger.AvailableNow`` into a parquet sink under the
session's shared checkpoint folder (with a checkpoint location there too, so a
restarted query resumes exactly once) and return the written table as a batch
DataFrame.  Update-mode aggregations go through ``foreachBatch``: every micro-batch
appends its updated rows tagged with the batch id, and the final view keeps the latest
row per key.  Keyed state (R3-R5) does not depend on the order of arrival
(``ordered``): rows wait for the watermark or for the turn before them, and beside those a key
holds a few scalars.  Closed intervals (R6) leave the state with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from episodic.functions import text as X
from episodic.functions import vector as V
from episodic.functions.rand import u01
from episodic.session import bounded_broadcast, materialize
from episodic.sources.sinks import scratch_path
from episodic.streaming.ordered import GROUPS, in_number_order, in_time_order, key_groups

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
CONV_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def read_stream(spark: SparkSession, sf_dir: str, table: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream over the table's parquet file(s) in ``sf_dir`` (the folder is the source,
    the glob picks the table)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir.rstrip("/")))


def stream_steps(events: DataFrame) -> DataFrame:
    """Per-event step fields usable in a stream (no episode window: keyed by event_id)."""
    k = F.get_json_object("props", "$.k").cast("int")
    hour, minute, second = (F.hour("ts").cast("double"), F.minute("ts").cast("double"), F.second("ts").cast("double"))
    return events.select(
        F.concat(F.lit("ds"), (F.col("user_id") % 5).cast("string")).alias("dataset_name"),
        F.col("user_id").alias("traj_id"), "event_id", "ts", "event_type", "value",
        F.array("value", k / F.lit(10.0), hour, minute, second, F.lit(0.0), k / F.lit(100.0)).alias("action"),
        F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "purchase", -1.0).otherwise(0.0).alias("rel_gripper"),
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_append(stream: DataFrame, name: str, ckpt: str | None = None, out: str | None = None, progress: list | None = None) -> DataFrame:
    """Drive an append-mode stream to completion into parquet; return the written rows.

    A run with the checkpoint ``ckpt`` and the sink ``out`` of an earlier one goes on where that
    one ended.  ``progress`` receives the progress of each batch."""
    spark = stream.sparkSession
    out, ckpt = out or scratch_path(spark, name), ckpt or scratch_path(spark, name + "-ckpt")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)  # read when the query starts
    try:
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    if progress is not None:
        progress += q.recentProgress
    return spark.read.parquet(out)


def spooled(df: DataFrame, at: Column, jitter: float, key: str, close: DataFrame, slices: int = 4) -> tuple[DataFrame, float]:
    """The rows of ``df`` as files in order of arrival, and the delay that covers their disorder.

    A row arrives up to ``jitter`` after ``at`` (seconds or steps), so neighbouring slices of
    arrival interleave.  ``close`` comes last; it carries a time beyond all others and lets the
    watermark pass them."""
    spark = df.sparkSession
    timed = df.withColumn("_at", at + u01(11, key) * jitter)
    lo, hi = timed.agg(F.min("_at"), F.max("_at")).first()
    width = ((hi or 0) - (lo or 0)) / slices + 1
    rows = materialize(timed.withColumn("_slice", F.floor((F.col("_at") - F.lit(lo or 0)) / width)))
    path = scratch_path(spark, "spool")
    for k in range(slices):
        rows.where(F.col("_slice") == k).drop("_at", "_slice").write.mode("append").parquet(path)
    close.select(*[F.col(c).cast(t) for c, t in df.dtypes]).coalesce(1).write.mode("append").parquet(path)
    files = max(1, len(rows.inputFiles()))  # about one slice a trigger
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path), jitter + width


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Drive an update-mode aggregation; return the latest row per key."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-ckpt")

    def sink(bdf: DataFrame, bid: int) -> None:
        bdf.withColumn("_batch", F.lit(bid)).write.mode("append").parquet(out)

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    cols = [c for c in res.columns if c not in keys and c != "_batch"]
    latest = res.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("_r"))
    return latest.select(*keys, *[F.col("_r." + c).alias(c) for c in cols])


# --------------------------------------------------------------------------- R1
def stream_normalize(steps: DataFrame, stats_struct: DataFrame, kind: str = "bounds_q99") -> DataFrame:
    """Normalize arriving steps with frozen statistics (stream-static join with the stats
    table, broadcast after a check of its size).  A step of a dataset without statistics is an
    error, as in the batch operator."""
    st = stats_struct.filter(F.col("field") == "action").select("dataset_name", F.col("stats").alias("action_stats"))
    joined = steps.join(bounded_broadcast(st), "dataset_name", "left")
    missing = F.raise_error(F.concat(F.lit("no statistics for dataset "), F.col("dataset_name")))
    joined = joined.withColumn("action_stats", F.when(F.col("action_stats").isNull(), missing).otherwise(F.col("action_stats")))
    return joined.withColumn("action", V.normalize("action", "action_stats", kind)).drop("action_stats")


# --------------------------------------------------------------------------- R2 / R6
def stream_success(rollouts: DataFrame, by: str = "task") -> DataFrame:
    """R2: running success rate per task (update mode)."""
    return rollouts.groupBy(by).agg(
        F.count(F.lit(1)).cast("bigint").alias("episodes"),
        F.sum(F.col("success").cast("bigint")).alias("successes"),
    ).withColumn("rate", F.col("successes") / F.col("episodes"))


def stream_interval_loss(metrics: DataFrame, freq: int) -> DataFrame:
    """Per-interval loss sums (update mode); the final view keeps complete intervals."""
    return metrics.groupBy(F.ceil(F.col("step") / freq).alias("interval")).agg(
        F.sum("loss").alias("loss_sum"), F.max("step").alias("max_step")
    )


def closed_interval_loss(metrics: DataFrame, freq: int, delay: int, step: str = "step", loss: str = "loss") -> DataFrame:
    """R6 in append mode: the loss sum of every interval of ``freq`` steps once no earlier step
    can come, ``delay`` steps behind the latest; the interval then leaves the state.  A step
    counts as a second of event time."""
    timed = metrics.withColumn("_at", F.timestamp_seconds(F.col(step) - 1)).withWatermark("_at", f"{int(delay) + 1} seconds")
    agg = timed.groupBy(F.window("_at", f"{freq} seconds").alias("_w")).agg(F.sum(loss).alias("loss_sum"), F.max(step).alias("max_step"))
    return agg.select((F.unix_seconds("_w.end") / freq).cast("bigint").alias("interval"), "loss_sum", "max_step")


# --------------------------------------------------------------------------- R3
def rate_gate(steps: DataFrame, min_gap_seconds: float, key: str = "traj_id", time: str = "ts", delay: str = "6 hours", groups: int = GROUPS) -> DataFrame:
    """Accept a step only if more than ``min_gap_seconds`` passed since the last accepted
    step of the episode, in order of (time, event_id) whatever the order of arrival; steps are
    released ``delay`` behind the latest time (state: last accepted time, and the steps of the
    last ``delay``)."""
    gap = round(min_gap_seconds * 1_000_000)

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        us, event_id = row[:2]
        last = state[0]
        ok = last is None or us - last > gap
        return (us if ok else last,), [(event_id, ok)]

    return in_time_order(steps, key, time, delay, ["event_id"], step, (None,), "last_us bigint", "event_id bigint, accepted boolean", groups)


# --------------------------------------------------------------------------- R4
def stream_act_mode(turns: DataFrame, limit: int = 2, key: str = "conv_id", order: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """D5 per conversation, by turn number whatever the order of arrival (state: replies
    seen, switched, and turns that wait for an earlier one).  Turns of the assistant are replies;
    a null text is empty."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        seen, switched = state
        turn, who, t = row
        if who != "assistant":
            return state, []
        if switched:
            return state, [(turn, "action", None)]
        t, seen = t or "", seen + 1
        if X.ACT_MARKER in t:
            switched = True
        elif seen >= limit:
            t, switched = t + " " + X.ACT_MARKER, True
        return (seen, switched), [(turn, "dialogue", t)]

    return in_number_order(turns, key, order, [role, text], step, (0, False), "seen int, switched boolean", f"{order} bigint, mode string, reply string")


# --------------------------------------------------------------------------- R5
def stream_rel2abs(steps: DataFrame, key: str = "traj_id", order: str = "event_id", x: str = "rel_gripper",
                   last: str | None = None) -> DataFrame:
    """W7 online.  Causal once the first non-zero threshold is known; before that the
    key's undecided prefix is buffered in state and released as soon as it is decided.

    An episode that never closes or opens has the default open state, which only its end can
    confirm: the boolean column ``last`` marks an episode's last step and releases what is
    buffered.  Without that column an undecided episode stays buffered."""

    def thr(v):
        return 1 if v < -0.1 else (-1 if v > 0.1 else 0)

    def fn(k, pdfs, state: GroupState):
        cur, pend = state.get if state.exists else (0, [])
        pend = list(pend)
        rows = pd.concat(list(pdfs)).sort_values(order)
        out_ids, out_vals = [], []
        ends = rows[last] if last else [False] * len(rows)
        for oid, v, end in zip(rows[order], rows[x], ends):
            tv = thr(v)
            if cur == 0 and tv == 0 and end:
                out_ids += [*pend, int(oid)]
                out_vals += [1.0] * (len(pend) + 1)
                pend = []
                continue
            if cur == 0 and tv == 0:
                pend.append(int(oid))
                continue
            if cur == 0:
                start = -tv
                out_ids += pend
                out_vals += [start / 2 + 0.5] * len(pend)
                pend = []
            if tv != 0:
                cur = tv
            out_ids.append(int(oid))
            out_vals.append(cur / 2 + 0.5)
        state.update((int(cur), pend))
        yield pd.DataFrame({key: [k[0]] * len(out_ids), order: out_ids, "value": out_vals})

    return steps.select(key, order, x, *([last] if last else [])).groupBy(key).applyInPandasWithState(
        fn, f"{key} bigint, {order} bigint, value double", "cur int, pending array<bigint>", "append",
        GroupStateTimeout.NoTimeout,
    )


def rel2abs_marks(steps: DataFrame, key: str = "traj_id", order: str = "event_id", x: str = "rel_gripper", last: str = "last",
                  time: str = "ts", delay: str = "6 hours", groups: int = GROUPS) -> DataFrame:
    """R5 in order of (time, order), whatever the order of arrival, with one scalar a key.

    Steps before the first threshold go out at once without a value; what decides them -- the
    first threshold, or the episode's end (``last``), after which the state is open -- goes out
    as a mark, a row without ``order``.  ``resolve_marks`` puts the two together."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (cur,), (_, oid, v, end) = state, row[:4]
        turned = 0 if v is None else 1 if v < -V.REL_THRESHOLD else -1 if v > V.REL_THRESHOLD else 0
        if cur == 0 and turned == 0:
            return state, [(oid, None)] + ([(None, 1.0)] if end else [])
        mark = [(None, -turned / 2 + 0.5)] if cur == 0 else []
        cur = turned or cur
        return (cur,), mark + [(oid, cur / 2 + 0.5)]

    return in_time_order(steps, key, time, delay, [order, x, last], step, (0,), "cur int", f"{order} bigint, value double", groups)


def resolve_marks(out: DataFrame, key: str = "traj_id", order: str = "event_id") -> DataFrame:
    """The steps of ``rel2abs_marks`` with their values; steps without a mark yet are left out."""
    marks = out.where(F.col(order).isNull()).groupBy(key).agg(F.max("value").alias("_mark"))
    open_ = out.where(F.col(order).isNotNull() & F.col("value").isNull()).select(key, order).join(marks, key)
    done = out.where(F.col(order).isNotNull() & F.col("value").isNotNull())
    return done.unionByName(open_.select(key, order, F.col("_mark").alias("value")))
