"""Streams against their batch rules under disorder, and step and statistics sources."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from episodic.operators import dialogue as D
from episodic.operators import episodes as E
from episodic.operators import mixture as MX
from episodic.operators import stats as S
from episodic.session import bounded_broadcast
from episodic.sources import stats_io as SIO
from episodic.sources import steps_io as SI
from episodic.streaming import streams as SS

T0 = datetime.datetime(2024, 1, 1)


def _files(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _interleaved(rows, files, rng, disorder):
    """Rows by arrival (up to ``disorder`` later than their time), cut into files."""
    order = sorted(rows, key=lambda r: (r["ts"] + datetime.timedelta(seconds=rng.uniform(0, disorder))))
    size = -(-len(order) // files)
    return [order[k : k + size] for k in range(0, len(order), size)]


def _events(n=300, users=5, seed=1):
    rng = random.Random(seed)
    return [{"traj_id": rng.randint(0, users - 1) if k % 3 else 0, "event_id": k, "ts": T0 + datetime.timedelta(seconds=rng.randint(0, 20_000)),
             "rel_gripper": rng.choice([0.0, 0.0, 0.0, 0.05, 1.0, -1.0])} for k in range(n)]


CLOSE = T0 + datetime.timedelta(days=900)


@pytest.mark.parametrize("files", [3, 6])
def test_rate_gate_equals_batch_under_interleaved_files(spark, tmp_path, files):
    rng = random.Random(files)
    rows = _events()
    parts = [[(r["traj_id"], r["event_id"], r["ts"]) for r in p] for p in _interleaved(rows, files, rng, 3000)] + [[(None, None, CLOSE)]]
    progress = []
    # rows may come as late as their slice is wide, and the disorder on top
    out = SS.run_append(SS.rate_gate(_files(spark, str(tmp_path / "in"), parts, "traj_id bigint, event_id bigint, ts timestamp"), 900, delay="24000 seconds"), "gate", progress=progress)
    want = {}
    for u in {r["traj_id"] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r["traj_id"] == u), key=lambda r: (r["ts"], r["event_id"])):
            ok = last is None or (r["ts"] - last).total_seconds() > 900
            last = r["ts"] if ok else last
            want[u, r["event_id"]] = ok
    assert {(r["traj_id"], r["event_id"]): r["accepted"] for r in out.collect()} == want
    assert len(progress) >= files


def test_rel2abs_marks_equal_batch_under_interleaved_files(spark, tmp_path):
    rows = _events(seed=4) + [{"traj_id": 77, "event_id": 1000 + k, "ts": T0 + datetime.timedelta(seconds=k), "rel_gripper": 0.0} for k in range(40)]  # never decided
    ends = {}
    for r in rows:
        ends[r["traj_id"]] = max(ends.get(r["traj_id"], (T0, -1)), (r["ts"], r["event_id"]))
    parts = [[(r["traj_id"], r["event_id"], r["ts"], r["rel_gripper"], (r["ts"], r["event_id"]) == ends[r["traj_id"]]) for r in p] for p in _interleaved(rows, 4, random.Random(9), 3000)]
    schema = "traj_id bigint, event_id bigint, ts timestamp, rel_gripper double, last boolean"
    out = SS.run_append(SS.rel2abs_marks(_files(spark, str(tmp_path / "in"), [*parts, [(None, None, CLOSE, None, None)]], schema), delay="24000 seconds"), "marks")
    got = {(r["traj_id"], r["event_id"]): r["value"] for r in SS.resolve_marks(out).collect()}
    steps = spark.createDataFrame([("d", r["traj_id"], r["ts"], r["event_id"], r["rel_gripper"]) for r in rows], "dataset_name string, traj_id bigint, ts timestamp, event_id bigint, x double")
    batch = E.rel2abs_gripper_df(E.add_timestep(steps, E.EPISODE, ["ts", "event_id"]), "x", "y")
    assert got == {(r["traj_id"], r["event_id"]): r["y"] for r in batch.collect()}
    assert out.where("event_id IS NULL").groupBy("traj_id").count().where("count > 1").isEmpty()  # one mark an episode


def test_act_mode_equals_batch_whatever_the_order_of_turns(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["go", "stop [ACT]", "", "hm"])) for c in range(12) for t in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    parts = [rows[k::4] for k in range(4)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    out = SS.run_append(SS.stream_act_mode(_files(spark, str(tmp_path / "in"), parts, schema), limit=3), "act")
    batch = D.act_mode(spark.createDataFrame(rows, schema).where("role = 'assistant'"), "text", "turn", ["conv_id"], 3)
    assert {tuple(r) for r in out.select("conv_id", "turn", "mode", "reply").collect()} == {tuple(r) for r in batch.select("conv_id", "turn", "mode", "reply").collect()}


def test_a_stopped_stream_goes_on_where_it_ended(spark, tmp_path):
    rows = _events(seed=6)
    parts = [[(r["traj_id"], r["event_id"], r["ts"]) for r in p] for p in _interleaved(rows, 2, random.Random(3), 1000)]
    schema, path = "traj_id bigint, event_id bigint, ts timestamp", str(tmp_path / "in")
    how = dict(ckpt=str(tmp_path / "ckpt"), out=str(tmp_path / "out"))
    SS.run_append(SS.rate_gate(_files(spark, path, parts[:1], schema), 900, delay="24000 seconds"), "gate", **how)
    out = SS.run_append(SS.rate_gate(_files(spark, path, [*parts[1:], [(None, None, CLOSE)]], schema), 900, delay="24000 seconds"), "gate", **how)
    assert sorted(r["event_id"] for r in out.collect()) == sorted(r["event_id"] for r in rows)


def test_closed_intervals_leave_the_state(spark, tmp_path):
    parts = [[(s, float(s)) for s in range(k * 1000 + 1, (k + 1) * 1000 + 1)] for k in range(6)]
    progress = []
    out = SS.run_append(SS.closed_interval_loss(_files(spark, str(tmp_path / "in"), [*parts, [(10**9, None)]], "step bigint, loss double"), 100, 50), "loss", progress=progress)
    got = {r["interval"]: (r["loss_sum"], r["max_step"]) for r in out.collect()}
    assert got == {i: (sum(range((i - 1) * 100 + 1, i * 100 + 1)), i * 100) for i in range(1, 61)}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) <= 21 and held[-1] <= 2  # two files' intervals at most, not all sixty


def test_a_quota_without_frames_is_an_error(spark):
    frames = spark.createDataFrame([("a", k) for k in range(3)], "dataset_name string, doc_id bigint")
    quotas = spark.createDataFrame([("a", 3), ("b", 4)], "dataset_name string, quota bigint")
    with pytest.raises(Exception, match="dataset without frames: b"):
        MX.mixture_quota(frames, quotas, 1, "doc_id").collect()
    none = spark.createDataFrame([("a", 4), ("b", 0)], "dataset_name string, quota bigint")
    assert sorted(r["copies"] for r in MX.mixture_quota(frames, none, 1, "doc_id").collect()) == [1, 1, 2]


def test_a_long_episode_is_many_files(spark, tmp_path):
    df = spark.range(6000).select(F.lit("d").alias("dataset_name"), F.when(F.col("id") < 4000, F.lit(0)).otherwise(F.col("id")).alias("traj_id"), F.col("id").alias("t"))
    path = str(tmp_path / "steps")
    SI.write_steps(df, path, files=6, file_rows=500)
    spread = spark.read.parquet(path).where("traj_id = 0").select(F.input_file_name().alias("f")).distinct().count()
    assert spread >= 4 and SI.read_steps(spark, path, dataset="d").count() == 6000
    assert SI.read_steps(spark, path, dataset="other").count() == 0
    assert "PartitionFilters: [isnotnull(dataset_name" in SI.read_steps(spark, path, dataset="d")._jdf.queryExecution().toString()


def test_bucketed_steps_need_no_exchange(spark):
    df = spark.range(2000).select(F.lit("d").alias("dataset_name"), (F.col("id") % 7).alias("traj_id"), F.floor(F.col("id") / 7).alias("t"), F.col("id").cast("double").alias("x"))
    spark.sql("DROP TABLE IF EXISTS steps_by_block")
    SI.save_steps_table(df, "steps_by_block", 4)
    try:
        back = SI.steps_table(spark, "steps_by_block", ["x"])
        near = back.withColumn("next", F.lead("x").over(E.episode_window()))
        assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
        assert E.with_block(back) is back and back.count() == 2000
        spark.conf.set("episodic.episodeBlockRows", "32")
        with pytest.raises(ValueError, match="another block size"):
            SI.steps_table(spark, "steps_by_block")
    finally:
        spark.conf.set("episodic.episodeBlockRows", "16")
        spark.sql("DROP TABLE IF EXISTS steps_by_block")


def _small(spark):
    return spark.createDataFrame([("a", 0, t, [float(t), 1.0], [0.5]) for t in range(20)], "dataset_name string, traj_id int, t int, action array<double>, proprio array<double>")


def test_statistics_keep_mask_and_counts(spark, tmp_path):
    df = _small(spark)
    stats = S.dataset_stats(df).withColumn("mask", F.when(F.col("field") == "action", F.col("dim") == 0))
    SIO.save_stats(stats, S.dataset_counts(df), str(tmp_path / "s"))
    got = {(r["field"], r["dim"]): (r["mask"], r["num_transitions"], r["num_trajectories"]) for r in SIO.load_stats(spark, str(tmp_path / "s")).collect()}
    assert got == {("action", 0): (True, 20, 1), ("action", 1): (False, 20, 1), ("proprio", 0): (None, 20, 1)}
    packed = {r["field"]: r["stats"]["mask"] for r in S.stats_struct(SIO.load_stats(spark, str(tmp_path / "s"))).collect()}
    assert packed == {"action": [True, False], "proprio": None}


def test_statistics_cache_has_a_second_place(spark, tmp_path):
    df = _small(spark)
    (tmp_path / "file").write_text("no folder can be made below a file")
    bad, good = str(tmp_path / "file" / "x"), str(tmp_path / "home")
    with pytest.raises(Exception):
        SIO.cached_stats(df, ("k",), bad)
    first, hit = SIO.cached_stats(df, ("k",), bad, fallback=good)
    second, again = SIO.cached_stats(df, ("k",), bad, fallback=good)
    assert (hit, again) == (False, True) and first.count() == second.count() == 3
    # two writers at once: both results are there, one counts
    stats, counts = S.dataset_stats(df), S.dataset_counts(df)
    path = str(tmp_path / "both")
    names = {SIO._store(stats, counts, path), SIO._store(stats, counts, path)}
    assert SIO._committed(spark, path) == min(names) and SIO._committed(spark, str(tmp_path / "none")) is None


def test_a_wide_table_is_not_broadcast(spark):
    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    hinted = bounded_broadcast(wide)._jdf.queryExecution().logical().toString()
    plain = bounded_broadcast(wide, max_bytes=10_000)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in plain.lower()


def test_unlabelled_steps_have_no_dialogue(spark):
    items = spark.createDataFrame([("a", ["p"], [("r",)], 0)], "instruction string, speech_conv array<string>, conversation array<struct<response:string>>, pos int")
    steps = spark.createDataFrame([("a",), ("",), (None,)], "task string")
    got = {r["task"]: r["entry"] for r in D.attach_dialogue(steps, D.instruction_catalog(items)).collect()}
    assert got["a"] is not None and got[""] is None and got[None] is None


def test_many_keys_share_their_states(spark, tmp_path):
    """The work of a batch follows the rows, not the keys: as many states as groups at most."""
    big = 2**60  # beyond the whole numbers of doubles
    rows = [(u if u else None, big + 3 * u + k, T0 + datetime.timedelta(seconds=600 * k + u % 60)) for u in range(1500) for k in (0, 2, 1)]
    parts = [rows[k::3] for k in range(3)] + [[(None, None, CLOSE)]]
    progress = []
    out = SS.run_append(SS.rate_gate(_files(spark, str(tmp_path / "in"), parts, "traj_id bigint, event_id bigint, ts timestamp"), 900, delay="24000 seconds"), "gate", progress=progress)
    assert {(r["traj_id"], r["event_id"], r["accepted"]) for r in out.collect()} == {(u, e, (e - big) % 3 != 1) for u, e, _ in rows}
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 1024
