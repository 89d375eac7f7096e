"""Properties: normalize/un-normalize round trip, rotations, exact quantiles, streaming = batch."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from episodic.functions import rotation as RT
from episodic.functions import vector as V
from episodic.operators import stats as S
from episodic.plans import queries as Q
from tests.conftest import SF_SMALL


def test_unnormalize_inverts_q99_inside_bounds(spark):
    st = spark.createDataFrame([([0.5, 2.0],)], "x array<double>").withColumn(
        "s", F.struct(F.array(F.lit(0.0), F.lit(1.0)).alias("q01"), F.array(F.lit(1.0), F.lit(3.0)).alias("q99"),
                      F.array(F.lit(0.0), F.lit(0.0)).alias("min"), F.array(F.lit(2.0), F.lit(4.0)).alias("max"),
                      F.lit(None).cast("array<boolean>").alias("mask")))
    r = st.select(V.unnormalize(V.normalize("x", "s", "bounds_q99"), "s").alias("y")).first()
    assert r["y"] == pytest.approx([0.5, 2.0], abs=1e-6)


def test_zero_unused_dims_even_when_masked(spark):
    st = spark.createDataFrame([([5.0, 7.0],)], "x array<double>").withColumn(
        "s", F.struct(*[F.array(F.lit(a), F.lit(b)).alias(n) for n, a, b in
                        [("q01", 1.0, 1.0), ("q99", 9.0, 1.0), ("min", 0.0, 3.0), ("max", 10.0, 3.0)]],
                      F.array(F.lit(True), F.lit(False)).alias("mask")))
    r = st.select(V.normalize("x", "s", "bounds_q99").alias("y")).first()
    assert r["y"] == pytest.approx([0.0, 0.0], abs=1e-6)


def test_rotation_round_trip(spark):
    rng = np.random.default_rng(0)
    e = rng.uniform(-1.2, 1.2, size=(20, 3)).tolist()
    df = spark.createDataFrame([(x,) for x in e], "e array<double>")
    rows = df.select("e", RT.euler_to_rmat("e").alias("m")).select("e", "m", RT.rmat_to_euler("m").alias("b"), RT.invert_rmat("m").alias("i")).collect()
    for r in rows:
        m = np.array(r["m"]).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-9)
        assert np.allclose(np.array(r["i"]).reshape(3, 3), m.T)
        assert r["b"] == pytest.approx(r["e"], abs=1e-9)


def test_quaternion_identity_and_axis(spark):
    s = math.sqrt(0.5)
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 1.0],), ([0.0, 0.0, s, s],)], "q array<double>")
    rows = df.select(RT.quat_to_euler("q").alias("e")).collect()
    assert rows[0]["e"] == pytest.approx([0, 0, 0], abs=1e-12)
    assert rows[1]["e"] == pytest.approx([0, 0, math.pi / 2], abs=1e-9)


def test_exact_quantile_fallback_path(spark):
    vals = [float(v) for v in np.random.default_rng(1).normal(size=500)] + [1.0] * 300
    long = spark.createDataFrame([("g", v) for v in vals], "grp string, x double")
    # a summary whose brackets miss the target ranks forces the exact fallback
    bogus = spark.createDataFrame([("g", len(vals), [50.0, 60.0, 0.0, 50.0, 60.0, 0.0])], "grp string, _n long, _probe array<double>")
    got = S.exact_quantiles(long, ["grp"], "x", summary=bogus).first()
    assert got["q01"] == pytest.approx(np.quantile(vals, 0.01))
    assert got["q99"] == pytest.approx(np.quantile(vals, 0.99))
    good = S.exact_quantiles(long, ["grp"], "x").first()
    assert good["q01"] == pytest.approx(np.quantile(vals, 0.01))
    assert good["q99"] == pytest.approx(np.quantile(vals, 0.99))


def test_rate_gate_matches_brute_force(spark):
    got = Q.QUERIES["rate_gate"](spark, SF_SMALL).collect()
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id", "event_id", "ts").collect()
    by = {}
    for r in sorted(ev, key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        by.setdefault(r["user_id"], []).append(r)
    want = {}
    for u, rs in by.items():
        last = None
        for r in rs:
            ok = last is None or (r["ts"] - last).total_seconds() > 4 * 3600
            if ok:
                last = r["ts"]
            want[r["event_id"]] = ok
    assert {r["event_id"]: r["accepted"] for r in got} == want


@pytest.mark.parametrize("gaps", [False, True])
def test_frame_index_matches_sorted_position(spark, gaps):
    from episodic.operators.mixture import frame_index

    rows = []
    for ds in ("a", "b"):
        for traj in (3, 1, 7):
            ts = range(0, 20, 2) if (gaps and traj == 7) else range(traj * 3)
            rows += [(ds, traj, t) for t in ts]
    df = spark.createDataFrame(rows, "dataset_name string, traj_id long, t int")
    got = {(r["dataset_name"], r["traj_id"], r["t"]): r["_fi"] for r in frame_index(df).collect()}
    for ds in ("a", "b"):
        keys = sorted((tr, t) for d, tr, t in rows if d == ds)
        for i, (tr, t) in enumerate(keys):
            assert got[(ds, tr, t)] == i


def test_load_stats_object_layout(spark, tmp_path):
    import json

    from episodic.sources.stats_io import load_stats

    doc = {"libero_spatial": {"action": {"mean": [0.1, 0.2], "std": [1.0, 2.0], "max": [3.0, 4.0], "min": [-3.0, -4.0],
                                         "q01": [-2.0, -3.0], "q99": [2.0, 3.0], "mask": [True, False]},
                              "proprio": {"mean": [0.0], "std": [1.0], "max": [1.0], "min": [-1.0], "q01": [-0.5], "q99": [0.5]},
                              "num_transitions": 10, "num_trajectories": 2}}
    p = tmp_path / "stats.json"
    p.write_text(json.dumps(doc, indent=2))
    rows = {(r["field"], r["dim"]): r for r in load_stats(spark, str(p), layout="object").collect()}
    assert rows[("action", 1)]["q99"] == 3.0 and rows[("action", 0)]["mean"] == 0.1
    assert rows[("proprio", 0)]["min"] == -1.0 and len(rows) == 3


def test_draw_counts_within_4_sigma(spark):
    from episodic.operators import mixture as MX
    from episodic.sources import tables as T

    mix = T.mixture(spark, SF_SMALL)
    n = 20000
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("u", F.lit(0.0))
    from episodic.functions.rand import u01

    draws = draws.withColumn("u", u01(11, "draw"))
    got = {r["dataset_name"]: r["c"] for r in MX.draw_to_dataset(draws, mix).groupBy("dataset_name").agg(F.count("*").alias("c")).collect()}
    w = {r["dataset_name"]: r["sample_weight"] for r in MX.mixture_weights(mix).collect()}
    for ds, p in w.items():
        mu, sd = n * p, math.sqrt(n * p * (1 - p))
        assert abs(got.get(ds, 0) - mu) <= 4 * sd + 1


def test_unnormalize_with_key(spark):
    from episodic.operators import normalize as N
    from episodic.operators import stats as S
    from episodic.sources import tables as T

    st = T.steps(spark, SF_SMALL).select("dataset_name", "traj_id", "t", "action")
    stats = S.stats_struct(S.dataset_stats(st, fields=("action",)))
    pred = st.select(F.array(*[F.lit(0.0)] * 7).alias("action")).limit(3)
    out = N.unnormalize(pred, stats, "action", key="ds1").collect()
    q = {r["dim"]: (r["q01"], r["q99"]) for r in S.dataset_stats(st, fields=("action",)).filter("dataset_name = 'ds1'").collect()}
    for r in out:
        assert r["action"] == pytest.approx([0.5 * (q[d][0] + q[d][1]) for d in range(7)])
    with pytest.raises(ValueError):
        N.unnormalize(pred, stats, "action", key="nope")


def test_rank_in_group_splits_heavy_ties(spark):
    from episodic.operators.frames import rank_in_group

    rows = [("a", 5, t) for t in range(2000)] + [("a", tr, t) for tr in (1, 2, 9) for t in range(30)] + [("b", 5, t) for t in range(40)]
    df = spark.createDataFrame(rows, "g string, traj long, t long")
    out = rank_in_group(df, ["g"], ["traj", "t"], "r", buckets=8)
    got = {(r["g"], r["traj"], r["t"]): r["r"] for r in out.collect()}
    for g in ("a", "b"):
        keys = sorted((tr, t) for gg, tr, t in rows if gg == g)
        for i, k in enumerate(keys):
            assert got[(g, *k)] == i
    glob = rank_in_group(df, [], ["traj", "t", "g"], "r", buckets=8)
    allk = sorted((tr, t, g) for g, tr, t in rows)
    got2 = {(r["traj"], r["t"], r["g"]): r["r"] for r in glob.collect()}
    assert [got2[k] for k in allk] == list(range(len(allk)))


def _stream_of(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_rel2abs_releases_undecided_episodes_at_their_end(spark, tmp_path):
    from episodic.streaming import streams as SS

    schema = "traj_id bigint, event_id bigint, rel_gripper double, done boolean"
    rows = [[(1, k, 0.0, False) for k in range(5)], [(1, k, 0.0, k == 9) for k in range(5, 10)] + [(2, 20, 0.0, False), (2, 21, 1.0, True)]]
    out = SS.run_append(SS.stream_rel2abs(_stream_of(spark, tmp_path, rows, schema), last="done"), "rel2abs_end")
    got = {(r["traj_id"], r["event_id"]): r["value"] for r in out.collect()}
    assert got == {**{(1, k): 1.0 for k in range(10)}, (2, 20): 1.0, (2, 21): 0.0}


def test_stream_normalize_refuses_steps_without_statistics(spark, tmp_path):
    from episodic.streaming import streams as SS

    stats = spark.sql("SELECT 'a' AS dataset_name, 'action' AS field, named_struct('mean', array(0D), 'std', array(1D), 'max', array(1D), 'min', array(0D),"
                      " 'q01', array(0D), 'q99', array(1D), 'mask', array(true)) AS stats")
    stream = _stream_of(spark, tmp_path, [[("a", [0.5]), ("b", [0.5])]], "dataset_name string, action array<double>")
    with pytest.raises(Exception, match="no statistics for dataset b"):
        SS.run_append(SS.stream_normalize(stream, stats), "normalize_missing").collect()


def test_stream_rel2abs_query_returns_users_without_a_click_or_purchase(spark, tmp_path):
    events = pq.read_table(f"{SF_SMALL}/events.parquet")
    quiet = events["user_id"][0].as_py()
    kind = [("view" if u == quiet else e) for u, e in zip(events["user_id"].to_pylist(), events["event_type"].to_pylist(), strict=True)]
    at = events.schema.get_field_index("event_type")
    pq.write_table(events.set_column(at, events.schema.field(at), pa.array(kind, events.schema.field(at).type)), tmp_path / "events.parquet")
    got = {r["event_id"]: r["value"] for r in Q.QUERIES["stream_rel2abs"](spark, str(tmp_path)).collect()}
    assert set(got) == set(events["event_id"].to_pylist())
    assert {got[i] for i, u in zip(events["event_id"].to_pylist(), events["user_id"].to_pylist(), strict=True) if u == quiet} == {1.0}
