"""Sequential pure-Python twins of the window operators on hand-made edge fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from episodic.functions import text as X
from episodic.operators import episodes as E
from episodic.operators import mixture as MX
from episodic.operators import projections as P


def binarize_twin(xs):
    out, carry = [0.0] * len(xs), xs[-1]
    for i in reversed(range(len(xs))):
        if xs[i] > 0.95:
            carry = 1.0
        elif xs[i] < 0.05:
            carry = 0.0
        out[i] = carry
    return out


def rel2abs_twin(xs):
    thr = [1 if x < -0.1 else (-1 if x > 0.1 else 0) for x in xs]
    nz = [v for v in thr if v != 0]
    cur = -nz[0] if nz else 1
    out = []
    for v in thr:
        if v != 0:
            cur = v
        out.append(cur / 2 + 0.5)
    return out


def chunk_twin(actions, window, future, mask):
    n = len(actions)
    res = []
    for t in range(n):
        slots = []
        for off in range(-window + 1, future + 1):
            idx = min(max(t + off, 0), n - 1)
            a = list(actions[idx])
            if t + off > n - 1:
                a = [v if (mask and mask[d]) else 0.0 for d, v in enumerate(actions[n - 1])]
            slots.append(a)
        res.append(slots)
    return res


def episodes_df(spark, seqs, col="x"):
    rows = [("ds", i, t, float(v)) for i, s in enumerate(seqs) for t, v in enumerate(s)]
    return spark.createDataFrame(rows, f"dataset_name string, traj_id long, t int, {col} double")


GRIPPER = [[0.5, 0.5, 0.99, 0.3, 0.01], [0.5, 0.7], [0.42], [0.0, 0.5, 0.5], [0.96, 0.5, 0.5, 0.3],
           [0.5] * 20 + [0.99] + [0.5] * 30 + [0.01] + [0.4] * 5, [0.5] * 50]
REL = [[0.0, 0.0, 0.0], [0.0, 0.5, 0.0, -0.5, 0.0], [0.0, 0.0, -0.7, 0.0], [0.2], [-0.05, 0.05, 0.0],
       [0.0] * 35 + [0.9] + [0.0] * 20 + [-0.9] + [0.0] * 3, [0.0] * 40]


def collect_by_traj(df, col):
    out = {}
    for r in df.orderBy("traj_id", "t").collect():
        out.setdefault(r["traj_id"], []).append(r[col])
    return out


def test_binarize_matches_sequential(spark):
    df = E.binarize_gripper_df(episodes_df(spark, GRIPPER), "x", "y")
    got = collect_by_traj(df, "y")
    for i, s in enumerate(GRIPPER):
        assert got[i] == pytest.approx(binarize_twin(s))


def test_rel2abs_matches_sequential(spark):
    df = E.rel2abs_gripper_df(episodes_df(spark, REL), "x", "y")
    got = collect_by_traj(df, "y")
    for i, s in enumerate(REL):
        assert got[i] == pytest.approx(rel2abs_twin(s))


@pytest.mark.parametrize("window,future,mask", [(1, 5, None), (2, 3, [False, True]), (3, 0, [True, True]), (1, 1, None)])
def test_chunk_matches_sequential(spark, window, future, mask):
    eps = [[[1.0, 10.0]], [[1.0, 10.0], [2.0, 20.0], [3.0, 30.0]], [[float(i), float(-i)] for i in range(7)],
           [[float(i), float(i * i)] for i in range(45)]]
    rows = [("ds", i, t, a) for i, e in enumerate(eps) for t, a in enumerate(e)]
    df = spark.createDataFrame(rows, "dataset_name string, traj_id long, t int, action array<double>")
    out = E.chunk_action(df, window, future, mask)
    got = collect_by_traj(out, "action_chunk")
    for i, e in enumerate(eps):
        assert [[list(s) for s in c] for c in got[i]] == chunk_twin(e, window, future, mask)
        # slot W-1 is always the current action
        assert [c[window - 1] for c in got[i]] == [list(a) for a in e]


def label_twin(ids, pad, marker=(151644, 77091, 198)):
    seq = list(ids)
    found = False
    for j in range(len(seq) - 3 - 3, -1, -1):
        if tuple(seq[j:j + 3]) == marker:
            start = j + 3
            seq = [-100 if i < start else v for i, v in enumerate(seq)]
            found = True
            break
    if not found:
        seq = [-100] * len(seq)
    return [-100 if v == pad else v for v in seq]


M = [151644, 77091, 198]
TOKEN_CASES = [
    [1, 2, 3],                                  # shorter than 6
    [5, 6, 7, 8, 9, 10],                        # no marker
    M + [11, 12, 13, 151645, 0, 0],             # one marker
    M + [11] + M + [12, 13, 151645, 0, 0],      # two markers: the last wins
    [4] + M + [1, 2],                           # marker at len-6
    [4, 4] + M + [1],                           # marker too close to the end
]


def test_label_mask_matches_sequential(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(TOKEN_CASES)], "seq_id long, ids array<bigint>")
    got = {r["seq_id"]: r["l"] for r in df.withColumn("l", X.label_mask("ids", 0)).collect()}
    for i, c in enumerate(TOKEN_CASES):
        assert got[i] == label_twin(c, 0)


@pytest.mark.parametrize("n,weights,expected_sum", [(10, [1, 1, 1], 10), (10, [100, 1, 0.5], 10), (7, [0, 3, 3, 1], 7), (5, [1, 1, 1, 1, 1], 5)])
def test_apportion(spark, n, weights, expected_sum):
    mix = spark.createDataFrame([(f"d{i}", i, float(w)) for i, w in enumerate(weights)], "dataset_name string, pos int, weight double")
    alloc = [r["quota"] for r in MX.apportion(mix, n).orderBy("pos").collect()]
    assert sum(alloc) == expected_sum
    total = sum(weights)
    for a, w in zip(alloc, weights):
        if w > 0:
            assert a >= 1
        else:
            assert a == 0
        assert abs(a - n * w / total) <= max(1.0, n * w / total)


def test_apportion_refuses_bad_input(spark):
    mix = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0), ("c", 2, 1.0)], "dataset_name string, pos int, weight double")
    with pytest.raises(Exception, match="fewer items"):
        MX.apportion(mix, 2).collect()
    with pytest.raises(Exception, match="negative"):
        MX.apportion(mix.withColumn("weight", F.col("pos") - 1.0), 9).collect()


def test_config_table(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 'EEF_POS', map('primary', 'img', 'wrist', 'w'), map('primary', 'd'), array('s')),"
                     " ('b', 'JOINT', map('primary', 'img'), map('primary', 'd'), array('s')), ('c', 'EEF_R6', map('wrist', 'w'), map('wrist', 'd'), array('s'))"
                     " AS t(dataset_name, action_encoding, image_views, depth_views, state_columns)")
    table = P.config_table(rows)
    cfg = P.config_for("a", table)
    assert cfg.image_obs_keys == {"primary": "img"} and cfg.depth_obs_keys == {} and cfg.columns() == ["img", "s", "language_instruction"]
    assert cfg.absolute_action_mask == [False] * 6 + [True] and cfg.action_normalization_mask == [True] * 6 + [False]
    for bad, why in (("b", "encoding"), ("c", "view")):
        with pytest.raises(ValueError, match=why):
            P.config_for(bad, table)
    with pytest.raises(KeyError):
        P.config_for("zz", table)


def test_null_values_inside_an_episode(spark):
    rows = [("d", 0, t, None if t == 3 else f"i{t}", None if t == 3 else [float(t)] * 7, [0.0] * 7) for t in range(6)]
    df = spark.createDataFrame(rows, "dataset_name string, traj_id int, t int, image string, state array<double>, action array<double>")
    chunk = {r["t"]: r["image_chunk"] for r in E.chunk_obs(df, ["image"], 2).collect()}
    assert chunk[4] == [None, "i4"] and chunk[3] == ["i2", None] and chunk[0] == ["i0", "i0"]
    assert sorted(r["t"] for r in E.state_delta(df).collect()) == [0, 1, 2, 3, 4]


def test_string_keys_are_ranked(spark):
    from episodic.operators.frames import rank_in_group

    names = [f"episode-{k:03d}" for k in range(50)] + ["é", "", "Z"]
    df = spark.createDataFrame([("d", n) for n in names], "dataset_name string, traj_id string")
    got = {r["traj_id"]: r["r"] for r in rank_in_group(df, ["dataset_name"], ["traj_id"], "r").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda s: s.encode()))}


def test_draws_on_an_empty_dataset_are_an_error(spark):
    mix = spark.createDataFrame([("a", 5, 1.0, 0), ("b", 5, 1.0, 1)], "dataset_name string, size bigint, weight double, pos int")
    frames = spark.createDataFrame([("a", k) for k in range(5)], "dataset_name string, doc_id bigint")
    with pytest.raises(Exception, match="without frames"):
        MX.mixture_draws(frames, mix, 100, 7, ["doc_id"]).collect()


def test_goal_last_step_maps_to_itself(spark):
    df = E.attach_episode(episodes_df(spark, [[0.1] * 5, [0.2]]), {"_ep_n": F.count(F.lit(1))}).withColumn("goal_t", E.goal_index(3))
    for r in df.collect():
        n = 5 if r["traj_id"] == 0 else 1
        assert r["t"] < r["goal_t"] or r["t"] == n - 1 == r["goal_t"]
        assert r["goal_t"] <= n - 1


@pytest.mark.parametrize("length", [4, 5])
def test_subsample_lengths(spark, length):
    df = episodes_df(spark, [[0.0] * length])
    assert E.subsample(df, 4, 1).count() == 4


def test_skip_unlabeled_all_some_none(spark):
    rows = [("ds", 0, 0, "a"), ("ds", 0, 1, "b"), ("ds", 1, 0, ""), ("ds", 1, 1, "c"), ("ds", 2, 0, ""), ("ds", 2, 1, "")]
    df = spark.createDataFrame(rows, "dataset_name string, traj_id long, t int, language_instruction string")
    kept = {r["traj_id"] for r in E.skip_unlabeled(df).collect()}
    assert kept == {0, 1}


def test_strings(spark):
    df = spark.createDataFrame([("./../a.wav", [72, 105, 0x1F600, 0, 66], "224,224", "224 224")],
                               "p string, cp array<int>, a string, b string")
    r = df.select(X.strip_path("p").alias("p"), X.strip_path("p", "/root").alias("q"), X.codepoints_to_text("cp").alias("t"),
                  X.parse_pair("a").alias("a"), X.parse_pair("b").alias("b")).first()
    assert r["p"] == "a.wav" and r["q"] == "/root/a.wav"
    assert r["t"] == "Hi\U0001F600"
    assert list(r["a"]) == [224, 224] and list(r["b"]) == [224, 224]
    bad = spark.createDataFrame([("a",)], "s string").select(X.parse_pair("s"))
    with pytest.raises(Exception):
        bad.collect()


def test_attach_dialogue_missing_task_is_error(spark):
    from episodic.operators import dialogue as D

    items = spark.createDataFrame([("a", ["p"], [("r",)], 0)], "instruction string, speech_conv array<string>, conversation array<struct<response:string>>, pos int")
    cat = D.instruction_catalog(items)
    ok = spark.createDataFrame([("a",)], "task string")
    assert D.attach_dialogue(ok, cat).count() == 1
    with pytest.raises(Exception):
        D.attach_dialogue(spark.createDataFrame([("b",)], "task string"), cat).collect()
