"""Order statistics, ranks, scans and subsampling at block and bucket borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.operators import episodes as E
from episodic.operators import frames as FR
from episodic.operators import selection as SEL
from episodic.operators import stats as S
from episodic.session import materialize


def _state(long, n_ranks, group=("g",)):
    summary = materialize(S._pass_a(long, list(group), "x", S.QUANTILES, 10_000))
    at = [F.lit(q) * (F.col("_n") - 1) for _, q in S.QUANTILES]
    ranks = [r for p in at for r in (F.floor(p), F.least(F.floor(p) + 1, F.col("_n") - 1))]
    lo, hi = ([F.col("_probe")[3 * (k // 2) + side] for k in range(4)] for side in (0, 1))
    return SEL.first_brackets(summary.select(*group, "_n", "_probe"), ranks, lo, hi, F.col("_n") * 4.0 / 10_000).drop("_probe")


@pytest.mark.parametrize("n", [1_000_000, 16_000_000])
def test_last_window_does_not_grow_with_the_group(spark, n):
    limit = 300
    long = spark.range(n).select(F.lit("a").alias("g"), (F.xxhash64("id") / 1e9).alias("x"))
    state, _ = SEL.narrowed(long, _state(long, 4), ["g"], "x", 4, limit)
    hist = SEL.histogram(long, state, ["g"], "x", 4)
    assert hist.where("_x IS NOT NULL").count() <= 4 * limit * 2


@pytest.mark.parametrize("limit", [5, 200, 1 << 16])
def test_quantiles_are_exact_at_every_limit(spark, limit):
    rng = np.random.default_rng(3)
    data = {"normal": rng.normal(size=3000), "two": rng.integers(0, 2, 3000).astype(float), "tied": np.where(rng.random(3000) < 0.6, 1.5, rng.normal(size=3000)),
            "steep": np.exp(rng.normal(size=3000) * 20), "one": np.array([4.0]), "few": np.array([3.0, -1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    long = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in S.exact_quantiles(long, ["g"], "x", limit=limit).collect()}
    for g, vs in data.items():
        for name, q in S.QUANTILES:
            assert got[g][name] == pytest.approx(np.quantile(vs, q), rel=1e-12), (g, name)


def test_ranks_of_text_with_a_common_prefix_spread_over_the_buckets(spark):
    names = [f"episode_{k:06d}" for k in range(4000)]
    df = spark.createDataFrame([("a", n) for n in names], "g string, name string").repartition(6)
    keyed, okeys = FR._order_columns(df, ["name"])
    bucketed, several = FR._bucketed(keyed, ["g"], okeys, 16)
    sizes = [r["count"] for r in bucketed.groupBy("_b").count().collect()]
    assert several and len(sizes) == 16 and max(sizes) < 4000 / 16 * 2
    got = {r["name"]: r["r"] for r in FR.rank_in_group(df, ["g"], ["name"], "r", buckets=16).collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_ranks_of_a_group_beyond_the_bucket_size(spark):
    # the fixture's session cuts groups at 40 rows
    rows = [("hot", k // 7, k) for k in range(900)] + [(f"g{k}", 0, k) for k in range(50)] + [(None, 1, k) for k in range(5)]
    df = spark.createDataFrame(rows, "g string, a int, b int").repartition(5)
    got = {(r["g"], r["b"]): r["r"] for r in FR.rank_in_group(df.where("g IS NOT NULL"), ["g"], ["a", "b"], "r").collect()}
    assert all(got["hot", k] == k for k in range(900)) and all(got[f"g{k}", k] == 0 for k in range(50))
    total = FR.running_totals(df.where("g = 'hot'").withColumn("one", F.lit(1)), ["g"], ["a", "b"], ["one"]).collect()
    assert all(r["one_cum"] == r["b"] + 1 for r in total)


def test_subsample_of_an_episode_with_a_third_of_all_steps(spark):
    rows = spark.range(30_000).select(F.lit("d").alias("dataset_name"), F.when(F.col("id") < 10_000, F.lit(-1)).otherwise(F.col("id") % 200).alias("traj_id"), "id")
    df = E.add_timestep(rows, E.EPISODE, ["id"])
    kept = E.subsample(df, 7, 5)
    got = {}
    for r in kept.select("traj_id", "t").collect():
        got.setdefault(r["traj_id"], set()).add(r["t"])
    from episodic.functions.rand import u01

    draws = {}
    for r in df.select("traj_id", "t", u01(5, *E.EPISODE, "t").alias("u")).collect():
        draws.setdefault(r["traj_id"], []).append((r["u"], r["t"]))
    assert got == {k: {t for _, t in sorted(v)[:7]} for k, v in draws.items()}
    assert E.subsample(df, 0, 5).count() == 0


def test_gripper_scans_over_ten_thousand_blocks(spark):
    spark.conf.set("episodic.blockFan", "64")
    try:
        n = 160_000  # 16-row blocks
        x = F.when(F.col("id") == 70_000, 1.0).when(F.col("id") == 30_000, -1.0).when(F.col("id") == 150_000, -1.0).otherwise(0.0)
        df = spark.range(n).select(F.lit("d").alias("dataset_name"), F.lit(1).alias("traj_id"), F.col("id").alias("t"), x.alias("x"))
        got = E.rel2abs_gripper_df(df, "x", "y").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()
        # open before the first closing step's opposite ... : closed first, then open until 70,000, closed until 150,000, open
        assert {r["y"]: (r["n"], r["lo"], r["hi"]) for r in got} == {0.0: (30_000 + 80_000, 0, 149_999), 1.0: (40_000 + 10_000, 30_000, 159_999)}
        g = F.when(F.col("t") == 90_000, 1.0).when(F.col("t") == 10_000, 0.0).otherwise(0.5)
        got = E.binarize_gripper_df(df.withColumn("g", g), "g", "y").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo")).collect()
        assert {r["y"]: (r["n"], r["lo"]) for r in got} == {0.0: (10_001, 0), 1.0: (80_000, 10_001), 0.5: (69_999, 90_001)}
    finally:
        spark.conf.unset("episodic.blockFan")
