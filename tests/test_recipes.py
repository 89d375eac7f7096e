"""Recipes of raw mixtures: every recipe compiles, and values follow the sources' rules."""

import math
import re

import pytest
from pyspark.sql import functions as F

from episodic.operators import projections as P
from episodic.operators import recipes as RC
from episodic.operators import registry as RG
from episodic.plans import pipelines as PL
from episodic.sources import tables as T
from tests.conftest import SF_SMALL

#: Columns that are not lists of ten numbers, by recipe ('' = any).
SCALARS = {"action.open_gripper": "true", "observation.state_gripper_pose": "0.25D", "action.gripper": "1", "observation.gripper_width": "0.5D", "language_instruction": "'do it'",
           "observation.natural_language_instruction": "'do it'", "observation.instruction": "array(72, 105, 0, 66)", "observation.image_with_depth": "'d'",
           "observation.exterior_image_1_left": "'one'", "observation.exterior_image_2_left": "'two'", "action.future/target_close": "array(1, 0)"}
FLAT_CLOSED = ("viola", "autolab_ur5", "pusht")


def columns_of(r):
    text = " ".join([r.action, *r.fields.values(), r.language, r.relabel or "", r.binarize or "", r.rel2abs or "", r.euler or "", *[f"`{c}`" for c in r.swap or ()]])
    return sorted(set(re.findall(r"`([^`]+)`", text)))


def raw(spark, recipe, values=None, steps=4):
    """Steps with the columns the recipe reads: lists hold step + 0.1 * place."""
    df = spark.range(steps).select(F.lit("x").alias("dataset_name"), F.lit(3).cast("bigint").alias("traj_id"), F.col("id").alias("t"))
    for c in columns_of(RC.RECIPES[recipe]):
        given = (values or {}).get(c) or SCALARS.get(c)
        if c == "action.gripper_closedness_action" and not given:
            given = "0.3D" if recipe in FLAT_CLOSED else "array(0.3D)"
        df = df.withColumn(c, F.expr(given or "transform(sequence(0, 9), i -> double(t) + i * 0.1D)"))
    return df


def run(spark, recipe, values=None, steps=4):
    out = RC.standardize_mixture(raw(spark, recipe, values, steps), {"x": recipe})
    return sorted(out.collect(), key=lambda r: r["t"])


@pytest.mark.parametrize("recipe", sorted(RC.RECIPES))
def test_every_recipe_compiles(spark, recipe):
    rows = run(spark, recipe)
    r = RC.RECIPES[recipe]
    assert len(rows) == 4 - (1 if r.drop_first else 0) - (1 if r.relabel else 0)
    assert all(v["action"] is not None and None not in v["action"] for v in rows)
    assert all((v["proprio"] is not None) == bool(r.proprio) for v in rows)
    assert {v["language_instruction"] for v in rows} == {"Hi" if r.codepoints else "do it"}


def close(a, b):
    return a == pytest.approx(b, abs=1e-12)


def test_values_of_single_steps(spark):
    row = [round(0.1 * k, 10) for k in range(10)]
    ten = {"action": "transform(sequence(0, 9), i -> i * 0.1D)"}

    def first(recipe, values=None):
        return run(spark, recipe, values, 1)[0]

    assert close(first("hydra")["action"], [*row[:6], 1 - row[9]])
    assert close(first("hydra")["proprio"], [*row[:3], *row[7:10], row[7]])
    assert close(first("nyu_franka", ten)["action"], [*row[2:8], row[8]]) and close(first("nyu_franka")["proprio"], row[4:])
    assert close(first("maniskill")["proprio"], [row[7]]) and close(first("asu")["proprio"], [*row, row[9]])
    assert close(first("fmb")["proprio"], [*row, 0.25])
    assert close(first("rh20t")["action"], [*row, 1.0]) and close(first("rh20t")["proprio"], [*row, 0.5])
    assert close(first("gnm")["action"], [*row, *[0.0] * 20, 0.0]) and close(first("gnm")["proprio"], [*row, 0, 0, 0, *row])
    assert close(first("viola")["action"], [*row, *row, 0.7]) and close(first("viola", {"action.gripper_closedness_action": "7D"})["action"][-1], 0.0)
    assert close(first("bc_z")["action"], [*row[:3], *row[:3], 0.0])
    assert close(first("furniture", {"action": "array(1D, 2D, 3D, 0D, 0D, sqrt(0.5D), sqrt(0.5D), -4D)"})["action"], [1, 2, 3, 0, 0, math.pi / 2, 1.0])
    assert close(first("last_seven")["action"], row[3:]) and close(first("drop_last")["action"], row[:-1])
    assert close(first("language_table", {"action": "array(1D, 2D)"})["action"], [1, 2, 0, 0, 0, 0, 1])
    assert close(first("libero", {"action": "array(1D, 2D, 3D, 4D, 5D, 6D, -1D)"})["action"], [1, 2, 3, 4, 5, 6, 1.0])
    assert close(first("robo_net")["proprio"], [*row[:4], 0, 0, row[9]]) and close(first("robo_net")["action"], [*row[:4], 0, 0, row[9]])


def test_episode_scans_of_recipes(spark):
    closed = {"action.gripper_closedness_action": "array(CASE WHEN t = 1 THEN 0.5D WHEN t = 3 THEN -0.5D ELSE 0D END)"}
    assert [r["action"][-1] for r in run(spark, "rt1", closed, 5)] == [1.0, 0.0, 0.0, 1.0, 1.0]
    grip = {"action": "array(1D, 2D, 3D, 4D, 5D, 6D, CASE WHEN t = 2 THEN 0D WHEN t = 3 THEN 0.99D ELSE 0.5D END)"}
    got = run(spark, "cartesian_tool", grip, 5)
    assert [r["action"][-1] for r in got] == [0.0, 0.0, 0.0, 1.0, 0.5] and all(close(r["action"][:6], [1, 2, 3, 4, 5, 6]) for r in got)
    moved = {"observation.state": "transform(sequence(0, 9), i -> double(t * t) + i)", "action.world_vector": "array(9D, 9D, 9D)", "action.rotation_delta": "array(9D, 9D, 9D)"}
    got = run(spark, "bridge_oxe", moved, 5)  # without the first step, differences of t * t, without the last step
    assert [(r["t"], r["action"]) for r in got] == [(0, [3.0] * 6 + [1.0]), (1, [5.0] * 6 + [1.0]), (2, [7.0] * 6 + [1.0])]
    got = run(spark, "bridge_speech", moved, 3)
    assert [(r["t"], r["action"][0]) for r in got] == [(0, 1.0), (1, 3.0)]


def test_cameras_change_places_by_episode(spark):
    df = raw(spark, "droid").drop("traj_id").crossJoin(spark.range(40).select(F.col("id").alias("traj_id")))
    out = RC.standardize_mixture(df, {"x": "droid"}, keep=["observation.exterior_image_1_left", "observation.exterior_image_2_left"])
    got = {}
    for r in out.collect():
        got.setdefault(r["traj_id"], set()).add((r["observation.exterior_image_1_left"], r["observation.exterior_image_2_left"]))
    assert all(len(v) == 1 for v in got.values()) and set().union(*got.values()) == {("one", "two"), ("two", "one")}


def test_names_and_errors(spark):
    assert len(RC.DATASETS) == 123 and set(RC.DATASETS.values()) == set(RC.RECIPES)
    with pytest.raises(ValueError, match="no standardization recipe for dataset nowhere"):
        RC.standardize_mixture(raw(spark, "libero"), ["nowhere"])
    with pytest.raises(Exception, match="no standardization recipe for dataset x"):
        RC.standardize_mixture(raw(spark, "libero"), ["libero_10_no_noops"]).collect()


def test_one_plan_gives_what_each_dataset_gives_alone(spark):
    frames = T.raw_datasets(spark, SF_SMALL)
    mixed = RC.standardize_mixture(RC.raw_mixture(frames), T.RAW_DATASETS, keep=["event_id"]).collect()
    for name, df in frames.items():
        alone = RC.standardize_mixture(RC.raw_mixture({name: df}), [name], keep=["event_id"]).collect()
        key = ["traj_id", "t", "action", "proprio", "language_instruction", "event_id"]
        assert sorted(repr([r[c] for c in key]) for r in alone) == sorted(repr([r[c] for c in key]) for r in mixed if r["dataset_name"] == name)


def test_a_configuration_runs_its_recipe(spark):
    raw_libero = T.raw_datasets(spark, SF_SMALL)["libero_spatial_no_noops"]
    rows = [("libero_spatial_no_noops", "EEF_POS", {"primary": "observation.image", "wrist": None}, {}, ["observation.state"]), ("ds0", "EEF_POS", {"primary": "image"}, {}, [])]
    table = P.config_table(spark.createDataFrame(rows, "dataset_name string, action_encoding string, image_views map<string,string>, depth_views map<string,string>, state_columns array<string>"), views=("primary",))
    out = P.apply_config(raw_libero, P.config_for("libero_spatial_no_noops", table))
    alone = RC.standardize_mixture(RC.raw_mixture({"libero_spatial_no_noops": raw_libero}), ["libero_spatial_no_noops"])
    key = ["traj_id", "t", "action", "proprio", "language_instruction"]
    assert sorted(repr([r[c] for c in key]) for r in out.collect()) == sorted(repr([r[c] for c in key]) for r in alone.collect())
    assert out.select("image_primary").where("image_primary <> ''").count() > 0 and out.first()["absolute_action_mask"] == [False] * 6 + [True]
    assert P.config_for("ds0", table).standardize_fn is None
    with pytest.raises(ValueError, match="not found: image"):
        P.apply_config(raw_libero, P.config_for("ds0", table))


def test_batch_transform_by_dataset(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "dataset_name string, x int")
    out = PL.transformed(df, {"y": lambda c: c["x"] + 1, "z": {"a": lambda c: c["x"] * 10, "*": lambda c: -c["x"]}, "w": {"b": lambda c: c["x"]}})
    assert [(r["y"], r["z"], r["w"]) for r in sorted(out.collect(), key=lambda r: r["x"])] == [(2, 10, None), (3, -2, 2), (4, -3, None)]


def test_registry_tables(spark):
    a, b = (spark.createDataFrame([(n,) for n in names], "name string") for names in (["x", "y", "y"], ["y", "z"]))
    assert {tuple(r) for r in RG.registry_difference(a, b, "name", "left", "right").collect()} == {("x", "left"), ("z", "right")}
    rows = spark.createDataFrame([("k", "u"), ("k", None), ("m", "v"), ("m", "u")], "key string, v string")
    assert {tuple(r) for r in RG.missing_values(rows, ["key"], "v", ["v", "u"]).collect()} == {("k", "v"), ("m", "")}
    u = RG.union_datasets([a.withColumn("n", F.lit(1)), b], ["name", "n"])
    assert u.count() == 5 and u.where("n IS NULL").count() == 2
