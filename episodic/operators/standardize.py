"""ST1: per-dataset standardizers as declarative column recipes, plus a registry.

Each recipe maps a raw step frame to the common schema (``action`` and, where the
recipe defines it, ``proprio``), using only array expressions and the episode
windows of ``episodes`` (W6-W8).  Raw field names follow the source datasets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodic.functions import rotation as RT
from episodic.functions import text as X
from episodic.functions.rand import u01
from episodic.functions import vector as V
from episodic.operators import episodes as E

Recipe = Callable[[DataFrame], DataFrame]


def _sl(c: str, start: int, stop: int | None = None) -> Column:
    """Python-style slice c[start:stop] on an array column (negative = from the end)."""
    col = F.col(c)
    n = F.size(col)
    lo = F.lit(start) if start >= 0 else n + F.lit(start)
    hi = n if stop is None else (F.lit(stop) if stop >= 0 else n + F.lit(stop))
    hi = F.least(hi, n)
    lo = F.greatest(lo, F.lit(0))
    return F.slice(col, lo + 1, F.greatest(hi - lo, F.lit(0)))


def _arr(x: Column) -> Column:
    return F.array(x.cast("double"))


def bridge_oxe(df: DataFrame) -> DataFrame:
    df = E.drop_first_step(df)
    df = df.withColumn("action", F.concat("world_vector", "rotation_delta", _arr(F.col("open_gripper"))))
    df = E.state_delta(df, "state", "action")
    return df.withColumn("proprio", F.concat(_sl("state", 0, 6), _sl("state", -1)))


def bridge_orig(df: DataFrame) -> DataFrame:
    df = E.drop_first_step(df)
    df = E.binarize_gripper_df(df.withColumn("_g", F.element_at("action", -1)), "_g", "_gb")
    df = df.withColumn("action", F.concat(_sl("action", 0, 6), _arr(F.col("_gb")))).drop("_g", "_gb")
    df = E.state_delta(df, "state", "action")
    return df.withColumn("proprio", F.concat(_sl("state", 0, 6), _sl("state", -1)))


def _rel2abs(df: DataFrame) -> DataFrame:
    return E.rel2abs_gripper_df(df, "gripper_closedness_action", "_ga")


def rt1(df: DataFrame) -> DataFrame:
    df = _rel2abs(df)
    return df.withColumn("action", F.concat("world_vector", "rotation_delta", _arr(F.col("_ga")))).drop("_ga")


def taco_play(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", F.concat(_sl("robot_obs", 0, 6), _sl("robot_obs", 7, 8)))
    return df.withColumn("action", F.concat(_sl("rel_actions", 0, 6), _arr(V.clip01(F.element_at("rel_actions", -1)))))


def jaco_play(df: DataFrame) -> DataFrame:
    df = _rel2abs(df)
    return df.withColumn("action", F.concat("world_vector", V.zeros(3), _arr(F.col("_ga")))).drop("_ga")


def roboturk(df: DataFrame) -> DataFrame:
    g = V.invert(V.clip01(F.col("gripper_closedness_action")))
    return df.withColumn("action", F.concat("world_vector", "rotation_delta", _arr(g)))


def language_table(df: DataFrame) -> DataFrame:
    a = F.col("action2")
    df = df.withColumn("action", F.concat(a, F.transform(a, lambda v: F.lit(0.0)), F.transform(a, lambda v: F.lit(0.0)), V.ones(1)))
    return df.withColumn("language_instruction", X.codepoints_to_text("instruction"))


def stanford_hydra(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", F.concat(_sl("state", 0, 3), _sl("state", 7, 10), _sl("state", -3, -2)))
    return df.withColumn("action", F.concat(_sl("action", 0, 6), _arr(V.invert(F.element_at("action", -1)))))


def furniture_bench(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", F.concat(_sl("state", 0, 7), _sl("state", -1)))
    a = "action_quat"
    return df.withColumn("action", F.concat(_sl(a, 0, 3), RT.quat_to_euler(_sl(a, 3, 7)),
                                            _arr(V.invert(V.clip01(F.element_at(a, -1))))))


def cmu_stretch(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", F.concat(_sl("state", 0, 3), V.zeros(3), _sl("state", -1)))
    return df.withColumn("action", _sl("action", 0, -1))


def gnm(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", F.concat("position", V.zeros(3), "yaw"))
    a = F.col("action2")
    return df.withColumn("action", F.concat(a, F.transform(a, lambda v: F.lit(0.0)), F.transform(a, lambda v: F.lit(0.0)), V.zeros(1)))


def libero(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", F.concat(_sl("state", 0, 6), _sl("state", -2)))
    return df.withColumn("action", F.concat(_sl("action", 0, 6), _arr(V.invert(V.clip01(F.element_at("action", -1))))))


def droid_wristact(df: DataFrame) -> DataFrame:
    df = df.withColumn("action", F.concat(RT.to_wrist_frame("cartesian_velocity", "cartesian_position"), "gripper_position"))
    return df.withColumn("proprio", F.concat("cartesian_position", "gripper_position"))


def berkeley_fanuc(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", F.concat(_sl("state", 0, 6), _sl("state", 6, 7)))
    return df.withColumn("action", F.concat("action6", _arr(V.invert(F.element_at(_sl("state", 6, 7), 1)))))


def playfusion(df: DataFrame) -> DataFrame:
    return df.withColumn("action", F.concat(_sl("action_quat", 0, 3), _sl("action_quat", -4)))


def robo_net(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", F.concat(_sl("state", 0, 4), V.zeros(2), _sl("state", -1)))
    return df.withColumn("action", F.concat(_sl("action", 0, 4), V.zeros(2), _sl("action", -1)))


def rand_swap(df: DataFrame, a: str, b: str, seed: int = 0, keys=E.EPISODE) -> DataFrame:
    """One draw per episode; u > 0.5 keeps the order of the two camera columns, else swaps."""
    keep = u01(seed, *keys) > 0.5
    return df.withColumn("_keep", keep).select(
        *[c for c in df.columns if c not in (a, b)],
        F.when(F.col("_keep"), F.col(a)).otherwise(F.col(b)).alias(a),
        F.when(F.col("_keep"), F.col(b)).otherwise(F.col(a)).alias(b),
    )


def droid_baseact(df: DataFrame, seed: int = 0) -> DataFrame:
    vel = "cartesian_velocity"
    df = df.withColumn("action", F.concat(_sl(vel, 0, 3), _sl(vel, 3, 6), F.transform("gripper_position", lambda g: V.invert(g))))
    df = rand_swap(df, "exterior_image_1_left", "exterior_image_2_left", seed)
    return df.withColumn("proprio", F.concat("cartesian_position", "gripper_position"))


def droid_finetuning(df: DataFrame) -> DataFrame:
    vel = "cartesian_velocity"
    df = df.withColumn("action", F.concat(_sl(vel, 0, 3), _sl(vel, 3, 6), F.transform("gripper_position", lambda g: V.invert(g))))
    return df.withColumn("proprio", F.concat("cartesian_position", "gripper_position"))


def bridge_speech_oxe(df: DataFrame) -> DataFrame:
    df = df.withColumn("action", F.concat("world_vector", "rotation_delta", _arr(F.col("open_gripper"))))
    df = E.state_delta(df, "state", "action")
    return df.withColumn("proprio", F.concat(_sl("state", 0, 6), _sl("state", -1)))


def ppgm(df: DataFrame) -> DataFrame:
    df = E.binarize_gripper_df(df.withColumn("_g", F.element_at("action", -1)), "_g", "_gb")
    df = df.withColumn("action", F.concat(_sl("action", 0, 6), _arr(F.col("_gb")))).drop("_g", "_gb")
    return df.withColumn("proprio", F.concat(_sl("state", 0, 6), _sl("state", -1)))


tdroid = ppgm


def cable_routing(df: DataFrame) -> DataFrame:
    return df.withColumn("action", F.concat("world_vector", "rotation_delta", V.zeros(1)))


def toto(df: DataFrame) -> DataFrame:
    return df.withColumn("action", F.concat("world_vector", "rotation_delta", _arr(F.col("open_gripper"))))


def pusht(df: DataFrame) -> DataFrame:
    return df.withColumn("action", F.concat("world_vector", "rotation_delta", _arr(F.col("gripper_closedness_action"))))


def autolab_ur5(df: DataFrame) -> DataFrame:
    df = _rel2abs(df).withColumn("proprio", _sl("state", 6, 14))
    return df.withColumn("action", F.concat("world_vector", "rotation_delta", _arr(F.col("_ga")))).drop("_ga")


def sl3_z3_last(df: DataFrame) -> DataFrame:
    """stanford_kuka_multimodal, ucsd_pick_place."""
    return df.withColumn("action", F.concat(_sl("action", 0, 3), V.zeros(3), _sl("action", -1)))


def first7(df: DataFrame) -> DataFrame:
    """nyu_rot."""
    return df.withColumn("action", _sl("action", 0, 7))


def sl6_inv_clip(df: DataFrame) -> DataFrame:
    """austin_buds, austin_sailor, austin_sirius, utaustin_mutex (state = first 8)."""
    df = df.withColumn("proprio", _sl("state", 0, 8))
    return df.withColumn("action", F.concat(_sl("action", 0, 6), _arr(V.invert(V.clip01(F.element_at("action", -1))))))


def nyu_franka_play(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", _sl("state", -6))
    return df.withColumn("action", F.concat(_sl("action", -8, -2), F.transform(_sl("action", -2, -1), lambda v: V.clip01(v))))


def drop_last_dim(df: DataFrame) -> DataFrame:
    """cmu_franka_exploration, ucsd_kitchen, tokyo_pr2, imperial_wristcam."""
    return df.withColumn("action", _sl("action", 0, -1))


def last7(df: DataFrame) -> DataFrame:
    """utokyo_xarm_bimanual."""
    return df.withColumn("action", _sl("action", -7))


def kaist_nonprehensile(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", _sl("state", -7))
    return df.withColumn("action", F.concat(_sl("action", 0, 6), V.zeros(1)))


def eef_grip(df: DataFrame) -> DataFrame:
    """tokyo_lsmo, robocook, asu_table_top, maniskill-like: proprio = eef (6) + gripper (last)."""
    return df.withColumn("proprio", F.concat(_sl("state", 0, 6), _sl("state", -1)))


def dlr_sara_grid_clamp(df: DataFrame) -> DataFrame:
    return df.withColumn("proprio", _sl("state", 0, 6))


def dlr_edan(df: DataFrame) -> DataFrame:
    return df.withColumn("action", F.concat(_sl("action", 0, 6), _arr(V.invert(F.element_at("action", -1)))))


def bc_z(df: DataFrame) -> DataFrame:
    return df.withColumn("action", F.concat(_sl("world_vector", 0, 3), _sl("rotation_delta", 0, 3), _arr(V.invert(F.col("open_gripper").cast("double")))))


def quat_last(df: DataFrame) -> DataFrame:
    """iamlab_pick_insert, cmu_playing_with_food: position, quaternion -> Euler, gripper as is."""
    a = "action_quat"
    return df.withColumn("action", F.concat(_sl(a, 0, 3), RT.quat_to_euler(_sl(a, 3, 7)), _sl(a, 7, 8)))


def uiuc_d3field(df: DataFrame) -> DataFrame:
    a = F.col("world_vector")
    return df.withColumn("action", F.concat(a, F.transform(a, lambda v: F.lit(0.0)), V.zeros(1)))


def fmb(df: DataFrame) -> DataFrame:
    return df.withColumn("proprio", F.concat(_sl("state", 0, 6), F.array("gripper_position")[0]))


def dobbe(df: DataFrame) -> DataFrame:
    return df.withColumn("proprio", F.col("state"))


def roboset(df: DataFrame) -> DataFrame:
    df = df.withColumn("proprio", F.col("state"))
    a = "action_quat"
    return df.withColumn("action", F.concat(_sl(a, 0, 7), _arr(V.invert(V.clip01(F.element_at(a, -1))))))


def rh20t(df: DataFrame) -> DataFrame:
    df = df.withColumn("action", F.concat(_sl("state", 0, 6), _arr(F.col("open_gripper"))))
    return df.withColumn("proprio", F.concat(_sl("state", 0, 6), _sl("state", -1)))


def identity(df: DataFrame) -> DataFrame:
    return df


REGISTRY: dict[str, Recipe] = {
    "bridge_oxe": bridge_oxe,
    "bridge_orig": bridge_orig,
    "bridge_dataset": bridge_orig,
    "fractal20220817_data": rt1,
    "taco_play": taco_play,
    "jaco_play": jaco_play,
    "roboturk": roboturk,
    "language_table": language_table,
    "stanford_hydra_dataset_converted_externally_to_rlds": stanford_hydra,
    "furniture_bench_dataset_converted_externally_to_rlds": furniture_bench,
    "cmu_stretch": cmu_stretch,
    "gnm_dataset": gnm,
    "libero_spatial_no_noops": libero,
    "libero_object_no_noops": libero,
    "libero_goal_no_noops": libero,
    "libero_10_no_noops": libero,
    "droid_wrist": droid_wristact,
    "berkeley_fanuc_manipulation": berkeley_fanuc,
    "cmu_play_fusion": playfusion,
    "robo_net": robo_net,
    "utokyo_xarm_pick_and_place_converted_externally_to_rlds": identity,
    "berkeley_mvp_converted_externally_to_rlds": identity,
    "berkeley_rpt_converted_externally_to_rlds": identity,
    "dlr_sara_pour_converted_externally_to_rlds": identity,
    "droid": droid_baseact,
    "droid_finetuning": droid_finetuning,
    "bridge_speech_oxe": bridge_speech_oxe,
    "ppgm": ppgm,
    "tdroid": tdroid,
    "kuka": rt1,
    "nyu_door_opening_surprising_effectiveness": rt1,
    "berkeley_cable_routing": cable_routing,
    "viola": roboturk,
    "berkeley_autolab_ur5": autolab_ur5,
    "toto": toto,
    "columbia_cairlab_pusht_real": pusht,
    "stanford_kuka_multimodal_dataset_converted_externally_to_rlds": sl3_z3_last,
    "ucsd_pick_and_place_dataset_converted_externally_to_rlds": sl3_z3_last,
    "nyu_rot_dataset_converted_externally_to_rlds": first7,
    "austin_buds_dataset_converted_externally_to_rlds": sl6_inv_clip,
    "austin_sailor_dataset_converted_externally_to_rlds": sl6_inv_clip,
    "austin_sirius_dataset_converted_externally_to_rlds": sl6_inv_clip,
    "utaustin_mutex": sl6_inv_clip,
    "nyu_franka_play_dataset_converted_externally_to_rlds": nyu_franka_play,
    "maniskill_dataset_converted_externally_to_rlds": eef_grip,
    "cmu_franka_exploration_dataset_converted_externally_to_rlds": drop_last_dim,
    "ucsd_kitchen_dataset_converted_externally_to_rlds": drop_last_dim,
    "tokyo_u_lsmo_converted_externally_to_rlds": eef_grip,
    "robocook": eef_grip,
    "asu_table_top_converted_externally_to_rlds": eef_grip,
    "utokyo_pr2_opening_fridge_converted_externally_to_rlds": drop_last_dim,
    "utokyo_pr2_tabletop_manipulation_converted_externally_to_rlds": drop_last_dim,
    "imperial_wrist_cam": drop_last_dim,
    "utokyo_xarm_bimanual_converted_externally_to_rlds": last7,
    "kaist_nonprehensile_converted_externally_to_rlds": kaist_nonprehensile,
    "dlr_sara_grid_clamp_converted_externally_to_rlds": dlr_sara_grid_clamp,
    "dlr_edan_shared_control_converted_externally_to_rlds": dlr_edan,
    "bc_z": bc_z,
    "iamlab_cmu_pickup_insert_converted_externally_to_rlds": quat_last,
    "cmu_playing_with_food": quat_last,
    "uiuc_d3field": uiuc_d3field,
    "fmb_dataset": fmb,
    "dobbe": dobbe,
    "roboset": roboset,
    "rh20t": rh20t,
}


def standardize(df: DataFrame, dataset: str) -> DataFrame:
    """Dispatch on the registry; an unknown dataset is an error."""
    if dataset not in REGISTRY:
        raise ValueError(f"no standardization recipe for dataset {dataset}")
    return df.transform(REGISTRY[dataset])
