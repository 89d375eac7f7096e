"""ST1 for whole mixtures: standardizer recipes as a table of column expressions.

A raw mixture is one frame: every dataset keeps the column names of its source, nested ones
written with a dot (``action.world_vector``, ``observation.state``), null in the rows of other
datasets.  A recipe says in SQL which columns make up the action, the state fields and the
instruction, and which episode scans it needs.  ``standardize_mixture`` compiles the recipes of
all datasets into one plan: each scan runs once over the whole frame, on the rows whose recipe
asks for it, and one ``CASE`` over the dataset names picks the expressions.  No loop over
datasets, no union, and one partitioning by episode blocks for all of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from episodic.functions import rotation as RT
from episodic.functions import text as X
from episodic.functions.rand import u01
from episodic.operators import episodes as E


@dataclass(frozen=True)
class Recipe:
    """Expressions over the source's columns.  Inside them ``_binary`` is the binarized gripper
    (W6) of ``binarize``, ``_absolute`` the absolute one (W7) of ``rel2abs``, ``_euler`` the angles
    (M12) of the quaternion ``euler``."""

    action: str = "`action`"
    fields: Mapping[str, str] = field(default_factory=dict)  # state fields by name
    proprio: Sequence[str] = ()  # the fields that make up proprio
    language: str = "`language_instruction`"
    codepoints: bool = False  # the instruction is a list of code points (X5)
    drop_first: bool = False  # F6
    relabel: str | None = None  # W8: actions become differences of this state
    binarize: str | None = None
    rel2abs: str | None = None
    euler: str | None = None
    swap: tuple[str, str] | None = None  # M18: cameras that change places by episode


def _zeros(x: str) -> str:
    return f"transform({x}, v -> 0D)"


def _invert(x: str) -> str:
    return f"transform({x}, v -> 1D - v)"


def _clip(x: str) -> str:
    return f"transform({x}, v -> greatest(least(v, 1D), 0D))"


def _joined(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


A, S = "`action`", "`observation.state`"
WORLD, ROTATION = "`action.world_vector`", "`action.rotation_delta`"
CLOSED, OPEN = "`action.gripper_closedness_action`", "array(double(`action.open_gripper`))"
SPOKEN = "`observation.natural_language_instruction`"
SIX, LAST = "slice(`action`, 1, 6)", "slice(`action`, -1, 1)"
ALL_BUT_LAST = "slice(`action`, 1, greatest(size(`action`) - 1, 0))"
POSE = {"EEF_state": f"slice({S}, 1, 6)", "gripper_state": f"slice({S}, -1, 1)"}
EEF = {"eef_state": f"slice({S}, 1, 6)", "gripper_state": f"slice({S}, -1, 1)"}
POSE_KEYS, EEF_KEYS = ("EEF_state", "gripper_state"), ("eef_state", "gripper_state")
_bridge = dict(action=_joined(WORLD, ROTATION, OPEN), fields=POSE, proprio=POSE_KEYS, language=SPOKEN, relabel=S)
_rt1 = dict(action=_joined(WORLD, ROTATION, "array(_absolute)"), language=SPOKEN)
_flipped = _joined(SIX, _invert(_clip(LAST)))
_four = dict(action=_joined("slice(`action`, 1, 4)", _zeros("slice(`action`, 1, 2)"), LAST), proprio=EEF_KEYS)
_tool = {"EEF_state": "slice(`observation.cartesian_position`, 1, 6)", "gripper_state": "slice(`observation.gripper_position`, -1, 1)"}
VELOCITY = "`action_dict.cartesian_velocity`"
DROID_STATE = {"proprio": "concat(`observation.cartesian_position`, `observation.gripper_position`)"}
DROID_CAMERAS = ("observation.exterior_image_1_left", "observation.exterior_image_2_left")

#: Recipes by their own name; slices, primitives and column names are fixed values of the sources.
RECIPES: dict[str, Recipe] = {
    "identity": Recipe(),
    "bridge_oxe": Recipe(**_bridge, drop_first=True),
    "bridge_speech": Recipe(**_bridge),
    "bridge_orig": Recipe(_joined(SIX, "array(_binary)"), POSE, POSE_KEYS, drop_first=True, relabel=S, binarize="element_at(`action`, -1)"),
    "cartesian_tool": Recipe(_joined(SIX, "array(_binary)"), _tool, POSE_KEYS, binarize="element_at(`action`, -1)"),
    "rt1": Recipe(**_rt1, rel2abs=f"element_at({CLOSED}, 1)"),
    "taco_play": Recipe(_joined("slice(`action.rel_actions_world`, 1, 6)", _clip("slice(`action.rel_actions_world`, -1, 1)")),
                        {"state_eef": "slice(`observation.robot_obs`, 1, 6)", "state_gripper": "slice(`observation.robot_obs`, 8, 1)"}, ("state_eef", "state_gripper"), SPOKEN),
    "jaco_play": Recipe(_joined(WORLD, _zeros(WORLD), "array(_absolute)"),
                        {"state_eef": "slice(`observation.end_effector_cartesian_pos`, 1, 6)", "state_gripper": "slice(`observation.end_effector_cartesian_pos`, -1, 1)"},
                        ("state_eef", "state_gripper"), SPOKEN, rel2abs=f"element_at({CLOSED}, 1)"),
    "cable_routing": Recipe(_joined(WORLD, ROTATION, _zeros(f"slice({WORLD}, 1, 1)")), language=SPOKEN),
    "roboturk": Recipe(_joined(WORLD, ROTATION, _invert(_clip(CLOSED))), language=SPOKEN),
    "viola": Recipe(_joined(WORLD, ROTATION, _invert(_clip(f"array({CLOSED})"))), language=SPOKEN),
    "autolab_ur5": Recipe(**_rt1, fields={"state": "slice(`observation.robot_state`, 7, 8)", "depth": "`observation.image_with_depth`"}, proprio=("state",), rel2abs=CLOSED),
    "toto": Recipe(_joined(WORLD, ROTATION, OPEN), language=SPOKEN),
    "language_table": Recipe(_joined(A, _zeros(A), _zeros(A), "array(1D)"), language="`observation.instruction`", codepoints=True),
    "pusht": Recipe(_joined(WORLD, ROTATION, f"array({CLOSED})"), language=SPOKEN),
    "stanford_kuka": Recipe(_joined("slice(`action`, 1, 3)", _zeros("slice(`action`, 1, 3)"), LAST)),
    "nyu_rot": Recipe("slice(`action`, 1, 7)", EEF, EEF_KEYS),
    "hydra": Recipe(_joined(SIX, _invert(LAST)), {"eef_state": f"concat(slice({S}, 1, 3), slice({S}, 8, 3))", "gripper_state": f"slice({S}, -3, 1)"}, EEF_KEYS),
    "eight_state": Recipe(_flipped, {"state": f"slice({S}, 1, 8)"}, ("state",)),
    "flipped": Recipe(_flipped),
    "nyu_franka": Recipe(_joined("slice(`action`, -8, 6)", _clip("slice(`action`, -2, 1)")), {"eef_state": f"slice({S}, -6, 6)"}, ("eef_state",)),
    "maniskill": Recipe(fields={"gripper_state": f"slice({S}, 8, 1)"}, proprio=("gripper_state",)),
    "furniture": Recipe(_joined("slice(`action`, 1, 3)", "_euler", _invert(_clip(LAST))), {"state": f"concat(slice({S}, 1, 7), slice({S}, -1, 1))"}, ("state",), euler="slice(`action`, 4, 4)"),
    "drop_last": Recipe(ALL_BUT_LAST),
    "drop_last_eef": Recipe(ALL_BUT_LAST, EEF, EEF_KEYS),
    "ucsd_kitchen": Recipe(ALL_BUT_LAST, {"joint_state": f"slice({S}, 1, 7)"}, ("joint_state",)),
    "ucsd_pick_place": Recipe(_joined("slice(`action`, 1, 3)", _zeros("slice(`action`, 1, 3)"), LAST), EEF, EEF_KEYS),
    "bc_z": Recipe(_joined("slice(`action.future/xyz_residual`, 1, 3)", "slice(`action.future/axis_angle_residual`, 1, 3)",
                           _invert("transform(slice(`action.future/target_close`, 1, 1), v -> double(v))")), language=SPOKEN),
    "last_seven": Recipe("slice(`action`, -7, 7)"),
    "robo_net": Recipe(**_four, fields={"eef_state": f"concat(slice({S}, 1, 4), {_zeros(f'slice({S}, 1, 2)')})", "gripper_state": f"slice({S}, -1, 1)"}),
    "mask_vit": Recipe(**_four, fields={"eef_state": f"concat(slice(`observation.end_effector_pose`, 1, 4), {_zeros('slice(`observation.end_effector_pose`, 1, 2)')})",
                                        "gripper_state": "slice(`observation.end_effector_pose`, -1, 1)"}),
    "kaist": Recipe(_joined(SIX, _zeros("slice(`action`, 1, 1)")), {"state": f"slice({S}, -7, 7)"}, ("state",)),
    "eef": Recipe(fields=EEF, proprio=EEF_KEYS),
    "six_state": Recipe(fields={"state": f"slice({S}, 1, 6)"}, proprio=("state",)),
    "edan": Recipe(_joined(SIX, _invert(LAST))),
    "asu": Recipe(fields={"eef_state": "`ground_truth_states.EE`", "gripper_state": f"slice({S}, -1, 1)"}, proprio=EEF_KEYS),
    "iamlab": Recipe(_joined("slice(`action`, 1, 3)", "_euler", "slice(`action`, 8, 1)"), {"joint_state": f"slice({S}, 1, 7)", "gripper_state": f"slice({S}, 8, 1)"},
                     ("joint_state", "gripper_state"), euler="slice(`action`, 4, 4)"),
    "d3field": Recipe(_joined(A, _zeros(A), _zeros("slice(`action`, 1, 1)"))),
    "fanuc": Recipe(_joined(A, _invert(f"slice({S}, 7, 1)")), {"joint_state": f"slice({S}, 1, 6)", "gripper_state": f"slice({S}, 7, 1)"}, ("joint_state", "gripper_state")),
    "playing_with_food": Recipe(_joined("slice(`action`, 1, 3)", "_euler", LAST), euler="slice(`action`, 4, 4)"),
    "play_fusion": Recipe(_joined("slice(`action`, 1, 3)", "slice(`action`, -4, 4)")),
    "stretch": Recipe(ALL_BUT_LAST, {"eef_state": f"concat(slice({S}, 1, 3), {_zeros(f'slice({S}, 1, 3)')})", "gripper_state": f"slice({S}, -1, 1)"}, EEF_KEYS),
    "gnm": Recipe(_joined(A, _zeros(A), _zeros(A), _zeros("slice(`action`, 1, 1)")),
                  {"state": f"concat(`observation.position`, {_zeros(f'slice({S}, 1, 3)')}, `observation.yaw`)"}, ("state",)),
    "fmb": Recipe(fields={"proprio": "concat(`observation.eef_pose`, array(double(`observation.state_gripper_pose`)))"}, proprio=("proprio",)),
    "dobbe": Recipe(fields={"proprio": S}, proprio=("proprio",)),
    "roboset": Recipe(_joined("slice(`action`, 1, 7)", _invert(_clip(LAST))), {"proprio": S}, ("proprio",)),
    "rh20t": Recipe(_joined("`action.tcp_base`", "array(double(`action.gripper`))"),
                    {"proprio": "concat(`observation.tcp_base`, array(double(`observation.gripper_width`)))"}, ("proprio",)),
    "droid": Recipe(_joined(f"slice({VELOCITY}, 1, 3)", f"slice({VELOCITY}, 4, 3)", _invert("`action_dict.gripper_position`")), DROID_STATE, ("proprio",), swap=DROID_CAMERAS),
    "droid_finetuning": Recipe(_joined(f"slice({VELOCITY}, 1, 3)", f"slice({VELOCITY}, 4, 3)", _invert("`action_dict.gripper_position`")), DROID_STATE, ("proprio",)),
    "libero": Recipe(_flipped, {"EEF_state": f"slice({S}, 1, 6)", "gripper_state": f"slice({S}, -2, 2)"}, POSE_KEYS),
}

#: Kinds of spoken instructions that a source exists for.
SPEECH = ("events", "sentiment", "overlap", "identity", "two", "three")
_EXTERNAL = "_dataset_converted_externally_to_rlds"
_CONVERTED = "_converted_externally_to_rlds"

#: Dataset names by recipe: fixed values.
DATASETS: dict[str, str] = {name: recipe for recipe, names in {
    "ucsd_kitchen": ["augmented_rlds", "ucsd_kitchen" + _EXTERNAL, *[f"ucsd_kitchen_{k}" for k in SPEECH]],
    "bridge_speech": [*[f"bridge_{k}" for k in SPEECH], "bridge_one"],
    "bridge_oxe": ["bridge_oxe"],
    "bridge_orig": ["bridge_orig", "bridge_dataset"],
    "cartesian_tool": ["ppgm", "ppgm_static", "ppgm_wrist", "tdroid_carrot_in_bowl", "tdroid_pour_corn_in_pot", "tdroid_flip_pot_upright",
                       "tdroid_move_object_onto_plate", "tdroid_knock_object_over", "tdroid_cover_object_with_towel"],
    "rt1": ["fractal20220817_data", "kuka", "nyu_door_opening_surprising_effectiveness", *[f"fractal_{k}" for k in SPEECH]],
    "taco_play": ["taco_play"],
    "jaco_play": ["jaco_play", *[f"jaco_play_{k}" for k in SPEECH]],
    "cable_routing": ["berkeley_cable_routing"],
    "roboturk": ["roboturk"],
    "viola": ["viola"],
    "autolab_ur5": ["berkeley_autolab_ur5"],
    "toto": ["toto"],
    "language_table": ["language_table"],
    "pusht": ["columbia_cairlab_pusht_real"],
    "stanford_kuka": ["stanford_kuka_multimodal" + _EXTERNAL],
    "nyu_rot": ["nyu_rot" + _EXTERNAL],
    "hydra": ["stanford_hydra" + _EXTERNAL],
    "eight_state": ["austin_buds" + _EXTERNAL, "utaustin_mutex"],
    "flipped": ["austin_sailor" + _EXTERNAL, "austin_sirius" + _EXTERNAL],
    "nyu_franka": ["nyu_franka_play" + _EXTERNAL],
    "maniskill": ["maniskill" + _EXTERNAL],
    "furniture": ["furniture_bench" + _EXTERNAL],
    "drop_last": ["cmu_franka_exploration" + _EXTERNAL, "imperialcollege_sawyer_wrist_cam"],
    "ucsd_pick_place": ["ucsd_pick_and_place" + _EXTERNAL],
    "bc_z": ["bc_z"],
    "drop_last_eef": ["utokyo_pr2_opening_fridge" + _CONVERTED, "utokyo_pr2_tabletop_manipulation" + _CONVERTED],
    "identity": ["utokyo_xarm_pick_and_place" + _CONVERTED, "berkeley_mvp" + _CONVERTED, "berkeley_rpt" + _CONVERTED, "dlr_sara_pour" + _CONVERTED],
    "last_seven": ["utokyo_xarm_bimanual" + _CONVERTED],
    "robo_net": ["robo_net"],
    "kaist": ["kaist_nonprehensile" + _CONVERTED],
    "mask_vit": ["stanford_mask_vit" + _CONVERTED],
    "eef": ["tokyo_u_lsmo" + _CONVERTED, "stanford_robocook" + _CONVERTED],
    "six_state": ["dlr_sara_grid_clamp" + _CONVERTED],
    "edan": ["dlr_edan_shared_control" + _CONVERTED],
    "asu": ["asu_table_top" + _CONVERTED],
    "iamlab": ["iamlab_cmu_pickup_insert" + _CONVERTED],
    "d3field": ["uiuc_d3field"],
    "fanuc": ["berkeley_fanuc_manipulation"],
    "playing_with_food": ["cmu_playing_with_food"],
    "play_fusion": ["cmu_play_fusion"],
    "stretch": ["cmu_stretch"],
    "gnm": ["berkeley_gnm_recon", "berkeley_gnm_cory_hall", "berkeley_gnm_sac_son"],
    "droid": ["droid"],
    "fmb": ["fmb_dataset"],
    "dobbe": ["dobbe"],
    "roboset": ["roboset"],
    "rh20t": ["rh20t"],
    "droid_finetuning": ["droid_wipe"],
    "libero": [*[f"libero_{k}_no_noops" for k in ("spatial", "object", "goal", "10")],
               *[f"libero_speech_{part}_{k}" for part in ("spatial", "object", "goal") for k in SPEECH], *[f"libero_speech10_{k}" for k in SPEECH]],
}.items() for name in names}


def flat(df: DataFrame) -> DataFrame:
    """``df`` with the fields of its struct columns as columns of their own, names joined by dots."""

    def leaves(kind: StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = []
        for f in kind.fields:
            out += leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, StructType) else [(*path, f.name)]
        return out

    paths = leaves(df.schema, ())
    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in paths])


def raw_mixture(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One frame of raw steps: ``frames`` by dataset name, flattened, each row with its
    ``dataset_name``, and null where another dataset has a column of its own."""
    parts = [flat(f).withColumn("dataset_name", F.lit(name)) for name, f in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _by_recipe(used: Mapping[str, list[str]], pick) -> Column | None:
    """CASE over the dataset names of each recipe that ``pick`` gives an expression for."""
    out = None
    for recipe, names in used.items():
        c = pick(RECIPES[recipe])
        if c is not None:
            here = F.col("dataset_name").isin(names)
            out = F.when(here, c) if out is None else out.when(here, c)
    return out


def standardize_mixture(df: DataFrame, datasets: Sequence[str] | Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """The steps of a raw mixture in one schema: dataset_name, traj_id, t, action, proprio (null
    where a recipe names no state fields), language_instruction and the columns ``keep``.

    ``datasets``: names of ``DATASETS``, or a mapping from names to recipes.  A name without
    recipe, a row of another dataset and a missing source column are errors."""
    chosen = dict(datasets) if isinstance(datasets, Mapping) else {}
    if not chosen:
        unknown = [n for n in datasets if n not in DATASETS]
        if unknown:
            raise ValueError(f"no standardization recipe for dataset {', '.join(sorted(unknown))}")
        chosen = {n: DATASETS[n] for n in datasets}
    used: dict[str, list[str]] = {}
    for name, recipe in chosen.items():
        used.setdefault(recipe, []).append(name)

    lost = F.raise_error(F.concat(F.lit("no standardization recipe for dataset "), F.col("dataset_name")))
    known = F.col("dataset_name").isin(list(chosen))
    df = df.withColumn("dataset_name", F.when(known, F.col("dataset_name")).otherwise(lost))

    first = _by_recipe(used, lambda r: F.lit(1) if r.drop_first else None)
    if first is not None:
        shift = F.coalesce(first, F.lit(0))
        df = E.invalidate(df).where(F.col("t") >= shift).withColumn("t", F.col("t") - shift)
    binary = _by_recipe(used, lambda r: F.expr(r.binarize).cast("double") if r.binarize else None)
    if binary is not None:
        df = E.binarize_gripper_df(df.withColumn("_gripper", binary), "_gripper", "_binary")
    absolute = _by_recipe(used, lambda r: F.expr(r.rel2abs).cast("double") if r.rel2abs else None)
    if absolute is not None:
        df = E.rel2abs_gripper_df(df.withColumn("_closed", absolute), "_closed", "_absolute")
    euler = _by_recipe(used, lambda r: F.expr(r.euler) if r.euler else None)
    if euler is not None:
        df = df.withColumn("_quaternion", euler).withColumn("_euler", RT.quat_to_euler("_quaternion"))
    for cameras in {RECIPES[r].swap for r in used if RECIPES[r].swap}:
        names = [n for r, ns in used.items() if RECIPES[r].swap == cameras for n in ns]
        change = F.col("dataset_name").isin(names) & ~(u01(0, *E.EPISODE) > 0.5)  # M18: one draw an episode
        x, y = (F.col(f"`{c}`") for c in cameras)
        df = df.withColumns({cameras[0]: F.when(change, y).otherwise(x), cameras[1]: F.when(change, x).otherwise(y)})

    action = _by_recipe(used, lambda r: F.expr(r.action).cast("array<double>"))
    state = _by_recipe(used, lambda r: F.concat(*[F.expr(r.fields[k]).cast("array<double>") for k in r.proprio]) if r.proprio else None)
    spoken = _by_recipe(used, lambda r: X.codepoints_to_text(F.expr(r.language)) if r.codepoints else F.expr(r.language))
    moved = _by_recipe(used, lambda r: F.expr(r.relabel).cast("array<double>") if r.relabel else None)
    df = df.withColumns({"_action": action, "_language": spoken, "_state": state if state is not None else F.lit(None).cast("array<double>")})
    if moved is not None:
        df = _relabelled(df.withColumn("_moved", moved))
    return df.select(*E.EPISODE, "t", F.col("_action").alias("action"), F.col("_state").alias("proprio"), F.col("_language").alias("language_instruction"),
                     *[F.col(f"`{c}`") for c in keep], *([E.BLK] if E.BLK in df.columns else []))


def _relabelled(df: DataFrame) -> DataFrame:
    """W8 on the rows with ``_moved``: the action is the difference to the next state, the gripper
    stays, and the episode's last step goes; other rows are left as they are."""
    n, agg = E.ep_n()
    df = E.attach_episode(df, {n: agg})
    at = {"_moved": 1}
    df = E.attach_neighbors(df, at, {})
    df = df.withColumn("_next", E._gather("_moved", 1, E.episode_window(), 1, 0, E.block_rows(df)))
    mine = F.col("_moved").isNotNull()
    delta = F.concat(F.zip_with(F.slice("_next", 1, 6), F.slice("_moved", 1, 6), lambda a, b: a - b), F.slice("_action", -1, 1))
    df = df.withColumn("_action", F.when(mine, delta).otherwise(F.col("_action")))
    return E.invalidate(df.where(~mine | (F.col("t") < F.col(n) - 1)))
