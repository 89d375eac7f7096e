"""Projection / restructuring operators (P1-P20) and dataset configuration.

All are column selections and expressions, so Catalyst prunes unused raw columns
down to the parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodic.functions import text as X
from episodic.operators import recipes as RC
from episodic.operators.standardize import REGISTRY

# Fixed encodings (values as in the source configuration).
STATE_ENCODINGS = {"NONE": -1, "POS_EULER": 1, "POS_QUAT": 2, "JOINT": 3, "JOINT_BIMANUAL": 4}
ACTION_ENCODINGS = {"EEF_POS": 1, "JOINT_POS": 2, "JOINT_POS_BIMANUAL": 3, "EEF_R6": 4}


# --------------------------------------------------------------------- P1 / P2
def map_cols(df: DataFrame, mapping: Mapping[str, str | None], prefix: str) -> DataFrame:
    """``{new: old}`` -> ``<prefix><new>``; ``None`` gives '' padding."""
    for new, old in mapping.items():
        df = df.withColumn(prefix + new, F.lit("") if old is None else F.col(old))
    return df


# --------------------------------------------------------------------- P6 / P7 / P8 / P9
def missing_keys(df: DataFrame, required: Sequence[str]) -> list[str]:
    """U4: required minus present column names (plan-time, no job)."""
    return sorted(set(required) - set(df.columns))


def require_keys(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail before planning if a required column is missing."""
    miss = missing_keys(df, required)
    if miss:
        raise ValueError(f"required columns not found: {', '.join(miss)}")
    return df


def extract_language(df: DataFrame, key: str) -> DataFrame:
    """Move the language column into ``task``; it must be a string."""
    if dict(df.dtypes).get(key) != "string":
        raise ValueError(f"column {key!r} cannot serve as instruction: string expected, found {dict(df.dtypes).get(key)}")
    return df.withColumn("task", F.struct(F.col(key).alias("language_instruction"))).drop(key)


def with_defaults(df: DataFrame, name: str) -> DataFrame:
    """user/response/conversation default '', where the column or the value is missing;
    speech_conv is mandatory; add dataset_name."""
    if "speech_conv" not in df.columns:
        raise ValueError("steps must carry a speech_conv column")
    for c in ("user", "response", "conversation"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit(""))
    return df.withColumn("dataset_name", F.lit(name))


def with_mask(df: DataFrame, mask: Sequence[bool], action: str = "action", name: str = "absolute_action_mask") -> DataFrame:
    """Tile a per-dimension boolean mask onto every step; its length must match the action."""
    m = F.array(*[F.lit(bool(b)) for b in mask])
    check = F.when(F.size(action) == len(mask), m).otherwise(
        F.raise_error(F.lit(f"the absolute mask has {len(mask)} entries, the action another number"))
    )
    return df.withColumn(name, check)


# --------------------------------------------------------------------- P11
@dataclass
class Config:
    """Dataset configuration after P11: chosen views, masks, recipe, and the columns to read."""

    name: str
    image_obs_keys: dict[str, str | None]
    depth_obs_keys: dict[str, str | None]
    state_obs_keys: list[str | None]
    absolute_action_mask: list[bool]
    action_normalization_mask: list[bool]
    normalization_type: str
    language_key: str | None
    standardize_fn: Callable[[DataFrame], DataFrame] | None

    def columns(self) -> list[str]:
        """Raw columns the configuration needs (drives column pruning)."""
        cols = [c for c in list(self.image_obs_keys.values()) + list(self.depth_obs_keys.values()) if c]
        cols += [c for c in self.state_obs_keys if c]
        if self.language_key:
            cols.append(self.language_key)
        return cols


#: (encoding, relative dimensions, absolute dimensions) of the loadable actions: fixed values.
LOADABLE = [("EEF_POS", 6, 1), ("EEF_R6", 9, 1)]


def config_table(configs: DataFrame, views: Sequence[str] = ("primary",), depth: bool = False, proprio: bool = True,
                 language: bool = True, normalization_type: str = "normal") -> DataFrame:
    """P11 for all datasets at once: ``configs`` (dataset_name, action_encoding, image_views and
    depth_views map<view, column>, state_columns array) joined with the encodings it may use.

    Adds the absolute and the normalization mask, keeps the wanted views only, and ``problem``:
    why a dataset cannot be loaded, else null."""
    spark = configs.sparkSession
    rows = [F.struct(F.lit(e).alias("action_encoding"), F.lit(r).alias("_rel"), F.lit(n).alias("_abs")) for e, r, n in LOADABLE]
    encodings = spark.range(1).select(F.inline(F.array(*rows)))
    wanted = F.array(*[F.lit(v) for v in views])
    absent = F.array_except(wanted, F.map_keys("image_views"))

    def chosen(column: str) -> Column:
        return F.map_filter(column, lambda view, _: F.array_contains(wanted, view))

    def mask(first: bool) -> Column:
        return F.concat(F.array_repeat(F.lit(first), F.col("_rel")), F.array_repeat(F.lit(not first), F.col("_abs")))

    problem = F.when(F.col("_rel").isNull(), F.concat(F.lit("unsupported action encoding "), F.col("action_encoding"))) \
        .when(F.size(absent) > 0, F.concat(F.lit("no such view: "), F.array_join(F.array_sort(absent), ", ")))
    none = F.create_map().cast("map<string,string>")
    return configs.join(encodings, "action_encoding", "left").select(
        "dataset_name", chosen("image_views").alias("image_views"), (chosen("depth_views") if depth else none).alias("depth_views"),
        (F.col("state_columns") if proprio else F.array().cast("array<string>")).alias("state_columns"),
        mask(False).alias("absolute_action_mask"), mask(True).alias("action_normalization_mask"),
        F.lit(normalization_type).alias("normalization_type"),
        F.lit("language_instruction" if language else None).cast("string").alias("language_key"), problem.alias("problem"))


def config_for(name: str, table: DataFrame) -> Config:
    """The configuration of one dataset of a ``config_table``, with its recipe."""
    found = table.where(F.col("dataset_name") == name).head()
    if found is None:
        raise KeyError(f"dataset {name!r} is not configured")
    if found["problem"]:
        raise ValueError(f"dataset {name!r} cannot be loaded: {found['problem']}")
    return Config(name, dict(found["image_views"]), dict(found["depth_views"]), list(found["state_columns"]), list(found["absolute_action_mask"]),
                  list(found["action_normalization_mask"]), found["normalization_type"], found["language_key"], recipe_for(name))


def recipe_for(name: str) -> Callable[[DataFrame], DataFrame] | None:
    """Hook ``standardize_fn``: the recipe of a dataset name, from the recipe table (raw steps in
    the source's own columns; others are kept) or the registry of flat recipes; None for others."""
    if name in RC.DATASETS:
        made = {"dataset_name", "traj_id", "t", "action", "proprio", "language_instruction"}

        def run(df: DataFrame) -> DataFrame:
            raw = RC.flat(df).withColumn("dataset_name", F.lit(name))
            return RC.standardize_mixture(raw, [name], keep=[c for c in raw.columns if c not in made])

        return run
    return REGISTRY.get(name)


def apply_config(df: DataFrame, cfg: Config) -> DataFrame:
    """Raw steps of one dataset as its configuration asks for: its recipe, image and depth views
    as ``image_<view>`` and ``depth_<view>`` ('' where a view has no column), ``proprio`` from the
    state columns unless the recipe made it, the absolute mask on every step, and no instruction
    where the configuration has no language.  A view or state column that is missing is an error."""
    out = cfg.standardize_fn(df) if cfg.standardize_fn else df
    views = {**{"image_" + k: c for k, c in cfg.image_obs_keys.items()}, **{"depth_" + k: c for k, c in cfg.depth_obs_keys.items()}}
    require_keys(out, [c for c in [*views.values(), *cfg.state_obs_keys] if c])
    out = out.withColumns({new: F.lit("") if old is None else F.col(f"`{old}`") for new, old in views.items()})
    state = [F.col(f"`{c}`") for c in cfg.state_obs_keys if c]
    if state:
        made = F.concat(*state).cast("array<double>")
        out = out.withColumn("proprio", F.coalesce("proprio", made) if "proprio" in out.columns else made)
    if cfg.language_key is None:
        out = out.drop("language_instruction")
    return with_mask(out, cfg.absolute_action_mask)


# --------------------------------------------------------------------- P13 / P14
def struct_map(df: DataFrame, col: str, fn: Callable[[Column], Column]) -> DataFrame:
    """P13 tree_map: apply ``fn`` to every leaf of a (nested) struct column."""
    dtype = df.schema[col].dataType

    def rec(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*[rec(c[f.name], f.dataType).alias(f.name) for f in t.fields])
        return fn(c)

    return df.withColumn(col, rec(F.col(col), dtype))


def struct_merge(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """P13 tree_merge: right-biased recursive merge of two struct columns."""
    ta, tb = df.schema[a].dataType, df.schema[b].dataType

    def rec(ca: Column, ta_, cb: Column, tb_) -> Column:
        names = [f.name for f in ta_.fields] + [f.name for f in tb_.fields if f.name not in {x.name for x in ta_.fields}]
        fa = {f.name: f.dataType for f in ta_.fields}
        fb = {f.name: f.dataType for f in tb_.fields}
        parts = []
        for nme in names:
            if nme in fa and nme in fb and isinstance(fa[nme], T.StructType) and isinstance(fb[nme], T.StructType):
                parts.append(rec(ca[nme], fa[nme], cb[nme], fb[nme]).alias(nme))
            elif nme in fb:
                parts.append(cb[nme].alias(nme))
            else:
                parts.append(ca[nme].alias(nme))
        return F.struct(*parts)

    return df.withColumn(out, rec(F.col(a), ta, F.col(b), tb))


def padding_of(dtype: T.DataType) -> Column:
    """Typed padding: zero for numbers, '' for strings, else an error."""
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.NumericType):
        return None  # arrays are padded element-wise by the caller
    raise ValueError(f"no padding value is defined for {dtype.simpleString()}")


def pad_where(df: DataFrame, cond: Column, cols: Sequence[str]) -> DataFrame:
    """Replace ``cols`` with their padding where ``cond`` holds."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in cols:
        t = types[c]
        if isinstance(t, T.ArrayType):
            pad = F.transform(c, lambda v: F.lit(0).cast(t.elementType))
        else:
            pad = padding_of(t)
        df = df.withColumn(c, F.when(cond, pad).otherwise(F.col(c)))
    return df


# --------------------------------------------------------------------- P15 / P16
def to_example(df: DataFrame) -> DataFrame:
    """Frame -> (proprio, action, image of the first window slot, lower-cased language, dataset)."""
    img = F.element_at("image_chunk", 1) if "image_chunk" in df.columns else F.col("image")
    return df.select(F.col("proprio"), F.col("action"), img.alias("image"),
                     X.decode_lower("language_instruction").alias("lang"), "dataset_name")


def to_speech_example(df: DataFrame) -> DataFrame:
    """P15 plus conversation, speech, user, response, wrist and first images."""
    base = [c for c in ("proprio", "action") if c in df.columns]
    return df.select(
        *base,
        F.col("image").alias("image"),
        X.decode_lower("language_instruction").alias("lang"),
        "conversation", "speech_conv", "user", "response", "dataset_name",
        F.coalesce(F.col("image_first_frame"), F.lit("")).alias("first_image"),
        F.coalesce(F.col("image_wrist"), F.lit("")).alias("wrist_image"),
    )


def rollout_state(eef_pos, axis_angle, gripper_qpos) -> Column:
    """Concatenated evaluation state."""
    return F.concat(*[F.col(c) if isinstance(c, str) else c for c in (eef_pos, axis_angle, gripper_qpos)])
