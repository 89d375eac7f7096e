"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables through ``episodic.sources.tables`` views and runs
the library operators over whole tables; outputs are scalar columns (long format) with
the same names as the oracle SQL in ``episodic.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodic.operators import episodes as E
from episodic.operators import normalize as N
from episodic.operators import registry as RG
from episodic.operators import stats as S
from episodic.plans.common import explode_chunk, r6
from episodic.functions.rand import u01
from episodic.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def _stats_struct(st: DataFrame, **kw) -> DataFrame:
    return S.stats_struct(S.dataset_stats(st, **kw))


# ----------------------------------------------------------------------------- sources
@query("steps_view")
def q_steps_view(spark, d):
    st = E.with_traj_len(T.steps(spark, d))
    return st.select(
        "dataset_name", "traj_id", F.col("t").cast("bigint").alias("t"), "event_id", "image", "language_instruction",
        r6("gripper").alias("gripper"), r6("rel_gripper").alias("rel_gripper"), F.col("traj_len").cast("bigint").alias("traj_len"),
    )


# ----------------------------------------------------------------------------- statistics
@query("dataset_stats")
def q_dataset_stats(spark, d):
    s = S.dataset_stats(T.steps(spark, d))
    return s.select("dataset_name", "field", F.col("dim").cast("bigint").alias("dim"),
                    *[r6(c).alias(c) for c in ("mean", "std", "max", "min", "q01", "q99")])


@query("dataset_counts")
def q_dataset_counts(spark, d):
    return S.dataset_counts(T.steps(spark, d))


# ----------------------------------------------------------------------------- flagship
def normalize_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Training default: stats -> normalize (bounds_q99 + zero unused dims) -> chunk (W=1, F=5)."""
    st = T.steps(spark, d)
    stats = _stats_struct(st)
    normed = N.normalize(st.select("dataset_name", "traj_id", "t", "action", "proprio"), stats, "bounds_q99")
    chunked = E.chunk_action(normed, window=1, future=5)
    out = explode_chunk(chunked, ["dataset_name", "traj_id", "t"], "action_chunk")
    return out.withColumn("t", F.col("t").cast("bigint"))


query("normalize_chunk")(normalize_chunk)


def _chunk_sums(ex: DataFrame) -> DataFrame:
    """Chunk values in long form, as sums by episode, slot and dimension."""
    return ex.groupBy("dataset_name", "traj_id", "slot", "dim").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"), r6(F.sum(F.col("value") * (F.col("t") + 1))).alias("weighted"))


# ----------------------------------------------------------------------------- sequence operators
EP = ["dataset_name", "traj_id"]
ABS_MASK_EEF = [False] * 6 + [True]  # EEF_POS: position/rotation relative, gripper absolute


def _keys_t(df):
    return df.select(*EP, F.col("t").cast("bigint").alias("t"), *[c for c in df.columns if c not in EP + ["t"]])


@query("binarize_gripper")
def q_binarize(spark, d):
    st = E.binarize_gripper_df(T.steps(spark, d), "gripper", "value")
    return st.select(*EP, F.col("t").cast("bigint").alias("t"), r6("value").alias("value"))


@query("rel2abs_gripper")
def q_rel2abs(spark, d):
    st = E.rel2abs_gripper_df(T.steps(spark, d), "rel_gripper", "value")
    return st.select(*EP, F.col("t").cast("bigint").alias("t"), r6("value").alias("value"))


@query("state_delta")
def q_state_delta(spark, d):
    st = E.state_delta(T.steps(spark, d), "state", "action")
    out = st.select(*EP, "t", F.posexplode("action").alias("dim", "v"))
    return out.select(*EP, F.col("t").cast("bigint").alias("t"), F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value"))


@query("chunk_obs")
def q_chunk_obs(spark, d):
    st = E.chunk_obs(T.steps(spark, d), ["image"], window=3)
    out = st.select(*EP, "t", F.posexplode(F.arrays_zip(F.col("image_chunk").alias("image"), F.col("pad_mask").alias("pad"))).alias("slot", "z"))
    return out.select(*EP, F.col("t").cast("bigint").alias("t"), F.col("slot").cast("bigint").alias("slot"),
                      F.col("z.image").alias("image"), F.col("z.pad").alias("pad_mask"))


@query("chunk_action_abs")
def q_chunk_action_abs(spark, d):
    st = E.chunk_action(T.steps(spark, d).select(*EP, "t", "action"), window=2, future=3, abs_mask=ABS_MASK_EEF)
    out = explode_chunk(st, EP + ["t"], "action_chunk")
    return out.withColumn("t", F.col("t").cast("bigint"))


@query("pad_mask_dict")
def q_pad_mask_dict(spark, d):
    st = E.add_pad_mask_dict(T.steps(spark, d), ["image", "language_instruction", "gripper"])
    return st.select(*EP, F.col("t").cast("bigint").alias("t"), F.col("pad_mask_dict.image").alias("image_mask"),
                     F.col("pad_mask_dict.language_instruction").alias("language_mask"), F.col("pad_mask_dict.gripper").alias("gripper_mask"))


def _episode_counts(df):
    return df.groupBy(*EP).agg(F.count(F.lit(1)).cast("bigint").alias("n_steps"))


@query("skip_unlabeled")
def q_skip_unlabeled(spark, d):
    return _episode_counts(E.skip_unlabeled(T.steps(spark, d)))


@query("max_action_filter")
def q_max_action(spark, d):
    return _episode_counts(E.max_abs_filter(T.steps(spark, d), "action", 450.0))


@query("max_proprio_filter")
def q_max_proprio(spark, d):
    return _episode_counts(E.max_abs_filter(T.steps(spark, d), "proprio", 400.0))


@query("drop_first_step")
def q_drop_first(spark, d):
    st = E.drop_first_step(T.steps(spark, d))
    return st.select(*EP, F.col("t").cast("bigint").alias("t"), "event_id")


@query("drop_last_step")
def q_drop_last(spark, d):
    st = E.drop_last_step(T.steps(spark, d))
    return st.select(*EP, F.col("t").cast("bigint").alias("t"), "event_id")


@query("traj_len")
def q_traj_len(spark, d):
    return E.traj_lengths(T.steps(spark, d))


@query("any_all_reduce")
def q_any_all(spark, d):
    return E.any_all(T.steps(spark, d), {"any_open": F.col("gripper") > 0.95, "any_big": F.exists("action", lambda v: v > 400)},
                     {"all_above": F.col("gripper") > 0.01, "all_nonneg": F.forall("state", lambda v: v >= 0)})


@query("chunk_filter")
def q_chunk_filter(spark, d):
    st = E.chunk_filter(T.steps(spark, d), F.col("language_instruction") != "")
    return st.select(*EP, F.col("t").cast("bigint").alias("t"))


# ----------------------------------------------------------------------------- randomized / ordering
from episodic.operators import frames as FR  # noqa: E402

SEED = 7


@query("goal_uniform")
def q_goal_uniform(spark, d):
    st = T.steps(spark, d).select(*EP, "t", "image")
    g = E.goal_uniform(st, SEED, ["image"])
    return g.select(*EP, F.col("t").cast("bigint").alias("t"), F.col("goal_t").cast("bigint").alias("goal_t"),
                    "goal_image", F.col("goal_pad_mask.goal_image").alias("goal_image_mask"))


@query("delete_task_conditioning")
def q_delete_task(spark, d):
    st = E.add_pad_mask_dict(T.steps(spark, d).select(*EP, "t", "image", "language_instruction"), ["language_instruction"])
    g = E.goal_uniform(st, SEED, ["image"])
    g = E.delete_task_conditioning(g, 0.5, SEED + 1, ["goal_image"], "language_instruction", "goal_t")
    return g.select(*EP, F.col("t").cast("bigint").alias("t"), F.col("goal_t").cast("bigint").alias("goal_t"),
                    "goal_image", "language_instruction", F.col("goal_pad_mask.goal_image").alias("goal_image_mask"),
                    F.col("pad_mask_dict.language_instruction").alias("language_mask"))


@query("subsample")
def q_subsample(spark, d):
    st = E.subsample(T.steps(spark, d).select(*EP, "t"), 50, SEED)
    return st.select(*EP, F.col("t").cast("bigint").alias("t"))


@query("split_train_val")
def q_split(spark, d):
    trajs = T.steps(spark, d).select(*EP).distinct()
    tr = FR.split_train_val(trajs, train=True).withColumn("split", F.lit("train"))
    va = FR.split_train_val(trajs, train=False).withColumn("split", F.lit("val"))
    return tr.unionByName(va)


@query("shuffled_read")
def q_shuffled_read(spark, d):
    trajs = T.steps(spark, d).select(*EP).distinct()
    return FR.shuffle_positions(trajs, SEED, ["traj_id"], "pos")


@query("shuffle_frames")
def q_shuffle_frames(spark, d):
    fr = T.steps(spark, d).select(*EP, F.col("t").cast("bigint").alias("t"))
    return FR.shuffle_positions(fr, SEED, ["traj_id", "t"], "pos")


@query("take_val")
def q_take_val(spark, d):
    fr = T.steps(spark, d).select(*EP, F.col("t").cast("bigint").alias("t"), "event_id")
    return FR.take_val(fr, 1000, ["dataset_name", "traj_id", "t"])


@query("batch")
def q_batch(spark, d):
    fr = T.steps(spark, d).select(*EP, F.col("t").cast("bigint").alias("t"))
    pos = FR.shuffle_positions(fr, SEED, ["traj_id", "t"], "pos")
    return FR.batch_ids(pos, 16).groupBy("batch").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_frames"),
        F.min_by("traj_id", "pos").alias("first_traj"),
        F.min_by("t", "pos").alias("first_t"),
    )


@query("repeat")
def q_repeat(spark, d):
    fr = T.steps(spark, d).select(*EP, F.col("t").cast("bigint").alias("t"))
    r = FR.repeat(fr, 2)
    return r.select(*EP, "t", F.col("pass").cast("bigint").alias("pass"),
                    F.floor(u01(SEED, "pass", "traj_id", "t") * 1000).cast("bigint").alias("draw"))


# ----------------------------------------------------------------------------- mixtures
from episodic.operators import mixture as MX  # noqa: E402

@query("mixture_weights")
def q_mixture_weights(spark, d):
    m = T.mixture(spark, d)
    a = MX.mixture_weights(m, False, "w_plain")
    b = MX.mixture_weights(a, True, "w_balanced")
    return b.select("dataset_name", r6("w_plain").alias("w_plain"), r6("w_balanced").alias("w_balanced"))


@query("mixture_length")
def q_mixture_length(spark, d):
    m = T.mixture(spark, d)
    a = MX.mixture_length(m, False).withColumnRenamed("mixture_length", "length_plain")
    b = MX.mixture_length(m, True).select("mixture_length")
    return a.withColumn("length_balanced", b.scalar())


@query("apportion")
def q_apportion(spark, d):
    m = T.mixture(spark, d)
    return MX.apportion(m, MX.mixture_length(m).scalar()).select("dataset_name", "quota")


@query("draw_to_dataset")
def q_draw_to_dataset(spark, d):
    m = T.mixture(spark, d)
    n = int(MX.mixture_length(m).first()[0])
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("u", u01(SEED, "draw"))
    return MX.draw_to_dataset(draws, m, "u").select("draw", "dataset_name")


def _doc_frames(spark, d):
    return T.read_table(spark, d, "documents", ["doc_id", "source"]).withColumnRenamed("source", "dataset_name")


@query("mixture_draws")
def q_mixture_draws(spark, d):
    out = MX.mixture_draws(_doc_frames(spark, d), T.mixture(spark, d), None, SEED, ["doc_id"])
    return out.select("draw", "dataset_name", "doc_id")


@query("mixture_quota")
def q_mixture_quota(spark, d):
    m = T.mixture(spark, d)
    quotas = MX.apportion(m, MX.mixture_length(m).scalar())
    out = MX.mixture_quota(_doc_frames(spark, d), quotas, SEED, "doc_id")
    return out.select("dataset_name", "doc_id", "copies")


@query("resolve_mixture")
def q_resolve_mixture(spark, d):
    spec = T.mixture_spec(spark, d)
    invalid = spec.filter(F.col("dataset_name") == "src19").select("dataset_name")  # unsupported configuration
    return MX.resolve_mixture(spec, invalid).select("mix", "dataset_name", r6("weight").alias("weight"), F.col("pos").cast("bigint").alias("pos"))


@query("registry_join")
def q_registry_join(spark, d):
    res = MX.resolve_mixture(T.mixture_spec(spark, d))
    sizes = T.mixture(spark, d).select("dataset_name", "size")
    return RG.registry_join(res, sizes).select("mix", "dataset_name", r6("weight").alias("weight"), "size")


@query("registry_anti")
def q_registry_anti(spark, d):
    docs = T.read_table(spark, d, "documents", ["doc_id", "lang", "source", "n_chars"])
    labelled = T.read_table(spark, d, "labels", ["doc_id"]).distinct().withColumn("labelled", F.lit(True))
    names = docs.join(labelled, "doc_id", "left").select(F.concat_ws("/", "source", "lang", (F.col("n_chars") % 7).cast("string")).alias("name"), "labelled")
    return RG.registry_difference(names.where("labelled IS NULL"), names.where("labelled"), "name", "config_only", "function_only")


@query("mixture_report")
def q_mixture_report(spark, d):
    return MX.mixture_report(T.mixture(spark, d)).select("dataset_name", r6("weight").alias("weight"), F.col("pos").cast("bigint").alias("pos"))


@query("union_datasets")
def q_union(spark, d):
    u = RG.union_datasets([T.steps(spark, d), T.vectors(spark, d)], [*EP, "t", "action"])
    return u.groupBy("dataset_name").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.max(F.size("action")).cast("bigint").alias("dims"))


@query("key_difference")
def q_key_difference(spark, d):
    cv = T.read_table(spark, d, "conversations", ["conv_id", "role"])
    return RG.missing_values(cv, ["conv_id"], "role", ["assistant", "system", "user"], "missing")


@query("views_check")
def q_views_check(spark, d):
    docs = T.read_table(spark, d, "documents", ["source", "lang"]).withColumnRenamed("source", "dataset_name")
    return RG.missing_values(docs, ["dataset_name"], "lang", ["de", "en", "es", "fr", "it"], "missing_views")


# ----------------------------------------------------------------------------- dialogue
from episodic.functions import text as X  # noqa: E402
from episodic.operators import dialogue as D  # noqa: E402


def _parsed(spark, d):
    return D.parse_conversation(T.dialogue(spark, d))


@query("parse_conversation")
def q_parse_conversation(spark, d):
    p = _parsed(spark, d).select("conv_id", F.explode("turns").alias("tr"))
    return p.select("conv_id", F.col("tr.idx").cast("bigint").alias("idx"), F.col("tr.assistant").alias("assistant"),
                    F.col("tr.audio").alias("audio"))


@query("build_messages")
def q_build_messages(spark, d):
    p = _parsed(spark, d)
    p = p.withColumn("action_ids", F.transform("turns", lambda t: F.length(t["assistant"]) % 2048))
    m = D.build_messages(p).select("conv_id", F.posexplode("messages").alias("msg_idx", "m"))
    m = m.select("conv_id", "msg_idx", F.col("m.role").alias("role"), F.posexplode("m.content").alias("item_idx", "c"))
    return m.select("conv_id", F.col("msg_idx").cast("bigint").alias("msg_idx"), "role",
                    F.col("item_idx").cast("bigint").alias("item_idx"), F.col("c.type").alias("type"), F.col("c.value").alias("value"))


@query("label_mask")
def q_label_mask(spark, d):
    tk = T.tokens(spark, d).withColumn("labels", X.label_mask("input_ids", "pad_id"))
    out = tk.select("seq_id", F.posexplode("labels").alias("pos", "label"))
    return out.select("seq_id", F.col("pos").cast("bigint").alias("pos"), F.col("label").cast("bigint").alias("label"))


@query("token_range")
def q_token_range(spark, d):
    tk = T.tokens(spark, d).withColumn("act", X.token_range("input_ids"))
    return tk.select("seq_id", F.size("act").cast("bigint").alias("n_kept"), F.element_at("act", 1).cast("bigint").alias("first_id"),
                     X.action_tokens("act").alias("action_text"))


@query("act_mode")
def q_act_mode(spark, d):
    cv = T.read_table(spark, d, "conversations", ["conv_id", "turn", "role", "text"]).filter(F.col("role") == "assistant")
    cv = cv.withColumn("text", F.concat("text", F.when(F.length("text") % 5 == 0, F.lit(" [ACT]")).otherwise(F.lit(""))))
    out = D.act_mode(cv, "text", "turn", ["conv_id"], limit=3)
    return out.select("conv_id", "turn", "mode", "reply", X.has_act("text").alias("has_act"))


def _catalog_items(spark, d):
    p = _parsed(spark, d)
    return p.select(
        F.concat(F.lit("Task "), (F.col("conv_id") % 10).cast("string")).alias("instruction"),
        X.split_turns("speech_conv").alias("speech_conv"),
        F.transform("turns", lambda t: F.struct(t["assistant"].alias("response"))).alias("conversation"),
        F.col("conv_id").alias("pos"),
    )


@query("instruction_catalog")
def q_instruction_catalog(spark, d):
    cat = D.instruction_catalog(_catalog_items(spark, d))
    return cat.select("instruction", F.size("entry.speech_conv").cast("bigint").alias("n_speech"),
                      F.element_at("entry.conv", 1).alias("first_response"), F.element_at("entry.conv", -1).alias("last_response"))


@query("attach_dialogue")
def q_attach_dialogue(spark, d):
    cat = D.instruction_catalog(_catalog_items(spark, d))
    st = T.steps(spark, d).select(*EP, "t", F.col("language_instruction").alias("task"))
    out = D.attach_dialogue(st, cat, "task")
    return out.select(*EP, F.col("t").cast("bigint").alias("t"), "task", F.size("entry.conv").cast("bigint").alias("n_conv"))


# ----------------------------------------------------------------------------- evaluation
from episodic.functions import vector as V  # noqa: E402
from episodic.operators import evaluate as EV  # noqa: E402
from episodic.sources import sinks as SK  # noqa: E402


@query("success_rate")
def q_success_rate(spark, d):
    s = EV.success_rate(T.rollouts(spark, d))
    return s.select("task", "episodes", "successes", r6("rate").alias("rate"))


@query("running_success")
def q_running_success(spark, d):
    s = EV.running_success(T.rollouts(spark, d))
    return s.select("task", "episode", "task_episodes", "task_successes", r6("task_rate").alias("task_rate"),
                    "total_episodes", "total_successes", r6("total_rate").alias("total_rate"))


@query("interval_loss")
def q_interval_loss(spark, d):
    s = EV.interval_loss(T.metrics(spark, d), 100)
    return s.select("steps", r6("train_loss").alias("train_loss"))


@query("latest_step")
def q_latest_step(spark, d):
    return EV.latest_step(T.checkpoints(spark, d), "name", "run")


@query("unnormalize")
def q_unnormalize(spark, d):
    st = T.steps(spark, d)
    stats = _stats_struct(st, fields=("action",))
    normed = N.normalize(st.select(*EP, "t", "action"), stats, "bounds_q99", fields=("action",))
    un = N.unnormalize(normed, stats, "action")
    out = un.select(*EP, "t", F.posexplode("action").alias("dim", "v"))
    return out.select(*EP, F.col("t").cast("bigint").alias("t"), F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value"))


@query("gripper_postprocess")
def q_gripper_post(spark, d):
    st = T.steps(spark, d).select(*EP, "t", "action")
    a = st.withColumn("pm", V.gripper_pm1("action", binarize=True)).withColumn("pm_raw", V.gripper_pm1("action", binarize=False))
    a = a.withColumn("flip", V.flip_last("pm")).withColumn("snap", V.snap_nonneg("flip"))
    return a.select(*EP, F.col("t").cast("bigint").alias("t"), r6(V.last_of("pm_raw")).alias("g_pm1"),
                    r6(V.last_of("pm")).alias("g_bin"), r6(V.last_of("flip")).alias("g_flip"), r6(V.last_of("snap")).alias("g_snap"),
                    r6(V.invert(V.clip01(V.last_of("action")))).alias("g_inv"))


@query("write_rollouts")
def q_write_rollouts(spark, d):
    st = T.steps(spark, d).select(F.col("traj_id").alias("episode"), F.col("dataset_name").alias("task"), "t", "state", "action", "image")
    path = SK.scratch_path(spark, "rollouts")
    SK.write_rollouts(st, path)
    back = spark.read.parquet(path)
    return back.groupBy("task", "episode").agg(F.count(F.lit(1)).cast("bigint").alias("n_steps"),
                                               r6(F.sum(F.col("action")[0])).alias("sum_a0"))


@query("append_summary")
def q_append_summary(spark, d):
    s = EV.interval_loss(T.metrics(spark, d), 100)
    path = SK.scratch_path(spark, "summary")
    SK.append_summary(s.filter(F.col("steps") <= 5000), path)
    SK.append_summary(s.filter(F.col("steps") > 5000), path)
    back = spark.read.schema("steps bigint, train_loss double").json(path)
    return back.select("steps", r6("train_loss").alias("train_loss"))


# ----------------------------------------------------------------------------- standardizers
from episodic.operators import standardize as STD  # noqa: E402

STD_QUERIES = {
    "std_bridge_oxe": "bridge_oxe",
    "std_bridge_orig": "bridge_orig",
    "std_rt1": "fractal20220817_data",
    "std_taco": "taco_play",
    "std_jaco": "jaco_play",
    "std_roboturk": "roboturk",
    "std_language_table": "language_table",
    "std_hydra": "stanford_hydra_dataset_converted_externally_to_rlds",
    "std_furniture": "furniture_bench_dataset_converted_externally_to_rlds",
    "std_stretch": "cmu_stretch",
    "std_gnm": "gnm_dataset",
    "std_libero": "libero_spatial_no_noops",
    "std_droid_wrist": "droid_wrist",
    "std_fanuc": "berkeley_fanuc_manipulation",
    "std_playfusion": "cmu_play_fusion",
    "std_robo_net": "robo_net",
    "std_droid_base": "droid",
    "std_nyu_franka": "nyu_franka_play_dataset_converted_externally_to_rlds",
    "std_iamlab": "iamlab_cmu_pickup_insert_converted_externally_to_rlds",
    "std_bc_z": "bc_z",
    "std_autolab_ur5": "berkeley_autolab_ur5",
}


def _std_long(df: DataFrame) -> DataFrame:
    parts = [F.struct(F.lit("action").alias("field"), F.col("action").alias("arr"))]
    if "proprio" in df.columns:
        parts.append(F.struct(F.lit("proprio").alias("field"), F.col("proprio").alias("arr")))
    ex = df.select(*EP, "t", F.explode(F.array(*parts)).alias("fa"))
    ex = ex.select(*EP, "t", F.col("fa.field").alias("field"), F.posexplode("fa.arr").alias("dim", "v"))
    return ex.select(*EP, F.col("t").cast("bigint").alias("t"), "field", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value"))


_defines_proprio = {"bridge_oxe", "bridge_orig", "taco_play", "stanford_hydra_dataset_converted_externally_to_rlds",
                    "furniture_bench_dataset_converted_externally_to_rlds", "cmu_stretch", "gnm_dataset",
                    "libero_spatial_no_noops", "droid_wrist", "berkeley_fanuc_manipulation", "robo_net", "droid",
                    "nyu_franka_play_dataset_converted_externally_to_rlds", "berkeley_autolab_ur5"}


for _q, _ds in STD_QUERIES.items():
    def _mk(ds):
        def run(spark, d):
            out = STD.standardize(T.raw_steps(spark, d), ds)
            if ds not in _defines_proprio and "proprio" in out.columns:
                out = out.drop("proprio")
            return _std_long(out)
        run.__name__ = "q_" + ds
        return run
    QUERIES[_q] = _mk(_ds)


@query("codepoints_to_text")
def q_codepoints(spark, d):
    raw = T.raw_steps(spark, d)
    out = STD.standardize(raw, "language_table")
    return out.select(*EP, F.col("t").cast("bigint").alias("t"), "language_instruction")


# ----------------------------------------------------------------------------- streaming
from episodic.streaming import streams as SS  # noqa: E402


@query("stream_normalize")
def q_stream_normalize(spark, d):
    stats = _stats_struct(T.steps(spark, d), fields=("action",))
    stream = SS.stream_normalize(SS.stream_steps(SS.read_stream(spark, d, "events", SS.EVENTS_SCHEMA)), stats)
    out = SS.run_append(stream.select("dataset_name", "traj_id", "event_id", "action"), "stream_normalize")
    out = out.select("dataset_name", "traj_id", "event_id", F.posexplode("action").alias("dim", "v"))
    return out.select("dataset_name", "traj_id", "event_id", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value"))


@query("stream_success")
def q_stream_success(spark, d):
    ev = SS.read_stream(spark, d, "events", SS.EVENTS_SCHEMA)
    ro = ev.select(F.col("event_type").alias("task"), (F.col("value") > 50).alias("success"))
    out = SS.run_update(SS.stream_success(ro), "stream_success", ["task"])
    return out.select("task", "episodes", "successes", r6("rate").alias("rate"))


def _event_spool(events, hours=6.0):
    """``events`` arriving up to ``hours`` late, in files that interleave, and the delay for it."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    close = events.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"))
    close = close.select(*[F.col(c) if c == "ts" else F.lit(None).alias(c) for c in events.columns])
    stream, delay = SS.spooled(events, ts, hours * 3600, "event_id", close)
    return stream, f"{int(delay) + 1} seconds"


@query("rate_gate")
def q_rate_gate(spark, d):
    ev = T.read_table(spark, d, "events", ["user_id", "event_id", "ts"])
    stream, delay = _event_spool(ev.withColumnRenamed("user_id", "traj_id"))
    return SS.run_append(SS.rate_gate(stream, 4 * 3600.0, delay=delay, groups=SS.key_groups(ev)), "rate_gate")


@query("stream_act_mode")
def q_stream_act_mode(spark, d):
    cv = T.read_table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    cv = cv.withColumn("text", F.concat("text", F.when(F.length("text") % 5 == 0, F.lit(" [ACT]")).otherwise(F.lit(""))))
    # turns arrive up to three turns late, in files that interleave
    stream, _ = SS.spooled(cv, F.col("turn").cast("double"), 3.0, "text", cv.limit(0))
    return SS.run_append(SS.stream_act_mode(stream, limit=3), "stream_act_mode")


@query("stream_rel2abs")
def q_stream_rel2abs(spark, d):
    ev = T.read_table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    st = SS.stream_steps(ev)
    # a user's last event releases the steps that no click or purchase has decided
    ends = st.groupBy("traj_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))
    st = st.select("traj_id", "event_id", "ts", "rel_gripper").join(ends, "traj_id").select(
        "traj_id", "event_id", "ts", "rel_gripper", (F.col("event_id") == F.col("last_id")).alias("last"))
    stream, delay = _event_spool(st)
    out = SS.resolve_marks(SS.run_append(SS.rel2abs_marks(stream, delay=delay, groups=SS.key_groups(ev)), "stream_rel2abs"))
    return out.select("traj_id", "event_id", r6("value").alias("value"))


@query("stream_interval_loss")
def q_stream_interval_loss(spark, d):
    ev = T.read_table(spark, d, "events", ["event_id", "value"])
    m = ev.select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"))
    close = m.agg((F.max("step") * 2 + 1_000_000_000).alias("step")).select("step", F.lit(None).alias("loss"))
    stream, delay = SS.spooled(m, F.col("step").cast("double"), 500.0, "step", close)
    out = SS.run_append(SS.closed_interval_loss(stream, 100, int(delay) + 1), "stream_interval_loss")
    out = out.filter(F.col("max_step") >= F.col("interval") * 100)
    return out.select((F.col("interval") * 100).cast("bigint").alias("steps"), r6(F.col("loss_sum") / 100.0).alias("train_loss"))


# ----------------------------------------------------------------------------- projections / config
from episodic.functions import rotation as RT  # noqa: E402
from episodic.operators import projections as P  # noqa: E402
from episodic.plans import pipelines as PL  # noqa: E402
from episodic.sources import stats_io as SIO  # noqa: E402


def _kt(df):
    return df.withColumn("t", F.col("t").cast("bigint"))


@query("map_images")
def q_map_images(spark, d):
    st = P.map_cols(T.steps(spark, d), {"primary": "image", "wrist": None}, "image_")
    st = P.map_cols(st, {"primary": None}, "depth_")
    return _kt(st.select(*EP, "t", "image_primary", "image_wrist", "depth_primary"))


@query("first_frame")
def q_first_frame(spark, d):
    st = E.first_frame(T.steps(spark, d), from_episode=True)
    st = E.first_frame(st, col="image", out="image_first_frame_given")
    return _kt(st.select(*EP, "t", "image_first_frame", "image_first_frame_given"))


@query("concat_proprio")
def q_concat_proprio(spark, d):
    st = T.steps(spark, d).withColumn("proprio", V.concat_proprio(F.slice("state", 1, 3), None, "world_vector"))
    out = st.select(*EP, "t", F.posexplode("proprio").alias("dim", "v"))
    return _kt(out.select(*EP, "t", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value")))


@query("extract_language")
def q_extract_language(spark, d):
    st = P.require_keys(T.steps(spark, d), ["action", "state", "language_instruction"])
    st = P.extract_language(st, "language_instruction")
    return _kt(st.select(*EP, "t", F.col("task.language_instruction").alias("language_instruction")))


@query("default_fields")
def q_default_fields(spark, d):
    # conversations without a complete turn have no dialogue fields: they take the defaults
    every = T.read_table(spark, d, "conversations", ["conv_id"]).distinct()
    dl = P.with_defaults(every.join(T.dialogue(spark, d), "conv_id", "left"), "dialogue_ds")
    return dl.select("conv_id", "user", "response", F.length("conversation").cast("bigint").alias("conv_len"), "dataset_name")


@query("absolute_mask")
def q_absolute_mask(spark, d):
    st = P.with_mask(T.steps(spark, d).select(*EP, "t", "action"), ABS_MASK_EEF)
    out = st.select(*EP, "t", F.posexplode("absolute_action_mask").alias("dim", "absolute"))
    return _kt(out.select(*EP, "t", F.col("dim").cast("bigint").alias("dim"), "absolute"))


# P11 configuration: the steps datasets use the EEF_POS encoding
def _steps_configs(st):
    """A configuration row for every dataset that the steps hold."""
    return st.select("dataset_name").distinct().selectExpr(
        "dataset_name", "'EEF_POS' AS action_encoding", "map('primary', 'image', 'wrist', CAST(NULL AS STRING)) AS image_views",
        "map('primary', CAST(NULL AS STRING)) AS depth_views", "array('state') AS state_columns")


@query("config_normalize")
def q_config_normalize(spark, d):
    st = T.steps(spark, d)
    cfg = P.config_for("ds0", P.config_table(_steps_configs(st), normalization_type="bounds_q99"))
    st = st.select(*EP, "t", *cfg.columns(), "action")
    stats = S.stats_struct(S.dataset_stats(st, fields=("action",)), cfg.action_normalization_mask)
    normed = N.normalize(st, stats, cfg.normalization_type, fields=("action",))
    out = normed.select(*EP, "t", F.posexplode("action").alias("dim", "v"))
    return _kt(out.select(*EP, "t", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value")))


@query("norm_mask")
def q_norm_mask(spark, d):
    st = S.stats_struct(S.dataset_stats(T.steps(spark, d), fields=("action",)), [True] * 6 + [False])
    out = st.select("dataset_name", "field", F.posexplode("stats.mask").alias("dim", "mask"))
    return out.select("dataset_name", "field", F.col("dim").cast("bigint").alias("dim"), "mask")


@query("struct_merge")
def q_struct_merge(spark, d):
    st = T.steps(spark, d).select(*EP, "t", "image", "language_instruction", "gripper")
    st = st.withColumn("task", F.struct(F.col("language_instruction"), F.struct(F.lit(True).alias("language_instruction"), F.lit(True).alias("image")).alias("pad_mask_dict")))
    st = st.withColumn("goal", F.struct(F.col("image").alias("image"), F.struct((F.length("image") != 0).alias("image")).alias("pad_mask_dict"),
                                        F.col("t").alias("timestep")))
    st = P.struct_merge(st, "task", "goal", "merged")
    st = P.struct_map(st, "merged", lambda c: c.cast("string"))
    return _kt(st.select(*EP, "t", F.col("merged.language_instruction").alias("language_instruction"), F.col("merged.image").alias("image"),
                         F.col("merged.pad_mask_dict.language_instruction").alias("lang_mask"), F.col("merged.pad_mask_dict.image").alias("image_mask"),
                         F.col("merged.timestep").alias("timestep")))


@query("padding")
def q_padding(spark, d):
    st = T.steps(spark, d).select(*EP, "t", "event_id", "image", "language_instruction", "gripper", "state")
    ev = T.read_table(spark, d, "events", ["event_id", "event_type"])
    st = st.join(ev, "event_id")
    st = P.pad_where(st, F.col("event_type") == "error", ["image", "language_instruction", "gripper", "state"])
    return _kt(st.select(*EP, "t", "image", "language_instruction", r6("gripper").alias("gripper"), r6(F.aggregate("state", F.lit(0.0), lambda a, x: a + x)).alias("state_sum")))


@query("example_projection")
def q_example_projection(spark, d):
    st = E.chunk_obs(T.steps(spark, d), ["image"], 2)
    ex = P.to_example(st.withColumn("keep_t", F.col("t")))
    return ex.select("dataset_name", "image", "lang", r6(F.aggregate("action", F.lit(0.0), lambda a, x: a + x)).alias("action_sum"),
                     r6(F.aggregate("proprio", F.lit(0.0), lambda a, x: a + x)).alias("proprio_sum"))


@query("speech_example_projection")
def q_speech_example(spark, d):
    dl = P.with_defaults(T.dialogue(spark, d), "dialogue_ds").withColumnRenamed("first_frame_image", "image_first_frame")
    dl = dl.withColumn("language_instruction", F.concat(F.lit("Conv "), F.col("conv_id").cast("string"))).withColumn("image_wrist", F.lit(None).cast("string"))
    ex = P.to_speech_example(dl.withColumn("conv_key", F.col("conv_id")))
    return ex.select("lang", "image", "first_image", "wrist_image", "user", "response", "dataset_name",
                     F.length("conversation").cast("bigint").alias("conv_len"), F.length("speech_conv").cast("bigint").alias("speech_len"))


@query("episode_summary")
def q_episode_summary(spark, d):
    return E.episode_summary(T.steps(spark, d), ["event_id", "image"])


@query("episode_pieces")
def q_episode_pieces(spark, d):
    pcs = E.episode_pieces(T.steps(spark, d), ["event_id"], piece=16)
    return pcs.select(*EP, F.col("piece").cast("bigint").alias("piece"), F.size("steps").cast("bigint").alias("n"),
                      F.element_at("steps", 1)["event_id"].alias("first_event"), F.element_at("steps", -1)["event_id"].alias("last_event"))


@query("pad_state")
def q_pad_state(spark, d):
    st = T.steps(spark, d).withColumn("p", V.pad_state("state"))
    out = st.select(*EP, "t", F.posexplode("p").alias("dim", "v"))
    return _kt(out.select(*EP, "t", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value")))


@query("rollout_state")
def q_rollout_state(spark, d):
    st = T.steps(spark, d).withColumn("s", P.rollout_state(F.slice("state", 1, 3), "rotation_delta", F.slice("state", 7, 2)))
    out = st.select(*EP, "t", F.posexplode("s").alias("dim", "v"))
    return _kt(out.select(*EP, "t", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value")))


@query("slice_keys")
def q_slice_keys(spark, d):
    st = T.steps(spark, d).withColumn("s", STD._sl("state", -3, -1)).withColumn("z", F.concat(STD._sl("state", 2, 4), V.zeros(2), V.ones(1)))
    out = st.select(*EP, "t", F.posexplode(F.concat("s", "z")).alias("dim", "v"))
    return _kt(out.select(*EP, "t", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value")))


# ----------------------------------------------------------------------------- rotations / strings
def _rot_input(spark, d):
    st = T.steps(spark, d)
    e = F.array(F.col("state")[4] / 60.0, F.col("state")[5] / 60.0, F.col("state")[2] / 100.0)
    return st.select(*EP, "t", e.alias("e"), "state")


@query("rotations")
def q_rotations(spark, d):
    st = _rot_input(spark, d).withColumn("m", RT.euler_to_rmat("e"))
    st = st.withColumn("back", RT.rmat_to_euler("m")).withColumn("inv", RT.invert_rmat("m")).withColumn("r6", RT.rotmat_to_rot6d("m"))
    parts = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("arr")) for k in ("m", "back", "inv", "r6")]
    out = st.select(*EP, "t", F.explode(F.array(*parts)).alias("p"))
    out = out.select(*EP, "t", F.col("p.kind").alias("kind"), F.posexplode("p.arr").alias("dim", "v"))
    return _kt(out.select(*EP, "t", "kind", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value")))


@query("pose_matrix")
def q_pose_matrix(spark, d):
    st = _rot_input(spark, d)
    st = st.withColumn("pose", RT.pose_matrix(F.transform(F.slice("state", 1, 3), lambda v: v / 100.0), F.col("e")[0]))
    out = st.select(*EP, "t", F.posexplode("pose").alias("dim", "v"))
    return _kt(out.select(*EP, "t", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value")))


@query("decode_lower")
def q_decode_lower(spark, d):
    st = T.steps(spark, d)
    return _kt(st.select(*EP, "t", X.decode_lower(F.encode("language_instruction", "UTF-8")).alias("lang")))


@query("parse_pair")
def q_parse_pair(spark, d):
    ev = T.steps(spark, d)
    sep = F.when(F.col("event_id") % 2 == 0, F.lit(",")).otherwise(F.lit(" "))
    s = F.concat(F.col("state")[2].cast("int").cast("string"), sep, F.col("state")[3].cast("int").cast("string"))
    p = ev.select("event_id", X.parse_pair(s).alias("p"))
    return p.select("event_id", F.col("p")[0].cast("bigint").alias("w"), F.col("p")[1].cast("bigint").alias("h"))


@query("gather")
def q_gather(spark, d):
    st = T.steps(spark, d).withColumn("g", X.gather("action", F.array(F.lit(6), F.lit(0), F.lit(3))))
    out = st.select(*EP, "t", F.posexplode("g").alias("dim", "v"))
    return _kt(out.select(*EP, "t", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value")))


@query("zero_action_filter")
def q_zero_action_filter(spark, d):
    st = T.steps(spark, d)
    stats = _stats_struct(st, fields=("action",))
    normed = N.normalize(st.select(*EP, "t", "action"), stats, "bounds_q99", fields=("action",))
    ch = E.chunk_action(normed, 1, 2)
    ch = N.attach_stats(ch, stats, fields=("action",))
    kept = ch.filter(V.moves("action_chunk", F.col("action_stats.q01"), F.col("action_stats.q99")))
    return _kt(kept.select(*EP, "t"))


# ----------------------------------------------------------------------------- persistence
@query("stats_roundtrip")
def q_stats_roundtrip(spark, d):
    st = T.steps(spark, d)
    path = SK.scratch_path(spark, "stats")
    masked = S.dataset_stats(st).withColumn("mask", F.when(F.col("field") == "action", F.col("dim") < 6))
    SIO.save_stats(masked, S.dataset_counts(st), path)
    back = SIO.load_stats(spark, path)
    return back.select("dataset_name", "field", F.col("dim").cast("bigint").alias("dim"), *[r6(c).alias(c) for c in SIO.STAT_FIELDS],
                       "mask", "num_transitions", "num_trajectories")


@query("cached_stats")
def q_cached_stats(spark, d):
    st = T.steps(spark, d)
    root = SK.scratch_path(spark, "stats-cache")
    deps = ("steps", d, "state", "bridge")
    first, hit1 = SIO.cached_stats(st, deps, root)
    second, hit2 = SIO.cached_stats(st, deps, root)
    if hit1 or not hit2:
        raise RuntimeError("statistics cache did not behave")
    return second.select("dataset_name", "field", F.col("dim").cast("bigint").alias("dim"), *[r6(c).alias(c) for c in SIO.STAT_FIELDS])


@query("synthetic_steps")
def q_synthetic_steps(spark, d):
    base = T.read_table(spark, d, "events", ["event_id"])
    syn = SIO.synthetic_steps(base, SEED)
    out = syn.select("event_id", "language_instruction", F.posexplode("action").alias("dim", "v"))
    return out.select("event_id", "language_instruction", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value"))


# ----------------------------------------------------------------------------- statistics at volume / wide
@query("dataset_stats_vectors")
def q_stats_vectors(spark, d):
    s = S.dataset_stats(T.vectors(spark, d), fields=("action",))
    return s.select("dataset_name", "field", F.col("dim").cast("bigint").alias("dim"),
                    *[r6(c).alias(c) for c in ("mean", "std", "max", "min", "q01", "q99")])


@query("dataset_stats_orders")
def q_stats_orders(spark, d):
    s = S.dataset_stats(T.order_steps(spark, d), fields=("action",))
    return s.select("dataset_name", "field", F.col("dim").cast("bigint").alias("dim"),
                    *[r6(c).alias(c) for c in ("mean", "std", "max", "min", "q01", "q99")])


def _normalize_vectors(spark, d, kind):
    v = T.vectors(spark, d)
    stats = _stats_struct(v, fields=("action",))
    n = N.normalize(v, stats, kind, fields=("action",))
    out = n.select("dataset_name", "traj_id", F.posexplode("action").alias("dim", "v"))
    return out.select("dataset_name", "traj_id", F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value"))


@query("normalize_normal")
def q_normalize_normal(spark, d):
    return _normalize_vectors(spark, d, "normal")


@query("normalize_bounds")
def q_normalize_bounds(spark, d):
    return _normalize_vectors(spark, d, "bounds")


# ----------------------------------------------------------------------------- pipelines
PIPE_OPTS = dict(train=True, goal_relabeling="uniform", window=2, future=3, subsample_length=50, skip_unlabeled=True,
                 max_action=450.0, task_augment="delete_task_conditioning", keep_image_prob=0.5,
                 absolute_action_mask=ABS_MASK_EEF, seed=SEED)


@query("episode_pipeline")
def q_episode_pipeline(spark, d):
    st = T.steps(spark, d).select(*EP, "t", "action", "image", "language_instruction")
    out = PL.episode_pipeline(st, PL.TrajOptions(**PIPE_OPTS))
    base = [*EP, "t", "goal_t", "language_instruction", "goal_image"]
    ex = explode_chunk(out.select(*base, "action_chunk"), base, "action_chunk")
    return ex.withColumn("t", F.col("t").cast("bigint")).withColumn("goal_t", F.col("goal_t").cast("bigint"))


@query("single_pipeline")
def q_single_pipeline(spark, d):
    st = T.steps(spark, d).select(*EP, "t", "action", "proprio", "image", "language_instruction")
    o = PL.TrajOptions(train=False, window=1, future=5, skip_unlabeled=True)
    frames, _, counts = PL.single_pipeline(st, o)
    ex = explode_chunk(frames.select(*EP, "t", "action_chunk"), [*EP, "t"], "action_chunk")
    return ex.withColumn("t", F.col("t").cast("bigint"))


def _steps_weights(spark, d):
    st = T.steps(spark, d)
    names = st.select("dataset_name").distinct()
    num = F.substring("dataset_name", 3, 8).cast("int")
    return names.select("dataset_name", F.when(num == 1, 2.0).when(num == 2, 0.5).otherwise(1.0).alias("weight"), num.alias("pos"))


@query("interleaved_pipeline")
def q_interleaved(spark, d):
    st = T.steps(spark, d).select(*EP, "t", "action", "proprio", "image", "language_instruction")
    o = PL.TrajOptions(train=True, window=1, future=2, seed=SEED)
    out = PL.interleaved_pipeline(st, _steps_weights(spark, d), o, SEED, None, 32)
    return out.select("pos", "batch", "draw", "dataset_name", "traj_id", F.col("t").cast("bigint").alias("t"))


@query("rand_swap")
def q_rand_swap(spark, d):
    out = STD.rand_swap(T.raw_steps(spark, d), "exterior_image_1_left", "exterior_image_2_left", SEED)
    return out.select(*EP, F.col("t").cast("bigint").alias("t"), "exterior_image_1_left", "exterior_image_2_left")


@query("read_steps")
def q_read_steps(spark, d):
    from episodic.sources import steps_io as SI

    path = SK.scratch_path(spark, "steps")
    SI.write_steps(T.steps(spark, d).select(*EP, "t", "event_id", "action", "image"), path)
    back = SI.read_steps(spark, path, columns=["event_id", "image"])
    return back.select(*EP, F.col("t").cast("bigint").alias("t"), "event_id", "image")


# ----------------------------------------------------------------------------- raw mixtures
from episodic.operators import recipes as RC  # noqa: E402
from episodic.session import materialize  # noqa: E402


def _raw_mixture(spark, d):
    """The raw steps as a table, as a source would have them."""
    return materialize(RC.raw_mixture(T.raw_datasets(spark, d)))


@query("std_mixture")
def q_std_mixture(spark, d):
    """Five source formats in one frame, standardized by one plan."""
    out = RC.standardize_mixture(_raw_mixture(spark, d), T.RAW_DATASETS, keep=["event_id"])
    parts = F.array(F.struct(F.lit("action").alias("field"), F.col("action").alias("v")), F.struct(F.lit("proprio").alias("field"), F.col("proprio").alias("v")))
    out = out.select(*EP, "t", "event_id", "language_instruction", F.explode(parts).alias("p"))
    out = out.select(*EP, "t", "event_id", "language_instruction", F.col("p.field").alias("field"), F.posexplode("p.v").alias("dim", "x"))
    return _kt(out.select(*EP, "t", "event_id", "language_instruction", "field", F.col("dim").cast("bigint").alias("dim"), r6("x").alias("value")))


@query("single_pipeline_raw")
def q_single_pipeline_raw(spark, d):
    """U6 from raw steps: recipe, statistics, normalization, chunks, as sums by episode, slot and dimension."""
    o = PL.TrajOptions(train=False, window=1, future=5)
    frames, _, _ = PL.single_pipeline(_raw_mixture(spark, d), o, datasets=T.RAW_DATASETS, keep=["observation.image"])
    return _chunk_sums(explode_chunk(frames.select(*EP, "t", "action_chunk"), [*EP, "t"], "action_chunk"))


@query("interleaved_pipeline_raw")
def q_interleaved_raw(spark, d):
    """U5 from raw steps of five source formats, with a batch transform."""
    o = PL.TrajOptions(train=True, window=1, future=2, seed=SEED)
    raw = _raw_mixture(spark, d)
    names = spark.createDataFrame([(n, 1.0 + k % 3, k) for k, n in enumerate(T.RAW_DATASETS)], "dataset_name string, weight double, pos int")
    out = PL.interleaved_pipeline(raw, names, o, SEED, 4000, 32, datasets=T.RAW_DATASETS, keep=["observation.image"],
                                  batch_transform={"short": lambda c: F.length(c["language_instruction"]) < 7})
    return out.select("pos", "batch", "draw", "dataset_name", "traj_id", F.col("t").cast("bigint").alias("t"), "short")


@query("redrawn_goals")
def q_redrawn_goals(spark, d):
    """Goals of drawn frames: a frame that is drawn again, in a later pass, has another goal."""
    st = materialize(T.steps(spark, d).select(*EP, "t", "image"))
    mix = st.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("size")).select(
        "dataset_name", "size", F.lit(1.0).alias("weight"), F.substring("dataset_name", 3, 8).cast("int").alias("pos"))
    n = 2 * int(st.count())
    drawn = MX.mixture_draws(st, mix, n, SEED, ["traj_id", "t"])
    out = E.goal_uniform(drawn, SEED + 5, ["image"], source=st, again=["pass"])
    return _kt(out.select("draw", "pass", *EP, "t", "goal_t", "goal_image"))
