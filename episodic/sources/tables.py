"""Readers for the driver tables and the fixture views built on them (FIXTURES.md part B).

Every view is a lazy DataFrame over the parquet scan, so Catalyst prunes columns and
pushes filters into the scan.  Nothing here collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodic.operators.episodes import add_timestep
from episodic.operators.frames import running_totals

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the dialogue / token fixtures (the reference's marker ids and strings).
ASSISTANT_START = [151644, 77091, 198]  # "<|im_start|>assistant\n"
ASSISTANT_END = 151645
PAD_ID = 151643
ACTION_TOKEN_MIN = 151665
ACTION_TOKEN_MAX = 153712
TOKENS_PER_SEQ = 32  # events per token sequence (sequences stay bounded)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``steps``: one row per step; episode = user, dataset = user_id % 5.

    Also carries the standardized 7-D ``action`` (world ++ rotation ++ gripper)
    and 8-D ``proprio`` (= state) used by the trajectory operators.
    """
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("int")
    hour, minute, second = (F.hour("ts").cast("double"), F.minute("ts").cast("double"), F.second("ts").cast("double"))
    base = ev.select(
        F.concat(F.lit("ds"), (F.col("user_id") % 5).cast("string")).alias("dataset_name"),
        F.col("user_id").alias("traj_id"),
        "event_id",
        "ts",
        "event_type",
        "value",
        k.alias("k"),
    )
    base = add_timestep(base, ["dataset_name", "traj_id"], ["ts", "event_id"])
    value = F.col("value")
    out = base.select(
        "dataset_name",
        "traj_id",
        "t",
        "event_id",
        "ts",
        F.array(value, F.col("k") / F.lit(10.0), hour).alias("world_vector"),
        F.array(minute, second, F.lit(0.0)).alias("rotation_delta"),
        (F.col("k") / F.lit(100.0)).alias("gripper"),
        F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "purchase", -1.0).otherwise(0.0).alias("rel_gripper"),
        F.array(value, value * 0.5, F.col("k").cast("double"), hour, minute, second, F.col("k") / F.lit(100.0), value / F.lit(100.0)).alias("state"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.concat(F.lit("img/"), F.col("event_id").cast("string"))).alias("image"),
        F.when(F.col("traj_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Task "), (F.col("traj_id") % 10).cast("string"))).alias("language_instruction"),
    )
    return out.withColumn("action", F.concat("world_vector", "rotation_delta", F.array("gripper"))).withColumn("proprio", F.col("state"))


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``order_steps``: lineitem as episodes (traj = order), 4-D action; one dataset (a hot group)."""
    li = read_table(
        spark, sf_dir, "lineitem",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"],
    )
    li = li.withColumn("dataset_name", F.lit("lineitem")).withColumnRenamed("l_orderkey", "traj_id")
    li = add_timestep(
        li, ["dataset_name", "traj_id"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"],
    )
    return li.select(
        "dataset_name", "traj_id", "t",
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("action"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``vectors``: dataset = label, 64-d embedding as the action vector, one step per vector."""
    em = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return em.select(
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("dataset_name"),
        F.col("vec_id").alias("traj_id"),
        F.lit(0).alias("t"),
        F.transform("embedding", lambda v: v.cast("double")).alias("action"),
    )


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``dialogue``: one row per conversation in the reference's string encoding.

    Every turn is in it: an assistant turn answers all turns since the one before it (system
    and user texts, joined by a line break), together a pair ``[USER]u[ASSISTANT]a``; turns that
    nobody answers form a last pair with an empty answer.  Pairs are joined by ``[UNK]``; audio
    paths ``./audio/<conv>_<first turn>.wav`` likewise; ``response`` is the last answer for even
    conv_id and '' for odd.  The number of answers before a turn is a running total in blocks,
    so only the encoded record itself holds a conversation.
    """
    cv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    cv = cv.withColumn("_a", (F.col("role") == "assistant").cast("bigint"))
    cv = running_totals(cv, ["conv_id"], ["turn"], ["_a"], "_cum")
    said = F.when(F.col("_a") == 0, F.struct("turn", "text"))
    pairs = cv.groupBy("conv_id", (F.col("_a_cum") - F.col("_a")).alias("pair")).agg(
        F.min("turn").alias("turn"), F.array_sort(F.collect_list(said)).alias("u"), F.max(F.when(F.col("_a") == 1, F.col("text"))).alias("a"))
    utext = F.array_join(F.transform("u", lambda s: F.coalesce(s["text"], F.lit(""))), "\n")
    pairs = pairs.select(
        "conv_id", "turn", F.coalesce("a", F.lit("")).alias("assistant"),
        F.concat(F.lit("[USER]"), utext, F.lit("[ASSISTANT]"), F.coalesce("a", F.lit(""))).alias("pair"),
        F.concat(F.lit("./audio/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".wav")).alias("path"))
    agg = pairs.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "pair", "path", "assistant"))).alias("p")
    )
    return agg.select(
        "conv_id",
        F.array_join(F.transform("p", lambda s: s["pair"]), "[UNK]").alias("conversation"),
        F.array_join(F.transform("p", lambda s: s["path"]), "[UNK]").alias("speech_conv"),
        F.when(F.col("conv_id") % 2 == 0, F.element_at("p", -1)["assistant"]).otherwise(F.lit("")).alias("response"),
        F.concat(F.lit("img/"), F.col("conv_id").cast("string")).alias("image"),
        F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit("_0")).alias("first_frame_image"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``tokens``: per user and block of 32 steps, ids = 151665 + k in time order.

    Every 4th block of a user has no marker; the others carry the assistant-start marker
    before the ids, sequences with odd block also get a second marker in the middle;
    one end token and two pad ids close each sequence.
    """
    st = steps(spark, sf_dir).select("traj_id", "t", "state")
    st = st.withColumn("blk", F.floor(F.col("t") / TOKENS_PER_SEQ))
    seqs = st.groupBy("traj_id", "blk").agg(
        F.array_sort(F.collect_list(F.struct("t", (F.lit(ACTION_TOKEN_MIN) + F.col("state")[2].cast("bigint")).alias("id")))).alias("s")
    )
    ids = F.transform("s", lambda x: x["id"])
    marker = F.array(*[F.lit(v).cast("bigint") for v in ASSISTANT_START])
    half = F.floor(F.size(ids) / 2).cast("int")
    body = F.when(
        F.col("blk") % 2 == 1,
        F.concat(F.slice(ids, 1, half), marker, F.slice(ids, half + 1, F.size(ids))),
    ).otherwise(ids)
    tail = F.array(F.lit(ASSISTANT_END).cast("bigint"), F.lit(PAD_ID).cast("bigint"), F.lit(PAD_ID).cast("bigint"))
    seq_id = F.col("traj_id") * (1 << 32) + F.col("blk")
    input_ids = F.when((seq_id % 4) == 0, F.concat(ids, tail)).otherwise(F.concat(marker, body, tail))
    return seqs.select(seq_id.alias("seq_id"), input_ids.alias("input_ids"), F.lit(PAD_ID).cast("bigint").alias("pad_id"))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``rollouts``: task = event_type, episode = event_id, success = value > 50."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    return ev.select(F.col("event_type").alias("task"), F.col("event_id").alias("episode"), (F.col("value") > 50).alias("success"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``metrics``: step = event_id + 1, loss = value."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "value"])
    return ev.select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``mixture``: dataset = document source, size = its document count,
    weight 1.0 / 2.0 / 0.5 by (source number) mod 3, pos = source number."""
    docs = read_table(spark, sf_dir, "documents", ["source"])
    num = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("size")).select(
        F.col("source").alias("dataset_name"),
        F.col("size").cast("bigint").alias("size"),
        F.when(num % 3 == 0, 1.0).when(num % 3 == 1, 2.0).otherwise(0.5).alias("weight"),
        num.alias("pos"),
    )


def mixture_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture spec with duplicates: mix = lang, one entry per (lang, source, text-length band);
    weight by band, pos = smallest doc_id of the entry.  Duplicated (mix, dataset) pairs
    exercise the first-wins rule of P12."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    band = F.when(F.col("n_chars") < 2000, 0).when(F.col("n_chars") < 20000, 1).otherwise(2)
    return docs.groupBy(F.col("lang").alias("mix"), F.col("source").alias("dataset_name"), band.alias("band")).agg(
        F.min("doc_id").alias("pos")
    ).select("mix", "dataset_name", (F.lit(1.0) / (F.col("band") + 1)).alias("weight"), "pos")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``checkpoints``: names steps_<o_orderkey> plus other_<n> per customer."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    a = o.select(F.col("o_custkey").alias("run"), F.concat(F.lit("steps_"), F.col("o_orderkey").cast("string")).alias("name"))
    b = o.select(F.col("o_custkey").alias("run"), F.concat(F.lit("other_"), F.col("o_orderkey").cast("string")).alias("name"))
    c = o.select(F.col("o_custkey").alias("run"), F.concat(F.lit("steps_"), F.col("o_orderkey").cast("string"), F.lit("x")).alias("name"))
    return a.unionByName(b).unionByName(c)


def raw_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw per-dataset step fields for the standardizer recipes, derived from ``steps``:
    every family's source columns (nested-action, flat-action, quaternion, 2-D,
    velocity and code-point instruction forms) are deterministic functions of an event."""
    st = steps(spark, sf_dir)
    value, k = F.col("state")[0], F.col("state")[2]
    hour, minute, second = F.col("state")[3], F.col("state")[4], F.col("state")[5]
    qraw = [k / 100.0, hour / 24.0, minute / 60.0, F.lit(1.0)]
    qn = F.sqrt(sum((q * q for q in qraw[1:]), qraw[0] * qraw[0]))
    lang = F.col("language_instruction")
    cps = F.when(F.length(lang) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(lang)), lambda i: F.ascii(F.substring(lang, i, 1)))
    )
    return st.select(
        "dataset_name", "traj_id", "t", "world_vector", "rotation_delta", "state", "action", "image", "language_instruction",
        (F.col("gripper") > 0.5).alias("open_gripper"),
        F.col("rel_gripper").alias("gripper_closedness_action"),
        F.concat(F.slice("action", 1, 6), F.array(F.col("rel_gripper") * 1.5)).alias("rel_actions"),
        F.col("state").alias("robot_obs"),
        F.array(value / 100.0, k / 100.0).alias("action2"),
        F.concat(cps, F.array(F.lit(0), F.lit(0))).alias("instruction"),
        F.concat("world_vector", F.array(*[q / qn for q in qraw]), F.array("gripper")).alias("action_quat"),
        F.array(value / 100.0, value / 200.0).alias("position"),
        F.array(second / 60.0).alias("yaw"),
        F.array(value / 100.0, k / 1000.0, hour / 100.0, minute / 600.0, second / 600.0, k / 500.0).alias("cartesian_velocity"),
        F.array(k / 100.0, hour / 24.0, minute / 60.0, second / 60.0 * 3.14, k / 200.0, hour / 48.0).alias("cartesian_position"),
        F.array("gripper").alias("gripper_position"),
        F.slice("action", 1, 6).alias("action6"),
        F.concat("image", F.lit("#1")).alias("exterior_image_1_left"),
        F.concat("image", F.lit("#2")).alias("exterior_image_2_left"),
    )


#: Datasets of the raw mixture and the users that belong to each (user_id mod 5).
RAW_DATASETS = ("bridge_oxe", "fractal20220817_data", "libero_spatial_no_noops", "taco_play", "tdroid_carrot_in_bowl")


def raw_datasets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw steps of five datasets, each in its own source's nested columns, derived from
    ``steps``: the events of the users with user_id mod 5 = its place in ``RAW_DATASETS``."""
    st = steps(spark, sf_dir)
    spoken, state = F.col("language_instruction"), F.col("state")
    step_id = ["traj_id", "t", "event_id"]

    def of(k: int) -> DataFrame:
        return st.where(F.col("traj_id") % 5 == k)

    def s(*fields: Column) -> Column:
        return F.struct(*fields)

    bridge = of(0).select(
        *step_id, s(F.col("world_vector"), F.col("rotation_delta"), (F.col("gripper") > 0.5).alias("open_gripper")).alias("action"),
        s(state.alias("state"), spoken.alias("natural_language_instruction"), F.col("image").alias("image")).alias("observation"))
    fractal = of(1).select(
        *step_id, s(F.col("world_vector"), F.col("rotation_delta"), F.array("rel_gripper").alias("gripper_closedness_action")).alias("action"),
        s(spoken.alias("natural_language_instruction"), F.col("image").alias("image")).alias("observation"))
    libero = of(2).select(
        *step_id, F.concat(F.slice("action", 1, 6), F.array(F.col("gripper") * 2 - 0.5)).alias("action"),
        s(state.alias("state"), F.col("image").alias("image")).alias("observation"), spoken.alias("language_instruction"))
    taco = of(3).select(
        *step_id, s(F.concat(F.slice("action", 1, 6), F.array(F.col("rel_gripper") * 1.5)).alias("rel_actions_world")).alias("action"),
        s(state.alias("robot_obs"), spoken.alias("natural_language_instruction"), F.col("image").alias("image")).alias("observation"))
    tdroid = of(4).select(
        *step_id, "action", s(F.slice("state", 1, 6).alias("cartesian_position"), F.array("gripper").alias("gripper_position"), F.col("image").alias("image")).alias("observation"),
        spoken.alias("language_instruction"))
    return dict(zip(RAW_DATASETS, (bridge, fractal, libero, taco, tdroid), strict=True))
