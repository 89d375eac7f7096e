"""Dialogue operators: parse encoded conversations, build chat messages, act-mode switch.

A conversation row (bounded: a handful of turns) carries the reference's string
encoding; all parsing is array expressions on that row.  Act-mode switching numbers an
episode's turns in buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodic.functions import text as X
from episodic.operators.frames import rank_in_group

MSG_TYPE = "array<struct<role:string,content:array<struct<type:string,value:string>>>>"


def parse_conversation(df: DataFrame, conversation: str = "conversation", speech: str = "speech_conv",
                       root: str = "") -> DataFrame:
    """``turns`` = array<struct<idx, assistant, audio>> from the encoded strings."""
    turns = X.split_turns(conversation)
    paths = X.split_turns(speech)
    zipped = F.transform(
        turns,
        lambda tr, i: F.struct(
            i.alias("idx"),
            X.assistant_text(tr).alias("assistant"),
            X.strip_path(F.get(paths, i), root).alias("audio"),
        ),
    )
    return df.withColumn("turns", zipped)


def response_turn(turns, response) -> Column:
    """Index of the first turn whose assistant text equals ``response``; error if none."""
    texts = F.transform(F.col(turns) if isinstance(turns, str) else turns, lambda t: t["assistant"])
    pos = F.array_position(texts, F.col(response) if isinstance(response, str) else response)
    return F.when(pos > 0, (pos - 1).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("no turn answers with: "), F.col(response)))
    )


def _content(*items) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("type"), v.cast("string").alias("value")) for t, v in items])


def _pair_messages(turn, image: Column) -> Column:
    user = F.struct(F.lit("user").alias("role"), _content(("image", image), ("audio", turn["audio"])).alias("content"))
    asst = F.struct(F.lit("assistant").alias("role"), _content(("text", turn["assistant"])).alias("content"))
    return F.array(user, asst)


def build_messages(df: DataFrame, image: str = "first_frame_image", pixels: str = "image",
                   response: str = "response", action_ids: str = "action_ids") -> DataFrame:
    """Chat messages.
    * response non-empty: turns 0..match as (user: image+audio, assistant: text) pairs;
    * response empty: every turn, then user(current image) + assistant(action tokens)."""
    img = F.col(image)
    with_resp = F.length(response) > 0
    idx = F.when(with_resp, response_turn("turns", response))
    upto = F.slice("turns", 1, idx + 1)
    pairs_resp = F.flatten(F.transform(upto, lambda t: _pair_messages(t, img)))
    pairs_all = F.flatten(F.transform("turns", lambda t: _pair_messages(t, img)))
    tail = F.array(
        F.struct(F.lit("user").alias("role"), _content(("image", F.col(pixels))).alias("content")),
        F.struct(F.lit("assistant").alias("role"), _content(("text", X.action_tokens(action_ids))).alias("content")),
    )
    msgs = F.when(with_resp, pairs_resp).otherwise(F.concat(pairs_all, tail))
    return df.withColumn("messages", msgs.cast(MSG_TYPE))


def act_mode(df: DataFrame, text: str, order: str, keys: list[str], limit: int = 2) -> DataFrame:
    """Per episode the model answers in dialogue until a reply contains ``[ACT]`` or the
    history reaches ``limit`` (the reference passes the task dict's length, 2); from the
    next step on it is in action mode.  A reply that hits the limit without the marker
    gets `` [ACT]`` appended.

    The switch comes with one of the first ``limit`` replies, so it is the least number of a
    marked reply among those (a partial aggregate); replies are numbered in buckets."""
    ranked = rank_in_group(df, keys, [order], "_before")  # history length before this step
    early = ranked.where((F.col("_before") < limit) & X.has_act(text))
    first = early.groupBy(*keys).agg(F.min("_before").alias("_marked"))
    out = ranked.join(first, keys, "left")
    turn = F.least(F.coalesce("_marked", F.lit(limit - 1)), F.lit(limit - 1))
    switched = F.col("_before") > turn
    reply = F.when(switched, F.lit(None).cast("string")).when(X.has_act(text), F.col(text)).when(
        F.col("_before") + 1 >= limit, F.concat(F.col(text), F.lit(" " + X.ACT_MARKER))
    ).otherwise(F.col(text))
    return out.withColumn("mode", F.when(switched, F.lit("action")).otherwise(F.lit("dialogue"))).withColumn("reply", reply).drop("_before", "_marked")


def instruction_catalog(items: DataFrame) -> DataFrame:
    """Instruction -> (speech_conv, responses); a later duplicate instruction wins.

    ``items`` rows: instruction, speech_conv array, conversation array<struct<response>>,
    pos (file order)."""
    rec = F.struct(F.col("speech_conv").alias("speech_conv"), F.transform("conversation", lambda c: c["response"]).alias("conv"))
    return items.groupBy("instruction").agg(F.max_by(rec, "pos").alias("entry"))


def attach_dialogue(df: DataFrame, catalog: DataFrame, task: str = "task") -> DataFrame:
    """Task description -> catalog entry.  A task without entry is an error; a step without a
    task (null or empty) is not labelled and has no entry."""
    out = df.join(catalog.withColumnRenamed("instruction", task), task, "left")
    labelled = F.coalesce(F.length(task), F.lit(0)) > 0
    lost = F.raise_error(F.concat(F.lit("no dialogue for task "), F.col(task)))
    return out.withColumn("entry", F.when(labelled & F.col("entry").isNull(), lost).when(labelled, F.col("entry")))
