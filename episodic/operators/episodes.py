"""Episode (trajectory) operators: timestep, filters, gripper relabels, chunking, goals.

An episode is the group of step rows sharing ``(dataset_name, traj_id)``, ordered by the
dense 0-based ``t``.  One episode may be huge (a third of all rows), so no operator
partitions a window by the episode alone.  Instead every episode window is *blocked*:

* ``_blk = t div B`` (``B`` = ``episodic.episodeBlockRows``, default 65,536); windows
  partition by ``(dataset_name, traj_id, _blk)``, so a long episode spreads over
  ``n / B`` tasks while a normal episode is one block;
* ``lead``/``lag`` by up to ``h`` rows see across block edges through a neighbour table:
  the first/last ``h`` values of every block (bounded aggregates of edge rows only)
  joined on (episode, block), so step rows never move between partitions;
* episode-level values (length, first/last value, any/all flags) are partial
  aggregates per episode, joined back on ``(dataset_name, traj_id, _blk)`` -- the key the
  windows already partition by, so no further exchange of the step rows;
* sequential scans (the reference's ``tf.scan``) are two-level: a scan inside the block
  (``first/last(..., ignorenulls)`` frames) plus a carry from the neighbouring blocks,
  computed on the per-block summary table, again in blocks (blocks of blocks).

The timestep itself (P5) is ``frames.rank_in_group``, which cuts episodes above
``episodic.hotEpisodeRows`` into buckets.  ``_blk`` is kept on the rows so consecutive
operators share one partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodic.functions import vector as V
from episodic.functions.rand import u01
from episodic.session import materialize

EPISODE = ["dataset_name", "traj_id"]
BLK = "_blk"
DEFAULT_BLOCK_ROWS = 1 << 16
DEFAULT_HOT_EPISODE_ROWS = 1 << 22


def block_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("episodic.episodeBlockRows", str(DEFAULT_BLOCK_ROWS)))


def with_block(df: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Add the episode block column and distribute the steps by (episode, block) -- the one
    exchange that splits long episodes over tasks; later operators reuse it."""
    if BLK in df.columns:
        return df
    out = df.withColumn(BLK, F.floor(F.col("t") / F.lit(block_rows(df))).cast("int"))
    return out.repartition(*keys, BLK)


def episode_window(keys: Sequence[str] = EPISODE, order: Sequence[str] = ("t",)):
    """Window over one block of an episode."""
    return Window.partitionBy(*keys, BLK).orderBy(*order)


def _whole_block(keys=EPISODE):
    return episode_window(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def attach_episode(df: DataFrame, aggs: Mapping[str, Column], keys: Sequence[str] = EPISODE) -> DataFrame:
    """Attach per-episode aggregates to every step row.

    The aggregate is partial (map-side combined), then replicated over the episode's
    blocks and joined on (keys, _blk), the partitioning of the blocked windows."""
    df = with_block(df, keys)
    todo = {n: c for n, c in aggs.items() if n not in df.columns}  # cached ``_ep_*`` columns are reused
    if not todo:
        return df
    ep = df.groupBy(*keys).agg(F.max(BLK).alias("_maxblk"), *[c.alias(n) for n, c in todo.items()])
    ep = ep.withColumn(BLK, F.explode(F.sequence(F.lit(0), F.col("_maxblk")))).drop("_maxblk")
    return df.join(ep, [*keys, BLK], "inner")


def invalidate(df: DataFrame) -> DataFrame:
    """Drop cached per-episode columns (after an operator removed or re-indexed steps)."""
    return df.drop(*[c for c in df.columns if c.startswith("_ep_")])


def ep_n() -> tuple[str, Column]:
    return "_ep_n", F.count(F.lit(1))


def ep_first(c: str) -> tuple[str, Column]:
    return "_ep_first_" + c, F.min_by(c, "t")


def ep_last(c: str) -> tuple[str, Column]:
    return "_ep_last_" + c, F.max_by(c, "t")


def ep_anylabel(lang: str) -> tuple[str, Column]:
    return "_ep_anylabel_" + lang, F.max((F.col(lang) != "").cast("int"))


def ep_absok(col: str, limit: float) -> tuple[str, Column]:
    ok = F.min(F.forall(col, lambda v: F.abs(v) <= F.lit(limit)).cast("int"))
    return f"_ep_absok_{col}_{str(limit).replace('.', '_')}", ok


def nh(c: str, lead: int) -> str:
    return f"_ep_nh{lead}_{c}"


def pt(c: str, lag: int) -> str:
    return f"_ep_pt{lag}_{c}"


def attach_neighbors(df: DataFrame, lead: Mapping[str, int], lag: Mapping[str, int], keys=EPISODE) -> DataFrame:
    """Attach, per row, the first ``lead[c]`` values of the next block and the last ``lag[c]``
    values of the previous block of each column.  Only block-edge rows are aggregated (at
    most lead + lag per block), one small table for all columns, joined on (episode,
    block), so the step rows keep their partitioning.  Already attached arrays are reused."""
    df = with_block(df, keys)
    b = block_rows(df)
    lead = {c: k for c, k in lead.items() if k > 0 and nh(c, k) not in df.columns}
    lag = {c: k for c, k in lag.items() if k > 0 and pt(c, k) not in df.columns}
    if not lead and not lag:
        return df
    if max([*lead.values(), *lag.values()]) >= b:
        raise ValueError(f"offsets must be smaller than the block size {b}")
    pos = F.pmod(F.col("t"), F.lit(b))
    parts = []

    def getter(name):
        return lambda e: e[name]

    if lead:
        hmax = max(lead.values())
        cols = sorted(lead)
        head = df.filter(pos < hmax).groupBy(*keys, BLK).agg(F.array_sort(F.collect_list(F.struct("t", *cols))).alias("_e"))
        parts.append(head.select(*keys, (F.col(BLK) - 1).alias(BLK),
                                 *[F.slice(F.transform("_e", getter(c)), 1, lead[c]).alias(nh(c, lead[c])) for c in cols]))
    if lag:
        lmax = max(lag.values())
        cols = sorted(lag)
        tail = df.filter(pos >= b - lmax).groupBy(*keys, BLK).agg(F.array_sort(F.collect_list(F.struct("t", *cols))).alias("_e"))
        parts.append(tail.select(*keys, (F.col(BLK) + 1).alias(BLK),
                                 *[F.slice(F.transform("_e", getter(c)), lmax - lag[c] + 1, lag[c]).alias(pt(c, lag[c])) for c in cols]))
    nb = parts[0] if len(parts) == 1 else parts[0].join(parts[1], [*keys, BLK], "full_outer")
    return df.join(nb, [*keys, BLK], "left")


def _gather(col: str, off: int, w, lead: int, lag: int, b: int) -> Column:
    """Value ``off`` steps away inside the episode: in-block lead/lag, else the neighbour block.
    Which one is told by the index, so a null value stays null."""
    if off == 0:
        return F.col(col)
    pos = F.pmod(F.col("t"), F.lit(b))
    if off > 0:
        return F.when(pos + off < b, F.lead(col, off).over(w)).otherwise(F.get(F.col(nh(col, lead)), pos + off - b))
    return F.when(pos + off >= 0, F.lag(col, -off).over(w)).otherwise(F.get(F.col(pt(col, lag)), pos + off + lag))


def _nearest(summary: DataFrame, value: str, out: str, before: bool, keys=EPISODE, at: str = BLK) -> DataFrame:
    """``summary`` (one row a block, written) with ``out``: the last non-null ``value`` of the blocks before
    (or the first of those after) each one.

    Blocks are taken together by ``episodic.blockFan`` (2,048) into blocks of blocks, and those
    again, so a window sees at most that many rows: the nearest value inside the block of blocks,
    else the one carried into it from its own neighbours."""
    fan = int(summary.sparkSession.conf.get("episodic.blockFan", "2048"))
    up = f"{at}u"
    rows = summary.withColumn(up, F.floor(F.col(at) / fan).cast("int"))
    w = Window.partitionBy(*keys, up).orderBy(at)
    near = (F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if before
            else F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.withColumn(out, near)
    if fan ** (len(up) - len(BLK)) >= 1 << 31:  # the one block of blocks of this level is the whole episode
        return rows.drop(up)
    pick = (F.max_by if before else F.min_by)(value, F.when(F.col(value).isNotNull(), F.col(at)))
    carried = f"_carried{up}"
    above = _nearest(rows.groupBy(*keys, up).agg(pick.alias(value)), value, carried, before, keys, up)
    return rows.join(above.select(*keys, up, carried), [*keys, up]).withColumn(out, F.coalesce(out, carried)).drop(up, carried)


def _block_summary_join(df: DataFrame, summary: DataFrame, keys=EPISODE) -> DataFrame:
    return df.join(summary, [*keys, BLK], "inner")


# --------------------------------------------------------------------- P5 / A3
def add_timestep(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "t") -> DataFrame:
    """P5: 0-based index (bigint) of each step inside its episode (``order`` must be total).

    An episode of more than ``episodic.hotEpisodeRows`` steps is cut into buckets of that size
    (``rank_in_group``), any other one is a single bucket."""
    from episodic.operators.frames import rank_in_group

    return rank_in_group(df, keys, order, name)


def with_traj_len(df: DataFrame, keys: Sequence[str] = EPISODE, name: str = "traj_len") -> DataFrame:
    """A3: number of steps of the row's episode."""
    return attach_episode(df, {name: F.count(F.lit(1))}, keys)


def traj_lengths(df: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """A3 as an aggregate: one row per episode (partial aggregation, no sort)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("traj_len"))


def any_all(df: DataFrame, any_of: Mapping[str, Column], all_of: Mapping[str, Column], keys: Sequence[str] = EPISODE) -> DataFrame:
    """A4: per episode whether any step, or every step, fulfils a condition (null counts as
    unknown and is left out; an episode of nulls alone gives null).  Partial aggregates only."""
    return df.groupBy(*keys).agg(*[F.bool_or(c).alias(n) for n, c in any_of.items()], *[F.every(c).alias(n) for n, c in all_of.items()])


# --------------------------------------------------------------------- filters
def skip_unlabeled(df: DataFrame, lang: str = "language_instruction", keys=EPISODE) -> DataFrame:
    """keep an episode iff any step has a non-empty instruction."""
    if lang not in df.columns:
        raise ValueError(f"no instruction column {lang!r} to filter by")
    name, agg = ep_anylabel(lang)
    return attach_episode(df, {name: agg}, keys).filter(F.col(name) == 1)


def max_abs_filter(df: DataFrame, col: str, limit: float | None, keys=EPISODE) -> DataFrame:
    """keep an episode iff |x| <= limit for all dims of all steps.
    A missing column (no proprio) or ``limit=None`` keeps everything."""
    if limit is None or col not in df.columns:
        return df
    name, ok = ep_absok(col, limit)
    return attach_episode(df, {name: ok}, keys).filter(F.col(name) == 1)


def drop_first_step(df: DataFrame, keys=EPISODE) -> DataFrame:
    """remove step 0 and re-index (blocks are recomputed from the new t)."""
    out = invalidate(df).filter(F.col("t") > 0).withColumn("t", F.col("t") - 1)
    return out.drop(BLK) if BLK in out.columns else out


def drop_last_step(df: DataFrame, keys=EPISODE) -> DataFrame:
    """remove the last step of each episode."""
    n, agg = ep_n()
    out = attach_episode(df, {n: agg}, keys)
    return invalidate(out.filter(F.col("t") < F.col(n) - 1))


def chunk_filter(df: DataFrame, pred: Column | None) -> DataFrame:
    """optional per-dataset frame predicate."""
    return df if pred is None else df.filter(pred)


# --------------------------------------------------------------------- W6 / W7 / W8
def binarize_gripper_df(df: DataFrame, x: str, out: str, keys=EPISODE) -> DataFrame:
    """>0.95 -> 1, <0.05 -> 0, in-between takes the next decided value; a trailing
    undecided run takes the episode's last raw value.  Two-level scan: the next decided
    value inside the block, else the first decided value of a later block, else the
    episode's last raw value (both from the per-block summary)."""
    df = with_block(df)
    dec = F.when(F.col(x) > V.GRIPPER_OPEN, F.lit(1.0)).when(F.col(x) < V.GRIPPER_CLOSED, F.lit(0.0))
    df = df.withColumn("_dec", dec)
    summ = materialize(df.groupBy(*keys, BLK).agg(
        F.min_by("_dec", F.when(F.col("_dec").isNotNull(), F.col("t"))).alias("_first"), F.max_by(F.col(x), "t").alias("_end")))
    ends = summ.groupBy(*keys).agg(F.max_by("_end", BLK).alias("_lastraw"))
    summ = _nearest(summ, "_first", "_carry", False, keys).select(*keys, BLK, "_carry").join(ends, list(keys))
    inblk = F.first("_dec", ignorenulls=True).over(episode_window(keys).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out_df = _block_summary_join(df, summ, keys).withColumn(out, F.coalesce(inblk, F.col("_carry"), F.col("_lastraw").cast("double")))
    return out_df.drop("_dec", "_carry", "_lastraw")


def rel2abs_gripper_df(df: DataFrame, x: str, out: str, keys=EPISODE) -> DataFrame:
    """Relative (+close / -open) to absolute (0 closed, 1 open).  Threshold +-0.1,
    forward fill of the last non-zero; before the first non-zero the state is the
    negation of that first non-zero (1 = open if there is none).  Two-level scan with
    the carry from earlier blocks."""
    df = with_block(df)
    thr = F.when(F.col(x) < -V.REL_THRESHOLD, F.lit(1)).when(F.col(x) > V.REL_THRESHOLD, F.lit(-1))
    known = F.when(F.col("_thr").isNotNull(), F.col("t"))
    df = df.withColumn("_thr", thr)
    summ = materialize(df.groupBy(*keys, BLK).agg(F.max_by("_thr", known).alias("_last"), F.min_by("_thr", known).alias("_start")))
    starts = summ.groupBy(*keys).agg(F.min_by("_start", F.when(F.col("_start").isNotNull(), F.col(BLK))).alias("_first"))
    summ = _nearest(summ, "_last", "_carry", True, keys).select(*keys, BLK, "_carry").join(starts, list(keys))
    inblk = F.last("_thr", ignorenulls=True).over(episode_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    val = F.coalesce(inblk, F.col("_carry"), -F.col("_first"), F.lit(1)).cast("double") / F.lit(2.0) + F.lit(0.5)
    return _block_summary_join(df, summ, keys).withColumn(out, val).drop("_thr", "_carry", "_first")


def state_delta(df: DataFrame, state: str = "state", action: str = "action", keys=EPISODE) -> DataFrame:
    """action[:6] = state[t+1][:6] - state[t][:6], keep the action's gripper; drop the last step."""
    h = attach_neighbors(attach_episode(df, dict([ep_n()]), keys), {state: 1}, {}, keys)
    h = h.withColumn("_nxt", _gather(state, 1, episode_window(keys), 1, 0, block_rows(h)))
    h = invalidate(h.filter(F.col("t") < F.col(ep_n()[0]) - 1))
    delta = F.zip_with(F.slice("_nxt", 1, 6), F.slice(state, 1, 6), lambda a, b: a - b)
    return h.withColumn(action, F.concat(delta, F.slice(action, -1, 1))).drop("_nxt")


# --------------------------------------------------------------------- W1-W4 chunking
def chunk_obs(df: DataFrame, cols: Sequence[str], window: int, keys=EPISODE, suffix: str = "_chunk") -> DataFrame:
    """W1 + W4: each observation column gets a window axis (t-W+1 .. t, clamped at 0)
    and ``pad_mask`` marks slots whose un-clamped index is >= 0."""
    df = attach_episode(df, dict(ep_first(c) for c in cols), keys)
    lag = window - 1
    h = attach_neighbors(df, {}, {c: lag for c in cols}, keys)
    w, b = episode_window(keys), block_rows(df)
    for c in cols:
        slots = [F.when(F.col("t") + (s - window + 1) >= 0, _gather(c, s - window + 1, w, 0, lag, b)).otherwise(F.col(ep_first(c)[0]))
                 if s < window - 1 else F.col(c) for s in range(window)]
        h = h.withColumn(c + suffix, F.array(*slots))
    mask = F.array(*[(F.col("t") + F.lit(s - window + 1)) >= 0 for s in range(window)])
    return h.withColumn("pad_mask", mask)


def chunk_action(
    df: DataFrame,
    window: int = 1,
    future: int = 0,
    abs_mask: Sequence[bool] | None = None,
    action: str = "action",
    out: str = "action_chunk",
    keys=EPISODE,
) -> DataFrame:
    """W2 + W3: action chunk with slots t-W+1 .. t+F, indices clamped to [0, len-1];
    slots past the episode end become neutral: absolute dims repeat the last action,
    relative dims are 0 (no mask = all relative)."""
    fa, la, n = ep_first(action)[0], ep_last(action)[0], ep_n()[0]
    df = attach_episode(df, dict([ep_first(action), ep_last(action), ep_n()]), keys)
    if abs_mask is None:
        neutral = F.transform(la, lambda v: F.lit(0.0))
    else:
        m = F.array(*[F.lit(bool(b)) for b in abs_mask])
        neutral = F.zip_with(m, la, lambda b, v: F.when(b, v).otherwise(F.lit(0.0)))
    lag = window - 1
    h = attach_neighbors(df, {action: future}, {action: lag}, keys)
    w, b = episode_window(keys), block_rows(df)
    slots = []
    for s in range(window + future):
        off = s - window + 1
        if off < 0:
            slots.append(F.when(F.col("t") + F.lit(off) >= 0, _gather(action, off, w, future, lag, b)).otherwise(F.col(fa)))
        elif off == 0:
            slots.append(F.col(action))
        else:
            slots.append(F.when(F.col("t") + F.lit(off) > F.col(n) - 1, neutral).otherwise(_gather(action, off, w, future, lag, b)))
    return h.withColumn(out, F.array(*slots))


def add_pad_mask_dict(df: DataFrame, fields: Sequence[str], name: str = "pad_mask_dict") -> DataFrame:
    """Per field, strings are padding iff empty; other types are never padding."""
    types = dict(df.dtypes)
    parts = []
    for f in fields:
        if types[f] == "string":
            parts.append((F.length(f) != 0).alias(f))
        else:
            parts.append(F.lit(True).alias(f))
    return df.withColumn(name, F.struct(*parts))


# --------------------------------------------------------------------- W9 / J5
def goal_index(seed: int, n: Column | str = "_ep_n", keys=EPISODE, again: Sequence[str] = ()) -> Column:
    """W9 index: uniform in [t+1, len), truncated, clamped to len-1 (last step -> itself).
    ``again``: columns with which the draw is made anew (the pass of a drawn frame)."""
    n = F.col(n) if isinstance(n, str) else n
    low = F.col("t") + F.lit(1)
    g = F.floor(u01(seed, *keys, "t", *again) * (n - low) + low).cast("bigint")
    return F.least(g, n - 1)


def goal_uniform(df: DataFrame, seed: int, obs_cols: Sequence[str], keys=EPISODE, source: DataFrame | None = None,
                 again: Sequence[str] = ()) -> DataFrame:
    """W9 + J5: draw a goal step per step and fetch its observation (equi-join on
    (episode, t) -- the key is near-unique, so the join is skew-free).  Goal fields land
    next to the step with their pad masks and ``goal_t`` = goal index.

    For drawn frames (some steps, some of them several times) ``source`` holds all steps, and
    ``again`` names the pass, so a frame that comes again has another goal."""
    source = df if source is None else source
    if source is df:
        with_goal = attach_episode(df, dict([ep_n()]), keys)
    elif ep_n()[0] in df.columns:
        with_goal = df
    else:
        with_goal = df.join(source.groupBy(*keys).agg(ep_n()[1].alias(ep_n()[0])), list(keys))
    with_goal = with_goal.withColumn("goal_t", goal_index(seed, ep_n()[0], keys, again))
    types = dict(source.dtypes)
    goal_side = source.select(
        *[F.col(k).alias("_g_" + k) for k in keys],
        F.col("t").alias("_g_t"),
        *[F.col(c).alias("goal_" + c) for c in obs_cols],
    )
    cond = [with_goal[k] == goal_side["_g_" + k] for k in keys] + [with_goal["goal_t"] == goal_side["_g_t"]]
    joined = with_goal.join(goal_side, cond, "inner").drop(*["_g_" + k for k in keys], "_g_t")
    masks = [
        ((F.length("goal_" + c) != 0) if types[c] == "string" else F.lit(True)).alias("goal_" + c)
        for c in obs_cols
    ]
    return joined.withColumn("goal_pad_mask", F.struct(*masks))


# --------------------------------------------------------------------- W10
def delete_task_conditioning(
    df: DataFrame, keep_image_prob: float, seed: int, image_cols: Sequence[str], lang: str = "language_instruction",
    timestep: str = "goal_t", keys=EPISODE, again: Sequence[str] = (),
) -> DataFrame:
    """Per step keep the goal images with probability p (always when the language is
    padding), else keep the language; pad the dropped side; when images are dropped the
    goal timestep becomes the last step, and what was dropped is marked as padding in
    ``goal_pad_mask`` and ``pad_mask_dict``.  No-op without language or image columns."""
    if lang not in df.columns or not image_cols:
        return df
    df = df if ep_n()[0] in df.columns else attach_episode(df, dict([ep_n()]), keys)
    keep_img = (u01(seed, *keys, "t", *again) < F.lit(keep_image_prob)) | (F.length(lang) == 0)
    df = df.withColumn("_keep_img", keep_img)
    for c in image_cols:
        df = df.withColumn(c, F.when(F.col("_keep_img"), F.col(c)).otherwise(F.lit("")))
    df = df.withColumn(lang, F.when(~F.col("_keep_img"), F.col(lang)).otherwise(F.lit("")))
    if timestep in df.columns:
        df = df.withColumn(timestep, F.when(F.col("_keep_img"), F.col(timestep)).otherwise(F.col(ep_n()[0]) - 1))
    for name, gone, fields in (("goal_pad_mask", ~F.col("_keep_img"), set(image_cols)), ("pad_mask_dict", F.col("_keep_img"), {lang})):
        if name in df.columns:
            inner = df.schema[name].dataType.names
            df = df.withColumn(name, F.struct(*[(F.col(name)[f] & ~gone if f in fields else F.col(name)[f]).alias(f) for f in inner]))
    return df.withColumnRenamed("_keep_img", "keep_images")


# --------------------------------------------------------------------- W11
def subsample(df: DataFrame, k: int | None, seed: int, keys=EPISODE) -> DataFrame:
    """Episodes longer than k keep k steps drawn without replacement (the k smallest
    seeded draws; ties by step).

    Draws are uniform, so the k smallest of n lie below a bound a little above k / n.  One
    aggregation with partial counts tells for each episode which of the bounds k' / n, 4 k' / n,
    16 k' / n, ... has at least k draws below it -- nearly always the first, and the last one holds
    all -- and only the steps below it are ranked: about k' = k + 6 sqrt(k) + 20 of an episode,
    however long it is."""
    if k is None:
        return df
    if k <= 0:
        return invalidate(df.limit(0))
    n, agg = ep_n()
    df = attach_episode(df, {n: agg}, keys).withColumn("_u", u01(seed, *keys, "t"))
    near = k + 6 * math.sqrt(k) + 20
    bound = F.lit(1.0)
    for j in reversed(range(18)):
        below = F.count_if(F.col("_u") < F.lit(near * 4.0**j) / F.col(n))
        bound = F.when(below >= F.least(F.lit(k), F.max(n)), F.lit(near * 4.0**j) / F.max(n)).otherwise(bound)
    low = attach_episode(df, {"_bound": bound}, keys).where(F.col("_u") < F.col("_bound"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_u", "t"))
    return invalidate(low.withColumn("_place", place).where(F.col("_place") <= k).drop("_u", "_bound", "_place"))


# --------------------------------------------------------------------- P3 / P17
def first_frame(df: DataFrame, col: str | None = None, image: str = "image", from_episode: bool = False,
                out: str = "image_first_frame", keys=EPISODE) -> DataFrame:
    """``image_first_frame``: the given per-step column (null -> ''), the episode's
    first image (``from_episode=True``), or '' when absent."""
    if from_episode:
        df = attach_episode(df, dict([ep_first(image)]), keys)
        return df.withColumn(out, F.coalesce(F.col(ep_first(image)[0]), F.lit("")))
    if col is None or col not in df.columns:
        return df.withColumn(out, F.lit(""))
    return df.withColumn(out, F.coalesce(F.col(col), F.lit("")))


def episode_pieces(df: DataFrame, cols: Sequence[str], piece: int = 1024, keys=EPISODE) -> DataFrame:
    """Episodic view as ordered lists of per-step records, cut into pieces of at
    most ``piece`` steps so no row (and no task) holds an unbounded episode."""
    p = F.floor(F.col("t") / piece).cast("int")
    return df.groupBy(*keys, p.alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("t", *cols))).alias("steps")
    )


def episode_summary(df: DataFrame, cols: Sequence[str], keys=EPISODE) -> DataFrame:
    """P17 check form: size, first and last record of each episode via partial aggregation."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("size")]
    for c in cols:
        aggs += [F.min_by(c, "t").alias("first_" + c), F.max_by(c, "t").alias("last_" + c)]
    return df.groupBy(*keys).agg(*aggs)
