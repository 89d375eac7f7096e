"""Compositions of the operators in the reference's order.

Every dataset of a mixture goes through the same plan at once: the union of the
standardized datasets is one DataFrame, all episode operators partition by
``(dataset_name, traj_id)``, so one exchange serves the whole mixture instead of a
loop over datasets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodic.operators import episodes as E
from episodic.operators import frames as FR
from episodic.operators import mixture as MX
from episodic.operators import normalize as N
from episodic.operators import recipes as RC
from episodic.operators import stats as S
from episodic.session import materialize


@dataclass
class TrajOptions:
    train: bool = True
    goal_relabeling: str | None = None  # "uniform"
    window: int = 1
    future: int = 0
    subsample_length: int | None = None
    skip_unlabeled: bool = False
    max_action: float | None = None
    max_proprio: float | None = None
    task_augment: str | None = None  # "delete_task_conditioning"
    keep_image_prob: float = 0.5
    absolute_action_mask: list[bool] | None = None
    image_cols: list[str] = field(default_factory=lambda: ["image"])
    language: str = "language_instruction"
    seed: int = 0


def episode_pipeline(df: DataFrame, o: TrajOptions) -> DataFrame:
    """Filters -> pad masks -> goal relabel -> task augmentation (train) -> chunk ->
    subsample (train).

    Every per-episode value the steps need (length, first/last action and images, filter
    flags) is attached in one aggregation, and the block-edge neighbours of the chunked
    columns in one small table, before the operators run; the operators find and reuse
    them, so the step rows are joined twice in total instead of once per operator."""
    aggs = [E.ep_n(), E.ep_first("action"), E.ep_last("action"), *[E.ep_first(c) for c in o.image_cols]]
    if o.skip_unlabeled:
        aggs.append(E.ep_anylabel(o.language))
    if o.max_action is not None:
        aggs.append(E.ep_absok("action", o.max_action))
    if o.max_proprio is not None and "proprio" in df.columns:
        aggs.append(E.ep_absok("proprio", o.max_proprio))
    df = E.attach_episode(df, dict(aggs))
    df = E.attach_neighbors(df, {"action": o.future}, {"action": o.window - 1, **{c: o.window - 1 for c in o.image_cols}})
    if o.skip_unlabeled:
        df = E.skip_unlabeled(df, o.language)
    df = E.max_abs_filter(df, "action", o.max_action)
    df = E.max_abs_filter(df, "proprio", o.max_proprio)
    df = E.add_pad_mask_dict(df, [*o.image_cols, o.language])
    goal_cols: list[str] = []
    if o.goal_relabeling == "uniform":
        df = E.goal_uniform(df, o.seed, o.image_cols)
        goal_cols = ["goal_" + c for c in o.image_cols]
    elif o.goal_relabeling is not None:
        raise ValueError(f"unknown goal relabeling strategy {o.goal_relabeling}")
    if o.task_augment not in (None, "delete_task_conditioning"):
        raise ValueError(f"unknown task augmentation {o.task_augment!r}")
    if o.train and o.task_augment == "delete_task_conditioning":
        df = E.delete_task_conditioning(df, o.keep_image_prob, o.seed + 1, goal_cols, o.language, "goal_t")
    df = E.chunk_action(df, o.window, o.future, o.absolute_action_mask)
    df = E.chunk_obs(df, o.image_cols, o.window)
    if o.train and o.subsample_length is not None:
        df = E.subsample(df, o.subsample_length, o.seed + 2)
    return df


def standardized(df: DataFrame, datasets: Sequence[str] | Mapping[str, str] | None, keep: Sequence[str]) -> DataFrame:
    """The steps of a raw mixture by their datasets' recipes, written once (all later passes read
    them); steps that are standardized already (``datasets`` None) as they are.  A kept column
    takes the last part of its name."""
    if datasets is None:
        return df
    out = RC.standardize_mixture(df, datasets, keep).drop(E.BLK)
    for c in keep:
        out = out.withColumnRenamed(c, c.rsplit(".", 1)[-1])
    return materialize(out)


def transformed(df: DataFrame, by: Mapping[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """Hook ``batch_transform``: columns computed from the frame's own, all in one projection.  A
    value may be a mapping from dataset names to functions (the name ``*`` stands for the others):
    rows take the column of their dataset, null where it has none."""

    def column(of) -> Column:
        if callable(of):
            return of(df)
        out = F.when(F.lit(False), F.lit(None))
        for name, fn in of.items():
            if name != "*":
                out = out.when(F.col("dataset_name") == name, fn(df))
        return out.otherwise(of["*"](df)) if "*" in of else out

    return df.withColumns({name: column(of) for name, of in by.items()}) if by else df


def single_pipeline(df: DataFrame, o: TrajOptions, kind: str = "bounds_q99", stats_long: DataFrame | None = None,
                    action_normalization_mask: list[bool] | None = None, datasets: Sequence[str] | Mapping[str, str] | None = None,
                    keep: Sequence[str] = (), batch_transform: Mapping | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recipe (raw steps: ``datasets`` names them) -> statistics (unless given) -> normalize
    -> W13 -> batch transform.  Returns (frames, statistics, counts)."""
    df = standardized(df, datasets, keep)
    stats_long = stats_long if stats_long is not None else S.dataset_stats(df)
    counts = S.dataset_counts(df)
    st = S.stats_struct(stats_long, action_normalization_mask)
    frames = transformed(episode_pipeline(N.normalize(df, st, kind), o), batch_transform or {})
    return frames, stats_long, counts


def interleaved_pipeline(df: DataFrame, weights: DataFrame, o: TrajOptions, seed: int, n: int | None = None,
                         batch_size: int | None = None, balance: bool = False, kind: str = "bounds_q99",
                         chunk_filter: Column | None = None, val_frames: int | None = None,
                         datasets: Sequence[str] | Mapping[str, str] | None = None, keep: Sequence[str] = (),
                         batch_transform: Mapping | None = None) -> DataFrame:
    """The whole mixture job over the steps of all datasets, raw (``datasets`` names them and
    their recipes run first) or standardized:
    stats -> weights -> normalize -> W13 -> F4 -> weighted draws (U1) -> validation take
    (T2, eval only) -> full shuffle (T1) -> batches (T3) -> batch transform.

    ``weights`` rows: dataset_name, weight, pos."""
    df = standardized(df, datasets, keep)
    counts = S.dataset_counts(df)
    st = S.stats_struct(S.dataset_stats(df))
    # goals and task augmentation are drawn anew in every pass, so they wait for the draws
    late = o.train and o.goal_relabeling == "uniform"
    frames = episode_pipeline(N.normalize(df, st, kind), replace(o, goal_relabeling=None, task_augment=None) if late else o)
    frames = E.chunk_filter(frames, chunk_filter)
    # lineage cut: the frame product is written once to the shared folder; the draw passes
    # (sizes, per-dataset numbering, the draw join) read it instead of re-running W13
    steps = df.select(*E.EPISODE, "t", *o.image_cols) if late else None
    frames = materialize(frames.drop(*[c for c in frames.columns if c.startswith("_") and not (late and c == E.ep_n()[0])]))
    mix = weights.join(counts.select("dataset_name", F.col("num_transitions").alias("size")), "dataset_name", "inner")
    drawn = MX.mixture_draws(frames, mix, n, seed, ["traj_id", "t"], balance)
    if not o.train and val_frames is not None:
        drawn = FR.take_val(drawn, val_frames, ["draw"])
    if late:
        drawn = E.goal_uniform(drawn, o.seed, o.image_cols, source=steps, again=["pass"])
        if o.task_augment == "delete_task_conditioning":
            drawn = E.delete_task_conditioning(drawn, o.keep_image_prob, o.seed + 1, ["goal_" + c for c in o.image_cols], o.language, "goal_t", again=["pass"])
        drawn = drawn.drop(E.ep_n()[0])
    # second cut: the shuffle's passes (bucket counts, numbering) read the drawn table
    drawn = materialize(drawn)
    out = FR.shuffle_positions(drawn, seed + 3, ["draw"], "pos")
    if batch_size:
        out = FR.batch_ids(out, batch_size)
    return transformed(out, batch_transform or {})
