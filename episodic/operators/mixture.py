"""Dataset mixtures: weights, epoch length, integer apportionment, weighted draws.

A mixture table has one row per dataset (``dataset_name, size, weight, pos``); its
size is bounded by the mixture configuration and checked before it is broadcast or
collected.  Frames are never collected: draws are matched to frames by an equi-join
on (dataset, frame index), with per-dataset frame numbering done by the skew-safe
``rank_in_group`` (one dataset may hold a third of all frames).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodic.functions.rand import u01
from episodic.operators.frames import rank_in_group
from episodic.session import bounded_broadcast


def mixture_weights(mix: DataFrame, balance: bool = False, out: str = "sample_weight") -> DataFrame:
    """A5: weights (default 1.0), optionally times dataset size, normalized to sum 1."""
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    if balance:
        w = w * F.col("size")
    total = F.sum(w).over(Window.partitionBy(F.lit(0)))  # one row per dataset: a tiny frame
    return mix.withColumn(out, w / total)


def mixture_length(mix: DataFrame, balance: bool = False) -> DataFrame:
    """int(max(size / normalized weight)) over primary datasets (raw weight == 1.0);
    raises if there is no primary dataset."""
    wdf = mixture_weights(mix, balance)
    res = wdf.agg(
        F.max(F.when(F.col("weight") == 1.0, F.col("size") / F.col("sample_weight"))).alias("_len")
    )
    return res.select(
        F.when(F.col("_len").isNull(), F.raise_error(F.lit("mixture has no primary dataset (weight == 1.0)")))
        .otherwise(F.col("_len").cast("bigint")).alias("mixture_length")
    )


def apportion(mix: DataFrame, n: int | Column, weight: str = "weight") -> DataFrame:
    """A7 re-aimed as a sampling quota: (dataset_name, pos, quota) that sum to ``n``.

    A positive weight whose share is below one gets one, and its weight leaves the others'
    total; what is left is shared out by floors and largest remainders (ties: the larger
    ``pos``).  In ascending order of weight the ones form a prefix: it ends at the first weight
    whose share of the rest is at least one, since handing out a one raises nobody's share.
    The windows run over the weight table, one row a dataset.  A negative weight, or a smaller
    ``n`` than there are datasets, is an error when the rows are read.
    """
    everyone = Window.partitionBy(F.lit(0))
    lightest = everyone.orderBy("_w", "pos")
    w = mix.select("dataset_name", "pos", F.col(weight).cast("double").alias("_w"), F.lit(n).cast("bigint").alias("_n") if isinstance(n, int) else n.cast("bigint").alias("_n"))
    w = w.withColumns({"_lo": F.min("_w").over(everyone), "_k": F.count(F.lit(1)).over(everyone)})
    fault = F.when(F.col("_lo") < 0, F.raise_error(F.lit("a weight is negative"))) \
        .when(F.col("_k") > F.col("_n"), F.raise_error(F.lit("fewer items than datasets to share them")))
    w = w.withColumn("_n", F.coalesce(fault.cast("bigint"), F.col("_n")))
    live = (F.col("_w") > 0).cast("int")
    w = w.withColumns({"_all": F.sum("_w").over(everyone), "_before": F.sum("_w").over(lightest) - F.col("_w"), "_ones": F.sum(live).over(lightest) - live})
    whole = F.col("_w") * (F.col("_n") - F.col("_ones")) >= F.col("_all") - F.col("_before")
    w = w.withColumn("_whole", F.max((live == 1) & whole).over(lightest))
    one = (F.col("_w") > 0) & ~F.col("_whole")
    w = w.withColumns({"_one": one, "_given": F.sum(one.cast("int")).over(everyone), "_rest": F.sum(F.when(one, 0.0).otherwise(F.col("_w"))).over(everyone)})
    w = w.withColumn("_share", F.when(F.col("_one") | (F.col("_rest") == 0), 0.0).otherwise(F.col("_w") / F.col("_rest") * (F.col("_n") - F.col("_given"))))
    w = w.withColumns({"_floor": F.floor("_share"), "_frac": F.col("_share") - F.floor("_share")})
    w = w.withColumns({"_open": F.col("_n") - F.col("_given") - F.sum("_floor").over(everyone),
                       "_turn": F.row_number().over(everyone.orderBy(F.desc("_frac"), F.desc("pos")))})
    quota = F.col("_floor") + F.col("_one").cast("int") + (F.col("_turn") <= F.col("_open")).cast("int")
    return w.select("dataset_name", "pos", quota.cast("bigint").alias("quota"))


def cdf_table(mix: DataFrame, balance: bool = False) -> DataFrame:
    """Cumulative weight ranges [lo, hi) per dataset in ``pos`` order (J7's lookup table)."""
    wdf = mixture_weights(mix, balance)
    w = Window.partitionBy(F.lit(0)).orderBy("pos")
    hi = F.sum("sample_weight").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return wdf.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("sample_weight")).withColumn(
        "idx", (F.row_number().over(w) - 1).cast("int")
    )


def draw_to_dataset(draws: DataFrame, mix: DataFrame, u: str = "u", balance: bool = False) -> DataFrame:
    """Each uniform draw picks the dataset whose cumulative range holds it.

    The range join is turned into an equi-join: the one-row vector of upper bounds gives
    the index = number of bounds <= u, joined on ``idx``."""
    cdf = cdf_table(mix, balance)  # one row per dataset; joins are broadcast by AQE at runtime when small
    bounds = cdf.agg(F.array_sort(F.collect_list(F.struct("idx", "hi"))).alias("_his"))
    bounds = bounds.select(F.transform("_his", lambda s: s["hi"]).alias("_his"), F.size("_his").alias("_k"))
    # the bound vector is one row: attached as a scalar subquery (computed once, no join)
    d = draws.withColumn("_his", bounds.select("_his").scalar()).withColumn("_k", bounds.select("_k").scalar())
    idx = F.least(F.size(F.filter("_his", lambda h: h <= F.col(u))), F.col("_k") - 1)
    d = d.withColumn("idx", idx.cast("int")).drop("_his", "_k")
    return d.join(cdf.select("idx", "dataset_name"), "idx", "inner").drop("idx")


def frame_index(frames: DataFrame, name: str = "_fi", episode: str = "traj_id") -> DataFrame:
    """Position of each frame in its dataset ordered by (episode, t), without ranking the
    frames: the offset of the episode (running sum of episode lengths over the one-row-per-
    episode table) plus the frame's rank inside the episode (``t`` when dense).  Exact, and
    a huge episode costs nothing extra.  Episodes with gaps in ``t`` (after subsampling)
    fall back to ``rank_in_group``."""
    from episodic.operators.frames import running_totals

    ep = frames.groupBy("dataset_name", episode).agg(F.count(F.lit(1)).alias("_len"), F.max("t").alias("_tmax"))
    if ep.filter(F.col("_tmax") + 1 != F.col("_len")).limit(1).count() > 0:
        return rank_in_group(frames, ["dataset_name"], [episode, "t"], name)
    offs = running_totals(ep, ["dataset_name"], [episode], ["_len"], "_cum")
    offs = offs.select("dataset_name", episode, (F.col("_len_cum") - F.col("_len")).alias("_off"))
    out = frames.join(offs, ["dataset_name", episode], "inner")
    return out.withColumn(name, (F.col("_off") + F.col("t")).cast("bigint")).drop("_off")


def draw_to_frame(draws: DataFrame, frames: DataFrame, frame_order: Sequence[str], draw_order: str = "draw") -> DataFrame:
    """The k-th draw of a dataset takes frame ``k mod size`` of that dataset (repeat semantics);
    ``pass`` = k div size tells how often the dataset was gone through before, for randomness that
    is drawn anew (``episodes.goal_uniform``).

    Draw numbering uses the skew-safe ``rank_in_group``; frames ordered by (episode, t) use
    ``frame_index`` (episode offsets), other orders ``rank_in_group``."""
    dk = rank_in_group(draws, ["dataset_name"], [draw_order], "_k")
    if list(frame_order) == ["traj_id", "t"]:
        fk = frame_index(frames, "_fi")
    else:
        fk = rank_in_group(frames, ["dataset_name"], list(frame_order), "_fi")
    sizes = frames.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("_size"))
    # a draw of a dataset that has no frames (left) is an error, not a lost draw
    empty = F.raise_error(F.concat(F.lit("draws fall on a dataset without frames: "), F.col("dataset_name")))
    dk = dk.join(sizes, "dataset_name", "left").withColumn("_size", F.when(F.col("_size").isNull(), empty.cast("bigint")).otherwise(F.col("_size")))
    dk = dk.withColumns({"_fi": F.pmod(F.col("_k"), F.col("_size")), "pass": F.floor(F.col("_k") / F.col("_size"))}).drop("_size", "_k")
    return dk.join(fk.drop("pass"), ["dataset_name", "_fi"], "inner").drop("_fi")


def mixture_draws(frames: DataFrame, mix: DataFrame, n: int | None, seed: int, frame_order: Sequence[str],
                  balance: bool = False) -> DataFrame:
    """``n`` weighted frame draws (default n = mixture length)."""
    spark = frames.sparkSession
    if n is None:
        n = int(mixture_length(mix, balance).first()[0])
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("u", u01(seed, "draw"))
    return draw_to_frame(draw_to_dataset(draws, mix, "u", balance), frames, frame_order, "draw")


def mixture_quota(frames: DataFrame, quotas: DataFrame, seed: int, key: str) -> DataFrame:
    """Exact-quota draws.  A dataset with quota q and size s gives every frame
    q div s copies, plus one more to the q mod s frames first in a seeded order.  A positive
    quota of a dataset without frames is an error, as in J8."""
    sizes = frames.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("_size"))
    ranked = rank_in_group(frames, ["dataset_name"], [u01(seed, key), key], "_r", uniform=True)
    q = quotas.where(F.col("quota") > 0).join(sizes, "dataset_name", "left")
    empty = F.raise_error(F.concat(F.lit("a quota asks for a dataset without frames: "), F.col("dataset_name")))
    q = q.withColumn("_size", F.when(F.col("_size").isNull(), empty.cast("bigint")).otherwise(F.col("_size")))
    # from the quotas' side, so that a quota without frames is seen
    out = q.select("dataset_name", "quota", "_size").join(ranked, "dataset_name", "left")
    copies = F.floor(F.col("quota") / F.col("_size")) + F.when(F.col("_r") < F.pmod(F.col("quota"), F.col("_size")), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("bigint")).filter(F.col("copies") > 0).select(*frames.columns, "copies")


def resolve_mixture(spec: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """Per mixture keep the first (lowest ``pos``) entry of each dataset and skip
    datasets whose configuration is invalid (left anti join)."""
    w = Window.partitionBy("mix", "dataset_name").orderBy("pos")
    out = spec.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    if invalid is not None:
        out = out.join(invalid.select("dataset_name").distinct(), "dataset_name", "left_anti")
    return out


def mixture_or_single(resolved: DataFrame, name: str) -> DataFrame:
    """An unknown mixture name means the single dataset of that name with weight 1.0."""
    sel = resolved.filter(F.col("mix") == name)
    if sel.limit(1).count() == 0:
        return resolved.sparkSession.createDataFrame([(name, name, 1.0, 0)], "mix string, dataset_name string, weight double, pos int")
    return sel


def mixture_report(mix: DataFrame, balance: bool = False) -> DataFrame:
    """Dataset and its normalized weight (6 digits), in mixture order."""
    return mixture_weights(mix, balance).select("dataset_name", F.round("sample_weight", 6).alias("weight"), "pos").orderBy("pos")
