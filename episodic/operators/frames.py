"""Frame-level ordering operators: positions, splits, shuffles, batches, repeats.

``rank_in_group`` is the building block: a 0-based position inside a group (or globally)
without funnelling a group through one task.  A group is cut into buckets of at most about
``episodic.hotEpisodeRows`` rows, in the order asked for: its cuts are whole order keys -- of
any type, all order columns together, so text with a common prefix and heavy ties of the first
column are cut like anything else -- taken from a sample that a hash of the key chooses.  A row
finds its bucket by binary search among the cuts, rows are counted per (group, bucket) with
partial aggregation, prefix sums over those counts give each bucket's offset, and a window
partitioned by (group, bucket) numbers the rows inside a bucket.  Groups of one bucket need no
cuts, so for small groups this is a plain ``row_number``.  Where the first order column is
uniform in [0, 1) already (a seeded shuffle), its buckets are arithmetic: no sample, no cuts.

Every step is deterministic (a hash, not a sampled range partitioner), so retries and the two
consumers of the data agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodic.functions.rand import u01
from episodic.operators.episodes import DEFAULT_HOT_EPISODE_ROWS
from episodic.session import materialize

#: Buckets of a group at most, and sampled keys for each of them.
MAX_BUCKETS, SAMPLED = 4096, 32


def _order_columns(df: DataFrame, order: Sequence[str | Column]) -> tuple[DataFrame, list[str]]:
    for i, c in enumerate(order):
        df = df.withColumn(f"_o{i}", F.col(c) if isinstance(c, str) else c)
    return df, [f"_o{i}" for i in range(len(order))]


def _partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _cuts(keyed: DataFrame, group: list[str], okeys: list[str], buckets: int | None) -> DataFrame | None:
    """(group, _cuts): ascending order keys that cut each group of more than one bucket; None if
    there is no such group.  One count of the rows a group, and a sample where one is large."""
    rows_each = int(keyed.sparkSession.conf.get("episodic.hotEpisodeRows", str(DEFAULT_HOT_EPISODE_ROWS)))
    sizes = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.lit(buckets) if buckets else F.least(F.ceil(F.col("_n") / rows_each), F.lit(MAX_BUCKETS))
    if not group:
        wanted = F.greatest(wanted, F.lit(_partitions(keyed)))
    large = materialize(sizes.withColumn("_k", wanted).where("_k > 1"))
    if large.isEmpty():
        return None
    key = F.struct(*okeys)
    part = F.shiftrightunsigned(F.xxhash64(*okeys), 11) / F.lit(float(1 << 53))
    some = (keyed.join(large, group) if group else keyed.withColumns({c: large.select(c).scalar() for c in ("_n", "_k")})).where(part * F.col("_n") < F.col("_k") * SAMPLED)
    found = some.groupBy(*group).agg(F.sort_array(F.collect_set(key)).alias("_s"), F.max("_k").alias("_k"))
    at = F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col("_k")).cast("int")))
    return materialize(found.select(*group, F.array_distinct(at).alias("_cuts")))


def _bucket(okeys: list[str], most: int = MAX_BUCKETS) -> Column:
    """Number of cuts up to the row's key, by binary search; 0 where there are none."""
    steps = []
    while not steps or steps[-1] > 1:
        steps.append((steps[-1] // 2) if steps else 1 << most.bit_length())
    key = F.struct(*okeys)
    find = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda at, s: F.when(F.get("_cuts", at + s - 1) <= key, at + s).otherwise(at))
    return F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(find)


def _bucketed(df: DataFrame, group: list[str], okeys: list[str], buckets: int | None) -> tuple[DataFrame, bool]:
    """``df`` with ``_b``, its bucket in the group, and whether there is more than one."""
    cuts = _cuts(df, group, okeys, buckets)
    if cuts is None:
        return df.withColumn("_b", F.lit(0)), False
    df = df.join(cuts, group, "left") if group else df.withColumn("_cuts", cuts.select("_cuts").scalar())
    return df.withColumn("_b", _bucket(okeys)).drop("_cuts"), True


def _offsets(keyed: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """(group, _b, sums): totals of the buckets before each one (at most ``MAX_BUCKETS`` a group)."""
    totals = keyed.groupBy(*group, "_b").agg(*[c.alias(n) for n, c in sums.items()])
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, "_b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rank",
                  buckets: int | None = None, uniform: bool = False) -> DataFrame:
    """0-based row number of each row within ``group`` (``[]`` = the whole frame) in
    ``order``; ``group + order`` must be a total order and the order columns comparable.

    ``buckets`` cuts every group into that many; ``uniform`` says that the first order column is
    spread evenly over [0, 1)."""
    group = list(group)
    keyed, okeys = _order_columns(df, order)
    if uniform:
        k = F.lit(buckets or _partitions(df))
        keyed, several = keyed.withColumn("_b", F.floor(F.col("_o0") * k).cast("int")), True
    else:
        keyed, several = _bucketed(keyed, group, okeys, buckets)
    place = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*okeys)).cast("bigint") - 1
    if several:
        keyed = keyed.join(_offsets(keyed, group, {"_off": F.count(F.lit(1))}), [*group, "_b"], "inner")
        place = place + F.col("_off")
    return keyed.withColumn(name, place).drop("_b", "_off", *okeys)


def split_train_val(trajs: DataFrame, train: bool = True, pct: int = 95, has_val: bool = False,
                    key: str = "dataset_name", traj: str = "traj_id") -> DataFrame:
    """S2 on a trajectory table: ``train[:95%]`` / ``train[95%:]`` in trajectory order
    per dataset (when the source has no ``val`` split; otherwise everything is train)."""
    if has_val:
        return trajs if train else trajs.limit(0)
    ranked = rank_in_group(trajs, [key], [traj], "_r")
    counts = trajs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(counts, key)
    bound = F.round(F.col("_n") * F.lit(pct / 100.0))
    cond = F.col("_r") < bound if train else F.col("_r") >= bound
    return ranked.filter(cond).drop("_r", "_n")


def shuffle_positions(df: DataFrame, seed: int, keys: Sequence[str], name: str = "pos") -> DataFrame:
    """Position of each row in a seeded full shuffle (order by u01(seed, keys), keys)."""
    return rank_in_group(df, [], [u01(seed, *keys), *keys], name, uniform=True)


def take_val(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` frames in a deterministic order (validation set)."""
    return df.orderBy(*order).limit(n)


def batch_ids(df: DataFrame, batch_size: int, pos: str = "pos", name: str = "batch") -> DataFrame:
    """Consecutive positions form batches of ``batch_size``."""
    return df.withColumn(name, F.floor(F.col(pos) / batch_size).cast("bigint"))


def repeat(df: DataFrame, count: int, name: str = "pass") -> DataFrame:
    """T4: cycle the frame set ``count`` times (pass number kept for re-drawn randomness)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], cols: Sequence[str],
                   suffix: str = "_cum", buckets: int | None = None) -> DataFrame:
    """Inclusive running sums of ``cols`` within ``group`` (``[]`` = global) in ``order``
    (``group + order`` total), without a window over a whole group: bucket totals are
    prefix-summed over the small bucket table, and a window partitioned by (group, bucket) adds
    the running sum inside the bucket."""
    group = list(group)
    keyed, okeys = _order_columns(df, order)
    keyed, several = _bucketed(keyed, group, okeys, buckets)
    inner = Window.partitionBy(*group, "_b").orderBy(*okeys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if several:
        keyed = keyed.join(_offsets(keyed, group, {f"_off_{c}": F.sum(c) for c in cols}), [*group, "_b"], "inner")
    for c in cols:
        here = F.sum(c).over(inner)
        keyed = keyed.withColumn(c + suffix, here + F.col(f"_off_{c}") if several else here)
    return keyed.drop("_b", *[f"_off_{c}" for c in cols], *okeys)
