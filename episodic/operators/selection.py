"""Exact order statistics of huge groups by iterated selection.

A target is a rank in a group.  Around it lies a bracket: values below are only counted, values
inside matter.  A mergeable sketch of the values strictly inside the bracket proposes a narrower
one, a scan counts what lies below, on the edges and inside of it, and so on until the bracket
is expected to hold at most ``limit`` rows.  Then one last scan collapses everything outside
brackets to counts and what is inside to (value, count) pairs, and a window over those pairs --
``limit`` at most, however large the group -- reads off the value.

* A rank that falls on an edge value is solved by the count of that value, so a value that half
  of a group shares costs one number, and every level shrinks the open interval.
* Each level divides the rows inside by about 200; a group of 10^12 rows needs three.
* A proposal that misses its rank (the counts tell) is widened and tried again; nothing falls
  back to collecting a group.
* Scans are aggregations with map-side partial results; rows are neither exploded nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodic.session import materialize

#: Rows that the last bracket of a rank is expected to hold at most.
LIMIT = 1 << 16
#: Equal parts into which a sketch cuts the inside of a bracket, and its accuracy.
PARTS, ACCURACY = 1000, 10_000
#: Parts added on both sides of the one with the rank; a miss takes four times as many.
MARGIN = 2
MAX_LEVELS = 64

_ARRAYS = ("_r", "_lo", "_hi", "_above", "_under", "_below", "_inside", "_parts", "_margin", "_expect", "_value", "_done")


def first_brackets(summary: DataFrame, ranks: Sequence[Column], lo: Sequence[Column], hi: Sequence[Column], expect: Column) -> DataFrame:
    """State of the first level: ``summary`` (a written table, one row a group, ``_n`` rows) with
    the ranks, their proposed edges and the number of rows expected between them."""
    k = len(ranks)

    def same(c: Column) -> Column:
        return F.array(*[c] * k)

    none, known = F.lit(None).cast("double"), F.col("_n") > 0
    return summary.where(known).select(
        *[c for c in summary.columns if c not in _ARRAYS],
        F.array(*[r.cast("bigint") for r in ranks]).alias("_r"), F.array(*lo).alias("_lo"), F.array(*hi).alias("_hi"),
        same(none).alias("_above"), same(none).alias("_under"), same(F.lit(0).cast("bigint")).alias("_below"), same(F.col("_n")).alias("_inside"),
        same(F.lit(None).cast("array<double>")).alias("_parts"), same(F.lit(MARGIN)).alias("_margin"), same(expect.cast("double")).alias("_expect"),
        same(none).alias("_value"), same(F.lit(False)).alias("_done"))


def _edges(state: DataFrame, group: list[str], k: int) -> DataFrame:
    """(group, _l*, _il*, _h*, _ih*): the bounds of each bracket as plain columns, and whether the
    bound itself is inside.  No bound is the least or the largest value; a bracket that is done
    holds nothing."""
    out = []
    for t in range(k):
        done, lo, hi, above, under = (F.col(c)[t] for c in ("_done", "_lo", "_hi", "_above", "_under"))
        out += [F.when(done, float("inf")).otherwise(F.coalesce(lo, above, F.lit(float("-inf")))).alias(f"_l{t}"), (~done & (lo.isNotNull() | above.isNull())).alias(f"_il{t}"),
                F.when(done, float("-inf")).otherwise(F.coalesce(hi, under, F.lit(float("nan")))).alias(f"_h{t}"), (~done & (hi.isNotNull() | under.isNull())).alias(f"_ih{t}")]
    return state.select(*group, *out)


def _less(x: Column, t: int) -> Column:
    """Is the value below bracket ``t``?"""
    return (x < F.col(f"_l{t}")) | ((x == F.col(f"_l{t}")) & ~F.col(f"_il{t}"))


def _within(x: Column, t: int) -> Column:
    """Is the value inside bracket ``t``, edges included?"""
    return ~_less(x, t) & ((x < F.col(f"_h{t}")) | ((x == F.col(f"_h{t}")) & F.col(f"_ih{t}")))


def _proposed(state: DataFrame, k: int) -> DataFrame:
    """Edges from the parts of the inside, the rank's own and ``_margin`` on both sides; where
    those reach beyond the inside there is no edge, and the open interval's bound counts."""
    lo, hi, expect = [], [], []
    for t in range(k):
        at, inside, m = F.col("_r")[t] - F.col("_below")[t], F.col("_inside")[t], F.col("_margin")[t]
        first = F.floor(at * PARTS / inside) - m
        last = F.ceil((at + 1) * PARTS / inside) + m
        parts = F.col("_parts")[t]
        keep = F.col("_done")[t] | parts.isNull()
        lo.append(F.when(keep, F.col("_lo")[t]).otherwise(F.get(parts, F.when(first >= 0, first).cast("int"))))
        hi.append(F.when(keep, F.col("_hi")[t]).otherwise(F.get(parts, F.when(last <= PARTS, last).cast("int"))))
        expect.append(F.when(F.col("_done")[t], 0.0).when(keep, F.col("_expect")[t]).otherwise(F.least(inside, inside * (2 * m + 2) / PARTS + 1).cast("double")))
    return state.withColumns({"_lo": F.array(*lo), "_hi": F.array(*hi), "_expect": F.array(*expect)})


def _counted(long: DataFrame, state: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """One scan: what lies below, on the edges and strictly inside the proposed brackets, and a
    sketch of the inside.  No row is repeated or moved before the aggregation."""
    x = F.col(value)
    aggs = []
    for t in range(k):
        within = _within(x, t)
        on_lo, on_hi = (within & F.col(f"_i{side}{t}") & (x == F.col(f"_{side}{t}")) & F.col(f"_has_{side}{t}") for side in ("l", "h"))
        strict = within & ~on_lo & ~on_hi
        aggs += [F.count_if(_less(x, t)).alias(f"_lt{t}"), F.count_if(on_lo).alias(f"_on_lo{t}"), F.count_if(strict).alias(f"_in{t}"), F.count_if(on_hi).alias(f"_on_hi{t}"),
                 F.percentile_approx(F.when(strict, x), [i / PARTS for i in range(PARTS + 1)], ACCURACY).alias(f"_parts{t}")]
    has = state.select(*group, *[F.col(c)[t].isNotNull().alias(f"_has_{side}{t}") for t in range(k) for c, side in (("_lo", "l"), ("_hi", "h"))])
    return long.join(_edges(state, group, k).join(has, group), group).groupBy(*group).agg(*aggs)


def _moved(state: DataFrame, counted: DataFrame, group: list[str], k: int) -> DataFrame:
    """The next state: solved on an edge, narrowed to the inside, or widened after a miss."""
    both = state.join(counted, group)
    new: dict[str, list[Column]] = {c: [] for c in _ARRAYS}
    for t in range(k):
        r, lt, on_lo, inside, on_hi = (F.col(c)[t] if c == "_r" else F.col(f"{c}{t}") for c in ("_r", "_lt", "_on_lo", "_in", "_on_hi"))
        same_edge = F.col("_lo")[t].eqNullSafe(F.col("_hi")[t])
        on_hi = F.when(same_edge & F.col("_lo")[t].isNotNull(), F.lit(0)).otherwise(on_hi)
        done = F.col("_done")[t]
        at_lo = ~done & (r >= lt) & (r < lt + on_lo)
        at_in = ~done & (r >= lt + on_lo) & (r < lt + on_lo + inside)
        at_hi = ~done & (r >= lt + on_lo + inside) & (r < lt + on_lo + inside + on_hi)
        miss = ~done & ~at_lo & ~at_in & ~at_hi
        blind = miss & F.col("_parts")[t].isNull()  # the first proposal: start from the whole group
        none = F.lit(None).cast("double")
        new["_r"].append(r)
        new["_lo"].append(F.when(blind, none).otherwise(F.col("_lo")[t]))
        new["_hi"].append(F.when(blind, none).otherwise(F.col("_hi")[t]))
        new["_above"].append(F.when(at_in & F.col("_lo")[t].isNotNull(), F.col("_lo")[t]).otherwise(F.col("_above")[t]))
        new["_under"].append(F.when(at_in & F.col("_hi")[t].isNotNull(), F.col("_hi")[t]).otherwise(F.col("_under")[t]))
        new["_below"].append(F.when(at_in, lt + on_lo).otherwise(F.col("_below")[t]))
        new["_inside"].append(F.when(at_in, inside).otherwise(F.col("_inside")[t]))
        new["_parts"].append(F.when(at_in, F.col(f"_parts{t}")).otherwise(F.col("_parts")[t]))
        new["_margin"].append(F.when(at_in, F.lit(MARGIN)).when(miss & ~blind, F.least(F.col("_margin")[t] * 4, F.lit(PARTS))).otherwise(F.col("_margin")[t]))
        new["_expect"].append(F.when(blind, F.col("_n").cast("double")).otherwise(F.col("_expect")[t]))
        new["_value"].append(F.when(at_lo, F.col("_lo")[t]).when(at_hi, F.col("_hi")[t]).otherwise(F.col("_value")[t]))
        new["_done"].append(done | at_lo | at_hi)
    keep = [c for c in state.columns if c not in _ARRAYS]
    return both.select(*keep, *[F.array(*new[c]).alias(c) for c in _ARRAYS])


def _open(state: DataFrame) -> tuple[bool, float]:
    """Is any bracket open, and how many rows is the widest one expected to hold?"""
    some, most = state.agg(F.max(F.array_contains("_done", False)), F.max(F.array_max("_expect"))).first()
    return bool(some), float(most or 0.0)


def narrowed(long: DataFrame, state: DataFrame, group: list[str], value: str, k: int, limit: int = LIMIT) -> tuple[DataFrame, bool]:
    """The state whose open brackets are all expected to hold at most ``limit`` rows, and whether
    any is open."""
    for _ in range(MAX_LEVELS):
        some, most = _open(state)
        if not some or most <= limit:
            return state, some
        state = materialize(_proposed(_moved(state, _counted(long, state, group, value, k), group, k), k))
    raise RuntimeError("the brackets of an order statistic do not narrow")


def histogram(long: DataFrame, state: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """(group, _less, _x, _c): counts of the values inside any bracket, and of all others by the
    brackets they lie below (``_less``: one bit a rank)."""
    x = F.col(value)
    less, inside = F.lit(0), F.lit(False)
    for t in range(k):
        less = less + F.when(_less(x, t), F.lit(1 << t)).otherwise(F.lit(0))
        inside = inside | _within(x, t)
    edges = _edges(state.where(F.array_contains("_done", False)), group, k)
    return long.join(edges, group).groupBy(*group, less.alias("_less"), F.when(inside, x).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))


def _read(hist: DataFrame, state: DataFrame, group: list[str], k: int) -> DataFrame:
    """(group, _found): the value at each open rank by its number; a rank that the bracket missed
    is not in it."""
    each = hist.join(_edges(state, group, k).join(state.select(*group, "_r", "_done"), group), group)
    x = F.col("_x")
    rows = [F.struct(F.lit(t).alias("_t"), F.when(x.isNotNull() & _within(x, t), x).alias("_x"),
                     (F.col("_less").bitwiseAND(F.lit(1 << t)) > 0).alias("_under"), F.col("_r")[t].alias("_r"), F.col("_done")[t].alias("_done")) for t in range(k)]
    each = each.select(*group, "_c", F.explode(F.array(*rows)).alias("e")).select(*group, "_c", "e.*").where(~F.col("_done") & (F.col("_under") | F.col("_x").isNotNull()))
    order = Window.partitionBy(*group, "_t").orderBy(F.col("_x").asc_nulls_first())
    upto = F.sum("_c").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.groupBy(*group, "_t", "_r", "_x").agg(F.sum("_c").alias("_c")).withColumn("_upto", upto)
    hit = F.col("_x").isNotNull() & (F.col("_upto") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_upto"))
    return each.where(hit).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_x"))).alias("_found"))


def order_statistics(long: DataFrame, state: DataFrame, group: Sequence[str], value: str, k: int, limit: int = LIMIT) -> DataFrame:
    """(group columns of ``state``, _value): the values at the ``k`` ranks of every group.  Null
    values must not occur; NaN is the largest."""
    group = list(group)
    for _ in range(MAX_LEVELS):
        state, some = narrowed(long, state, group, value, k, limit)
        if not some:
            return state.select(*[c for c in state.columns if c not in _ARRAYS], "_value")
        found = _read(histogram(long, state, group, value, k), state, group, k)
        both = state.join(found, group, "left")
        new: dict[str, list[Column]] = {"_value": [], "_done": [], "_margin": [], "_lo": [], "_hi": [], "_expect": []}
        for t in range(k):
            got = F.element_at("_found", t)
            miss = ~F.col("_done")[t] & got.isNull()
            blind = miss & F.col("_parts")[t].isNull()
            none = F.lit(None).cast("double")
            new["_value"].append(F.coalesce(F.col("_value")[t], got))
            new["_done"].append(F.col("_done")[t] | got.isNotNull())
            new["_margin"].append(F.when(miss & ~blind, F.least(F.col("_margin")[t] * 4, F.lit(PARTS))).otherwise(F.col("_margin")[t]))
            new["_lo"].append(F.when(blind, none).otherwise(F.col("_lo")[t]))
            new["_hi"].append(F.when(blind, none).otherwise(F.col("_hi")[t]))
            new["_expect"].append(F.when(~miss, 0.0).when(blind, F.col("_n").cast("double")).otherwise(F.col("_expect")[t]))
        state = materialize(both.withColumns({c: F.array(*v) for c, v in new.items()}).drop("_found"))
        if _open(state)[0]:  # a miss: wider edges
            state = materialize(_proposed(state, k))
    raise RuntimeError("an order statistic was not found")
