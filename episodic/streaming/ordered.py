"""Keyed stream operators that do not depend on the order of arrival.

Rows of a key wait in state until no earlier row can come any more -- until the watermark
has passed them (``applyInPandasWithState``), or, for numbered rows, until all smaller numbers
are there (``transformWithState``) -- and are then handed on in order.  What waits is bounded by
the watermark's delay (or by the gap in the numbers); beside it a key holds a few scalars.
By time, the keys of a group share a state and a call: with a state a key, calls took nearly all
of the time.  A group's timeout is due with its earliest waiting row.

The store of numbered rows must hold lists (``RocksDB``); ``streams.run_append`` sets it for the
query.  Rows that arrive later than the watermark allows are dropped by Spark, as everywhere in
Structured Streaming: the delay is the promise about the source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (scalars, row) -> (scalars, output rows); rows and scalars are tuples.
Step = Callable[[tuple, tuple], tuple[tuple, list[tuple]]]
#: Groups of keys of a stream of unknown size.
GROUPS = 1_024


def _in_time_order(step: Step, start: tuple, columns: list[str], names: list[str], whole: set[str]):
    """Hands the rows of each key of a group to ``step`` in order of (event time, first column).

    One call a group and batch, with the state as values: new rows join the waiting ones, and
    those behind the watermark go on.  A row whose first column is null only moves the watermark."""
    held, fields = 1 + len(start), ["_key", "_us", *columns]

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scalars, rows = {}, []
        if state.exists:
            got = state.get
            scalars = {k: tuple(v) for k, *v in zip(*got[:held], strict=True)}
            rows = list(zip(*got[held:], strict=True))
        for part in parts:
            rows += [tuple(int(r[c]) if c in whole and r[c] is not None else r[c] for c in fields) for r in part["_row"] if r is not None and r[fields[2]] is not None]
        now = state.getCurrentWatermarkMs() * 1000
        rest = [r for r in rows if r[1] >= now]
        out = []
        for key, *row in sorted((r for r in rows if r[1] < now), key=lambda r: r[1:3]):
            scalars[key], found = step(scalars.get(key, start), tuple(row))
            out += [(key, *values) for values in found]
        if scalars or rest:
            known = [(k, *v) for k, v in scalars.items()]
            state.update((*_columns(known, held), *_columns(rest, len(fields))))
        if rest:
            state.setTimeoutTimestamp(max(1, min(r[1] for r in rest) // 1000 + 1))
        if out:
            yield pd.DataFrame(dict(zip(names, [pd.Series(c, dtype=object) for c in _columns(out, len(names))], strict=True)))

    return run


def _columns(rows: list[tuple], n: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(n)]


class InNumberOrder(StatefulProcessor):
    """Hands the rows of a key to ``step`` by their number, the first column, from 0 without gaps.
    A number that comes again is dropped; one that never comes holds back what follows it."""

    def __init__(self, step: Step, start: tuple, row: str, scalars: str, out: list[str]):
        self.step, self.start, self.row, self.scalars, self.out = step, start, row, scalars, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.row)
        self.state = handle.getValueState("state", f"next bigint, {self.scalars}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        nxt, *state = self.state.get() if self.state.exists() else (0, *self.start)
        state = tuple(state)
        had = self.waiting.exists()
        early = [tuple(r) for r in self.waiting.get()] if had else []
        rest = []
        for r in sorted(early + [tuple(r)[len(key):] for r in rows], key=lambda r: r[0]):
            if r[0] == nxt:
                state, found = self.step(state, r)
                nxt += 1
                for values in found:
                    yield Row(**dict(zip(self.out, (*key, *values), strict=True)))
            elif r[0] > nxt:
                rest.append(r)
        self.state.update((nxt, *state))
        if rest:
            self.waiting.put(rest)
        elif had:
            self.waiting.clear()

    def close(self) -> None:
        pass


def in_time_order(rows: DataFrame, key: str, time: str, delay: str, columns: list[str], step: Step, start: tuple, scalars: str, out: str,
                  groups: int = GROUPS) -> DataFrame:
    """The rows of each key in order of (``time``, first of ``columns``), handed to ``step`` as tuples
    (microseconds, *columns) once the watermark (``delay`` behind the latest time) has passed
    them.  A time without zone counts as the session's.  ``out``: columns after the key.

    Keys are kept in ``groups`` groups by hash, as each call costs far more than a row; the number
    belongs to the checkpoint.  ``key_groups`` finds one for a table."""
    kinds = dict(rows.dtypes)
    timed = rows.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    # whole numbers travel as text: of those with nulls, pandas would make doubles
    kinds |= {"_key": kinds[key], "_us": "bigint"}
    sent = {"_key": F.col(key), "_us": F.unix_micros("_time"), **{c: F.col(c) for c in columns}}
    whole = {c for c in sent if kinds[c] in ("tinyint", "smallint", "int", "bigint")}
    row = F.struct(*[(v.cast("string") if c in whole else v).alias(c) for c, v in sent.items()])
    timed = timed.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"), row.alias("_row"), "_time")
    fields = [("_known", kinds[key]), *[tuple(c.split()) for c in scalars.split(", ")], ("_key", kinds[key]), ("_us", "bigint"),
              *[(f"_{k}", kinds[c]) for k, c in enumerate(columns)]]
    names = [key, *[c.split()[0] for c in out.split(", ")]]
    return timed.groupBy("_group").applyInPandasWithState(
        _in_time_order(step, start, columns, names, whole), f"`{key}` {kinds[key]}, {out}", ", ".join(f"`{c}` array<{kind}>" for c, kind in fields),
        "append", GroupStateTimeout.EventTimeTimeout)


def key_groups(rows: DataFrame, size: int = 4_000) -> int:
    """Groups for ``in_time_order`` of about ``size`` rows of a table, a few for each task at least."""
    return max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // size)


def in_number_order(rows: DataFrame, key: str, number: str, columns: list[str], step: Step, start: tuple, scalars: str, out: str) -> DataFrame:
    """The rows of each key by ``number`` (0, 1, 2, ...), handed to ``step`` as tuples
    (number, *columns) as soon as all smaller numbers are there."""
    kinds = dict(rows.dtypes)
    row = ", ".join([f"`{number}` bigint", *[f"`{c}` {kinds[c]}" for c in columns]])
    names = [key, *[c.split()[0] for c in out.split(", ")]]
    return rows.select(key, F.col(number).cast("bigint").alias(number), *columns).groupBy(key).transformWithState(
        InNumberOrder(step, start, row, scalars, names), f"`{key}` {kinds[key]}, {out}", "Append", "None")
