"""Substring dedup by suffix arrays: remove every byte of a repeated 100-byte string.

Documents are cut into content shards (``repeats``); each shard sorts the suffixes of its
distinct fragments by induced sorting:

* classify suffixes as S (smaller than the next one) or L,
* sort the leftmost-smaller (LMS) substrings by one induction pass and name them; when names
  repeat, sort the reduced string of names recursively (by rank doubling once its alphabet is
  too large for bucket passes),
* induce the whole suffix array from the sorted LMS suffixes, bucket by bucket, each bucket as
  one vector operation,
* compute the permuted longest common prefixes: only where the preceding bytes differ is a
  prefix compared, everywhere else it is one shorter than that of the preceding position.

Neighbours with a common prefix of at least ``window`` bytes form a group; its earliest member
(document id, then position) stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodic.llm import kernel as K
from episodic.llm.common import table
from episodic.llm.repeats import Fragments, Unit, grouped, groups, repeated_spans, with_spans

BYTES = Unit(window=100, gram=24, words=False, within=True)
#: Symbols that are compared at once.
COMPARED = 1 << 20
#: Largest alphabet that is sorted bucket by bucket.
BUCKETS = 1 << 10


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (the last counts as such)."""
    d = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32)).astype(np.int8)
    s = np.ones(len(t), dtype=bool)
    turn = np.flatnonzero(d)
    if len(turn):
        lens = np.diff(np.concatenate(([-1], turn)))
        s[: turn[-1] + 1] = np.repeat(d[turn] > 0, lens)
        s[turn[-1] + 1 : -1] = False
    else:
        s[:-1] = False
    s[-1] = True
    return s


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Suffix array induced from the LMS positions ``lms``, sorted at least by first symbol."""
    n, sigma = len(t), len(count)
    tail = np.cumsum(count)
    head = tail - count
    sa = np.empty(n, np.int32)
    lcut = np.concatenate(([0], np.cumsum(np.bincount(t[lms], minlength=sigma))))
    used = np.flatnonzero(count)
    key = t.astype(np.uint16 if sigma <= 1 << 16 else np.int64)

    cur = head.copy()

    def push_l(x: np.ndarray) -> None:
        j = x[x > 0] - 1
        j = j[~s[j]]
        if not len(j):
            return
        c = key[j]
        order = np.argsort(c, kind="stable")
        c, j = c[order], j[order]
        num = np.bincount(c, minlength=sigma)
        sa[cur[c] + np.arange(len(c)) - (np.cumsum(num) - num)[c]] = j
        np.add(cur, num, out=cur)

    for c in used:
        done = head[c]
        while done < cur[c]:
            upto = cur[c]
            push_l(sa[done:upto])
            done = upto
        if lcut[c] < lcut[c + 1]:
            push_l(lms[lcut[c] : lcut[c + 1]])
    l_end = cur.copy()

    cur = tail.copy()
    sa[0] = n - 1
    cur[0] -= 1

    def push_s(x: np.ndarray) -> None:
        j = x[x > 0] - 1
        j = j[s[j]]
        if not len(j):
            return
        c = key[j]
        order = np.argsort(c, kind="stable")
        c, j = c[order], j[order]
        num = np.bincount(c, minlength=sigma)
        sa[cur[c] - 1 - np.arange(len(c)) + (np.cumsum(num) - num)[c]] = j
        np.subtract(cur, num, out=cur)

    for c in used[::-1]:
        done = tail[c]
        while done > cur[c]:
            downto = cur[c]
            push_s(sa[downto:done][::-1])
            done = downto
        if head[c] < l_end[c]:
            push_s(sa[head[c] : l_end[c]][::-1])
    return sa


def rank_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string whose last symbol is the only least one."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    first = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    alone = first & np.append(first[1:], True)
    pos = np.flatnonzero(~alone)
    open_ = order[pos]
    k = 1
    while len(pos):
        key = rank[open_] * n + rank[np.minimum(open_ + k, n - 1)]
        o = np.argsort(key)
        open_, key = open_[o], key[o]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        order[pos] = open_
        rank[open_] = pos[np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))]
        stay = ~(first & np.append(first[1:], True))
        pos, open_ = pos[stay], open_[stay]
        k *= 2
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting; the last symbol must be 0 and occur once."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    s = _smaller(t)
    count = np.bincount(t)
    is_lms = s.copy()
    is_lms[0] = False
    is_lms[1:] &= ~s[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    by_symbol = lms[np.argsort(t[lms], kind="stable")]
    if len(lms) == 1:
        return _induce(t, s, lms, count)
    sorted_lms = _induce(t, s, by_symbol, count)
    sorted_lms = sorted_lms[is_lms[sorted_lms]]
    end = np.empty(n, np.int64)  # a substring reaches to the next LMS position
    end[lms] = np.minimum(np.append(lms[1:], n - 1).astype(np.int64) + 1, n)
    name = np.concatenate(([0], np.cumsum(~_equal_spans(t, sorted_lms[1:], sorted_lms[:-1], (end[sorted_lms] - sorted_lms)[1:], (end[sorted_lms] - sorted_lms)[:-1]))))
    if name[-1] + 1 < len(lms):
        names = np.empty(n, np.int64)
        names[sorted_lms] = name
        reduced = names[lms]
        inner = suffix_array(reduced) if name[-1] < BUCKETS else rank_doubling(reduced)
        sorted_lms = lms[inner]
    return _induce(t, s, sorted_lms, count)


def _equal_spans(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Are t[a:a + length] and t[b:b + other] equal?  Compared symbol by symbol, a part at a time."""
    out = np.ones(len(a), dtype=bool) if other is None else length == other
    which = np.flatnonzero(out)
    total = np.cumsum(length[which], dtype=np.int64)
    i = 0
    while i < len(which):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + COMPARED, side="right")))
        w = which[i:j]
        n = length[w].astype(np.int64)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = t[np.repeat(a[w], n) + step] != t[np.repeat(b[w], n) + step]
        out[w[np.repeat(np.arange(len(w)), n)[differ]]] = False
        i = j
    return out


def _phi(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predecessor of each suffix in ``sa`` (-1: none), and where the preceding symbols differ."""
    n = len(t)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    fresh = np.ones(n, dtype=bool)
    back = phi[1:] - 1
    fresh[1:] = (back < 0) | (t[:-1] != t[np.maximum(back, 0)])
    return phi, fresh


def permuted_lcp(t: np.ndarray, sa: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest common prefix of every suffix with its predecessor in ``sa``, by text position.
    Prefixes shorter than ``least`` may be given as any smaller number.  Prefixes are compared by
    hashes; ``window_repeats`` checks what rests on them."""
    n = len(t)
    phi, fresh = _phi(t, sa)
    i = np.flatnonzero(fresh & (phi >= 0))
    j = phi[i]
    h = K.prefix_hash(t)
    length = np.zeros(len(i), np.int64)

    def grow(which: np.ndarray, step: int) -> np.ndarray:
        """Lengthens the prefixes that match ``step`` more symbols, and returns those."""
        a, b = i[which] + length[which], j[which] + length[which]
        ok = np.maximum(a, b) + step <= n
        a, b, which = a[ok], b[ok], which[ok]
        same = which[K.span_hash(h, a, a + step) == K.span_hash(h, b, b + step)]
        length[same] += step
        return same

    long = grow(np.arange(len(i)), least)
    more, step = long, 16
    while len(more):  # by steps that double while they match, then halve
        more = grow(more, step)
        step *= 2
    while step >= 1:
        grow(long, step)
        step //= 2
    plcp = np.zeros(n, np.int32)
    plcp[i] = length
    # elsewhere it is one less than at the position before
    at = np.arange(n, dtype=np.int32)
    start = np.maximum.accumulate(np.where(fresh, at, 0))
    return np.where(phi < 0, 0, plcp[start] + start - at)


def window_repeats(t: np.ndarray, sa: np.ndarray, window: int) -> np.ndarray:
    """By text position: does the window there equal that of the predecessor in ``sa``?

    Decided by the symbols: all of them where the preceding ones differ, the last one where the
    windows one position before are equal already."""
    long = permuted_lcp(t, sa, window) >= window
    phi, fresh = _phi(t, sa)
    heads = np.flatnonzero(long & fresh)
    wrong = np.zeros(len(t), dtype=bool)
    wrong[heads] = ~_equal_spans(t, heads, phi[heads], np.full(len(heads), window))
    tails = np.flatnonzero(long & ~fresh)
    wrong[tails] = t[tails + window - 1] != t[phi[tails] + window - 1]
    if not wrong.any():
        return long
    at = np.arange(len(t))
    last = np.maximum.accumulate(np.where(wrong, at, -1))
    return long & (last < np.maximum.accumulate(np.where(fresh, at, 0)))


def repeats_earlier(f: Fragments, unit: Unit) -> np.ndarray:
    """For every byte: does the window that starts here also start earlier?"""
    n, k = len(f.tokens), len(f.offs) - 1
    frag = np.repeat(np.arange(k), np.diff(f.offs))
    t = np.ones(n + k + 1, np.int16)  # 1 ends a fragment, 0 the text
    place = np.arange(n) + frag
    t[place] = f.tokens.astype(np.int16) + 2
    t[-1] = 0
    sa = suffix_array(t)
    long = window_repeats(t, sa, unit.window)[sa]
    owner = np.full(len(t), np.iinfo(np.int64).max)
    owner[place] = (f.owner[frag].astype(np.int64) << 40) + f.start[frag] + np.arange(n) - f.offs[:-1][frag]
    groups = np.flatnonzero(~long)
    least = np.minimum.reduceat(owner[sa], groups)
    rank = np.cumsum(~long) - 1
    out = np.zeros(len(t), dtype=bool)
    out[sa] = owner[sa] > least[rank]
    inside = np.arange(n) + unit.window <= f.offs[1:][frag]
    return out[place] & inside


def spans(docs: DataFrame, unit: Unit = BYTES, id_col: str = "doc_id", text_col: str = "text", **sizes) -> tuple[DataFrame, DataFrame]:
    num = groups(docs, text_col)
    rows = grouped(docs, id_col, text_col, num)
    return rows, repeated_spans(rows, unit, repeats_earlier, num, **sizes)


def substring_report(docs: DataFrame, unit: Unit = BYTES, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Null text counts as empty.  Rows that share id and text are one document, so neither is
    earlier than the other.  A null id is smaller than any other.  Other columns are not read.
    """

    def report(left: pa.Table, texts: list[bytes], spans_of: list[list[tuple[int, int]]]) -> pa.Table:
        n, gone, num, sha = [], [], [], []
        for text, cut in zip(texts, spans_of, strict=True):
            n.append(len(text))
            gone.append(sum(b - a for a, b in cut))
            num.append(len(cut))
            sha.append(hashlib.sha256(b"".join(_kept(text, cut))).hexdigest())
        return pa.table({"_id": left.column("_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                         "n_spans": pa.array(num, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    rows, found = spans(docs, unit, id_col, text_col, **sizes)
    return with_spans(rows, found, report, "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("_id", id_col)


def _kept(text: bytes, cut: list[tuple[int, int]]) -> Iterator[bytes]:
    at = 0
    for a, b in cut:
        yield text[at:a]
        at = b
    yield text[at:]


def without_repeats(docs: DataFrame, unit: Unit = BYTES, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; all rows and columns stay.

    A span is narrowed to whole characters, so the text stays valid UTF-8.  Null text stays null.
    """
    num = groups(docs, text_col)
    found = repeated_spans(grouped(docs, id_col, text_col, num), unit, repeats_earlier, num, **sizes)

    def inner(text: bytes, a: int, b: int) -> tuple[int, int]:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        return a, b

    def cut(left: pa.Table, texts: list[bytes], spans_of: list[list[tuple[int, int]]]) -> pa.Table:
        kept = [b"".join(_kept(t, [inner(t, a, b) for a, b in c])).decode() for t, c in zip(texts, spans_of, strict=True)]
        kept = [None if null else t for null, t in zip(left.column("_text").is_null().to_pylist(), kept, strict=True)]
        others = {c: left.column(c) for c in left.column_names if c.startswith("_c")}
        return pa.table({**others, "_text": pa.array(kept, pa.string())})

    others = [c for c in docs.columns if c != text_col]
    full = docs.select(F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(num)).cast("int").alias("_g"),
                       F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)])
    kinds = ", ".join([f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)] + ["_text string"])
    done = with_spans(full, found, cut, kinds)
    names = {c: f"_c{i}" for i, c in enumerate(others)} | {text_col: "_text"}
    return done.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))
