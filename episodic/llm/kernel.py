"""Vectorized text kernels on Arrow buffers: word splitting, rolling hashes and window minima.

A batch of texts is one byte buffer with offsets; every kernel works on that buffer and never
on single Python strings.  Hashes are 64-bit polynomial prefix sums followed by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that belong to a normalized word: ASCII letters and digits, and every non-ASCII byte.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if size <= 1 << 22:  # larger ones belong to one very long text and are not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, at least one text each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(tokens: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (token + 1) * base^position over [i, j)."""
    h = np.zeros(len(tokens) + 1, dtype=U64)
    np.cumsum((tokens.astype(U64) + U64(1)) * _power(_BASE, len(tokens)), out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans [start, end) of the tokens behind ``h``."""
    return mix((h[end] - h[start]) * _power(_BASE_INV, len(h))[start] + (end - start).astype(U64))


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with ``inside`` set that no text border cuts,
    and the offsets of each text's words."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = inside[buf]
    border = np.zeros(n + 1, dtype=bool)
    border[offs] = True
    before = np.concatenate(([False], m[:-1])) & ~border[:n]
    after = np.concatenate((m[1:], [False])) & ~border[1:]
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(buf), starts, ends)


def slide(values: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``w`` consecutive values."""
    s = 1
    m = values
    while s * 2 <= w:
        m = op(m[:-s], m[s:])
        s *= 2
    return op(m[: len(m) - (w - s)], m[w - s :]) if s < w else m


def window_runs(tokens: np.ndarray, offs: np.ndarray, window: int, gram: int):
    """Cut every text into runs of window starts that share the least ``gram``-token hash.

    Equal windows have equal least hashes, so runs that share a window share the run's key.
    Returns (key, start, count, text, again, prefix hash): ``start`` in tokens of the buffer,
    ``count`` window starts, ``again``: the run's least gram occurs twice in a row, so windows
    may repeat inside the run.
    """
    n = len(tokens)
    none = np.zeros(0, np.int64)
    h = prefix_hash(tokens)
    if n < window:
        return np.zeros(0, U64), none, none, none, np.zeros(0, bool), h
    at = np.arange(n - gram + 1)
    g = span_hash(h, at, at + gram)
    w = window - gram + 1
    least = slide(g, w, np.minimum)  # of window start i
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    valid = np.arange(len(least)) + window <= offs[1:][text]
    change = np.ones(len(least), dtype=bool)
    change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(change & valid)
    ends = np.flatnonzero(valid & np.append(change[1:] | ~valid[1:], True)) + 1
    key = least[starts]
    # a gram that is the least of some window that holds it
    low = np.where(valid, least, U64(0))
    pad = np.zeros(w - 1, dtype=U64)
    chosen = np.flatnonzero(slide(np.concatenate((pad, low, pad)), w, np.maximum) == g)
    twice = np.unique(g[chosen[1:]][g[chosen[1:]] == g[chosen[:-1]]])
    again = np.isin(key, twice) if len(twice) else np.zeros(len(key), dtype=bool)
    return key, starts, ends - starts, text[starts], again, h


def covered(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans by text: sorted maximal (text, start, end); touching spans are merged."""
    if not len(text):
        return text, start, end
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    big = int(max(end.max(), 1)) + 1
    rank = np.cumsum(np.concatenate(([0], (text[1:] != text[:-1]).astype(np.int64))))
    lo, hi = rank * big + start, np.maximum.accumulate(rank * big + end)
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    return text[first], start[first], hi[last] - rank[last] * big
