"""Substring dedup by FM-indexes: remove every word of a repeated 50-word window.

Documents are cut into content shards (``repeats``).  Each shard holds a compressed FM-index over
the words of its distinct fragments -- a wavelet matrix of the Burrows-Wheeler transform, one bit
vector a level with counts for each 64 bits -- and streams the fragments of the documents through
it, last word first, all fragments side by side.  A step of backward search is one rank query.
The matching statistic of a position is kept at ``window`` at most: before each step the interval
is widened to all suffixes that share the last ``window`` - 1 words, so after it the interval
holds exactly the occurrences of the window that starts here.  A window repeats if the smallest
document id in its interval is smaller than its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from episodic.llm import kernel as K
from episodic.llm.common import table
from episodic.llm.repeats import Fragments, Unit, grouped, groups, repeated_spans, with_spans
from episodic.llm.suffix_dedup import _equal_spans, rank_doubling

WORDS = Unit(window=50, gram=10, words=True, within=False)
#: Words of a fragment that one stream feeds; longer fragments are fed as overlapping pieces.
STREAM = 512


class WaveletMatrix:
    """Rank queries over a sequence of symbols below 2^levels, from bit vectors."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for level in reversed(range(self.levels)):
            bit = (now >> np.uint32(level)) & np.uint32(1) != 0
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view("<u8")
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)))[:-1].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))
        # now all occurrences of a symbol stand together
        heads = np.flatnonzero(np.concatenate(([True], now[1:] != now[:-1])))
        self.start = np.zeros(sigma, np.int64)
        self.start[now[heads]] = heads

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``at``."""
        p = at
        for k, level in enumerate(reversed(range(self.levels))):
            word = p >> 6
            mask = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][word] + np.bitwise_count(self.bits[k][word] & mask)
            p = np.where((symbol >> level) & 1, self.zeros[k] + ones, p - ones)
        return p - self.start[symbol]


class FMIndex:
    """FM-index of texts of integer symbols from 2 on; 1 ends a text, 0 the collection."""

    def __init__(self, t: np.ndarray, window: int):
        n, sigma = len(t), int(t.max()) + 1
        # rank doubling may stop at the first power of two from ``window`` on; here it runs to the end
        self.sa = rank_doubling(t).astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=sigma))))[:-1]
        self.bwt = WaveletMatrix(t[self.sa - 1], sigma)
        h = K.prefix_hash(t)

        def blocks(depth: int) -> np.ndarray:
            """For every row of the array the first one that shares ``depth`` symbols."""
            fits = self.sa + depth <= n
            digest = K.span_hash(h, self.sa, np.minimum(self.sa + depth, n))
            same = np.flatnonzero((digest[1:] == digest[:-1]) & fits[1:] & fits[:-1]) + 1
            same = same[_equal_spans(t, self.sa[same], self.sa[same - 1], np.full(len(same), depth))]  # by the symbols, not the hash alone
            new = np.ones(n, dtype=bool)
            new[same] = False
            return np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))

        self.shorter = blocks(window - 1)
        self.block = blocks(window)
        self.window = window

    def extend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First row of the suffixes that continue those of ``row`` by one symbol to the left."""
        return self.first[symbol] + self.bwt.rank(symbol, row)

    def windows(self, t: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For the streams t[start:end], which occur in the collection: the first row of the
        interval of the window that starts at each position (-1: no whole window)."""
        out = np.full(len(t), -1, np.int64)
        order = np.argsort(start - end, kind="stable")  # longest first
        start, end = start[order], end[order]
        row = np.zeros(len(start), np.int64)
        for step in range(int((end - start).max()) if len(start) else 0):
            live = int(np.searchsorted(start - end, -step, side="left"))  # streams longer than step
            at = end[:live] - 1 - step
            now = row[:live]
            if step >= self.window:  # the match has ``window`` words: drop the last one
                now = self.shorter[now]
            now = self.extend(t[at], now)
            row[:live] = now
            if step >= self.window - 1:
                out[at] = self.block[now]
        return out


def repeats_smaller(f: Fragments, unit: Unit) -> np.ndarray:
    """For every word: does the window that starts here occur in a document with a smaller id?"""
    n, k = len(f.tokens), len(f.offs) - 1
    frag = np.repeat(np.arange(k), np.diff(f.offs))
    _, ids = np.unique(f.tokens, return_inverse=True)
    t = np.ones(n + k + 1, np.int64)
    place = np.arange(n) + frag
    t[place] = ids + 2
    t[-1] = 0
    index = FMIndex(t, unit.window)
    owner = np.full(len(t), np.iinfo(np.int64).max)
    owner[place] = f.owner[frag]
    heads = np.flatnonzero(index.block == np.arange(len(t)))
    least = np.zeros(len(t), np.int64)
    least[heads] = np.minimum.reduceat(owner[index.sa], heads)
    size = np.diff(f.offs)
    per = STREAM - unit.window + 1
    num = np.maximum(1, -(-(size - unit.window + 1) // per))
    first = np.repeat(f.offs[:-1] + np.arange(k), num) + (np.arange(num.sum()) - np.repeat(np.cumsum(num) - num, num)) * per
    last = np.minimum(first + STREAM, np.repeat(f.offs[1:] + np.arange(k), num))
    row = index.windows(t, first, last)[place]
    return (row >= 0) & (least[np.maximum(row, 0)] < f.owner[frag])


def repeated_words(docs: DataFrame, unit: Unit = WORDS, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_text) of every row: the word spans [start, end) of
    windows that a document with a smaller id has, and the words that stay, joined by one space.

    Words are what stands between ASCII white space, unchanged.  Null text has none.  Rows that
    share an id count as one document.  A null id is smaller than any other.  Other columns are
    not read.
    """
    num = groups(docs, text_col)
    rows = grouped(docs, id_col, text_col, num)
    found = repeated_spans(rows, unit, repeats_smaller, num, **sizes)

    def report(left: pa.Table, texts: list[bytes], spans_of: list[list[tuple[int, int]]]) -> pa.Table:
        n, gone, kept = [], [], []
        for text, cut in zip(texts, spans_of, strict=True):
            words = text.split()
            n.append(len(words))
            gone.append(sum(b - a for a, b in cut))
            at, stay = 0, []
            for a, b in cut:
                stay += words[at:a]
                at = b
            kept.append(b" ".join(stay + words[at:] if cut else words))
        spans = pa.array([[{"start": a, "end": b} for a, b in cut] for cut in spans_of], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table({"_id": left.column("_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "spans": spans,
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    schema = "_id bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept_text string"
    return with_spans(rows, found, report, schema).withColumnRenamed("_id", id_col)


def op3_fm_index_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_words(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept_text AS binary), 256) AS kept_sha256")
