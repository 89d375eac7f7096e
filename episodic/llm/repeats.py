"""Content shards: the frame in which the substring operators find repeats across all documents.

A window of ``window`` tokens is filed under the least hash of its ``gram``-token parts, so equal
windows always have one key.  Runs of neighbouring windows with one key form a fragment.

1. every document: the keys of its fragments, one row for each key and document group,
2. keys that occur once are dropped, the rest go back to their document groups,
3. by document group: fragments with a repeated key; equal ones are merged and sent to the shard
   of their key,
4. by shard: an index over the distinct fragments (suffix array, FM-index) decides which windows
   repeat an earlier one,
5. by document group: the spans meet their documents.

All traffic is rows -- keys, fragments, spans -- so it grows with the text, not with pairs of
groups or shards.  Document groups and shards are sized by bytes (``GROUP_BYTES``), however
large the corpus is.  A key with more than ``HOT`` occurrences is filed again by the hash of the
whole window, so even a passage that a third of all documents share is spread over all shards.
Hashes only file: fragments are merged, and windows called equal, by their content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodic.llm import kernel as K
from episodic.llm.common import parts

#: Occurrences from which the windows of a key are filed one by one.
HOT = 20_000
#: Bytes of distinct fragments that one index holds; a shard with more is indexed in turns.
INDEX_BYTES = 1 << 20
#: Bytes of text of a document group, and of the texts whose fragments one shard gets, about.
GROUP_BYTES = 1 << 22
#: Bytes of a slice of texts, and tokens of a longer text, that are hashed at once.
SEGMENT = 1 << 20


@dataclass(frozen=True)
class Unit:
    """What a token is, and how repeats count."""

    window: int
    gram: int
    words: bool  # tokens are words, else bytes
    within: bool  # repeats inside one document count

    def tokens(self, buf: np.ndarray, offs: np.ndarray):
        """(tokens, offsets of each text's tokens, byte starts, byte ends); words as hashes."""
        if not self.words:
            return buf, offs, None, None
        s, e, woffs = K.words(buf, offs, ~K.SPACE)
        return K.word_hashes(buf, s, e), woffs, s, e

    def exact(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets of each text's tokens); words as numbers, one for each distinct word."""
        if not self.words:
            return buf, offs
        s, e, woffs = K.words(buf, offs, ~K.SPACE)
        return _classes(np.concatenate(([0], np.cumsum(e - s))), buf[~K.SPACE[buf]]), woffs


@dataclass
class Fragments:
    """Distinct fragments of a shard: concatenated tokens, offsets, and their first owner."""

    tokens: np.ndarray
    offs: np.ndarray
    owner: np.ndarray  # rank of the smallest document id that has the fragment
    start: np.ndarray  # its first token there


#: Decides for every window of the first occurrence whether an earlier window equals it:
#: booleans by token of ``Fragments.tokens`` (the last window - 1 of a fragment are not windows).
Engine = Callable[[Fragments, Unit], np.ndarray]


def _classes(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A number for each byte string data[offs[i]:offs[i+1]], the same for equal strings only."""
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return strings.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _merged(key: np.ndarray, offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first fragment of each distinct (key, bytes), class of each fragment)."""
    code = _classes(offs, data)
    order = np.lexsort((key, code))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (key[order][1:] != key[order][:-1])
    same = np.empty(len(order), np.int64)
    same[order] = np.cumsum(new) - 1
    return order[new], same


def _taken(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices data[start:start + length], one behind the other."""
    return data[np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))]


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _borders(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(sorted_keys)
    return np.concatenate((np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))), [n])) if n else np.zeros(1, np.int64)


def _runs(unit: Unit, buf: np.ndarray, offs: np.ndarray, segment: int = SEGMENT) -> Iterator[tuple]:
    """(token arrays and fragments) of slices of whole texts; a long text in overlapping segments.

    Yields (first text, tokens, prefix hash, key, start in the slice, count, text, again,
    token offset of each text in the slice, byte starts, byte ends, the bytes that they (or, where
    tokens are bytes, the starts themselves) count in).
    """
    for i, j in K.slices(offs, segment):
        part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        tok, toffs, s, e = unit.tokens(part, o)
        if len(tok) > 2 * segment:  # one very long text
            step = segment
            for at in range(0, len(tok), step):
                piece = tok[at : at + step + unit.window - 1]
                found = K.window_runs(piece, np.array([0, len(piece)]), unit.window, unit.gram)
                cut = slice(at, at + len(piece))
                yield (i, piece, found[5], *found[:5], np.array([-at]), None if s is None else s[cut], None if e is None else e[cut], part if unit.words else piece)
            continue
        found = K.window_runs(tok, toffs, unit.window, unit.gram)
        yield i, tok, found[5], *found[:5], toffs[:-1], s, e, part


def _ids(column) -> np.ndarray:
    """Ids as 64-bit integers; null counts as the smallest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def _tags(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each text: rows that share an id but not the text are told apart."""
    out = np.zeros(len(offs) - 1, np.int64)
    for i, j in K.slices(offs, SEGMENT):
        h = K.prefix_hash(buf[offs[i] : offs[j]])
        out[i:j] = K.span_hash(h, offs[i:j] - offs[i], offs[i + 1 : j + 1] - offs[i]).view(np.int64)
    return out


def groups(docs: DataFrame, text_col: str, group_bytes: int = GROUP_BYTES) -> int:
    """Number of document groups, by the bytes of all texts; at least the shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("bigint"))).first()[0] or 0
    return max(parts(docs.sparkSession), -(-size // group_bytes))


def grouped(docs: DataFrame, id_col: str, text_col: str, num: int) -> DataFrame:
    """(_g, _id, _text): documents with their group, one of ``num``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.select(F.pmod(F.xxhash64("_id"), F.lit(num)).cast("int").alias("_g"), "_id", "_text")


def repeated_spans(rows: DataFrame, unit: Unit, engine: Engine, num: int, hot: int = HOT, index_bytes: int = INDEX_BYTES, segment: int = SEGMENT) -> DataFrame:
    """(_g, _id, _tag, start, end): the token spans that repeat an earlier window, by document
    group (``num`` of them); spans may overlap."""
    shards = max(64, 2 * num)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("_g").to_numpy(zero_copy_only=False)
            buf, offs = K.buffer_of(batch.column("_text"))
            for i, _, _, key, _, _, text, again, *_ in _runs(unit, buf, offs, segment):
                g = group[i + text].astype(np.int32)
                if unit.within:  # a run that may repeat itself counts twice
                    key, g = np.concatenate((key, key[again])), np.concatenate((g, g[again]))
                elif len(key):  # once for each document
                    order = np.lexsort((key, text))
                    k, t = key[order], text[order]
                    first = np.concatenate(([True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
                    key, g = k[first], g[order][first]
                order = np.lexsort((g, key))
                key, g = key[order], g[order]
                cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])))) if len(key) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"_g": pa.array(g[cut]), "key": pa.array(key[cut].view(np.int64)), "n": pa.array(np.diff(np.append(cut, len(key))).astype(np.int32))})

    def fragments(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, at = np.unique(_column(right, "key").view(np.uint64), return_index=True)
        is_hot = _column(right, "hot")[at] if len(at) else np.zeros(0, bool)
        none = pa.schema([("_s", pa.int32()), ("_g", pa.int32()), ("key", pa.int64()), ("count", pa.int64()), ("data", pa.binary()),
                          ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]).empty_table()
        if not len(wanted) or not left.num_rows:
            return none
        ids, (buf, offs) = _ids(left.column("_id")), K.buffer_of(left.column("_text"))
        tags = _tags(buf, offs)
        keys_, docs_, starts_, counts_, lens_, pieces_ = [], [], [], [], [], []
        for i, tok, h, key, start, count, text, _, first, s, e, part in _runs(unit, buf, offs, segment):
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            hit = wanted[at] == key
            key, start, count, text, heat = key[hit], start[hit], count[hit], text[hit], is_hot[at[hit]]
            if heat.any():  # every window of a hot key by itself, filed by its own hash
                n = count[heat]
                each = np.repeat(start[heat], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = K.mix(K.span_hash(h, each, each + unit.window))
                key, start, text = (np.concatenate((x[~heat], y)) for x, y in ((key, own), (start, each), (text, np.repeat(text[heat], n))))
                count = np.concatenate((count[~heat], np.ones(len(each), count.dtype)))
            if not len(key):
                continue
            end = start + count + unit.window - 1
            keys_.append(key)
            docs_.append(i + text)
            starts_.append(start - first[text])
            counts_.append(count)
            b0, b1 = (s[start], e[end - 1]) if unit.words else (start, end)  # words travel with what is between them
            lens_.append(b1 - b0)
            pieces_.append(_taken(part, b0, b1 - b0))
        if not keys_:
            return none
        key, doc, start, count, length, data = (np.concatenate(x) for x in (keys_, docs_, starts_, counts_, lens_, pieces_))
        del pieces_
        offs = np.concatenate(([0], np.cumsum(length)))
        first, same = _merged(key, offs, data)
        by = np.argsort(same, kind="stable")
        lists = pa.array(np.concatenate(([0], np.cumsum(np.bincount(same, minlength=len(first))))).astype(np.int32))
        some = length[first]
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(some))).astype(np.int64)), pa.py_buffer(_taken(data, offs[first], some))])
        return pa.table({"_s": pa.array((K.mix(key[first]) % np.uint64(shards)).astype(np.int32)), "_g": pa.array(np.full(len(first), left.column("_g")[0].as_py(), np.int32)),
                         "key": pa.array(key[first].view(np.int64)), "count": pa.array(count[first].astype(np.int64)), "data": binary.cast(pa.binary()),
                         "ids": pa.ListArray.from_arrays(lists, pa.array(ids[doc[by]])), "tags": pa.ListArray.from_arrays(lists, pa.array(tags[doc[by]])),
                         "starts": pa.ListArray.from_arrays(lists, pa.array(start[by].astype(np.int64)))})

    def decide(t: pa.Table) -> pa.Table:
        key, count = _column(t, "key"), _column(t, "count")
        data, offs = K.buffer_of(t.column("data"))
        lists = t.column("ids").combine_chunks()
        num_of = lists.value_lengths().to_numpy()
        ids, tags, start = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "tags", "starts"))
        frag, group = np.repeat(np.arange(len(key)), num_of), np.repeat(_column(t, "_g"), num_of)
        # equal fragments of different document groups become one
        one, same = _merged(key, offs, data)
        frag = same[frag]
        order = np.lexsort((start, ids, frag))
        frag, ids, tags, start, group = frag[order], ids[order], tags[order], start[order], group[order]
        lead = _borders(frag)[:-1]  # the first occurrence of each fragment
        owner, owner_start = ids[lead], start[lead]
        key, count, at, length = key[one], count[one], offs[one], np.diff(offs)[one]
        turn = np.argsort(key, kind="stable")
        runs = [(np.zeros(0, np.int64),) * 3]  # (fragment, first and last + 1 repeated window)
        cut = _borders(key[turn])
        i = 0
        while i < len(cut) - 1:  # whole keys, as many as one index holds
            total = np.cumsum(length[turn[cut[i] :]])
            fits = int(np.searchsorted(total, index_bytes, side="right")) + cut[i]
            j = max(i + 1, int(np.searchsorted(cut, fits, side="right")) - 1)
            some = turn[cut[i] : cut[j]]
            tok, toffs = unit.exact(_taken(data, at[some], length[some]), np.concatenate(([0], np.cumsum(length[some]))))
            _, rank = np.unique(owner[some], return_inverse=True)
            flags = engine(Fragments(tok, toffs, rank, owner_start[some]), unit)
            edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            which = np.searchsorted(toffs, a, side="right") - 1  # a fragment ends in no window, so runs end before
            runs.append((some[which], a - toffs[which], b - toffs[which]))
            i = j
        # later occurrences repeat the first one as a whole; where only other documents count,
        # so do those in larger ids alone
        first_of = np.repeat(lead, np.diff(np.append(lead, len(frag))))
        whole = ids != ids[first_of]
        if unit.within:
            whole |= start != start[first_of]
        out = [(group[whole], ids[whole], tags[whole], start[whole], start[whole] + count[frag[whole]] + unit.window - 1)]
        rest = np.flatnonzero(~whole)
        rf, ra, rb = (np.concatenate(x) for x in zip(*runs, strict=True))
        by = np.argsort(rf, kind="stable")
        rf, ra, rb = rf[by], ra[by], rb[by]
        lo, hi = np.searchsorted(rf, frag[rest]), np.searchsorted(rf, frag[rest], side="right")
        o, r = np.repeat(rest, hi - lo), np.arange((hi - lo).sum()) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)
        out.append((group[o], ids[o], tags[o], start[o] + ra[r], start[o] + rb[r] + unit.window - 1))
        g, i_, t_, s_, e_ = (np.concatenate(x) for x in zip(*out, strict=True))
        # spans of one row that overlap become one
        row = np.stack((i_, t_), 1)
        _, one_row, of = np.unique(row, axis=0, return_index=True, return_inverse=True) if len(row) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        of, s_, e_ = K.covered(of.reshape(-1), s_, e_)
        back = one_row[of]
        return pa.table({"_g": pa.array(g[back].astype(np.int32)), "_id": pa.array(i_[back]), "_tag": pa.array(t_[back]), "start": pa.array(s_.astype(np.int64)), "end": pa.array(e_.astype(np.int64))})

    counted = rows.mapInArrow(keys, "_g int, key bigint, n int")
    total = F.sum("n").over(Window.partitionBy("key"))
    back = counted.withColumn("total", total).where("total > 1").select("_g", "key", (F.col("total") > hot).alias("hot"))
    found = rows.groupBy("_g").cogroup(back.groupBy("_g")).applyInArrow(
        fragments, "_s int, _g int, key bigint, count bigint, data binary, ids array<bigint>, tags array<bigint>, starts array<bigint>")
    return found.groupBy("_s").applyInArrow(decide, "_g int, _id bigint, _tag bigint, start bigint, end bigint")


def with_spans(rows: DataFrame, spans: DataFrame, apply: Callable, schema: str) -> DataFrame:
    """``apply(ids, null ids, texts, spans by row)`` over every document group; a row's spans are merged."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        buf, offs = K.buffer_of(left.column("_text")) if left.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        ids = _ids(left.column("_id")) if left.num_rows else np.zeros(0, np.int64)
        i, t, s, e = (_column(right, c) for c in ("_id", "_tag", "start", "end"))
        mine: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if len(i):
            pair, doc = np.unique(np.stack((i, t), 1), axis=0, return_inverse=True)
            d, s, e = K.covered(doc.reshape(-1), s, e)
            cut = _borders(d)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                mine[tuple(pair[d[a]].tolist())] = list(zip(s[a:b].tolist(), e[a:b].tolist(), strict=True))
        tags = _tags(buf, offs)
        spans_of = [mine.get(x, []) for x in zip(ids.tolist(), tags.tolist(), strict=True)]
        raw = memoryview(np.ascontiguousarray(buf))
        texts = [bytes(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return apply(left, texts, spans_of)

    return rows.groupBy("_g").cogroup(spans.groupBy("_g")).applyInArrow(run, schema)
