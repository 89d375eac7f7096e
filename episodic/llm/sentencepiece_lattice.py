"""SentencePiece encoding and decoding by a lattice in columns.

*Words.*  A text is cut wherever two neighbouring characters stand side by side in no piece of
the vocabulary: no merge and no piece can cross such a place, so the parts ("words") are encoded
by themselves.  Words are numbered in blocks of about 2 MB of text; each distinct one is encoded once a
block.  Nothing is shuffled or written: words of real and made texts are mostly rare, and
moving them costs as much disk as the texts.

*Lattice.*  The symbols of all words of a block are one column.  For a BPE model the edges are
the neighbours whose texts together are a piece, found by joining (left, right) with a table of
all the ways to cut a piece in two; for a unigram model the pieces that start at a symbol, found
by joining (prefix, symbol) with a table of the pieces' prefixes.  Both joins compare content.

*Fold.*  All words of a block fold together, a step at a time.  For a unigram model it is Viterbi's
recursion over the edges.  For a BPE model Viterbi is not what the model means: there the score of
a piece is the rank of its merge, so a step applies in each word its best-scored edge, leftmost
first, until a word has none.  Characters without a piece become byte pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodic.llm import kernel as K
from episodic.llm.common import table, written

SPACE = "▁"
NORMAL, UNKNOWN_KIND, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Characters from which a word is encoded by the library itself: the fold is quadratic in them.
LONG = 200
#: Bytes of text in a block, one text at least.
BLOCK = 2 << 20
_NONE = 1 << 30
_JOINS = 22


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        size = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if size is None else size
        yield tag >> 3, raw[at : at + size]
        at += size


class Model:
    """What a model file says: pieces (text, score, kind) and whether it is unigram or BPE."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.kind, self.dummy_prefix, self.squeeze, self.normalizer = UNIGRAM, True, True, b"identity"
        self.pieces: list[tuple[str, float, int]] = []
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                self.dummy_prefix, self.squeeze, self.normalizer = bool(f.get(3, 1)), bool(f.get(4, 1)), f.get(1, b"")
        if self.normalizer != b"identity" or self.squeeze:
            raise ValueError("only models that keep the text as it is can be encoded")
        self.bytes = [0] * 256
        for i, (text, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN_KIND), 0)
        self.fallback = any(self.bytes)
        held = {c for t, _, k in self.pieces if k in (NORMAL, USER) for c in t}
        self.apart = next(c for c in "\n\t\0\x01\x02" if c not in held)

    def joins(self) -> np.ndarray:
        """A table of the character pairs inside pieces, by hash; a false hit only joins words."""
        out = np.zeros(1 << _JOINS, dtype=bool)
        for text, _, kind in self.pieces:
            if kind in (NORMAL, USER) and len(text) > 1:
                c = np.array([ord(x) for x in text], np.uint32)
                out[_pair(c[:-1], c[1:])] = True
        return out

    def texts(self) -> list[bytes]:
        """What each id stands for, as bytes."""
        return [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == 3 else t.replace(SPACE, " ").encode() for t, _, k in self.pieces]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * K.U64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * K.U64(0xD6E8FEB86659FD93)) >> K.U64(64 - _JOINS)


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


class Lattice:
    """Encodes words, given as one column of characters and the words' lengths.

    Symbols are numbers: the pieces' texts and the characters that occur in them; characters of no
    piece get numbers behind those, block by block."""

    def __init__(self, model: Model):
        self.model, self.joins, self.library = model, model.joins(), None
        pieces = [(t, i, s) for i, (t, s, k) in enumerate(model.pieces) if k in (NORMAL, USER) and t]
        number = {t: i for i, t in enumerate(dict.fromkeys([t for t, _, _ in pieces] + sorted({c for t, _, _ in pieces for c in t})))}
        self.symbols = len(number)
        self.of_char = np.full(0x110000, -1, np.int64)
        ids = [self.byte_ids(t) for t in number]
        for t, k in number.items():
            if len(t) == 1:
                self.of_char[ord(t)] = k
        for t, i, _ in pieces:
            ids[number[t]] = [i]
        self.ids, self.sizes = [x for y in ids for x in y], [len(y) for y in ids]
        if model.kind == BPE:
            level = {s: r for r, s in enumerate(sorted({s for _, _, s in pieces}, reverse=True))}
            cuts = {number[t[:k]] * self.symbols + number[t[k:]]: (level[s], number[t]) for t, _, s in pieces for k in range(1, len(t)) if t[:k] in number and t[k:] in number}
            self.keys = np.array(sorted(cuts), np.int64)
            self.rank, self.made = np.array([cuts[k] for k in self.keys.tolist()], np.int64).reshape(-1, 2).T
        else:
            prefixes = {t: i for i, t in enumerate(dict.fromkeys(["", *(t[:k] for t, _, _ in pieces for k in range(1, len(t) + 1))]))}
            steps = {prefixes[t[:-1]] * self.symbols + number[t[-1]]: i for t, i in prefixes.items() if t}
            self.keys = np.array(sorted(steps), np.int64)
            self.made = np.array([steps[k] for k in self.keys.tolist()], np.int64)
            self.ends, self.score = np.full(len(prefixes), -1, np.int64), np.zeros(len(prefixes))
            for t, _, score in pieces:
                self.ends[prefixes[t]], self.score[prefixes[t]] = number[t], score
            self.unknown = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0) - 10.0

    def byte_ids(self, text: str) -> list[int]:
        """Byte pieces of a text, or the unknown piece."""
        return [self.model.bytes[b] for b in text.encode()] if self.model.fallback else [self.model.unknown]

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table for (left, right), and which are there."""
        if not len(self.keys):
            return np.zeros(len(left), np.int64), np.zeros(len(left), bool)
        key = left * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, (self.keys[at] == key) & (right < self.symbols)

    def _merges(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, symbol) of the parts after all merges of a BPE model."""
        word = np.repeat(np.arange(len(length)), length)

        def edges(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # of the parts i and their right neighbours
            after = np.minimum(i + 1, len(sym) - 1)
            at, there = self._find(sym[i], sym[after])
            there &= (after > i) & (word[after] == word[i])
            return (np.where(there, self.rank[at], _NONE), self.made[at]) if len(self.keys) else (np.full(len(i), _NONE), i)

        rank, made = edges(np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat((rank << 32) + np.arange(len(sym)), first)  # leftmost of equal ones
            more = (best >> 32) < _NONE
            keep = np.repeat(more, np.diff(np.append(first, len(sym))))
            done.append((word[~keep], sym[~keep]))
            at = best[more] & 0xFFFFFFFF
            sym[at] = made[at]
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            fresh = np.concatenate((moved, moved[moved > 0] - 1))
            rank[fresh], made[fresh] = edges(fresh)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (word, sym)
        order = np.argsort(word, kind="stable")
        return word[order], sym[order]

    def _viterbi(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, symbol) of the best-scored segmentation of a unigram model; a character without a
        piece costs ``unknown``, and of equal scores the longer last part wins."""
        word = np.repeat(np.arange(len(length)), length)
        base = np.cumsum(length + 1) - length - 1  # borders of all words in one column
        left = np.arange(len(sym)) + word  # the border before each character
        at, node, found = np.arange(len(sym)), np.zeros(len(sym), np.int64), []
        n = 0
        while len(at):  # all prefixes of pieces, a character longer each time
            row, there = self._find(node, sym[at + n])
            at, node, n = at[there], self.made[row[there]], n + 1
            whole = self.ends[node] >= 0
            found.append((left[at[whole]], left[at[whole]] + n, self.score[node[whole]], self.ends[node[whole]]))
            inside = at + n < len(sym)
            at, node = at[inside], node[inside]
            inside = word[at + n] == word[at]
            at, node = at[inside], node[inside]
        bare = np.ones(len(sym), dtype=bool)
        if found:
            bare[np.flatnonzero(np.isin(left, found[0][0]))] = False
        found.append((left[bare], left[bare] + 1, np.full(int(bare.sum()), self.unknown), sym[bare]))
        start, end, score, part = (np.concatenate(x) for x in zip(*found, strict=True))
        borders = len(sym) + len(length)
        best, back, by = np.zeros(borders), np.full(borders, -1, np.int64), np.zeros(borders, np.int64)
        place = np.arange(borders) - np.repeat(base, length + 1)
        order = np.argsort(place[end], kind="stable")
        cut = np.searchsorted(place[end][order], np.arange(1, int(length.max(initial=0)) + 2))
        for a, b in zip(cut[:-1], cut[1:], strict=True):  # edges that end behind the k-th characters
            e = order[a:b]
            total = best[start[e]] + score[e]
            e, total = (x[np.lexsort((-start[e], total, end[e]))] for x in (e, total))
            last = np.flatnonzero(np.append(end[e][1:] != end[e][:-1], True)[: len(e)])
            best[end[e[last]]], back[end[e[last]]], by[end[e[last]]] = total[last], start[e[last]], part[e[last]]
        which, here, out = np.arange(len(length)), base + length, []
        while len(which):
            more = back[here] >= 0
            which, here = which[more], here[more]
            out.append((which, by[here], here))
            here = back[here]
        which, part, here = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (which, which, which)
        order = np.argsort(here, kind="stable")
        return which[order], part[order]

    def encode(self, c: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their number by word."""
        sym = self.of_char[c]
        strange, number = np.unique(c[sym < 0], return_inverse=True)
        sym[sym < 0] = self.symbols + number
        extra = [self.byte_ids(chr(x)) for x in strange.tolist()]
        sizes = np.array(self.sizes + [len(x) for x in extra], np.int64)
        ids = np.array(self.ids + [y for x in extra for y in x], np.int32)
        word, part = (self._merges if self.model.kind == BPE else self._viterbi)(sym, length)
        n = sizes[part]
        return _spans(ids, (np.cumsum(sizes) - sizes)[part], n), np.bincount(word, n, len(length)).astype(np.int64)

    def encode_long(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if words and self.library is None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model.raw)
        apart = self.model.apart  # in front: a character that no piece holds, so nothing joins it
        found = [self.library.encode(apart + w)[len(self.library.encode(apart)) :] for w in words]
        return np.array([y for x in found for y in x], np.int32), np.array([len(x) for x in found], np.int64)

    def block(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        prefix = SPACE if self.model.dummy_prefix else ""
        marked = [prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(marked)
        c = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        border = np.concatenate(([0], np.cumsum([len(t) for t in marked], dtype=np.int64)))
        new = np.ones(len(c), dtype=bool)
        new[1:] = ~self.joins[_pair(c[:-1], c[1:])]
        new[border[:-1][border[:-1] < len(c)]] = True
        start = np.flatnonzero(new)
        data = np.frombuffer(whole.encode(), np.uint8)
        of_char = np.flatnonzero((data & 0xC0) != 0x80)
        offsets = np.append(of_char[start], len(data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        numbered = words.dictionary_encode()
        code = numbered.indices.to_numpy()
        first = np.zeros(len(numbered.dictionary), np.int64)
        first[code[::-1]] = np.arange(len(start))[::-1]
        length = np.append(start[1:], len(c))[first] - start[first] if len(start) else first
        short = length < LONG
        ids, size = self.encode(_spans(c, start[first[short]], length[short]), length[short])
        more, sizes = self.encode_long([w.as_py().decode() for w in numbered.dictionary.filter(pa.array(~short))])
        place = np.empty(len(first), np.int64)
        place[np.concatenate((np.flatnonzero(short), np.flatnonzero(~short)))] = np.arange(len(first))
        size = np.concatenate((size, sizes))
        n, at = size[place[code]], (np.cumsum(size) - size)[place[code]]
        total = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, border)]
        return pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(_spans(np.concatenate((ids, more)), at, n)))


def _spans(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values [start, start + n) of all spans in a row."""
    return values[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


_lattices: dict[int, Lattice] = {}


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, crc32 of the text) of every row; null and empty texts have no ids.

    Repeated rows are encoded one by one; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    raw = docs.sparkSession.sparkContext.broadcast(model.raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(raw.value)
        lattice = _lattices.get(key)
        if lattice is None:
            _lattices.clear()
            lattice = _lattices[key] = Lattice(Model(raw.value))
        for batch in batches:
            _, offs = K.buffer_of(batch.column("_text"))
            for i, j in K.slices(offs, BLOCK):
                texts = [t or "" for t in batch.column("_text").slice(i, j - i).to_pylist()]
                crc = pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), lattice.block(texts), crc], names=["_id", "ids", "crc"])

    return rows.mapInArrow(run, f"_id {kind}, ids array<int>, crc bigint").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids; bytes that are no UTF-8 become replacement signs."""
    pieces = F.array(*[F.lit(t.hex().upper()) for t in model.texts()])
    known = encoded.sparkSession.range(1).select(pieces.alias("t"))
    prefix = model.dummy_prefix
    joined = F.array_join(F.transform(ids_col, lambda i: F.get(F.col("_t"), i)), "")
    text = F.decode(F.unhex(joined), "UTF-8")
    text = F.when(text.startswith(" "), F.substring(text, F.lit(2), F.length(text))).otherwise(text) if prefix else text
    return encoded.withColumn("_t", written(known).scalar()).withColumn(out_col, text).drop("_t")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: number of ids, their CRC-32 (little-endian unsigned 32-bit), and whether decoding
    them gives the text again."""
    import public_tokenizers

    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    found = encode(table(spark, sf_dir, "documents"), model)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            n = lists.value_lengths()
            crc = [zlib.crc32(v.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for v in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n.cast(pa.int64()), pa.array(crc, pa.int64()), batch.column("round_trip")],
                                             names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    back = decode(found, model).select("doc_id", "ids", (F.crc32(F.col("text").cast("binary")) == F.col("crc")).alias("round_trip"))
    return back.mapInArrow(digest, "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean")
