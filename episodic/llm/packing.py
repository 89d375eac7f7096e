"""Best-fit packing of tokenized documents into sequences of a fixed number of tokens.

1. Tokenize in one pass without a shuffle; documents longer than a sequence are cut.
2. Count pieces by length (at most ``capacity`` rows, whatever the size of the corpus).
3. Plan on those counts: *large-item matching* -- at most two pieces above a third of the
   capacity fit into one bin, so each one above half takes the largest partner that fits,
   longest first, and the rest pair with each other; then all shorter pieces, longest first,
   go to the tightest gap that holds them.  The plan speaks of "the pieces of length l with
   ranks r..r+n" and "the bins b..b+m", so its size depends on the capacity, not on the corpus.
4. Rank the pieces of each length (hash buckets with prefix sums, so a length that a third of
   all pieces have is ranked by many tasks) and look up bin and offset by rank.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodic.llm import kernel as K
from episodic.llm.common import parts, table, written

CAPACITY = 4096
END_ID = 1
#: Words whose ids a Python worker remembers: twice that many at most.  When that many are new, the
#: older ones are dropped, but for those that were needed since.
REMEMBER = 250_000
#: Bytes of text that are cut into words at a time, one text at least.
PART = 8 << 20


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit) of words between ASCII white space.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words.  Words of plain letters, digits and signs skip the normalizer: below U+0300 it only
    lowers the case.  All others go through the whole tokenizer.  Letters with at most one sign
    behind them, which most words are, are cut without the pattern: the pattern takes letters as
    one piece and a sign behind them as another.
    """

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.whole = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        split = [p["pattern"]["Regex"] for p in (parsed.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        steps = [n["type"] for n in (parsed.get("normalizer") or {}).get("normalizers", [])]
        self.direct = steps == ["NFC", "Replace", "Lowercase"] and len(split) == 1 and parsed["model"]["type"] == "BPE"
        if self.direct:
            self.cut = regex.compile(split[0])
            parsed |= {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
            self.model = Tokenizer.from_str(json.dumps(parsed)).model
            self.plain = regex.compile("[\\x21-\\x7e\\u00c0-\\u012f\\u0131-\\u02ff]*")
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            other = iter(range(256, 512))
            self.shown = {b: chr(b) if b in shown else chr(next(other)) for b in range(256)}
            self.packed = [i.to_bytes(4, "little") for i in range(1 + max(parsed["model"]["vocab"].values()))]
            rest = set(split[0].split("|")) - {"[\\p{N}]"}
            self.letters = {"[\\p{L}]+", "[^\\s\\p{L}\\p{N}]+"} == {p for p in rest if p[:1] != "'"}
            self.signs = frozenset(b".,;:!?)" if self.letters else b"")
            self.piece: dict[bytes, bytes] = {}
            self.older_piece: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        out = self.older.get(word)
        if out is None and not word:
            out = b""  # white space at a border of the text
        if out is None:
            out = self._word(word) if self.direct else self._whole(word.decode("utf-8", "replace"))
        if len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        get, sign = self.piece.get, word[-1:] if word[-1] in self.signs else b""
        body = word[:-1] if sign else word
        if self.letters and body.isalpha():  # of bytes: ASCII
            low = body.lower()
        else:
            text = word.decode("utf-8", "replace")
            if "<|" in text or not self.plain.fullmatch(text):
                return self._whole(text)
            if not (self.letters and (stem := text[:-1] if sign else text).isalpha()):
                return b"".join([get(p) or self._one(p) for p in map(str.encode, self.cut.findall(text.lower()))])
            low = stem.lower().encode()
        out = get(low) or self._one(low)
        return out + (get(sign) or self._one(sign)) if sign else out

    def _one(self, piece: bytes) -> bytes:
        out = self.older_piece.get(piece)
        if out is None:
            mapped = piece.decode("ascii") if piece.isascii() else piece.decode("latin-1").translate(self.shown)
            out = b"".join([self.packed[t.id] for t in self.model.tokenize(mapped)])
        if len(self.piece) >= REMEMBER:
            self.older_piece, self.piece = self.piece, {}
        self.piece[piece] = out
        return out


_words: dict[int, WordIds] = {}


def read_spec(path: str) -> str:
    """The tokenizer file, read by the driver and sent to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def ids_of(texts: pa.Array, get: Callable[[bytes], bytes]) -> tuple[np.ndarray, list[int]]:
    """The ids of all ``texts`` strung together, as bytes, and where each text's begin and end.

    ``get`` gives the ids of a word; it is asked once for every distinct word."""
    cut = pc.ascii_split_whitespace(texts)
    numbered = cut.flatten().dictionary_encode()
    words = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    known = pa.array([get(w) for w in words], pa.large_binary())
    data, at = K.buffer_of(known.take(numbered.indices))
    return data, at[cut.offsets.to_numpy()].tolist()


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID,
              with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's token ids, cut at ``capacity``.

    Null text counts as empty: a document of the end id alone.  Other columns are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    end = b"" if end_id is None else np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(spec.value.encode())
        words = _words.get(key)
        if words is None:
            _words.clear()
            words = _words[key] = WordIds(spec.value)
        get = words.__getitem__
        for batch in batches:
            texts = batch.column("_text").fill_null("")
            offs = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
            for i, j in K.slices(offs, PART):
                part = batch.slice(i, j - i)
                data, border = ids_of(texts.slice(i, j - i), get)
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for k in range(j - i):
                    got = data[border[k] : border[k + 1]].tobytes() + end
                    for n in range(0, max(len(got) // 4, 1), capacity):
                        one = got[4 * n : 4 * (n + capacity)]
                        rows.append(k)
                        piece.append(n // capacity)
                        start.append(n)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                        if with_ids:
                            ids.append(one)
                cols = [part.column("_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())] if with_ids else cols, names=[*names, "ids"] if with_ids else names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return rows.mapInArrow(run, out).withColumnRenamed("_id", id_col)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the pieces of each length go, and the number of bins.

    A row (length, rank, count, bin, per_bin, offset): piece ``rank + k`` of that length, for k
    below ``count``, goes to bin ``bin + k // per_bin`` at ``offset + (k % per_bin) * length``.
    """
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    if left and max(left) > capacity:
        raise ValueError(f"a piece of {max(left)} tokens exceeds {capacity}")
    used: dict[int, int] = defaultdict(int)  # ranks given so far, by length
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, bins)
    bins = 0

    def place(length: int, first: int, n: int, count: int, per_bin: int, offset: int) -> None:
        rows.append((length, used[length], count, first, per_bin, offset))
        used[length] += count
        left[length] -= count

    def open_bins(lengths: list[int], n: int) -> None:
        nonlocal bins
        offset = 0
        for length in lengths:
            place(length, bins, n, n, 1, offset)
            offset += length
        gaps[capacity - offset].append((bins, n))
        bins += n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for big in (n for n in large if 2 * n > capacity):
        for partner in (n for n in large if n + big <= capacity and 2 * n <= capacity):
            if (n := min(left[big], left[partner])) > 0:
                open_bins([big, partner], n)
        if left[big]:
            open_bins([big], left[big])
    odd = None
    for mid in (n for n in large if 2 * n <= capacity):
        if odd is not None and left[mid]:
            open_bins([odd, mid], 1)
            odd = None
        if left[mid] > 1:
            open_bins([mid, mid], left[mid] // 2)
        if left[mid]:
            odd = mid
    if odd is not None:
        open_bins([odd], 1)

    for small in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= small):
            if not left[small]:
                break
            stay: list[tuple[int, int]] = []
            ranges, gaps[gap] = gaps[gap], stay
            per_bin = gap // small
            for first, n in ranges:
                full = min(n, left[small] // per_bin)
                if full:
                    place(small, first, full, full * per_bin, per_bin, capacity - gap)
                    gaps[gap - per_bin * small].append((first, full))
                rest = left[small] if full < n else 0
                if rest:
                    place(small, first + full, 1, rest, per_bin, capacity - gap)
                    gaps[gap - rest * small].append((first + full, 1))
                    full += 1
                if full < n:
                    stay.append((first + full, n - full))
            if not gaps[gap]:
                del gaps[gap]
        if left[small]:
            per_bin, count = capacity // small, left[small]
            full, rest = divmod(count, per_bin)
            if full:
                place(small, bins, full, full * per_bin, per_bin, 0)
                gaps[capacity - per_bin * small].append((bins, full))
            if rest:
                place(small, bins + full, 1, rest, per_bin, 0)
                gaps[capacity - rest * small].append((bins + full, 1))
            bins += full + (rest > 0)
    return rows, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (id, piece, length and any other columns; a table that is cheap to read twice)
    with sequence_id and offset.  Pieces of no tokens get sequence -1.  Repeated rows are
    pieces of their own."""
    spark = pieces.sparkSession
    rows = pieces.withColumn("_b", F.pmod(F.xxhash64(F.col(id_col), "piece"), F.lit(max(16, parts(spark)))).cast("int"))
    tally = rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each length, at most ``capacity`` of them
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    found, _ = plan(counts, capacity)
    plan_rows = np.array(sorted(found), dtype=np.int64).reshape(-1, 6)
    lookup = spark.sparkContext.broadcast(plan_rows)
    before = tally.select("length", "_b", (F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy(id_col, "piece")))
    ranked = ranked.join(before, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1)
    names = pieces.columns
    ranked = ranked.select(*names, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = lookup.value
        key = (p[:, 0] << 46) + p[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            seq, off = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
            has = length > 0
            if has.any():
                _, first_rank, _, first_bin, per_bin, offset = p[np.searchsorted(key, (length[has] << 46) + rank[has], side="right") - 1].T
                k = rank[has] - first_rank
                seq[has], off[has] = first_bin + k // per_bin, offset + k % per_bin * length[has]
            keep = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields] + ["sequence_id bigint", "offset bigint"])
    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every packed sequence; needs pieces ``with_ids``."""
    row = F.struct("offset", "ids")
    ordered = F.sort_array(F.collect_list(row))  # at most ``capacity`` tokens a sequence
    return packed.where("sequence_id >= 0").groupBy("sequence_id").agg(ordered.alias("_p")).select(
        "sequence_id", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                     with_ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` with their places."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(written(pieces_of(docs, tokenizer_path, capacity, end_id, with_ids)), capacity)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
