"""String / array column functions (X1-X8, F8, F9, D4).  All JVM-side expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
TURN_SEP = "[UNK]"
ASSISTANT_SEP = "[ASSISTANT]"
ACT_MARKER = "[ACT]"
ACTION_TOKEN_MIN = 151665
ACTION_TOKEN_MAX = 153712
ASSISTANT_START = (151644, 77091, 198)
IGNORE_INDEX = -100


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode_lower(c) -> Column:
    """Bytes -> UTF-8 text, lower case (strings pass through)."""
    return F.lower(_c(c).cast("string"))


def split_turns(c) -> Column:
    """Split on the literal turn separator."""
    return F.split(_c(c), r"\[UNK\]", -1)


def assistant_text(turn) -> Column:
    """Text after the assistant marker (element 1); a missing marker is an error."""
    parts = F.split(_c(turn), r"\[ASSISTANT\]", -1)
    return F.when(F.size(parts) > 1, parts[1]).otherwise(
        F.raise_error(F.concat(F.lit("turn without assistant marker: "), _c(turn)))
    )


def strip_path(p, root: str = "") -> Column:
    """Strip leading '.' and '/' characters, then join to ``root`` (empty root = none)."""
    stripped = F.regexp_replace(_c(p), r"^[./]+", "")
    if not root:
        return stripped
    return F.concat(F.lit(root.rstrip("/") + "/"), stripped)


def codepoints_to_text(cp) -> Column:
    """Integer code points -> text, keeping what precedes the first NUL."""
    hexed = F.array_join(F.transform(_c(cp), lambda x: F.lpad(F.hex(x), 8, "0")), "")
    txt = F.decode(F.unhex(hexed), "UTF-32")
    return F.split(txt, "\u0000", 2)[0]


def action_tokens(ids) -> Column:
    """Ids -> concatenated ``<robot_action_i>`` tokens."""
    return F.array_join(F.transform(_c(ids), lambda x: F.concat(F.lit("<robot_action_"), x.cast("string"), F.lit(">"))), "")


def parse_pair(c) -> Column:
    """X7: "224,224" or "224 224" -> array of two ints; anything else is an error."""
    parts = F.split(F.trim(F.regexp_replace(_c(c), ",", " ")), r"\s+")
    ints = F.transform(parts, lambda x: x.try_cast("int") if hasattr(x, "try_cast") else F.expr("try_cast(x AS INT)"))
    ok = (F.size(parts) == 2) & F.forall(ints, lambda x: x.isNotNull())
    return F.when(ok, ints).otherwise(F.raise_error(F.concat(F.lit("Invalid size pair: "), _c(c))))


def gather(arr, idx) -> Column:
    """Index an array by an array of 0-based indices."""
    a = _c(arr)
    return F.transform(_c(idx), lambda i: F.get(a, i))


def has_act(text) -> Column:
    """F8: text contains the action-mode marker."""
    return _c(text).contains(ACT_MARKER)


def token_range(ids, lo: int = ACTION_TOKEN_MIN, hi: int = ACTION_TOKEN_MAX) -> Column:
    """keep ids in [lo, hi] and subtract ``lo``."""
    return F.transform(F.filter(_c(ids), lambda x: (x >= lo) & (x <= hi)), lambda x: x - F.lit(lo))


def label_mask(ids, pad_id, marker: Sequence[int] = ASSISTANT_START, ignore: int = IGNORE_INDEX) -> Column:
    """Find the last marker scanning start positions len-6 .. 0; keep labels after it,
    ``ignore`` before it (everything when absent); pad ids become ``ignore``.

    The ids and the start index are bound once per row (a one-element array mapped by a
    lambda), so the per-token lambda does O(1) work instead of rescanning the sequence."""
    pad = _c(pad_id) if not isinstance(pad_id, int) else F.lit(pad_id)
    m = F.array(*[F.lit(v).cast("bigint") for v in marker])
    k = len(marker)

    def per_row(s):
        seq = s["ids"]
        n = F.size(seq)
        starts = F.when(n >= 2 * k, F.sequence(F.lit(0), n - 2 * k)).otherwise(F.array().cast("array<int>"))
        last = F.array_max(F.filter(starts, lambda j: F.slice(seq, j + 1, k) == m))
        begin = F.coalesce(last + k, n)
        return F.struct(seq.alias("ids"), begin.alias("begin"))

    def labels(s):
        return F.transform(
            s["ids"],
            lambda x, i: F.when((i >= s["begin"]) & (x != s["pad"]), x.cast("bigint")).otherwise(F.lit(ignore).cast("bigint")),
        )

    bound = F.transform(F.array(F.struct(_c(ids).alias("ids"))), per_row)
    bound = F.transform(bound, lambda s: F.struct(s["ids"].alias("ids"), s["begin"].alias("begin"), pad.cast("bigint").alias("pad")))
    return F.element_at(F.transform(bound, labels), 1)
