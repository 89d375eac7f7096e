"""Vector (array<double>) column functions: normalization, gripper post-processing, padding.

All functions map ``Column -> Column`` and run inside the JVM (higher-order
functions ``transform``/``zip_with``), so they stay in the scan's stage.
Values are computed in double (the reference casts to float32 at the end).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
EPS = 1e-8  # denominator guard in normalization
GRIPPER_OPEN = 0.95  # binarize: above -> open (1)
GRIPPER_CLOSED = 0.05  # binarize: below -> closed (0)
REL_THRESHOLD = 0.1  # rel2abs: < -0.1 opening, > 0.1 closing

NORMALIZATION_TYPES = ("normal", "bounds", "bounds_q99")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _at(arr: Column, i: Column) -> Column:
    return F.get(arr, i)


def normalize(x, st, kind: str = "bounds_q99") -> Column:
    """M1-M4: normalize an action/proprio array with a stats struct.

    ``st`` is a struct column with array fields mean, std, min, max, q01, q99 and an
    optional boolean array ``mask`` (null = normalize every dim).
    * normal:      (x-mean)/(std+eps) where mask
    * bounds:      clip(2(x-min)/(max-min+eps)-1, -1, 1) where mask
    * bounds_q99:  same with q01/q99
    For the bounds kinds dims with min == max become 0 even where the mask is false.
    """
    x, st = _c(x), _c(st)
    if kind not in NORMALIZATION_TYPES:
        raise ValueError(f"Unknown normalization type {kind}")

    def mask_at(i):
        return F.coalesce(_at(st["mask"], i), F.lit(True))

    if kind == "normal":
        return F.transform(
            x,
            lambda v, i: F.when(mask_at(i), (v - _at(st["mean"], i)) / (_at(st["std"], i) + F.lit(EPS))).otherwise(v),
        )
    lo_f, hi_f = ("min", "max") if kind == "bounds" else ("q01", "q99")

    def one(v, i):
        lo, hi = _at(st[lo_f], i), _at(st[hi_f], i)
        scaled = F.lit(2.0) * (v - lo) / (hi - lo + F.lit(EPS)) - F.lit(1.0)
        clipped = F.greatest(F.least(scaled, F.lit(1.0)), F.lit(-1.0))
        masked = F.when(mask_at(i), clipped).otherwise(v)
        return F.when(_at(st["min"], i) == _at(st["max"], i), F.lit(0.0)).otherwise(masked)

    return F.transform(x, one)


def unnormalize(x, st, apply_mask: bool = False) -> Column:
    """M5: 0.5*(x+1)*(q99-q01)+q01.  The reference reads the mask but never applies it;
    ``apply_mask=True`` leaves masked-out dims unchanged instead."""
    x, st = _c(x), _c(st)

    def one(v, i):
        lo, hi = _at(st["q01"], i), _at(st["q99"], i)
        out = F.lit(0.5) * (v + F.lit(1.0)) * (hi - lo) + lo
        if apply_mask:
            out = F.when(F.coalesce(_at(st["mask"], i), F.lit(True)), out).otherwise(v)
        return out

    return F.transform(x, one)


def zeros(k: int) -> Column:
    """K zeros (double)."""
    return F.array_repeat(F.lit(0.0), k)


def ones(k: int) -> Column:
    return F.array_repeat(F.lit(1.0), k)


def clip01(x) -> Column:
    """M10 on a scalar."""
    return F.greatest(F.least(_c(x), F.lit(1.0)), F.lit(0.0))


def invert(x) -> Column:
    """M6: 1 - x on a scalar."""
    return F.lit(1.0) - _c(x)


def last_of(arr) -> Column:
    return F.element_at(_c(arr), -1)


def map_last(arr, fn) -> Column:
    """Apply ``fn`` to the last element of an array, keep the rest."""
    arr = _c(arr)
    n = F.size(arr)
    return F.transform(arr, lambda v, i: F.when(i == n - 1, fn(v)).otherwise(v))


def gripper_pm1(arr, binarize: bool = True) -> Column:
    """M7: last dim [0,1] -> [-1,1] via 2x-1, optionally binarized with sign."""

    def f(v):
        y = F.lit(2.0) * v - F.lit(1.0)
        return F.signum(y) if binarize else y

    return map_last(arr, f)


def flip_last(arr) -> Column:
    """M8: last dim * -1."""
    return map_last(arr, lambda v: -v)


def snap_nonneg(arr) -> Column:
    """M9: last dim >= 0 -> 1, else unchanged."""
    return map_last(arr, lambda v: F.when(v >= 0, F.lit(1.0)).otherwise(v))


def pad_state(s) -> Column:
    """First 6 state values, a 0, then the last value (8-D)."""
    s = _c(s)
    return F.concat(F.slice(s, 1, 6), F.array(F.lit(0.0)), F.slice(s, -1, 1))


def concat_proprio(*parts) -> Column:
    """Concatenate state arrays as double; ``None`` stands for one 0.0 of padding."""
    cols = [F.array(F.lit(0.0)) if p is None else F.transform(_c(p), lambda v: v.cast("double")) for p in parts]
    return F.concat(*cols)


def abs_max(arr) -> Column:
    """max |x| over an array (for max_action / max_proprio filters)."""
    return F.array_max(F.transform(_c(arr), lambda v: F.abs(v)))


def moves(chunk, q01, q99, eps: float = 1e-5, dims: int = 6) -> Column:
    """a chunk (array of action arrays) moves iff any of the first ``dims`` dims of any
    slot differs by more than ``eps`` from the normalized zero 2(0-q01)/(q99-q01+1e-8)-1."""
    chunk, q01, q99 = _c(chunk), _c(q01), _c(q99)
    zero = F.transform(F.slice(q01, 1, dims), lambda lo, i: F.lit(2.0) * (F.lit(0.0) - lo) / (_at(q99, i) - lo + F.lit(EPS)) - F.lit(1.0))
    return F.exists(
        chunk,
        lambda a: F.exists(F.zip_with(F.slice(a, 1, dims), zero, lambda v, z: F.abs(v - z)), lambda d: d > F.lit(eps)),
    )
