"""Rotation helpers (M11-M15) as closed-form column expressions on ``array<double>``.

Conventions (public formulas): Euler angles (x, y, z) compose as R = Rz(z) Ry(y) Rx(x);
matrices are row-major arrays of 9; quaternions are (x, y, z, w).  Each formula is
written once against a tiny ``ops`` interface, so the same closed form yields a Spark
Column (``SPARK``) and the DuckDB text used by the oracle (``SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIMBAL_EPS = 1e-9


class _SparkOps:
    def get(self, a, i):
        return F.get(a, i)

    def lit(self, x):
        return F.lit(float(x))

    sin = staticmethod(F.sin)
    cos = staticmethod(F.cos)
    asin = staticmethod(F.asin)
    sqrt = staticmethod(F.sqrt)
    abs = staticmethod(F.abs)

    def atan2(self, y, x):
        return F.atan2(y, x)

    def clip1(self, x):
        return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))

    def when(self, cond, a, b):
        return F.when(cond, a).otherwise(b)

    def array(self, xs):
        return F.array(*xs)


class Q:
    """SQL text with arithmetic operators."""

    def __init__(self, s):
        self.s = str(s)

    def __str__(self):
        return self.s

    def _b(self, op, o, rev=False):
        a, b = (o, self) if rev else (self, o)
        return Q(f"({a} {op} {b})")

    def __add__(self, o):
        return self._b("+", o)

    def __radd__(self, o):
        return self._b("+", o, True)

    def __sub__(self, o):
        return self._b("-", o)

    def __rsub__(self, o):
        return self._b("-", o, True)

    def __mul__(self, o):
        return self._b("*", o)

    def __rmul__(self, o):
        return self._b("*", o, True)

    def __truediv__(self, o):
        return self._b("/", o)

    def __neg__(self):
        return Q(f"(-{self})")

    def __gt__(self, o):
        return self._b(">", o)

    def __lt__(self, o):
        return self._b("<", o)


class _SqlOps:
    def get(self, a, i):
        return Q(f"{a}[{i + 1}]")

    def lit(self, x):
        return Q(f"{float(x)!r}::DOUBLE")

    def sin(self, x):
        return Q(f"sin({x})")

    def cos(self, x):
        return Q(f"cos({x})")

    def asin(self, x):
        return Q(f"asin({x})")

    def sqrt(self, x):
        return Q(f"sqrt({x})")

    def abs(self, x):
        return Q(f"abs({x})")

    def atan2(self, y, x):
        return Q(f"atan2({y}, {x})")

    def clip1(self, x):
        return Q(f"greatest(least({x}, 1.0), -1.0)")

    def when(self, cond, a, b):
        return Q(f"(CASE WHEN {cond} THEN {a} ELSE {b} END)")

    def array(self, xs):
        return Q("[" + ", ".join(str(x) for x in xs) + "]")


SPARK = _SparkOps()
SQL = _SqlOps()


def _elems(o, a, n, start=0):
    return [o.get(a, start + i) for i in range(n)]


def euler_to_rmat_e(o, e):
    x, y, z = e
    sx, sy, sz, cx, cy, cz = o.sin(x), o.sin(y), o.sin(z), o.cos(x), o.cos(y), o.cos(z)
    return [
        cy * cz, sx * sy * cz - cx * sz, cx * sy * cz + sx * sz,
        cy * sz, sx * sy * sz + cx * cz, cx * sy * sz - sx * cz,
        -sy, sx * cy, cx * cy,
    ]


def rmat_to_euler_e(o, m):
    r00, r01, r02, r10, _r11, _r12, r20, r21, r22 = m
    gimbal = o.abs(r20) > o.lit(1.0 - GIMBAL_EPS)
    sign = o.when(r20 > o.lit(0.0), o.lit(1.0), o.lit(-1.0))
    y = o.when(gimbal, -sign * o.lit(1.5707963267948966), -o.asin(o.clip1(r20)))
    x = o.when(gimbal, o.atan2(-sign * r01, -sign * r02), o.atan2(r21, r22))
    z = o.when(gimbal, o.lit(0.0), o.atan2(r10, r00))
    return [x, y, z]


def transpose_e(m):
    return [m[0], m[3], m[6], m[1], m[4], m[7], m[2], m[5], m[8]]


def matmul_e(a, b):
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def matvec_e(a, v):
    return [a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3)]


def quat_to_rmat_e(o, q):
    x, y, z, w = q
    two = o.lit(2.0)
    one = o.lit(1.0)
    return [
        one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w),
        two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w),
        two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y),
    ]


def to_wrist_frame_e(o, vel, pose):
    """R^-1 v and R^-1 dR R (as R6) for a 6-D velocity in a 6-D pose's frame."""
    R = euler_to_rmat_e(o, pose[3:6])
    Rinv = transpose_e(R)
    vt = matvec_e(Rinv, vel[0:3])
    dR = matmul_e(Rinv, matmul_e(euler_to_rmat_e(o, vel[3:6]), R))
    return vt + dR[0:6]


DEFAULT_ROTATION = [0.0, 0.0, 1.0, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0]  # fixed value of the pose formula


def pose_matrix_e(o, xyz, zangle):
    """4x4 pose from xyz and a z-axis angle: rotation Rz(angle) @ DEFAULT_ROTATION."""
    c, s = o.cos(zangle), o.sin(zangle)
    zero, one = o.lit(0.0), o.lit(1.0)
    rz = [c, -s, zero, s, c, zero, zero, zero, one]
    rot = matmul_e(rz, [o.lit(v) for v in DEFAULT_ROTATION])
    return rot[0:3] + [xyz[0]] + rot[3:6] + [xyz[1]] + rot[6:9] + [xyz[2]] + [zero, zero, zero, one]


# ---- Column API -------------------------------------------------------------
def _col(c):
    return F.col(c) if isinstance(c, str) else c


def euler_to_rmat(e) -> Column:
    return F.array(*euler_to_rmat_e(SPARK, _elems(SPARK, _col(e), 3)))


def rmat_to_euler(m) -> Column:
    return F.array(*rmat_to_euler_e(SPARK, _elems(SPARK, _col(m), 9)))


def invert_rmat(m) -> Column:
    return F.array(*transpose_e(_elems(SPARK, _col(m), 9)))


def rotmat_to_rot6d(m) -> Column:
    """First two rows, row-major."""
    return F.slice(_col(m), 1, 6)


def quat_to_euler(q) -> Column:
    """Quaternion (x, y, z, w) -> Euler (x, y, z)."""
    return F.array(*rmat_to_euler_e(SPARK, quat_to_rmat_e(SPARK, _elems(SPARK, _col(q), 4))))


def to_wrist_frame(vel, pose) -> Column:
    return F.array(*to_wrist_frame_e(SPARK, _elems(SPARK, _col(vel), 6), _elems(SPARK, _col(pose), 6)))


def pose_matrix(xyz, zangle) -> Column:
    return F.array(*pose_matrix_e(SPARK, _elems(SPARK, _col(xyz), 3), _col(zangle)))


# ---- SQL text (oracle) --------------------------------------------------------
def sql_list(exprs) -> str:
    return "[" + ", ".join(str(e) for e in exprs) + "]"


def sql_elems(name: str, n: int, start: int = 0):
    return _elems(SQL, Q(name), n, start)
