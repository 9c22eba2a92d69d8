"""Rotations as plain column expressions: quaternions (w, x, y, z), rotation vectors and 3x3 matrices.

A quaternion is a tuple of four DOUBLE columns and a vector a tuple of three, so whole-stage code generation sees
scalar arithmetic only; arrays appear at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Quaternion = tuple[Column, Column, Column, Column]
Vector = tuple[Column, Column, Column]

#: below this angle a rotation vector is turned into a quaternion by its series
SMALL = 1e-12


def vector(array: Column, at: int = 0) -> Vector:
    """Three elements of an array column as DOUBLE."""
    return tuple(array[at + k].cast("double") for k in range(3))


def norm(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def from_rotvec(v: Vector) -> Quaternion:
    """Unit quaternion of a rotation vector."""
    angle = norm(v)
    scale = F.when(angle < SMALL, F.lit(0.5)).otherwise(F.sin(angle / 2) / F.when(angle < SMALL, F.lit(1.0)).otherwise(angle))
    return F.cos(angle / 2), v[0] * scale, v[1] * scale, v[2] * scale


def canonical(q: Quaternion) -> Quaternion:
    """The same rotation with w >= 0."""
    sign = F.when(q[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return tuple(c * sign for c in q)


def to_rotvec(q: Quaternion, own: bool = False) -> Vector:
    """Rotation vector with an angle of at most pi; ``own`` says that w >= 0 already."""
    w, x, y, z = q if own else canonical(q)
    n = norm((x, y, z))
    scale = F.when(n < SMALL, F.lit(2.0)).otherwise(2 * F.atan2(n, w) / F.when(n < SMALL, F.lit(1.0)).otherwise(n))
    return x * scale, y * scale, z * scale


def multiply(a: Quaternion, b: Quaternion) -> Quaternion:
    """First b, then a."""
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def conjugate(q: Quaternion) -> Quaternion:
    return q[0], -q[1], -q[2], -q[3]


def delta(action: Quaternion, state: Quaternion) -> Vector:
    """Rotation vector that leads from the state to the action: action * state^-1."""
    return to_rotvec(multiply(action, conjugate(state)))


def staged(df: DataFrame, name: str, parts: list[Column] | tuple[Column, ...]) -> tuple[DataFrame, Quaternion]:
    """Adds the parts as scalar columns ``name0``, ``name1``, ... and returns the frame with references to them. Scalars
    that the next step uses several times stay a projection of their own; an array built here would be merged into each
    of its uses, and the expression would grow by a factor at every step."""
    names = [f"{name}{k}" for k in range(len(parts))]
    return df.withColumns(dict(zip(names, parts, strict=True))), tuple(F.col(n) for n in names)


def with_delta(df: DataFrame, action: Vector, state: Vector, out: str = "delta") -> DataFrame:
    """Adds the delta rotation as an array column, step by step over scalar columns."""
    kept = df.columns
    df, qa = staged(df, "_qa", from_rotvec(action))
    df, qs = staged(df, "_qs", from_rotvec(state))
    df, q = staged(df, "_q", multiply(qa, conjugate(qs)))
    df, q = staged(df, "_c", canonical(q))
    return df.select(*kept, F.array(*to_rotvec(q, own=True)).alias(out))


def with_quaternion(df: DataFrame, matrix: list[list[Column]], out: str = "quaternion") -> DataFrame:
    """Adds the quaternion (w >= 0) of a matrix as an array column, step by step over scalar columns."""
    kept = df.columns
    df, m = staged(df, "_m", [c for row in matrix for c in row])
    df, q = staged(df, "_f", from_matrix([list(m[3 * i : 3 * i + 3]) for i in range(3)], signed=False))
    return df.select(*kept, F.array(*canonical(q)).alias(out))


def to_matrix(q: Quaternion) -> list[list[Column]]:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def from_matrix(m: list[list[Column]], signed: bool = True) -> Quaternion:
    """Quaternion, of the four forms the one with the largest divisor; with w >= 0 where ``signed``."""
    t = m[0][0] + m[1][1] + m[2][2]
    zero = F.lit(0.0)

    def form(s: Column, parts: list[Column]) -> list[Column]:
        root = F.sqrt(F.greatest(s, zero)) * 2
        return [p / F.when(root < SMALL, F.lit(1.0)).otherwise(root) for p in parts]

    def four(s: Column, own: int, off: list[Column]) -> list[Column]:
        divided = form(s, off)
        quarter = F.sqrt(F.greatest(s, zero)) / 2
        return divided[:own] + [quarter] + divided[own:]

    a = four(1 + t, 0, [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]])
    b = four(1 + m[0][0] - m[1][1] - m[2][2], 1, [m[2][1] - m[1][2], m[0][1] + m[1][0], m[0][2] + m[2][0]])
    c = four(1 - m[0][0] + m[1][1] - m[2][2], 2, [m[0][2] - m[2][0], m[0][1] + m[1][0], m[1][2] + m[2][1]])
    d = four(1 - m[0][0] - m[1][1] + m[2][2], 3, [m[1][0] - m[0][1], m[0][2] + m[2][0], m[1][2] + m[2][1]])
    big_a, big_b, big_c = t > 0, (m[0][0] >= m[1][1]) & (m[0][0] >= m[2][2]), m[1][1] >= m[2][2]
    q = tuple(F.when(big_a, a[k]).when(big_b, b[k]).when(big_c, c[k]).otherwise(d[k]) for k in range(4))
    return canonical(q) if signed else q


def any_encoding(array: Column) -> list[list[Column]]:
    """3x3 matrix of a flat rotation: 3 numbers are a rotation vector, 9 a matrix by rows; NULL otherwise."""
    size = F.size(array)
    turned = to_matrix(from_rotvec(tuple(F.get(array, F.lit(k)).cast("double") for k in range(3))))
    return [[F.when(size == 3, turned[i][j]).when(size == 9, F.get(array, F.lit(3 * i + j)).cast("double")) for j in range(3)] for i in range(3)]


def product(a: list[list[float]], m: list[list[Column]]) -> list[list[Column]]:
    """Constant matrix times column matrix; zeros of the constant cost nothing."""
    return [[_sum([(a[i][k], m[k][j]) for k in range(3)]) for j in range(3)] for i in range(3)]


def transposed(m: list[list]) -> list[list]:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def change_basis(base: list[list[float]], m: list[list[Column]], tool: list[list[float]]) -> list[list[Column]]:
    """base * m * tool for constant base and tool."""
    return transposed(product(transposed(tool), transposed(product(base, m))))


def apply_constant(base: list[list[float]], v: Vector) -> Vector:
    """v * base^T."""
    return tuple(_sum([(base[i][k], v[k]) for k in range(3)]) for i in range(3))


def relative_pose(base_rotation: list[list[Column]], base_position: Vector, rotation: list[list[Column]], position: Vector):
    """Pose in the base's frame: rigid inverse (R^T, -R^T t) of the base times the pose."""
    back = transposed(base_rotation)
    gap = tuple(position[k] - base_position[k] for k in range(3))
    turned = [[back[i][0] * rotation[0][j] + back[i][1] * rotation[1][j] + back[i][2] * rotation[2][j] for j in range(3)] for i in range(3)]
    return turned, tuple(back[i][0] * gap[0] + back[i][1] * gap[1] + back[i][2] * gap[2] for i in range(3))


def _sum(terms: list[tuple[float, Column]]) -> Column:
    out = None
    for factor, column in terms:
        if factor:
            part = column if factor == 1 else -column if factor == -1 else column * float(factor)
            out = part if out is None else out + part
    return out if out is not None else F.lit(0.0)


def accumulate(steps: Column, start: Column) -> Column:
    """Ordered product of rotations: ``steps`` is an array of quaternion arrays in order, each applied after what came
    before (new * old); ``start`` a quaternion array. The order matters, so the array must be sorted by frame."""

    def times(old: Column, new: Column) -> Column:
        return F.array(*multiply(tuple(new[k] for k in range(4)), tuple(old[k] for k in range(4))))

    return F.aggregate(steps, start, times)
