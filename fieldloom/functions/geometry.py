"""Column builders for distances, boxes, volumes and rigid transforms.

Points are three columns; transforms are the twelve entries of an affine matrix, row by row, so that products stay
plain arithmetic inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]
Affine = list[Column]


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def point(values: Column, first: int = 0) -> list[Column]:
    return [F.get(values, F.lit(first + k)).cast("double") for k in range(3)]


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(sum(((_c(x) - _c(y)) * (_c(x) - _c(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def segment_distance(p: Point, a: Point, b: Point, least: float = 1e-12) -> Column:
    """From p to the stretch from a to b; a stretch of no length is a point."""
    along = [_c(y) - _c(x) for x, y in zip(a, b, strict=True)]
    size = sum((d * d for d in along), F.lit(0.0))
    dot = sum(((_c(q) - _c(x)) * d for q, x, d in zip(p, a, along, strict=True)), F.lit(0.0))
    t = F.when(size <= least, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / size)))
    return distance(p, [_c(x) + t * d for x, d in zip(a, along, strict=True)])


def box_centre(low: Point, high: Point) -> list[Column]:
    return [(x + y) / 2 for x, y in zip(low, high, strict=True)]


def box_volume(low: Point, high: Point) -> Column:
    sides = [F.greatest(F.lit(0.0), y - x) for x, y in zip(low, high, strict=True)]
    return sides[0] * sides[1] * sides[2]


def primitive_volume(kind: Column, size: Point, radius: Column, length: Column) -> Column:
    """Of boxes, cylinders and spheres, negative lengths as 0; null for other kinds and missing lengths."""
    at_least = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x.cast("double")))
    r = at_least(radius)
    x, y, z = map(at_least, size)
    return F.when(kind == "box", x * y * z).when(kind == "cylinder", F.lit(pi) * r * r * at_least(length)).when(kind == "sphere", F.lit(4.0 / 3.0 * pi) * r * r * r)


def pose_affine(pose: Point) -> Affine:
    """Of x, y, z, roll, pitch, yaw: rotation about x, then y, then z, and translation."""
    x, y, z, roll, pitch, yaw = map(_c, pose)
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, x, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, y, -sp, cp * sr, cp * cr, z]


def quaternion_affine(q: Point, at: Point) -> Affine:
    """Of x, y, z, w, which is normalised (null at length zero), and a translation."""
    n = F.sqrt(sum((_c(v) * _c(v) for v in q), F.lit(0.0)))
    x, y, z, w = (_c(v) / F.nullif(n, F.lit(0.0)) for v in q)
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), _c(at[0]),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), _c(at[1]),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y), _c(at[2]),
    ]


def scale_affine(scale: Point) -> Affine:
    zero = F.lit(0.0)
    return [_c(scale[r]) if r == c else zero for r in range(3) for c in range(4)]


def compose(a: Affine, b: Affine) -> Affine:
    """b first, then a."""
    return [sum((a[4 * r + k] * b[4 * k + c] for k in range(3)), a[4 * r + 3] if c == 3 else F.lit(0.0)) for r in range(3) for c in range(4)]


def apply(m: Affine, p: Point) -> list[Column]:
    return [m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(3)]


def affine_pose(m: Affine, least: float = 1e-9) -> list[Column]:
    """x, y, z, roll, pitch, yaw. Where the pitch is a right angle, all turning about one axis counts as roll."""
    flat = F.sqrt(m[0] * m[0] + m[4] * m[4])
    lock = flat < least
    roll = F.when(lock, F.atan2(-m[6], m[5])).otherwise(F.atan2(m[9], m[10]))
    yaw = F.when(lock, F.lit(0.0)).otherwise(F.atan2(m[4], m[0]))
    return [m[3], m[7], m[11], roll, F.atan2(-m[8], flat), yaw]


def nested(m: Affine) -> Column:
    """As array of four rows."""
    rows = [F.array(*m[4 * r : 4 * r + 4]) for r in range(3)]
    return F.array(*rows, F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))


def translation(matrix: Column) -> Column:
    """array(x, y, z) of an array of four rows; null where it has another shape."""
    good = (F.size(matrix) == 4) & F.forall(matrix, lambda r: F.size(r) == 4)
    return F.when(good, F.transform(F.slice(matrix, 1, 3), lambda r: F.get(r, F.lit(3))))


def sigmoid(x: Column, most: float = 60.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), x))))


def decibels(gain: Column) -> Column:
    return 10 * F.log10(gain + F.lit(1e-30))


def half_up(numerator: Column, denominator: Column) -> Column:
    """Integer quotient of numbers that aren't negative, rounded half up, without leaving integers."""
    return F.call_function("div", 2 * numerator + denominator, 2 * denominator)
