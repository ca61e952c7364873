"""Column functions over boxes, grids, planes, rotations and moves of a search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy(element: Column) -> Column:
    return F.upper(F.trim(element)) != "H"


def inside(point: list[Column], centre: list[Column], size: list[Column]) -> Column:
    """Whether a point lies in a box, its faces included."""
    out = F.lit(True)
    for p, c, s in zip(point, centre, size, strict=True):
        out = out & (F.abs(p - c) <= s / 2)
    return out


def box_complaint(centre: list[Column], size: list[Column], low: list[Column], high: list[Column]) -> Column:
    """Empty if a box meets a structure's bounds, else the first axis on which it does not."""
    out = F.lit("")
    for axis, c, s, a, b in list(zip("xyz", centre, size, low, high, strict=True))[::-1]:
        out = F.when((c + s / 2 < a) | (c - s / 2 > b), axis).otherwise(out)
    return out


def sphere_volume(radius: Column) -> Column:
    return 4.0 / 3.0 * math.pi * radius * radius * radius


def amplitude(eigenvalue: Column, temperature: float = 1.0) -> Column:
    return F.when(eigenvalue > 0, F.sqrt(temperature / eigenvalue))


def rotated(point: list[Column], origin: list[Column], axis: list[Column], degrees: Column) -> list[Column]:
    """A point turned about an axis through the origin given (Rodrigues); unchanged where the axis has no length."""
    a = F.radians(degrees)
    n = F.sqrt(sum((x * x for x in axis), F.lit(0.0)))
    u = [x / F.nullif(n, F.lit(0.0)) for x in axis]
    v = [p - o for p, o in zip(point, origin, strict=True)]
    dot = sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0))
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    turned = [x * F.cos(a) + c * F.sin(a) + w * dot * (1 - F.cos(a)) for x, c, w in zip(v, cross, u, strict=True)]
    return [F.coalesce(o + t, p) for o, t, p in zip(origin, turned, point, strict=True)]


def planarity(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, planarity)``: root mean square distance of a group's points to their best plane, the square root of the least
    eigenvalue of their covariance."""
    names = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    g = df.groupBy(*keys).agg(*[F.covar_pop(a, b).alias(a + b) for a, b in names])
    xx, yy, zz, xy, xz, yz = (F.col(a + b) for a, b in names)
    q = (xx + yy + zz) / 3
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))
    least = F.when(p > 0, q + 2 * p * F.cos(F.acos(r) / 3 + 2 * math.pi / 3)).otherwise(q)
    return g.select(*keys, F.sqrt(F.greatest(F.lit(0.0), least)).alias("planarity"))


def metropolis(before: Column, after: Column, draw: Column, temperature: float = 1.2) -> Column:
    """Whether a move is taken: always downhill, uphill by chance."""
    return (after < before) | (draw < F.exp((before - after) / temperature))


def interpolated(points: DataFrame, grid: DataFrame, keys: list[str], spacing: float = 1.0) -> DataFrame:
    """``(keys, point, value)``: trilinear interpolation of ``grid (keys, ix, iy, iz, value)``; null where one of the eight corners is not
    there, which is outside of the grid."""
    p = points
    for c in "xyz":
        p = p.withColumn(f"b{c}", F.floor(F.col(c) / spacing).cast("int")).withColumn(f"f{c}", F.col(c) / spacing - F.floor(F.col(c) / spacing))
    corner = F.explode(F.array(*[F.struct(*[F.lit(b).alias(n) for b, n in zip(bits, "xyz", strict=True)]) for bits in ((i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1))]))
    p = p.withColumn("c", corner)
    weight = F.lit(1.0)
    for c in "xyz":
        p = p.withColumn(f"i{c}", F.col(f"b{c}") + F.col(f"c.{c}"))
        weight = weight * F.when(F.col(f"c.{c}") == 1, F.col(f"f{c}")).otherwise(1 - F.col(f"f{c}"))
    got = p.withColumn("w", weight).join(grid, [*keys, "ix", "iy", "iz"], "left")
    g = got.groupBy(*keys, "point").agg(F.sum(F.col("w") * F.col("value")).alias("v"), F.count("value").alias("n"))
    return g.select(*keys, "point", F.when(F.col("n") == 8, F.col("v")).alias("value"))
