"""Spatial joins by cells: a radius join is an equi-join on cells of the radius' size and a check of the distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.stages import drop_path, shuffled, written

PROBE, POINTS = 1.4, 92
#: Areas: edge of the cells that give two atoms each, atoms and covers of a block, rows of a call, neighbours tried first.
FINE, CHUNK, BLOCK, PACK, NEAREST = 0.75, 500, 50_000, 20_000, 24


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("int")


def squared(a: str = "a_", b: str = "b_") -> Column:
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"), F.lit(0.0))


def range_join(left: DataFrame, right: DataFrame, radius: float, keys: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Pairs within the radius; columns of the sides begin with ``a_`` and ``b_``, ``d2`` is the squared distance.

    Each left point looks into the 27 cells around it; dense cells spread by AQE's handling of skewed joins. Neither side goes
    through the driver.
    """
    keys = keys or []
    x = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in left.columns if c not in keys])
    y = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in keys])
    for c in "xyz":
        x = x.withColumn(f"c{c}", F.explode(F.array(*[_cell(f"a_{c}", radius) + k for k in (-1, 0, 1)])))
        y = y.withColumn(f"c{c}", _cell(f"b_{c}", radius))
    d2 = squared()
    near = d2 <= radius * radius if inclusive else d2 < radius * radius
    return x.join(shuffled(y), [*keys, "cx", "cy", "cz"]).where(near).withColumn("d2", d2).drop("cx", "cy", "cz")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, keys: list[str] | None = None) -> DataFrame:
    """Each left point's nearest right point within the radius, or null: ``(keys, id, nearest, distance)``."""
    keys = keys or []
    pairs = range_join(left, right, radius, keys)
    best = pairs.groupBy(*keys, f"a_{left_id}").agg(F.min(F.struct("d2", f"b_{right_id}")).alias("m"))
    best = best.select(*keys, F.col(f"a_{left_id}").alias(left_id), F.col(f"m.b_{right_id}").alias("nearest"), F.sqrt("m.d2").alias("distance"))
    return left.select(*keys, left_id).join(best, [*keys, left_id], "left")


def bounding_box(df: DataFrame, keys: list[str], buffer: float = 5.0) -> DataFrame:
    """Centre and size of each group's box with a buffer on all sides."""
    aggs = []
    for c in "xyz":
        aggs += [((F.max(c) + F.min(c)) / 2).alias(f"c{c}"), (F.max(c) - F.min(c) + 2 * buffer).alias(f"s{c}")]
    return df.groupBy(*keys).agg(*aggs)


def gyration_radius(df: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean square distance to the centroid."""
    var = sum((F.var_pop(c) for c in "xyz"), F.lit(0.0))
    return df.groupBy(*keys).agg(F.sqrt(var).alias("gyration"))


def sphere_points(spark, count: int = POINTS) -> DataFrame:
    """Points of a golden spiral on the unit sphere."""
    golden = math.pi * (3 - math.sqrt(5))
    k = F.col("id")
    z = 1 - 2 * (k + 0.5) / count
    r = F.sqrt(1 - z * z)
    return spark.range(count).select(k.cast("int").alias("point"), (r * F.cos(golden * k)).alias("px"), (r * F.sin(golden * k)).alias("py"), z.alias("pz"))


def sasa(atoms: DataFrame, keys: list[str], probe: float = PROBE, points: int = POINTS, most: float = 2.0, others: DataFrame | None = None) -> DataFrame:
    """Solvent-accessible area of each atom ``(keys, atom, x, y, z, radius)``: the share of its sphere's points that no
    other atom of the group covers, nor any of ``others`` (a partner's atoms). ``most`` is the greatest radius.

    The points are tried against a few atoms of each small cell first, which bounds what an atom meets however many lie
    there; what these leave is tried against all atoms. No pairs of atoms are written or shuffled.
    """
    atoms = atoms.select(*keys, "atom", "x", "y", "z", "radius")
    covers = atoms.withColumn("own", F.lit(True))
    if others is not None:
        covers = covers.unionByName(others.select(*keys, "atom", "x", "y", "z", "radius").withColumn("own", F.lit(False)))
    every = F.array(*[F.lit(k) for k in range(points)])
    left, path = written(_uncovered(atoms.withColumn("free", every), _few_per_cell(covers, keys), keys, probe, points, most), "uncovered")
    empty = F.size("free") == 0
    last = _uncovered(left.where(~empty), covers, keys, probe, points, most)
    radius = F.col("radius") + probe
    share = F.size("free") / float(points)
    # a file of its own: the first trial's goes
    out, _ = written(left.where(empty).unionByName(last).select(*keys, "atom", (share * 4 * math.pi * radius * radius).alias("sasa")), "areas")
    drop_path(atoms.sparkSession, path)
    return out


def _few_per_cell(covers: DataFrame, keys: list[str], size: float = FINE) -> DataFrame:
    """At most two atoms of each small cell: that with the greatest radius and that with the least."""
    row = F.struct("radius", "own", "atom", "x", "y", "z")
    cells = covers.groupBy(*keys, *[_cell(c, size).alias(f"c{c}") for c in "xyz"]).agg(F.array_distinct(F.array(F.max(row), F.min(row))).alias("few"))
    return cells.select(*keys, F.explode("few").alias("r")).select(*keys, "r.*")


def _uncovered(rows: DataFrame, covers: DataFrame, keys: list[str], probe: float, points: int, most: float) -> DataFrame:
    """Atoms ``(keys, atom, x, y, z, radius, free)`` with those of their points ``free`` that none of ``covers`` covers.

    Atoms meet the covers of their cell and those around it in blocks of bounded numbers of both; several small ones
    go through one call.
    """
    size = 2 * (most + probe)
    at = [f"c{c}" for c in "xyz"]
    rows = rows.withColumns({f"c{c}": _cell(c, size) for c in "xyz"})
    near = covers.withColumns({f"c{c}": _cell(c, size) for c in "xyz"})
    counts = near.groupBy(*keys, *at).agg(F.count("*").alias("m"))
    for c in at:
        near = near.withColumn(c, F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)])))
        counts = counts.withColumn(c, F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)])))
    counts = counts.groupBy(*keys, *at).agg(F.sum("m").alias("m"))
    cells = rows.groupBy(*keys, *at).agg(F.count("*").alias("n")).join(counts, [*keys, *at], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    # long, as the parts that hashes choose: both sides deal by a hash of these, and that of an int is another
    sized = {"chunks": F.ceil(F.col("n") / float(CHUNK)).cast("long"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("m") / float(BLOCK))).cast("long")}
    cells, _ = written(cells.withColumns(sized).withColumn("cell", F.monotonically_increasing_id()), "cells")
    packs = 1 + int((cells.agg(F.sum(F.col("m") * F.col("chunks") + F.col("n") * F.col("blocks"))).first()[0] or 0) // PACK)
    unit = ["cell", "chunk", "block"]
    pack = F.pmod(F.xxhash64(*unit), F.lit(packs)).alias("pack")
    on = F.lit(True)
    for c in (*keys, *at):
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}"))
    mine = rows.alias("r").join(cells.alias("k"), on).select("r.*", "cell", F.pmod(F.xxhash64("r.atom"), F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).drop(*at)
    met = near.join(cells.drop("n", "m"), [*keys, *at]).select("own", "atom", "x", "y", "z", "radius", F.col("cell").alias("cell"), F.pmod(F.xxhash64("own", "atom"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    names = [*keys, "atom", "x", "y", "z", "radius", "free"]
    sphere = _sphere(points)

    def tried(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(unit, kind="stable"), b.sort_values(unit, kind="stable")
        place = {u: (i, j) for u, i, j in _spans(b[unit])}
        p, r = a[["x", "y", "z"]].to_numpy(float), a["radius"].to_numpy(float)
        q, s, own, ids, mine_ids = b[["x", "y", "z"]].to_numpy(float), b["radius"].to_numpy(float), b["own"].to_numpy(bool), b["atom"].to_numpy(), a["atom"].to_numpy()
        free = [np.asarray(f, dtype=int) for f in a["free"]]
        for u, i, j in _spans(a[unit]):
            lo, hi = place.get(u, (0, 0))
            for k in range(i, j):
                other = ~(own[lo:hi] & (ids[lo:hi] == mine_ids[k]))
                free[k] = _still_free(sphere, free[k], p[k], r[k] + probe, q[lo:hi][other], s[lo:hi][other] + probe)
        return a[names[:-1]].assign(free=pd.Series([f.tolist() for f in free], index=a.index, dtype=object))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    found = mine.withColumn("pack", pack).groupBy("pack").cogroup(met.withColumn("pack", pack).groupBy("pack")).applyInPandas(tried, schema)
    one = found.groupBy(*keys, "atom").agg(*[F.first(c).alias(c) for c in ("x", "y", "z", "radius")], F.collect_list("free").alias("all"))
    return one.withColumn("free", F.aggregate("all", F.col("all")[0], F.array_intersect)).select(*names)


def _spans(units: pd.DataFrame) -> list[tuple]:
    """Runs of equal rows: ``(row, first, end)``."""
    first = np.flatnonzero(~units.duplicated().to_numpy()).tolist()
    return [(tuple(u), i, j) for u, i, j in zip(units.to_numpy()[first].tolist(), first, [*first[1:], len(units)][: len(first)], strict=True)]


def _still_free(sphere: np.ndarray, free: np.ndarray, at: np.ndarray, radius: float, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Which of an atom's points no sphere covers: the nearest are tried first, on what is left the others."""
    gap = centres - at
    d2 = (gap * gap).sum(1)
    reach = np.flatnonzero(d2 < (radii + radius) ** 2 * (1 + 1e-9))
    if len(reach) > NEAREST:
        part = np.argpartition(d2[reach], NEAREST)
        reach = reach[part]
    step = NEAREST
    k = 0
    while k < len(reach) and len(free):
        chosen = reach[k : k + step]
        v = gap[chosen][:, None, :] - radius * sphere[free][None, :, :]
        v *= v
        d = v[:, :, 0] + v[:, :, 1] + v[:, :, 2]
        free = free[~(d < (radii[chosen] ** 2)[:, None]).any(0)]
        k, step = k + step, 1024
    return free


def _sphere(count: int) -> np.ndarray:
    turn = math.pi * (3 - math.sqrt(5))
    out = []
    for k in range(count):
        z = 1 - 2 * (k + 0.5) / count
        r = math.sqrt(1 - z * z)
        out.append((r * math.cos(turn * k), r * math.sin(turn * k), z))
    return np.array(out)


def rmsd(a: DataFrame, b: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Root mean square distance of points with equal index."""
    x = a.select(*keys, index, *[F.col(c).alias(f"a_{c}") for c in "xyz"])
    y = b.select(*keys, index, *[F.col(c).alias(f"b_{c}") for c in "xyz"])
    return x.join(y, [*keys, index]).groupBy(*keys).agg(F.sqrt(F.avg(squared())).alias("rmsd"), F.count("*").alias("n"))


def coulomb(ligand: DataFrame, receptor: DataFrame, keys: list[str], dielectric: float = 4.0, k: float = 332.0637) -> DataFrame:
    """Sum of k q q / (dielectric r**2) over all pairs of a group; pairs at one place add nothing."""
    x = ligand.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("x", "y", "z", "charge")])
    y = receptor.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "z", "charge")])
    d2 = squared()
    e = F.when(d2 > 0, k * F.col("a_charge") * F.col("b_charge") / (dielectric * d2)).otherwise(0.0)
    return x.join(y, keys).groupBy(*keys).agg(F.sum(e).alias("coulomb"))


def kabsch(mobile: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, shift and remaining distance of the best superposition."""
    cm, ct = mobile.mean(0), target.mean(0)
    u, _, vt = np.linalg.svd((mobile - cm).T @ (target - ct))
    sign = np.sign(np.linalg.det(u @ vt)) or 1.0
    r = u @ np.diag([1.0, 1.0, sign]) @ vt
    moved = (mobile - cm) @ r + ct
    return r, ct - cm @ r, float(np.sqrt(((moved - target) ** 2).sum(1).mean()))


def superposed_rmsd(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, i, ax, ay, az, bx, by, bz)`` -> distance after superposition, group by group."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf[keys].head(1).assign(rmsd=kabsch(pdf[["ax", "ay", "az"]].to_numpy(), pdf[["bx", "by", "bz"]].to_numpy())[2])

    schema = ", ".join(f"{k} {dict(pairs.dtypes)[k]}" for k in keys) + ", rmsd double"
    return pairs.groupBy(*keys).applyInPandas(fit, schema)


def lower_bound_rmsd(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The greater of two one-sided nearest-point distances between poses, points of one kind only."""
    x = a.select(*keys, "kind", F.col("atom").alias("a_atom"), *[F.col(c).alias(f"a_{c}") for c in "xyz"])
    y = b.select(*keys, "kind", F.col("atom").alias("b_atom"), *[F.col(c).alias(f"b_{c}") for c in "xyz"])
    p = x.join(y, [*keys, "kind"]).withColumn("d2", squared())
    one = p.groupBy(*keys, "a_atom").agg(F.min("d2").alias("m")).groupBy(*keys).agg(F.sqrt(F.avg("m")).alias("ab"))
    two = p.groupBy(*keys, "b_atom").agg(F.min("d2").alias("m")).groupBy(*keys).agg(F.sqrt(F.avg("m")).alias("ba"))
    return one.join(two, keys).select(*keys, F.greatest("ab", "ba").alias("rmsd_lb"))


def free_volume(centres: DataFrame, atoms: DataFrame, keys: list[str], radius: float, probe: float = 1.4, spacing: float = 1.0, most: float = 2.0) -> DataFrame:
    """Volume of the grid cells around each centre that no atom, with a probe, reaches."""
    n = int(radius // spacing)
    steps = F.sequence(F.lit(-n), F.lit(n))
    g = centres
    for c in "xyz":
        g = g.withColumn(f"g{c}", F.explode(steps))
    g = g.where(F.expr(f"(gx*gx + gy*gy + gz*gz) * {spacing * spacing} <= {radius * radius}"))
    g = g.select(*keys, F.struct("gx", "gy", "gz").alias("cell"), *[(F.col(c) + F.col(f"g{c}") * spacing).alias(c) for c in "xyz"])
    hit = range_join(g, atoms, most + probe, keys).where(F.col("d2") <= (F.col("b_radius") + probe) * (F.col("b_radius") + probe)).select(*keys, F.col("a_cell").alias("cell")).distinct()
    left = g.join(hit, [*keys, "cell"], "left_anti").groupBy(*keys).agg((F.count("*") * spacing**3).alias("free"))
    return centres.select(*keys).distinct().join(left, keys, "left").select(*keys, F.coalesce("free", F.lit(0.0)).alias("free_volume"))


def rank_nearest(df: DataFrame, keys: list[str], distance: str, item: str, most: int) -> DataFrame:
    """The nearest ``most`` members of each group."""
    return df.withColumn("near", F.row_number().over(Window.partitionBy(*keys).orderBy(distance, item))).where(F.col("near") <= most)
