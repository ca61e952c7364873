"""Lattices made from atoms: pockets as buried free cells, and fields of pair energies.

A lattice is never held as an array. Cells are rows ``(keys, cell)``; a cell's number packs its three indices, so that a step in any
direction adds a constant. Atoms scatter onto the cells they reach, rays are scans along lattice lines, components and the cover of
a cavity are found in rounds over written tables. Structures are keys like any other: none is gathered into one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import metrics as m
from quarry.plans.components import components
from quarry.plans.stages import drop_path, shuffled, written

from .spatial import free_volume, range_join

#: Bits of an index in a cell's number, and what is added to indices so that steps over the border stay positive.
BITS, MARGIN = 21, 1024
STEP = {"x": 1 << 2 * BITS, "y": 1 << BITS, "z": 1}
#: The 26 cubic directions; one of each opposite pair names a family of lattice lines.
DIRECTIONS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
AXES = [d for d in DIRECTIONS if d > (0, 0, 0)]


def step_of(direction: tuple[int, int, int]) -> int:
    return sum(d * STEP[c] for d, c in zip(direction, "xyz", strict=True))


def cell_of(i: Column, j: Column, k: Column) -> Column:
    return sum(((n.cast("long") + MARGIN) * STEP[c] for n, c in zip((i, j, k), "xyz", strict=True)), F.lit(0).cast("long"))


def index_of(cell: Column, c: str) -> Column:
    return (F.shiftright(cell, 2 * BITS - BITS * "xyz".index(c)).bitwiseAND((1 << BITS) - 1) - MARGIN).cast("int")


def frames(atoms: DataFrame, keys: list[str], spacing: float, probe: float) -> DataFrame:
    """``(keys, ox, oy, oz, nx, ny, nz)``: the lattice around each structure, beyond the largest inflated radius by a cell."""
    pad = F.max(F.col("radius") + probe) + spacing
    ends = atoms.groupBy(*keys).agg(pad.alias("pad"), *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))])
    ends = ends.withColumns({f"o{c}": F.col(f"l{c}") - F.col("pad") for c in "xyz"})
    size = {f"n{c}": (F.floor((F.col(f"h{c}") + F.col("pad") - F.col(f"o{c}")) / spacing) + 1).cast("int") for c in "xyz"}
    return ends.withColumns(size).select(*keys, *[f"{n}{c}" for n in "on" for c in "xyz"])


def reached(atoms: DataFrame, frame: DataFrame, keys: list[str], spacing: float, reach: Column) -> DataFrame:
    """Each atom's columns beside the lattice points within ``reach`` of it: their indices ``ix, iy, iz`` and squared distance ``d2``.

    A row of points is bounded by what the other two indices leave of the reach, so few points are tried in vain.
    """
    rows = atoms.join(frame, keys).withColumn("reach", reach)
    left = F.col("reach") * F.col("reach")
    for c in "xyz":
        span = F.sqrt(F.greatest(left, F.lit(0.0)))
        low = F.greatest(F.ceil((F.col(c) - span - F.col(f"o{c}")) / spacing - 1e-6), F.lit(0)).cast("int")
        high = F.least(F.floor((F.col(c) + span - F.col(f"o{c}")) / spacing + 1e-6), F.col(f"n{c}") - 1).cast("int")
        rows = rows.withColumn(f"i{c}", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
        gap = F.col(f"o{c}") + F.col(f"i{c}") * spacing - F.col(c)
        rows = rows.withColumn(f"g{c}", gap * gap)
        left = left - F.col(f"g{c}")
    d2 = F.col("gx") + F.col("gy") + F.col("gz")
    return rows.withColumn("d2", d2).where("d2 <= reach * reach").select(*atoms.columns, "ix", "iy", "iz", "d2")


def blocked_cells(atoms: DataFrame, frame: DataFrame, keys: list[str], spacing: float = 1.0, probe: float = 1.4) -> DataFrame:
    """``(keys, cell)`` of the lattice points where the probe does not fit."""
    near = reached(atoms.select(*keys, "x", "y", "z", "radius"), frame, keys, spacing, F.col("radius") + probe)
    return near.select(*keys, cell_of(F.col("ix"), F.col("iy"), F.col("iz")).alias("cell")).distinct()


def walled_directions(blocked: DataFrame, frame: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """``(keys, cell, walled)``: how many of the 26 directions meet a blocked cell within ``steps`` cells, for the free cells that any does.

    Along each of the 13 families of lattice lines, the gap between a blocked cell and the one before it is free: its cells within
    ``steps`` of either end look at a wall in one direction. A free cell gets each direction at most once, so counting is enough.
    """
    cell = F.col("cell")
    lines = []
    for a, d in enumerate(AXES):
        along = next(c for c, n in zip("xyz", d, strict=True) if n)
        place = index_of(cell, along)
        lines.append(F.struct(F.lit(a).alias("axis"), (cell - place.cast("long") * step_of(d)).alias("line"), place.alias("place"), F.lit(step_of(d)).cast("long").alias("step")))
    rows = blocked.select(*keys, "cell", F.explode(F.array(*lines)).alias("l")).select(*keys, "cell", "l.*")
    w = Window.partitionBy(*keys, "axis", "line").orderBy("place")
    gap = F.lit(steps)
    before = F.least(gap, F.coalesce(F.col("place") - F.lag("place").over(w) - 1, gap))
    after = F.least(gap, F.coalesce(F.lead("place").over(w) - F.col("place") - 1, gap))
    rows = rows.select(*keys, "cell", "step", before.alias("before"), after.alias("after"))

    def free(n: str, sign: int) -> Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(1), F.col(n)), lambda s: F.col("cell") + s * F.col("step") * sign)).otherwise(F.array().cast("array<bigint>"))

    seen = rows.select(*keys, F.explode(F.concat(free("before", -1), free("after", 1))).alias("cell"))
    counts = seen.groupBy(*keys, "cell").agg(F.count("*").cast("int").alias("walled"))
    return inside(counts, frame, keys)


def inside(cells: DataFrame, frame: DataFrame, keys: list[str], cell: str = "cell") -> DataFrame:
    """The cells that lie on their lattice."""
    fits = F.lit(True)
    for c in "xyz":
        fits = fits & index_of(F.col(cell), c).between(F.lit(0), F.col(f"n{c}") - 1)
    return cells.join(frame, keys).where(fits).select(*cells.columns)


def open_neighbours(seeds: DataFrame, blocked: DataFrame, frame: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, cell, open)``: how many of the 26 neighbours of each seed are free, on the lattice, and no seeds."""
    near = seeds.select(*keys, "cell", F.explode(F.array(*[F.col("cell") + step_of(d) for d in DIRECTIONS])).alias("next"))
    near = inside(near, frame, keys, "next")
    known = blocked.select(*keys, F.col("cell").alias("next")).unionByName(seeds.select(*keys, F.col("cell").alias("next")))
    found = near.join(shuffled(known), [*keys, "next"], "left_anti").groupBy(*keys, "cell").agg(F.count("*").alias("open"))
    return seeds.select(*keys, "cell").join(shuffled(found), [*keys, "cell"], "left").withColumn("open", F.coalesce("open", F.lit(0)))


def systems(seeds: DataFrame, keys: list[str]) -> DataFrame:
    """``seeds`` with ``system``, the first cell of its 26-connected component."""
    ahead = seeds.select(*keys, "cell", F.explode(F.array(*[F.col("cell") + step_of(d) for d in AXES])).alias("next"))
    links = ahead.join(shuffled(seeds.select(*keys, F.col("cell").alias("next"))), [*keys, "next"])
    found = components(links.select(F.struct(*keys, "cell").alias("a"), F.struct(*keys, F.col("next").alias("cell")).alias("b")))
    at = found.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.cell").alias("cell"), F.col("component.cell").alias("system"))
    return seeds.join(shuffled(at), [*keys, "cell"], "left").withColumn("system", F.coalesce("system", "cell"))


def first_come(items: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The items ``(keys, id)`` that going through them in the order of ids would keep, if each keeps its later neighbours out.

    ``edges`` are ``(keys, a, b)`` with a before b. In each round an item is kept once all its neighbours before it are out.
    """
    spark = items.sparkSession
    edges, edges_path = written(edges.select(*keys, "a", "b"), "neighbours")
    open_, path = written(items.select(*keys, "id"), "open")
    kept, paths = items.select(*keys, "id").limit(0), [edges_path]
    while open_.limit(1).count():
        held = edges.join(shuffled(open_.withColumnRenamed("id", "a")), [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("id")).distinct()
        now, now_path = written(open_.join(shuffled(held), [*keys, "id"], "left_anti"), "kept")
        paths.append(now_path)
        kept = kept.unionByName(now)
        gone = now.unionByName(edges.join(shuffled(now.withColumnRenamed("id", "a")), [*keys, "a"]).select(*keys, F.col("b").alias("id"))).distinct()
        open_, new = written(open_.join(shuffled(gone), [*keys, "id"], "left_anti"), "open")
        drop_path(spark, path)
        path = new
    out, _ = written(kept, "first-come")
    drop_path(spark, path, *paths)
    return out


def sub_pockets(cells: DataFrame, keys: list[str], radius: float, core: int) -> DataFrame:
    """``cells (keys, system, cell, walled)`` with ``pocket``: the order of the centre that a cell is nearest to, in its system. Distances are
    those of indices, ``radius`` included, so that ties are exact.

    A system's core are the cells within ``core`` directions of its most buried one. Centres are the core's cells, most buried
    first, that lie farther than ``radius`` from all centres before; ties go to the earlier centre.
    """
    own = [*keys, "system"]
    index = [index_of(F.col("cell"), c).cast("double").alias(c) for c in "xyz"]
    if radius <= 0:
        return cells.withColumn("pocket", F.struct(F.lit(0).alias("less"), F.col("system").alias("cell")))
    most = cells.groupBy(*own).agg(F.max("walled").alias("most"))
    rank = F.struct((F.col("most") - F.col("walled")).alias("less"), "cell")
    core_cells, path = written(cells.join(most, own).where(F.col("walled") >= F.col("most") - core).select(*own, rank.alias("id"), *index), "core")
    edges = range_join(core_cells, core_cells, radius, own).where("a_id < b_id").select(*own, F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    centres = core_cells.join(first_come(core_cells, edges, own), [*own, "id"])

    def nearest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(*own, F.col("a_cell").alias("cell")).agg(F.min(F.struct("d2", F.col("b_id").alias("id"))).alias("__m")).select(*own, "cell", F.col("__m.id").alias("pocket"))

    # a centre within twice the radius is nearer than any beyond; the other cells meet all centres of their system
    points = cells.select(*own, "cell", *index)
    near, near_path = written(nearest(range_join(points, centres, 2 * radius, own)), "near")
    rest = points.join(shuffled(near), [*own, "cell"], "left_anti")
    a = rest.select(*own, *[F.col(c).alias(f"a_{c}") for c in ("cell", "x", "y", "z")])
    b = centres.select(*own, *[F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "z")])
    far = a.join(b, own).withColumn("d2", sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "xyz"), F.lit(0.0)))
    return cells.join(shuffled(near.unionByName(nearest(far))), [*own, "cell"])


@dataclass
class Pockets:
    """``found``: ``(keys, pocket, cx, cy, cz, volume, score, n_points)``, pockets numbered from 0 by score; ``points``: their cells,
    ``(keys, pocket, cell, x, y, z)``."""

    found: DataFrame
    points: DataFrame


def find_pockets(atoms: DataFrame, keys: list[str], spacing: float = 1.0, probe: float = 1.4, min_volume: float = 100.0, max_pockets: int = 10, buried: float = 0.55, ray_length: float = 5.0, pocket_radius: float = 6.0, core_depth: float = 3 / 26) -> Pockets:
    """Pockets of each structure of ``atoms (keys, x, y, z, radius)``.

    A lattice point where the probe fits is buried if at least this share of the 26 directions meets a blocked point within the ray's length.
    Buried points that touch are a cavity system, which is cut around its most buried cells. The score is the cube root of
    the volume over 100, times the mean share of walled directions, times one less the mean share of neighbours that are free but not
    buried. Pockets below ``min_volume`` are left out; the first ``max_pockets`` by score (then size, then place) stay.
    Structures without pockets have no rows. The depth of a core counts in whole directions.
    """
    if spacing <= 0 or probe < 0 or ray_length <= 0 or pocket_radius < 0:
        raise ValueError("spacing and ray_length must be positive, probe and pocket_radius not negative")
    frame, _ = written(frames(atoms, keys, spacing, probe), "frames")
    blocked, blocked_path = written(blocked_cells(atoms, frame, keys, spacing, probe), "blocked")
    walled = walled_directions(blocked, frame, keys, max(1, round(ray_length / spacing)))
    seeds, seeds_path = written(walled.where(F.col("walled") / F.lit(26.0) >= buried), "seeds")
    opened = open_neighbours(seeds, blocked, frame, keys)
    cells = systems(seeds, keys).join(shuffled(opened), [*keys, "cell"]).join(frame.select(*keys, "ox", "oy", "oz"), keys)
    place = {c: F.col(f"o{c}") + index_of(F.col("cell"), c) * spacing for c in "xyz"}
    cells, cells_path = written(cells.withColumns(place).drop("ox", "oy", "oz"), "cavities")
    grouped, _ = written(sub_pockets(cells, keys, pocket_radius / spacing, int(26 * core_depth + 1e-9)), "pocket-cells")
    size = F.count("*") * float(spacing**3)
    sums = grouped.groupBy(*keys, "system", "pocket").agg(
        F.count("*").alias("n_points"), size.alias("volume"), *[F.avg(c).alias(f"c{c}") for c in "xyz"], F.avg(F.col("walled") / 26.0).alias("burial"), F.avg(F.col("open") / 26.0).alias("exposure")
    )
    score = F.pow(F.col("volume") / 100.0, F.lit(1.0 / 3.0)) * F.col("burial") * F.greatest(F.lit(0.0), 1.0 - F.col("exposure"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), F.desc("n_points"), "system", "pocket")  # a structure has few pockets
    ranked, _ = written(sums.where(F.col("volume") >= min_volume).withColumn("score", score).withColumn("number", F.row_number().over(w) - 1).where(F.col("number") < max_pockets), "pockets")
    points = grouped.join(ranked.select(*keys, "system", "pocket", "number"), [*keys, "system", "pocket"])
    drop_path(atoms.sparkSession, blocked_path, seeds_path, cells_path)
    return Pockets(ranked.select(*keys, F.col("number").alias("pocket"), "cx", "cy", "cz", "volume", "score", "n_points"), points.select(*keys, F.col("number").alias("pocket"), "cell", "x", "y", "z"))


def buriedness(points: DataFrame, atoms: DataFrame, keys: list[str], group: list[str], point: str, probe: float = 1.4, ray_length: float = 5.0, most: float = 2.2) -> DataFrame:
    """``(group, buriedness)``: the mean share of the 26 directions in which a ray from a point comes within an atom's inflated radius, over
    all points.

    An atom walls a direction if it lies ahead, no farther along the ray than its length. ``keys`` (part of ``group``) say which atoms count;
    ``most`` is the greatest radius.
    """
    reach = math.hypot(ray_length, most + probe) * (1 + 1e-9)  # no atom farther off meets a ray
    near = range_join(points.select(*group, point, "x", "y", "z"), atoms.select(*keys, "x", "y", "z", "radius"), reach, keys)
    gap = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"]
    hits = F.lit(0)
    for k, d in enumerate(DIRECTIONS):
        length = sum(n * n for n in d) ** 0.5
        along = sum((g * (n / length) for g, n in zip(gap, d, strict=True)), F.lit(0.0))
        across = F.sqrt(F.greatest(F.col("d2") - along * along, F.lit(0.0)))
        hits = hits.bitwiseOR(F.when((along > 0) & (along <= ray_length) & (across < F.col("b_radius") + probe), 1 << k).otherwise(0))
    own = [c for c in group if c not in keys]
    masks = near.groupBy(*keys, *[F.col(f"a_{c}").alias(c) for c in own], F.col(f"a_{point}").alias(point)).agg(F.bit_or(hits).alias("mask"))
    met = points.select(*group, point).join(shuffled(masks), [*group, point], "left")
    return met.groupBy(*group).agg(F.avg(F.coalesce(F.bit_count("mask"), F.lit(0)) / 26.0).alias("buriedness"))


def lining(points: DataFrame, atoms: DataFrame, keys: list[str], group: list[str], radius: float = 5.0) -> DataFrame:
    """``(group, lining)``: residues with an atom within the radius of any point, by chain, number and name, as ``NAMEnumber chain``."""
    near = range_join(points.select(*group, "x", "y", "z"), atoms.select(*keys, "x", "y", "z", "chain", "res_id", "res_name"), radius, keys)
    own = [F.col(c if c in keys else f"a_{c}").alias(c) for c in group]
    named = near.select(*own, F.struct(F.col("b_chain").alias("chain"), F.col("b_res_id").alias("res_id"), F.col("b_res_name").alias("res_name")).alias("r")).distinct()
    sets = named.groupBy(*group).agg(F.sort_array(F.collect_list("r")).alias("rs"))
    label = F.transform("rs", lambda r: F.trim(F.concat(r["res_name"], r["res_id"].cast("string"), F.lit(" "), r["chain"])))
    return points.select(*group).distinct().join(sets.select(*group, label.alias("lining")), group, "left").withColumn("lining", F.coalesce("lining", F.array().cast("array<string>")))


def detect_pockets(atoms: DataFrame, keys: list[str], min_volume: float = 50.0, max_pockets: int = 40, probe: float = 1.4, ray_length: float = 5.0, lining_radius: float = 5.0, local_radius: float = 6.0, most: float = 2.2, **settings) -> DataFrame:
    """Pockets of each structure with lining, burial by rays from their points, and the free volume around their centres."""
    pockets = find_pockets(atoms, keys, min_volume=min_volume, max_pockets=max_pockets, probe=probe, ray_length=ray_length, **settings)
    group = [*keys, "pocket"]
    lined = lining(pockets.points, atoms, keys, group, lining_radius)
    burial = buriedness(pockets.points, atoms, keys, group, "cell", probe, ray_length, most=most)
    centres = pockets.found.select(*group, *[F.col(f"c{c}").alias(c) for c in "xyz"])
    mine = atoms.join(centres.select(*group), keys).select(*group, "x", "y", "z", "radius")
    return pockets.found.join(lined, group).join(burial, group).join(free_volume(centres, mine, group, local_radius, probe, most=most), group)


# -- fields ------------------------------------------------------------------------------------------------


def box_frames(boxes: DataFrame, spacing: float = 0.375, even: bool = False) -> DataFrame:
    """``boxes`` ``(.., cx, cy, cz, sx, sy, sz)`` as lattices: voxels that cover each edge, around the same centre; points are one more."""
    out = boxes
    for c in "xyz":
        n = F.greatest(F.ceil(F.greatest(F.col(f"s{c}"), F.lit(1e-9)) / spacing), F.lit(1)).cast("int")
        n = n + F.pmod(n, F.lit(2)) if even else n
        out = out.withColumn(f"n{c}", n + 1).withColumn(f"o{c}", F.col(f"c{c}") - (F.col(f"n{c}") - 1) * spacing / 2)
    return out.drop(*[f"{n}{c}" for n in "cs" for c in "xyz"])


def energy_maps(frame: DataFrame, atoms: DataFrame, types: DataFrame, keys: list[str], spacing: float = 0.375, cutoff: float = 8.0, weights: dict | None = None) -> DataFrame:
    """``(keys, type, ix, iy, iz, value)``: the energy of a probe of each type at each lattice point, summed over the atoms within the cutoff.

    ``atoms`` are ``(keys, x, y, z, radius, hydrophobic, donor, acceptor)``, ``types`` ``(type, radius, hydrophobic, donor, acceptor)``, a fixed list
    of kinds. Each atom sends its terms to the points it reaches; a task adds up what meets at a point before anything moves. Points
    that no atom reaches have no row and stand for zero.
    """
    near = reached(atoms.select(*keys, "x", "y", "z", "radius", "hydrophobic", "donor", "acceptor"), frame, keys, spacing, F.lit(float(cutoff)))
    probe = types.select("type", *[F.col(c).alias(f"t_{c}") for c in ("radius", "hydrophobic", "donor", "acceptor")])
    met = near.join(F.broadcast(probe))  # types of a force field: a fixed list
    hbond = (F.col("donor") & F.col("t_acceptor")) | (F.col("acceptor") & F.col("t_donor"))
    value = m.vina_pair(F.sqrt("d2") - F.col("radius") - F.col("t_radius"), F.col("hydrophobic") & F.col("t_hydrophobic"), hbond, weights or m.VINA)
    return met.select(*keys, "type", "ix", "iy", "iz", value.alias("value")).groupBy(*keys, "type", "ix", "iy", "iz").agg(F.sum("value").alias("value"))


def map_energy(atoms: DataFrame, maps: DataFrame, frame: DataFrame, keys: list[str], pose: list[str], spacing: float = 0.375, slope: float = 1e6) -> DataFrame:
    """``(pose, energy)`` of atoms ``(pose, type, x, y, z)`` in the maps of their structure (``keys``, part of ``pose``): trilinear between the eight
    points around each atom. An atom outside of the box pays ``slope`` for each unit of distance to it, beside the value at the border.
    """
    rows = atoms.join(frame, keys)
    out = F.lit(0.0)
    for c in "xyz":
        at = (F.col(c) - F.col(f"o{c}")) / spacing
        top = (F.col(f"n{c}") - 1).cast("double")
        out = out + F.greatest(-at, at - top, F.lit(0.0)) * spacing
        rows = rows.withColumn(f"u{c}", F.least(F.greatest(at, F.lit(0.0)), top))
        rows = rows.withColumn(f"i{c}", F.least(F.floor(f"u{c}"), F.greatest(F.col(f"n{c}") - 2, F.lit(0))).cast("int"))
    rows = rows.withColumn("beyond", out)
    corners = []
    for d in [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]:
        share = F.lit(1.0)
        for n, c in zip(d, "xyz", strict=True):
            t = F.col(f"u{c}") - F.col(f"i{c}")
            share = share * (t if n else 1.0 - t)
        corners.append(F.struct(*[(F.col(f"i{c}") + n).alias(f"i{c}") for n, c in zip(d, "xyz", strict=True)], share.alias("share")))
    seen = rows.select(*pose, "type", "beyond", F.posexplode(F.array(*corners)).alias("k", "p")).select(*pose, "type", F.when(F.col("k") == 0, F.col("beyond") * slope).otherwise(0.0).alias("extra"), "p.*")
    met = seen.join(maps, [*keys, "type", "ix", "iy", "iz"], "left")
    return met.groupBy(*pose).agg(F.sum(F.coalesce(F.col("value") * F.col("share"), F.lit(0.0)) + F.col("extra")).alias("energy"))


def direct_energy(atoms: DataFrame, receptor: DataFrame, types: DataFrame, keys: list[str], pose: list[str], cutoff: float = 8.0, weights: dict | None = None) -> DataFrame:
    """``(pose, energy)`` by the pair terms themselves, which the maps stand for."""
    probe = types.select("type", *[F.col(c).alias(f"t_{c}") for c in ("radius", "hydrophobic", "donor", "acceptor")])
    mine = atoms.join(F.broadcast(probe), "type")
    near = range_join(mine, receptor.select(*keys, "x", "y", "z", "radius", "hydrophobic", "donor", "acceptor"), cutoff, keys)
    hbond = (F.col("b_donor") & F.col("a_t_acceptor")) | (F.col("b_acceptor") & F.col("a_t_donor"))
    value = m.vina_pair(F.sqrt("d2") - F.col("b_radius") - F.col("a_t_radius"), F.col("b_hydrophobic") & F.col("a_t_hydrophobic"), hbond, weights or m.VINA)
    own = [F.col(c if c in keys else f"a_{c}").alias(c) for c in pose]
    found = near.groupBy(*own).agg(F.sum(value).alias("energy"))
    return atoms.select(*pose).distinct().join(found, pose, "left").withColumn("energy", F.coalesce("energy", F.lit(0.0)))
