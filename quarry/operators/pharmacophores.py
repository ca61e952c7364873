"""Pharmacophores: features that recur among members of a series, and molecules fitted to them.

A molecule is a table of features ``(molecule, feature, family, x, y, z)``. Fits are found by geometric hashing: pairs of a molecule's
features meet pairs of the model's on families and binned distances, triangles are put together from three consistent pairs, and the
deviation of a superposition follows from the distances alone. Only the best triangle of each molecule moves any coordinates, by column
expressions; nothing runs in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.stages import drop_path, shuffled, written

from .simjoin import around_most
from .spatial import range_join

#: What results depend on: radius of a model's feature, least share of members, tolerance and cost of a miss, shape.
RADIUS, THRESHOLD, TOLERANCE, MISS_PENALTY, SHAPE_TOLERANCE, MIN_COVERAGE = 1.5, 0.5, 1.5, 1.0, 1.2, 0.6
#: Features of a model at most: all that depends on the model alone stays small.
MOST_FEATURES = 64


def build_model(features: DataFrame, radius: float = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """``(number, family, x, y, z, support, members)`` of features that recur among members in one frame.

    Points of a family are clustered around the one with most free neighbours within the radius (ties: the earlier, by member and feature); a
    cluster that ``threshold`` of all members support is a feature, at its centroid. Numbers follow support, family and place.
    """
    order = F.row_number().over(Window.partitionBy("family").orderBy("molecule", "feature"))
    points, path = written(features.select("molecule", "family", "x", "y", "z", order.cast("long").alias("id")), "contributions")
    near = range_join(points, points, radius, ["family"]).where("a_id < b_id").select("family", F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    clusters = around_most(points.select("family", "id"), near, ["family"])
    n = features.select(F.count_distinct("molecule").alias("members"))  # one row
    sums = points.join(shuffled(clusters), ["family", "id"]).groupBy("family", "representative").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count_distinct("molecule").alias("support"))
    held = sums.crossJoin(F.broadcast(n)).where(F.col("support") >= threshold * F.col("members"))
    number = F.row_number().over(Window.orderBy(F.desc("support"), "family", "representative")) - 1
    # as many rows as families can support within the threshold
    out, _ = written(held.select("family", "representative", "x", "y", "z", "support", "members").withColumn("number", number), "model")
    drop_path(features.sparkSession, path)
    return out.select("number", "family", "x", "y", "z", "support", "members")


def checked(model: DataFrame) -> DataFrame:
    """The model, if it has no more features than a model may have."""
    if model.limit(MOST_FEATURES + 1).count() > MOST_FEATURES:
        raise ValueError(f"a model has {MOST_FEATURES} features at most")
    return model


def _pairs(features: DataFrame, keys: list[str], own: str) -> DataFrame:
    """Ordered pairs of different features of a molecule or a model: ``(keys, p, q, fp, fq, d)``."""
    p = features.select(*keys, F.col(own).alias("p"), F.col("family").alias("fp"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    q = features.select(*keys, F.col(own).alias("q"), F.col("family").alias("fq"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    met = p.join(shuffled(q), keys) if keys else p.crossJoin(F.broadcast(q))
    gap = sum(((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "xyz"), F.lit(0.0))
    return met.where("p <> q").select(*keys, "p", "q", "fp", "fq", F.sqrt(gap).alias("d"))


def triangle_rmsd(a: list[Column], b: list[Column]) -> Column:
    """Deviation of two triangles after the best superposition, from their sides (opposite ways alike: ``12, 13, 23``).

    With the corners centred, the sum of the two singular values of their covariance follows from their inner products and areas.
    """
    def gram(d: list[Column]) -> list[list[Column]]:
        d2 = [[F.lit(0.0), d[0] * d[0], d[1] * d[1]], [d[0] * d[0], F.lit(0.0), d[2] * d[2]], [d[1] * d[1], d[2] * d[2], F.lit(0.0)]]
        row = [sum(r[1:], r[0]) / 3.0 for r in d2]
        mean = (row[0] + row[1] + row[2]) / 3.0
        return [[(row[i] + row[j] - mean - d2[i][j]) / 2.0 for j in range(3)] for i in range(3)]

    g, h = gram(a), gram(b)
    inner = sum((g[i][j] * h[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    both = inner + 2.0 * (4.0 / 3.0) * F.sqrt(squared_area(a) * squared_area(b))
    size = sum((g[i][i] + h[i][i] for i in range(3)), F.lit(0.0))
    return F.sqrt(F.greatest(size - 2.0 * F.sqrt(F.greatest(both, F.lit(0.0))), F.lit(0.0)) / 3.0)


def squared_area(d: list[Column]) -> Column:
    x, y, z = (s * s for s in d)
    return F.greatest((2.0 * (x * y + y * z + z * x) - x * x - y * y - z * z) / 16.0, F.lit(0.0))


def best_triangles(features: DataFrame, model: DataFrame, first: float = 2.0, flat: float = 1e-6) -> DataFrame:
    """``(molecule, i, j, k, a, b, c, rmsd)``: the model's features ``i < j < k`` of three families and the molecule's ``a, b, c`` of the same that
    superpose best, ties to the lowest numbers. Triangles without an area fix no rotation and are left out.

    If a superposition deviates by r, no side differs by more than 6 ** 0.5 r. So pairs that differ by less than a bound give all triangles
    within that share of it: molecules that have one are settled, the others look on with twice the bound.
    """
    spark = features.sparkSession
    mine, mine_path = written(_pairs(features, ["molecule"], "feature"), "pairs")
    its = _pairs(model, [], "number").where("p < q and fp <> fq").select(F.col("p").alias("i"), F.col("q").alias("j"), "fp", "fq", F.col("d").alias("e")).cache()
    longest = max(x or 0.0 for x in (mine.agg(F.max("d")).first()[0], its.agg(F.max("e")).first()[0]))
    open_, path = written(mine.select("molecule").distinct(), "open")
    done, paths, bound = None, [mine_path], first
    while True:
        last = bound > longest
        size = F.lit(bound)
        x = mine.join(shuffled(open_), "molecule").withColumn("bin", F.floor(F.col("d") / size))
        y = its.withColumn("bin", F.explode(F.array(*[F.floor(F.col("e") / size) + n for n in (-1, 0, 1)])))
        hits = x.join(F.broadcast(y), ["fp", "fq", "bin"]).where(F.abs(F.col("d") - F.col("e")) <= size).select("molecule", "i", "j", "p", "q", "d", "e", "fp", "fq")
        hits, hits_path = written(hits, "hits")
        paths.append(hits_path)
        ij = hits.select("molecule", "i", "j", F.col("p").alias("a"), F.col("q").alias("b"), F.col("d").alias("d12"), F.col("e").alias("e12"), F.col("fp").alias("f1"), F.col("fq").alias("f2"))
        ik = hits.select("molecule", "i", F.col("j").alias("k"), F.col("p").alias("a"), F.col("q").alias("c"), F.col("d").alias("d13"), F.col("e").alias("e13"), F.col("fq").alias("f3"))
        jk = hits.select("molecule", F.col("i").alias("j"), F.col("j").alias("k"), F.col("p").alias("b"), F.col("q").alias("c"), F.col("d").alias("d23"), F.col("e").alias("e23"))
        met = ij.join(shuffled(ik), ["molecule", "i", "a"]).where("j < k and f1 <> f3 and f2 <> f3").join(shuffled(jk), ["molecule", "j", "k", "b", "c"])
        d, e = ([F.col(f"{n}{s}") for s in ("12", "13", "23")] for n in "de")
        met = met.where((squared_area(d) > flat) & (squared_area(e) > flat)).withColumn("rmsd", F.round(triangle_rmsd(d, e), 6))
        best = met.groupBy("molecule").agg(F.min(F.struct("rmsd", "i", "j", "k", "a", "b", "c")).alias("m")).select("molecule", "m.*")
        best, best_path = written(best if last else best.where(F.col("rmsd") <= bound / math.sqrt(6.0)), "triangles")
        paths.append(best_path)
        done = best if done is None else done.unionByName(best)
        if last:
            break
        open_, new = written(open_.join(shuffled(best.select("molecule")), "molecule", "left_anti"), "open")
        drop_path(spark, path)
        path = new
        if not open_.limit(1).count():
            break
        bound *= 2
    out, _ = written(done, "fits")
    drop_path(spark, path, *paths)
    return out


def _minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _unit(a: list[Column]) -> list[Column]:
    n = F.sqrt(_dot(a, a))
    return [x / n for x in a]


def superpositions(best: DataFrame, features: DataFrame, model: DataFrame) -> DataFrame:
    """``(molecule, rmsd, r, from, to)``: the rotation (rows of an array) that lays the molecule's triangle on the model's, and both centres.

    Each triangle has a frame: along its first side, across it in its plane, and the plane's normal. In these frames both run the same way, and
    one angle is left.
    """
    rows = best
    for n, c in zip("abc", "ijk", strict=True):
        rows = rows.join(shuffled(features.select("molecule", F.col("feature").alias(n), F.array("x", "y", "z").alias(f"m{n}"))), ["molecule", n])
        rows = rows.join(F.broadcast(model.select(F.col("number").alias(c), F.array("x", "y", "z").alias(f"t{n}"))), c)
    for s in "mt":
        p, q, r = ([F.col(f"{s}{n}")[k] for k in range(3)] for n in "abc")
        rows = rows.withColumn(f"{s}0", F.array(*[(p[k] + q[k] + r[k]) / 3.0 for k in range(3)]))
        one = _unit(_minus(q, p))
        up = _unit(_cross(_minus(q, p), _minus(r, p)))
        rows = rows.withColumn(f"{s}e", F.array(*one)).withColumn(f"{s}n", F.array(*up))
        rows = rows.withColumn(f"{s}f", F.array(*_cross([F.col(f"{s}n")[k] for k in range(3)], [F.col(f"{s}e")[k] for k in range(3)])))

    def flat(s: str, n: str, axis: str) -> Column:
        return _dot([F.col(f"{s}{n}")[k] - F.col(f"{s}0")[k] for k in range(3)], [F.col(f"{s}{axis}")[k] for k in range(3)])

    turn = F.atan2(sum((flat("m", n, "e") * flat("t", n, "f") - flat("m", n, "f") * flat("t", n, "e") for n in "abc"), F.lit(0.0)), sum((flat("m", n, "e") * flat("t", n, "e") + flat("m", n, "f") * flat("t", n, "f") for n in "abc"), F.lit(0.0)))
    rows = rows.withColumn("turn", turn)
    e = [F.cos("turn") * F.col("te")[k] + F.sin("turn") * F.col("tf")[k] for k in range(3)]
    f = [F.cos("turn") * F.col("tf")[k] - F.sin("turn") * F.col("te")[k] for k in range(3)]
    r = [F.array(*[e[x] * F.col("me")[y] + f[x] * F.col("mf")[y] + F.col("tn")[x] * F.col("mn")[y] for y in range(3)]) for x in range(3)]
    return rows.select("molecule", "rmsd", F.array(*r).alias("r"), F.col("m0").alias("from"), F.col("t0").alias("to"))


def moved(points: DataFrame, placed: DataFrame) -> DataFrame:
    """Points ``(molecule, .., x, y, z)`` after the superposition of their molecule."""
    rows = points.join(shuffled(placed.select("molecule", "r", "from", "to")), "molecule")
    gap = [F.col(c) - F.col("from")[k] for k, c in enumerate("xyz")]
    return rows.select(*[c for c in points.columns if c not in "xyz"], *[(_dot([F.col("r")[k][y] for y in range(3)], gap) + F.col("to")[k]).alias(c) for k, c in enumerate("xyz")])


def matched(features: DataFrame, model: DataFrame, tolerance: float = TOLERANCE, miss_penalty: float = MISS_PENALTY) -> DataFrame:
    """``(molecule, fit, coverage, n_matched)`` of features that lie in the model's frame.

    Each of the model's features, in their order, takes the nearest free feature of its family (ties: the first), if that lies within the
    tolerance; its weight falls from 1 to 0 there. A miss costs ``miss_penalty``; the fit is the mean, between 0 and 1.
    """
    target = F.array_sort(F.collect_list(F.struct("number", "family", "x", "y", "z")))
    wanted = F.broadcast(checked(model).agg(target.alias("model")))  # one row of MOST_FEATURES at most
    own = features.groupBy("molecule").agg(F.collect_list(F.struct("feature", "family", "x", "y", "z")).alias("own"))
    start = F.struct(F.array().cast(f"array<{dict(features.dtypes)['feature']}>").alias("used"), F.lit(0.0).alias("total"))

    def take(state, w):
        free = F.filter("own", lambda f: (f["family"] == w["family"]) & ~F.array_contains(state["used"], f["feature"]))
        gaps = F.transform(free, lambda f: F.struct(F.sqrt(sum(((f[c] - w[c]) * (f[c] - w[c]) for c in "xyz"), F.lit(0.0))).alias("d"), f["feature"].alias("feature")))
        near = F.array_min(gaps)
        hit = F.coalesce(near["d"] <= tolerance, F.lit(False))
        return F.struct(F.when(hit, F.array_append(state["used"], near["feature"])).otherwise(state["used"]).alias("used"), (state["total"] + F.when(hit, 1.0 - near["d"] / tolerance).otherwise(0.0)).alias("total"))

    rows = own.crossJoin(wanted).withColumn("state", F.aggregate("model", start, take))
    n, hits = F.size("model"), F.size("state.used")
    fit = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("state.total") - miss_penalty * (n - hits)) / n)))
    return rows.select("molecule", fit.alias("fit"), F.when(n == 0, 0.0).otherwise(hits / n).alias("coverage"), hits.alias("n_matched"))


def outside(atoms: DataFrame, envelope: DataFrame, tolerance: float = SHAPE_TOLERANCE) -> DataFrame:
    """``(molecule, n_heavy, n_outside)``: atoms with no point of the members' envelope within the tolerance."""
    rows = atoms.select("molecule", "atom", "x", "y", "z")
    near = range_join(rows, envelope.select("x", "y", "z"), tolerance).select(F.col("a_molecule").alias("molecule"), F.col("a_atom").alias("atom")).distinct()
    held = near.withColumn("near", F.lit(1))
    return rows.join(shuffled(held), ["molecule", "atom"], "left").groupBy("molecule").agg(F.count("*").alias("n_heavy"), F.count_if(F.col("near").isNull()).alias("n_outside"))


def screen(features: DataFrame, atoms: DataFrame, model: DataFrame, envelope: DataFrame | None = None, tolerance: float = TOLERANCE, miss_penalty: float = MISS_PENALTY, shape_tolerance: float = SHAPE_TOLERANCE, min_coverage: float = MIN_COVERAGE, align: bool = True) -> DataFrame:
    """``(molecule, fit, coverage, n_matched, n_outside, rejected, reason)`` of each molecule.

    With ``align``, a molecule is laid on the model by its best triangle; one without any is rejected. With an envelope (heavy atoms of
    the members), a molecule with less than ``min_coverage`` of its atoms within ``shape_tolerance`` of it is rejected. Rejected
    molecules fit with 0.
    """
    model = checked(model)
    every = features.select("molecule").distinct()
    if align:
        placed, _ = written(superpositions(best_triangles(features, model), features, model), "placed")
        features, atoms = moved(features, placed), moved(atoms, placed)
    rows = every.join(shuffled(matched(features, model, tolerance, miss_penalty)), "molecule", "left").withColumn("placed", F.col("fit").isNotNull())
    if envelope is not None:
        rows = rows.join(shuffled(outside(atoms, envelope, shape_tolerance)), "molecule", "left")
        inside = (F.col("n_heavy") - F.col("n_outside")) / F.col("n_heavy") >= min_coverage
        rows = rows.withColumn("shape", F.coalesce(inside, F.lit(False)))
    else:
        rows = rows.withColumns({"n_outside": F.lit(0).cast("long"), "shape": F.lit(True)})
    reason = F.when(~F.col("placed"), "no alignment").when(~F.col("shape"), "shape").otherwise("")
    zero = F.lit(0.0)
    return rows.select("molecule", F.when(reason == "", F.col("fit")).otherwise(zero).alias("fit"), F.coalesce("coverage", zero).alias("coverage"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"), F.coalesce("n_outside", F.lit(0)).alias("n_outside"), (reason != "").alias("rejected"), reason.alias("reason"))
