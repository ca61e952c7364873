"""Graphs of molecules, over one table of all molecules' atoms and bonds: symmetry classes, bridges, rotors, torsion trees, paths.

Atoms are ``(keys, atom, element, ..)``, bonds ``(keys, i, j, order)``, each once. Every step is a round over written tables: a class
splits by its neighbours' classes, a tree grows by a level, a cycle is walked up to its top. Rounds end when nothing changes, so they are as
many as the deepest molecule needs, whatever the number of molecules.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.components import components
from quarry.plans.stages import drop_path, written

from .poses import assignment


class Rounds:
    """Tables that each round writes anew; the one before goes."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        out, path = written(df, name)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            drop_path(self.spark, old)
        return out

    def end(self, *keep: str) -> None:
        drop_path(self.spark, *[p for n, p in self.paths.items() if n not in keep])


def both_ways(bonds: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Bonds from either end: ``(keys, atom, other, more)``."""
    one = bonds.select(*keys, F.col("i").alias("atom"), F.col("j").alias("other"), *more)
    return one.unionByName(bonds.select(*keys, F.col("j").alias("atom"), F.col("i").alias("other"), *more))


def symmetry_classes(atoms: DataFrame, bonds: DataFrame, keys: list[str], label: str = "element") -> DataFrame:
    """``(keys, atom, symmetry)``: atoms that refinement cannot tell apart share a class, named by its least atom.

    Classes begin as labels. In each round a class splits where atoms differ in the orders and classes of their neighbours, until no class of
    any molecule does. Atoms of an orbit always share a class; in graphs where every atom has the same surroundings, so do others.
    """
    rounds = Rounds(atoms.sparkSession)
    ends = rounds.keep("ends", both_ways(bonds, keys, "order"))
    first = atoms.groupBy(*keys, label).agg(F.min("atom").alias("symmetry"))
    at = rounds.keep("classes", atoms.select(*keys, "atom", label).join(first, [*keys, label]).select(*keys, "atom", "symmetry"))
    n = at.select(*keys, "symmetry").distinct().count()
    while True:
        seen = ends.join(at.withColumnsRenamed({"atom": "other", "symmetry": "of"}), [*keys, "other"]).groupBy(*keys, "atom").agg(F.array_sort(F.collect_list(F.struct("order", "of"))).alias("around"))
        signed = at.join(seen, [*keys, "atom"], "left").withColumn("around", F.coalesce("around", F.array().cast(seen.schema["around"].dataType)))
        least = signed.groupBy(*keys, "symmetry", "around").agg(F.min("atom").alias("finer"))
        at = rounds.keep("classes", signed.join(least, [*keys, "symmetry", "around"]).select(*keys, "atom", F.col("finer").alias("symmetry")))
        more = at.select(*keys, "symmetry").distinct().count()
        if more == n:
            break
        n = more
    rounds.end("classes")
    return at


def spanning_trees(nodes: DataFrame, edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, node, parent, via, depth)``: breadth-first trees from the roots ``(keys, node)`` over edges ``(keys, i, j, via)``; of several parents
    the least. Nodes that no root reaches have no row."""
    rounds = Rounds(nodes.sparkSession)
    ends = rounds.keep("tree-ends", both_ways(edges, keys, "via"))
    none = ends.schema["via"].dataType
    level = roots.select(*keys, "node", F.lit(None).cast(nodes.schema["node"].dataType).alias("parent"), F.lit(None).cast(none).alias("via"), F.lit(0).alias("depth"))
    tree = rounds.keep("trees", level)
    depth = 0
    while True:
        ahead = tree.where(F.col("depth") == depth).select(*keys, F.col("node").alias("atom")).join(ends, [*keys, "atom"])
        found = ahead.join(tree.select(*keys, F.col("node").alias("other")), [*keys, "other"], "left_anti").groupBy(*keys, "other").agg(F.min(F.struct("atom", "via")).alias("__m"))
        new = found.select(*keys, F.col("other").alias("node"), F.col("__m.atom").alias("parent"), F.col("__m.via").alias("via"), F.lit(depth + 1).alias("depth"))
        new = rounds.keep("level", new)
        if not new.limit(1).count():
            break
        tree = rounds.keep("trees", tree.unionByName(new))
        depth += 1
    rounds.end("trees")
    return tree


def bridges(atoms: DataFrame, bonds: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, i, j)`` of the bonds that lie on no cycle.

    Each bond outside of a spanning forest closes one cycle. Both of its ends walk up the tree, the deeper one first, until they meet; the
    tree's bonds on the way lie on that cycle.
    """
    rounds = Rounds(atoms.sparkSession)
    pairs = rounds.keep("bonds", bonds.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i <> j").groupBy(*keys, "i", "j").agg(F.count("*").alias("n")))
    held = components(pairs.select(F.struct(*keys, F.col("i").alias("atom")).alias("a"), F.struct(*keys, F.col("j").alias("atom")).alias("b")))
    roots = held.select(F.col("component").alias("__r")).distinct().select(*[F.col(f"__r.{k}").alias(k) for k in keys], F.col("__r.atom").alias("node"))
    nodes = atoms.select(*keys, F.col("atom").alias("node"))
    tree = spanning_trees(nodes, pairs.select(*keys, "i", "j", F.lit(0).alias("via")), roots, keys)
    up = tree.select(*keys, "node", "parent", "depth")
    own = up.where("parent is not null").select(*keys, F.least("node", "parent").alias("i"), F.greatest("node", "parent").alias("j"))
    walks = rounds.keep("walks", pairs.join(own, [*keys, "i", "j"], "left_anti").select(*keys, F.col("i").alias("u"), F.col("j").alias("v")))
    closed = rounds.keep("closed", walks.select(*keys, F.col("u").alias("i"), F.col("v").alias("j")))
    a = up.select(*keys, F.col("node").alias("u"), F.col("parent").alias("pu"), F.col("depth").alias("du"))
    b = up.select(*keys, F.col("node").alias("v"), F.col("parent").alias("pv"), F.col("depth").alias("dv"))
    while walks.limit(1).count():
        met = walks.join(a, [*keys, "u"]).join(b, [*keys, "v"])
        deeper = F.col("du") >= F.col("dv")
        low, high = F.when(deeper, F.col("u")).otherwise(F.col("v")), F.when(deeper, F.col("pu")).otherwise(F.col("pv"))
        other = F.when(deeper, F.col("v")).otherwise(F.col("u"))
        step = rounds.keep("steps", met.select(*keys, low.alias("low"), high.alias("high"), other.alias("other")).distinct())
        passed = step.select(*keys, F.least("low", "high").alias("i"), F.greatest("low", "high").alias("j"))
        closed = rounds.keep("closed", closed.unionByName(passed).distinct())
        walks = rounds.keep("walks", step.where("high <> other").select(*keys, F.least("high", "other").alias("u"), F.greatest("high", "other").alias("v")).distinct())
    # a pair that is bonded twice is a cycle of two
    out = rounds.keep("bridges", pairs.where("n = 1").join(closed, [*keys, "i", "j"], "left_anti").select(*keys, "i", "j"))
    rounds.end("bridges")
    return out


def rotation_reasons(atoms: DataFrame, bonds: DataFrame, keys: list[str], locked: DataFrame | None = None) -> DataFrame:
    """``(keys, i, j, reason)`` of each bond: why it does not turn, or ``rotatable``.

    Bonds have an ``order`` (1, 2, 3; 4 is aromatic). In this order: locked; a hydrogen takes part; aromatic; not single; in a ring; the C-N bond of
    an amide (its carbon has a double bond to an oxygen); an end without another heavy neighbour; an end with three or more other heavy neighbours
    that are all equivalent.
    """
    rounds = Rounds(atoms.sparkSession)
    kinds = atoms.select(*keys, "atom", "element")
    rows = bonds.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "order")
    ends = both_ways(rows, keys, "order").join(kinds.select(*keys, F.col("atom").alias("other"), "element"), [*keys, "other"])
    ends = ends.join(symmetry_classes(atoms, bonds, keys).select(*keys, F.col("atom").alias("other"), "symmetry"), [*keys, "other"])
    heavy = F.filter("around", lambda x: x["element"] != "H")
    near = ends.groupBy(*keys, "atom").agg(F.collect_list(F.struct("other", "element", "order", "symmetry")).alias("around")).select(*keys, "atom", heavy.alias("heavy"))
    around = rounds.keep("around", kinds.join(near, [*keys, "atom"], "left"))
    on = rows.join(bridges(atoms, bonds, keys).withColumn("bridge", F.lit(True)), [*keys, "i", "j"], "left")
    for c in "ij":
        on = on.join(around.select(*keys, F.col("atom").alias(c), F.col("element").alias(f"e{c}"), F.coalesce("heavy", F.array().cast(around.schema["heavy"].dataType)).alias(f"h{c}")), [*keys, c])
    on = on.join(locked.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct().withColumn("locked", F.lit(True)), [*keys, "i", "j"], "left") if locked is not None else on.withColumn("locked", F.lit(None).cast("boolean"))

    def others(c: str, than: str) -> Column:
        return F.filter(f"h{c}", lambda x: x["other"] != F.col(than))

    def equivalent(c: str, than: str) -> Column:
        classes = F.array_distinct(F.transform(others(c, than), lambda x: x["symmetry"]))
        return (F.size(others(c, than)) >= 3) & (F.size(classes) == 1)

    def amide(carbon: str, nitrogen: str) -> Column:
        carbonyl = F.exists(f"h{carbon}", lambda x: (x["element"] == "O") & (x["order"] == 2))
        return (F.col(f"e{carbon}") == "C") & (F.col(f"e{nitrogen}") == "N") & carbonyl

    reason = (
        F.when(F.coalesce("locked", F.lit(False)), "locked").when((F.col("ei") == "H") | (F.col("ej") == "H"), "hydrogen").when(F.col("order") == 4, "aromatic").when(F.col("order") != 1, "bond-order")
        .when(F.col("bridge").isNull(), "ring").when(amide("i", "j") | amide("j", "i"), "amide").when((F.size("hi") < 2) | (F.size("hj") < 2), "terminal").when(equivalent("i", "j") | equivalent("j", "i"), "symmetric").otherwise("rotatable")
    )
    out = rounds.keep("reasons", on.select(*keys, "i", "j", reason.alias("reason")))
    rounds.end("reasons")
    return out


def torsion_trees(atoms: DataFrame, bonds: DataFrame, rotors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rigid parts of each molecule as a rooted tree, and the part of each atom.

    The first table is ``(keys, part, n_atoms, parent, parent_atom, attach_atom, depth)``: parts are named by their least atom; a part hangs on its
    parent by the rotor ``(i, j)`` between ``parent_atom`` there and ``attach_atom`` here. The second is ``(keys, atom, part)``. The root is the
    largest part; then the one whose centroid is nearest to that of the heavy atoms, then the one with the least atom.
    Rotors that lie on a cycle would close the tree; such are left in the frame by the order of the search. Atoms have ``x, y, z``.
    """
    rounds = Rounds(atoms.sparkSession)
    cut = rotors.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    stiff = bonds.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).join(cut, [*keys, "i", "j"], "left_anti")
    held = components(stiff.select(F.struct(*keys, F.col("i").alias("atom")).alias("a"), F.struct(*keys, F.col("j").alias("atom")).alias("b")))
    named = held.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.atom").alias("atom"), F.col("component.atom").alias("part"))
    at = rounds.keep("parts", atoms.join(named, [*keys, "atom"], "left").withColumn("part", F.coalesce("part", "atom")))
    heavy = F.col("element") != "H"
    middle = at.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(heavy, F.col(c))), F.avg(c)).alias(f"m{c}") for c in "xyz"])
    parts = at.groupBy(*keys, "part").agg(F.count("*").alias("n_atoms"), *[F.avg(c).alias(c) for c in "xyz"]).join(middle, keys)
    gap = sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0))
    parts = rounds.keep("sizes", parts.withColumn("gap", F.round(F.sqrt(gap), 9)))
    roots = parts.groupBy(*keys).agg(F.min(F.struct((-F.col("n_atoms")).alias("n"), "gap", "part")).alias("__m")).select(*keys, F.col("__m.part").alias("node"))
    links = cut.join(at.select(*keys, F.col("atom").alias("i"), F.col("part").alias("p")), [*keys, "i"]).join(at.select(*keys, F.col("atom").alias("j"), F.col("part").alias("q")), [*keys, "j"]).where("p <> q")
    links = links.select(*keys, F.col("p").alias("a"), F.col("q").alias("b"), F.struct("i", "j", "p").alias("via"))
    nodes = parts.select(*keys, F.col("part").alias("node"))
    tree = spanning_trees(nodes, links.withColumnsRenamed({"a": "i", "b": "j"}), roots, keys)
    first = F.col("via.p") == F.col("parent")
    ends = tree.select(*keys, F.col("node").alias("part"), "parent", F.when(first, F.col("via.i")).otherwise(F.col("via.j")).alias("parent_atom"), F.when(first, F.col("via.j")).otherwise(F.col("via.i")).alias("attach_atom"), "depth")
    out = rounds.keep("tree", parts.select(*keys, "part", "n_atoms").join(ends, [*keys, "part"]))
    rounds.end("parts", "tree")
    return out, at.select(*keys, "atom", "part")


def turning_atoms(tree: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, part, atom)``: the atoms that turn with the rotor on which a part hangs, its own and those of all parts below.

    In each round every part hands its name to its children; the rounds are as many as the tree is deep."""
    rounds = Rounds(tree.sparkSession)
    below = tree.where("parent is not null").select(*keys, "part", F.col("part").alias("holds"))
    grown = rounds.keep("below", below)
    front = rounds.keep("front", below)
    children = tree.where("parent is not null").select(*keys, F.col("parent").alias("holds"), F.col("part").alias("child"))
    while True:
        front = rounds.keep("front", front.join(children, [*keys, "holds"]).select(*keys, "part", F.col("child").alias("holds")))
        if not front.limit(1).count():
            break
        grown = rounds.keep("below", grown.unionByName(front))
    out = rounds.keep("turning", grown.join(parts.select(*keys, "atom", F.col("part").alias("holds")), [*keys, "holds"]).select(*keys, "part", "atom"))
    rounds.end("turning")
    return out


def best_paths(edges: DataFrame, sources: DataFrame, keys: list[str], widest: bool = False, most_rounds: int = 10_000) -> DataFrame:
    """``(keys, source, node, cost, previous)`` from every source ``(keys, source)`` over edges ``(keys, i, j, weight)`` that go both ways.

    The cost of a path is the sum of its weights (all above zero), or with ``widest`` its least weight, and the largest is best. In each
    round the nodes that have become better hand their cost to their neighbours. Of equally good ways in, the least node is named as
    ``previous``; with ``widest``, the least of the round that first reached that width, so that ways never run in circles. Nodes that cannot be
    reached have no row.
    """
    rounds = Rounds(edges.sparkSession)
    ends = rounds.keep("path-ends", both_ways(edges, keys, "weight"))
    kind = ends.schema["atom"].dataType
    sign = -1.0 if widest else 1.0  # the least number is best
    start = F.lit(float("-inf") if widest else 0.0)
    best = rounds.keep("best", sources.select(*keys, "source", F.col("source").cast(kind).alias("node"), start.alias("number"), F.lit(None).cast(kind).alias("previous")).distinct())
    front = best
    for _ in range(most_rounds):
        ahead = front.select(*keys, "source", F.col("node").alias("atom"), "number").join(ends, [*keys, "atom"])
        number = F.greatest(F.col("number"), F.col("weight") * sign) if widest else F.col("number") + F.col("weight")
        offer = ahead.select(*keys, "source", F.col("other").alias("node"), number.alias("number"), F.col("atom").alias("previous")).where("node <> source")
        offer = offer.groupBy(*keys, "source", "node").agg(F.min(F.struct("number", "previous")).alias("__m"))
        mine = best.select(*keys, "source", "node", F.col("number").alias("was"), F.col("previous").alias("before"))
        met = offer.join(mine, [*keys, "source", "node"], "left")
        better = F.col("was").isNull() | (F.col("__m.number") < F.col("was"))
        named = F.lit(not widest) & ~better & (F.col("__m.number") == F.col("was")) & (F.col("__m.previous") < F.col("before"))
        changed = rounds.keep("changed", met.where(better | named).select(*keys, "source", "node", F.col("__m.number").alias("number"), F.col("__m.previous").alias("previous"), better.alias("better")))
        if not changed.limit(1).count():
            break
        rest = best.join(changed.select(*keys, "source", "node"), [*keys, "source", "node"], "left_anti")
        best = rounds.keep("best", rest.unionByName(changed.drop("better")))
        front = rounds.keep("next", changed.where("better"))
    rounds.end("best")
    return best.select(*keys, "source", "node", (F.col("number") * sign).alias("cost"), "previous")


def traced(paths: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, source, target, nodes, cost)``: the way from source to target, node by node; targets ``(keys, source, target)`` that cannot be reached
    have no row. Each round takes one step back on all ways at once."""
    rounds = Rounds(paths.sparkSession)
    own = rounds.keep("steps", paths)
    rows = targets.join(own.select(*keys, "source", F.col("node").alias("target"), "cost", "previous"), [*keys, "source", "target"])
    open_ = rounds.keep("ways", rows.select(*keys, "source", "target", F.array("target").alias("nodes"), "cost", "previous"))
    while open_.where("previous is not null").limit(1).count():
        back = own.select(*keys, "source", F.col("node").alias("previous"), F.col("previous").alias("before"))
        met = open_.where("previous is not null").join(back, [*keys, "source", "previous"])
        walked = met.select(*keys, "source", "target", F.concat(F.array("previous"), F.col("nodes")).alias("nodes"), "cost", F.col("before").alias("previous"))
        open_ = rounds.keep("ways", open_.where("previous is null").unionByName(walked))
    rounds.end("ways")
    return open_.select(*keys, "source", "target", "nodes", "cost")


def atom_permutation(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, atom, target)``: where each atom ``(keys, atom, name)`` of one table stands in another, by its name. Groups whose names repeat on a side,
    or are not the same on both, have no rows."""
    a = source.groupBy(*keys, "name").agg(F.count("*").alias("na"), F.min("atom").alias("atom"))
    b = target.groupBy(*keys, "name").agg(F.count("*").alias("nb"), F.min("atom").alias("target"))
    met = a.join(b, [*keys, "name"], "full")
    fits = met.groupBy(*keys).agg(F.bool_and(F.coalesce((F.col("na") == 1) & (F.col("nb") == 1), F.lit(False))).alias("fits")).where("fits")
    return met.join(fits.select(*keys), keys).select(*keys, "atom", "target")


def symmetry_aware_rmsd(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, rmsd)`` of two poses ``(keys, atom, symmetry, ax, ay, az, bx, by, bz)`` in one frame, atoms matched inside their classes at the least cost.

    Atoms alone in their class need no choice and stay in columns; only classes of two and more, which are as small as a molecule's
    symmetry, are assigned, each by itself.
    """
    gap = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0))
    sizes = pairs.groupBy(*keys, "symmetry").agg(F.count("*").alias("n"))
    rows = pairs.join(sizes, [*keys, "symmetry"])
    alone = rows.where("n = 1").select(*keys, gap.alias("cost"))

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[[f"{s}{c}" for c in "xyz"]].to_numpy() for s in "ab")
        cost = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
        return pdf[keys].head(1).assign(cost=float(cost[np.arange(len(cost)), assignment(cost)].sum()))

    schema = ", ".join(f"{k} {dict(pairs.dtypes)[k]}" for k in keys) + ", cost double"
    several = rows.where("n > 1").groupBy(*keys, "symmetry").applyInPandas(least, schema)
    total = alone.unionByName(several).groupBy(*keys).agg(F.sum("cost").alias("cost"))
    return total.join(sizes.groupBy(*keys).agg(F.sum("n").alias("n")), keys).select(*keys, F.sqrt(F.col("cost") / F.col("n")).alias("rmsd"))
