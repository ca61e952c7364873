"""Lattices, pharmacophores, graphs of molecules, files and jobs against cases worked out by hand or by plain versions."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import lattice, molgraph, pharmacophores, spatial
from quarry.sources import trees
from quarry.streaming import jobs


def shell(radius=7.0, step=0.25):
    """Atoms all over a sphere, near enough to leave no hole."""
    n = int(4 * math.pi * radius**2 / (step * 8))
    golden = math.pi * (3 - math.sqrt(5))
    out = []
    for k in range(n):
        z = 1 - 2 * (k + 0.5) / n
        r = math.sqrt(1 - z * z)
        out.append((radius * r * math.cos(golden * k), radius * r * math.sin(golden * k), radius * z))
    return out


def test_a_closed_shell_is_one_pocket(spark):
    rows = [("shell", *p, 1.7, "A", k, "ALA") for k, p in enumerate(shell())] + [("atom", 0.0, 0.0, 0.0, 1.7, "A", 1, "ALA")]
    atoms = spark.createDataFrame(rows, "structure string, x double, y double, z double, radius double, chain string, res_id int, res_name string")
    pockets = lattice.find_pockets(atoms, ["structure"], ray_length=9.0, pocket_radius=0.0)
    (found,) = pockets.found.collect()
    assert found["structure"] == "shell" and found["pocket"] == 0
    assert max(abs(found[c]) for c in ("cx", "cy", "cz")) < 0.5
    inside = [p for p in pockets.points.collect()]
    assert found["n_points"] == len(inside) == found["volume"] and all(p["x"] ** 2 + p["y"] ** 2 + p["z"] ** 2 < 4.0**2 for p in inside)
    # all directions are walled and no neighbour is open: the score is that of the volume alone
    assert found["score"] == pytest.approx((found["volume"] / 100) ** (1 / 3))
    burial = lattice.buriedness(pockets.points, atoms, ["structure"], ["structure", "pocket"], "cell", ray_length=14.0).first()["buriedness"]
    assert burial == 1.0
    assert len(lattice.lining(pockets.points, atoms, ["structure"], ["structure", "pocket"], 5.0).first()["lining"]) > 10
    # several centres share the cells of the one system among them
    cut = lattice.find_pockets(atoms, ["structure"], ray_length=9.0, pocket_radius=3.0, min_volume=1.0, max_pockets=100)
    assert cut.found.agg(F.sum("n_points")).first()[0] == found["n_points"] and cut.found.count() > 1


def test_burial_counts_every_point(spark):
    """A pocket of 200 points far from each other; an atom beside each third one walls the nine directions towards it."""
    points = spark.range(200).selectExpr("'s' AS s", "0 AS pocket", "id AS cell", "id * 100.0D AS x", "0.0D AS y", "0.0D AS z")
    atoms = points.where("cell % 3 = 1").selectExpr("s", "x + 2.0D AS x", "y", "z", "1.5D AS radius")
    assert lattice.buriedness(points, atoms, ["s"], ["s", "pocket"], "cell").first()["buriedness"] == pytest.approx(9 * 67 / 26 / 200)


def test_walls_along_lines(spark):
    """Two blocked cells five apart on a line: four free cells between them see one or both within two steps."""
    frame = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 20, 20, 20)], "s int, ox double, oy double, oz double, nx int, ny int, nz int")
    cells = spark.createDataFrame([(1, 10, 10, 5), (1, 10, 10, 10)], "s int, i int, j int, k int").select("s", lattice.cell_of(F.col("i"), F.col("j"), F.col("k")).alias("cell"))
    seen = lattice.walled_directions(cells, frame, ["s"], 2)
    got = {(lattice_index(r["cell"])): r["walled"] for r in seen.collect()}
    assert [got.get((10, 10, k)) for k in range(3, 13)] == [1, 1, None, 1, 1, 1, 1, None, 1, 1]
    assert got[(9, 9, 4)] == 1 and got[(11, 11, 6)] == 1 and (10, 10, 2) not in got
    assert sum(got.values()) == 2 * 26 * 2


def lattice_index(cell):
    return tuple(((cell >> s) & ((1 << lattice.BITS) - 1)) - lattice.MARGIN for s in (42, 21, 0))


def test_maps_follow_the_sum(spark):
    """Between points of 0.375 the maps are off by less than 0.005 where no atoms overlap."""
    rnd = random.Random(3)
    receptor = spark.createDataFrame([(1, 9 * math.cos(k), 9 * math.sin(k), k - 4.0, 1.9, k % 2 == 0, k % 3 == 0, k % 3 == 1) for k in range(9)], "s int, x double, y double, z double, radius double, hydrophobic boolean, donor boolean, acceptor boolean")
    types = spark.createDataFrame([("C", 1.9, True, False, False), ("O", 1.7, False, True, True)], "type string, radius double, hydrophobic boolean, donor boolean, acceptor boolean")
    frame = lattice.box_frames(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 9.0, 9.0, 9.0)], "s int, cx double, cy double, cz double, sx double, sy double, sz double"))
    maps = lattice.energy_maps(frame, receptor, types, ["s"])
    poses = spark.createDataFrame([(1, k, "CO"[k % 2], *[rnd.uniform(-3.5, 3.5) for _ in range(3)]) for k in range(40)], "s int, pose int, type string, x double, y double, z double")
    got = {r["pose"]: r["energy"] for r in lattice.map_energy(poses, maps, frame, ["s"], ["s", "pose"]).collect()}
    want = {r["pose"]: r["energy"] for r in lattice.direct_energy(poses, receptor, types, ["s"], ["s", "pose"]).collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 0.005 and max(abs(v) for v in want.values()) > 0.01
    far = spark.createDataFrame([(1, 0, "C", 6.5, 0.0, 0.0)], "s int, pose int, type string, x double, y double, z double")
    border = spark.createDataFrame([(1, 0, "C", 4.5, 0.0, 0.0)], "s int, pose int, type string, x double, y double, z double")
    a, b = (lattice.map_energy(p, maps, frame, ["s"], ["s", "pose"], slope=10.0).first()["energy"] for p in (far, border))
    assert a - b == pytest.approx(20.0)


def test_triangles_deviate_as_superpositions_do(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for _ in range(50):
        p, q = rng.normal(size=(2, 3, 3))
        side = lambda t: [float(np.linalg.norm(t[i] - t[j])) for i, j in ((0, 1), (0, 2), (1, 2))]
        rows.append((*side(p), *side(q)))
        want.append(spatial.kabsch(p, q)[2])
    df = spark.createDataFrame(rows, ["a1", "a2", "a3", "b1", "b2", "b3"])
    got = df.select(pharmacophores.triangle_rmsd([F.col(f"a{k}") for k in (1, 2, 3)], [F.col(f"b{k}") for k in (1, 2, 3)]).alias("r")).collect()
    assert np.allclose([r["r"] for r in got], want, atol=1e-9)


def test_pharmacophore_of_a_series(spark):
    base = [("donor", 0.0, 0.0, 0.0), ("acceptor", 5.0, 0.0, 0.0), ("aromatic", 0.0, 7.0, 0.0), ("hydrophobic", 2.0, 2.0, 4.0)]
    rows = [(m, k, f, x + 0.1 * m, y, z) for m in range(4) for k, (f, x, y, z) in enumerate(base)] + [(0, 9, "donor", 30.0, 0.0, 0.0)]
    schema = "molecule int, feature int, family string, x double, y double, z double"
    model = pharmacophores.build_model(spark.createDataFrame(rows, schema))
    got = [tuple(r) for r in model.orderBy("number").collect()]
    assert [(r[0], r[1], r[5], r[6]) for r in got] == [(k, f, 4, 4) for k, f in enumerate(sorted(f for f, *_ in base))]
    assert dict((r[1], round(r[2], 9)) for r in got)["acceptor"] == 5.15
    turn = np.linalg.qr(np.random.default_rng(2).normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    centre = np.array([r[2:5] for r in got])
    family = [r[1] for r in got]
    moved, mirrored = centre @ turn.T + [10, -3, 2], centre * [1, 1, -1]
    others = [(1, k, family[k], *map(float, moved[k])) for k in range(4)] + [(2, k, family[k], *map(float, mirrored[k])) for k in range(4)]
    others += [(3, 0, "donor", 0.0, 0.0, 0.0), (3, 1, "donor", 9.0, 0.0, 0.0), (4, 0, "donor", 0.0, 0.0, 0.0), (4, 1, "acceptor", 100.0, 0.0, 0.0), (4, 2, "aromatic", 0.0, 40.0, 0.0)]
    f = spark.createDataFrame(others, schema)
    atoms = f.withColumnRenamed("feature", "atom").drop("family")
    hits = {r["molecule"]: r for r in pharmacophores.screen(f, atoms, model).collect()}
    assert hits[1]["fit"] == pytest.approx(1.0, abs=1e-6) and hits[1]["n_matched"] == 4 and not hits[1]["rejected"]
    assert hits[2]["n_matched"] == 3 and hits[2]["fit"] < 0.6  # a mirror image is no superposition
    assert hits[3]["reason"] == "no alignment" and hits[3]["fit"] == 0
    assert not hits[4]["rejected"] and hits[4]["n_matched"] <= 1  # laid on the model, far from its points
    shaped = {r["molecule"]: r for r in pharmacophores.screen(f, atoms, model, spark.createDataFrame(rows, schema)).collect()}
    assert shaped[4]["reason"] == "shape" and shaped[1]["reason"] == ""


def graph(spark, elements, bonds, xyz=None):
    """One molecule: elements by atom, bonds (i, j, order)."""
    atoms = spark.createDataFrame([(1, k, e, *(xyz[k] if xyz else (float(k), 0.0, 0.0))) for k, e in enumerate(elements)], "m int, atom int, element string, x double, y double, z double")
    return atoms, spark.createDataFrame([(1, *b) for b in bonds], "m int, i int, j int, order int")


#: Toluene's ring with its methyl (6), a chain (7, 8) on the other side, and an amide (8-9, 9=10, 9-11N).
MOLECULE = ("CCCCCCCCCCON", [(k, (k + 1) % 6, 4) for k in range(6)] + [(0, 6, 1), (3, 7, 1), (7, 8, 1), (8, 9, 1), (9, 10, 2), (9, 11, 1), ])


def test_classes_bridges_and_reasons(spark):
    elements, edges = MOLECULE
    rows = [(m, k, e) for m in (1, 3) for k, e in enumerate(elements)] + [(2, k, "C") for k in range(6)]
    bonds = [(m, *b) for m in (1, 3) for b in edges] + [(2, *b, 1) for b in ((0, 1), (0, 2), (0, 3), (0, 4), (4, 5))]  # the second has a tert-butyl
    atoms, bonds = spark.createDataFrame(rows, "m int, atom int, element string"), spark.createDataFrame(bonds, "m int, i int, j int, order int")
    classes = {r["atom"]: r["symmetry"] for r in molgraph.symmetry_classes(atoms, bonds, ["m"]).where("m = 1").collect()}
    assert classes[1] == classes[5] == 1 and classes[2] == classes[4] == 2 and len(set(classes.values())) == 10
    locked = spark.createDataFrame([(3, 8, 7)], "m int, i int, j int")
    got = {(r["m"], r["i"], r["j"]): r["reason"] for r in molgraph.rotation_reasons(atoms, bonds, ["m"], locked).collect()}
    want = {(0, 1): "aromatic", (0, 6): "terminal", (3, 7): "rotatable", (7, 8): "rotatable", (8, 9): "rotatable", (9, 10): "bond-order", (9, 11): "amide"}
    assert {b: got[1, *b] for b in want} == want and got[3, 7, 8] == "locked" and got[3, 3, 7] == "rotatable"
    assert got[2, 0, 4] == "symmetric" and got[2, 0, 1] == "terminal"


def test_bridges_of_random_graphs(spark):
    rnd = random.Random(6)
    atoms, bonds, want = [], [], set()
    for m in range(12):
        n = rnd.randint(1, 9)
        edges = {tuple(sorted((rnd.randrange(n), rnd.randrange(n)))) for _ in range(rnd.randint(0, 11))}
        edges = {e for e in edges if e[0] != e[1]}
        atoms += [(m, k) for k in range(n)]
        bonds += [(m, *e, 1) for e in edges]
        for i, j in edges:
            seen, todo = {i}, [i]
            while todo:
                x = todo.pop()
                new = {b if a == x else a for a, b in edges - {(i, j)} if x in (a, b)} - seen
                seen |= new
                todo += new
            if j not in seen:
                want.add((m, i, j))
    got = molgraph.bridges(spark.createDataFrame(atoms, "m int, atom int"), spark.createDataFrame(bonds, "m int, i int, j int, order int"), ["m"])
    assert {tuple(r) for r in got.collect()} == want


def test_torsion_tree_of_a_molecule(spark):
    atoms, bonds = graph(spark, *MOLECULE)
    rotors = spark.createDataFrame([(1, 3, 7), (1, 7, 8), (1, 9, 8)], "m int, i int, j int")
    tree, parts = molgraph.torsion_trees(atoms, bonds, rotors, ["m"])
    got = {r["part"]: tuple(r)[2:] for r in tree.collect()}
    assert got == {0: (7, None, None, None, 0), 7: (1, 0, 3, 7, 1), 8: (1, 7, 7, 8, 2), 9: (3, 8, 8, 9, 3)}
    turning = {}
    for r in molgraph.turning_atoms(tree, parts, ["m"]).collect():
        turning.setdefault(r["part"], set()).add(r["atom"])
    assert turning == {7: {7, 8, 9, 10, 11}, 8: {8, 9, 10, 11}, 9: {9, 10, 11}}


def test_paths_and_their_traces(spark):
    edges = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "d", 1.0), (1, "a", "c", 1.0), (1, "c", "d", 1.0), (1, "a", "d", 5.0), (1, "x", "y", 1.0)], "g int, i string, j string, weight double")
    sources = spark.createDataFrame([(1, "a")], "g int, source string")
    got = molgraph.best_paths(edges, sources, ["g"])
    assert {(r["node"], r["cost"], r["previous"]) for r in got.collect()} == {("a", 0.0, None), ("b", 1.0, "a"), ("c", 1.0, "a"), ("d", 2.0, "b")}
    ways = molgraph.traced(got, spark.createDataFrame([(1, "a", "d"), (1, "a", "x")], "g int, source string, target string"), ["g"]).collect()
    assert [(r["target"], r["nodes"]) for r in ways] == [("d", ["a", "b", "d"])]
    wide = {r["node"]: (r["cost"], r["previous"]) for r in molgraph.best_paths(edges, sources, ["g"], widest=True).collect()}
    assert wide["d"] == (5.0, "a") and wide["b"] == (1.0, "a")


def test_symmetry_aware_distance(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1, 1, 1.0, 0.0, 0.0, -1.0, 0.0, 0.0), (1, 2, 1, -1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 0, 0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0)]
    pairs = spark.createDataFrame(rows, "m int, atom int, symmetry int, ax double, ay double, az double, bx double, by double, bz double")
    assert {r["m"]: r["rmsd"] for r in molgraph.symmetry_aware_rmsd(pairs, ["m"]).collect()} == {1: 0.0, 2: 3.0}


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    body = "".join(f"mol{k}\n  x\n\n  1  0  0  0            999 V2000\n{k:10.4f}    0.0000    0.0000 C   0  0\nM  END\n$$$$\n" for k in range(400))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.sdf").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.option("lineSep", "$$$$\n").text(f"file://{tmp_path}/in").rdd.getNumPartitions() > 3
        got = trees.read_molecules(spark, f"file://{tmp_path}/in").orderBy("record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["record"], r["name"], r["atoms"][0]["x"], r["error"]) for r in got] == [(k, f"mol{k}", float(k), "") for k in range(400)]


def test_mol2_and_odd_trees(spark):
    text = "lig\n 2 1\nSMALL\n@<TRIPOS>ATOM\n 1 C1 0.5 1.0 -2.0 C.3 1 LIG 0.12\n 2 O1 1.5 0.0 0.0 O.2\n@<TRIPOS>BOND\n 1 1 2 ar\n"
    got = trees.mol2_molecules(spark.createDataFrame([(1, text), (2, "empty\n")], "record int, text string")).orderBy("record").collect()
    assert got[0]["name"] == "lig" and [tuple(a) for a in got[0]["atoms"]] == [(1, "C1", 0.5, 1.0, -2.0, "C.3", 0.12), (2, "O1", 1.5, 0.0, 0.0, "O.2", None)] and [tuple(b) for b in got[0]["bonds"]] == [(1, 2, "ar")]
    assert got[1]["error"] == "no atoms"
    rows = [(1, ""), (2, "ROOT\nENDROOT\nTORSDOF 0"), (3, "MODEL 1\nATOM      1  C   LIG A   1       1.000   2.000   3.000\nMODEL 2"), (4, "ENDBRANCH 1 2\nBRANCH 1 2\nATOM")]
    df = spark.createDataFrame(rows, "m int, text string")
    assert {r["m"]: r["error"] for r in trees.ligand_checks(df).collect()} == {1: "no root atoms", 2: "no root atoms", 3: "no TORSDOF", 4: "branch closed out of order"}
    assert {r["m"]: r["error"] for r in trees.receptor_checks(df).collect()} == {1: "no atoms", 2: "no atoms", 3: "several models", 4: ""}


def test_jobs_go_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("job", "seq", "op", "n"), r, strict=True))) for r in rows))

    def run():
        log = spark.readStream.schema(jobs.REQUESTS).json(f"file://{tmp_path}/in")
        jobs.serve(log, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()

    put("1.json", [("a", 1, "submit", 3), ("a", 2, "start", None), ("a", 3, "rows", 2), ("b", 1, "start", None), ("c", 1, "submit", 1), ("c", 2, "results", None), (None, 1, "submit", 1)])
    run()
    put("2.json", [("a", 4, "rows", 5), ("a", 5, "cancel", None), ("a", 6, "results", None), ("c", 3, "cancel", None), ("c", 4, "submit", 9), ("c", 5, "dance", None)])
    run()
    got = {(r["job"], r["seq"]): (r["answer"], r["state"], r["done"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got["a", 3] == ("ok", "running", 2) and got["a", 4] == ("ok", "completed", 3) and got["a", 5] == ("conflict", "completed", 3) and got["a", 6][0] == "ok"
    assert got["b", 1] == ("not_found", None, None) and got["c", 2] == ("conflict", "queued", 0) and got["c", 3][1] == "cancelled" and got["c", 4] == ("ok", "queued", 0) and got["c", 5] == ("bad_request", "queued", 0) and got[None, 1][0] == "bad_request"
    last = {r["job"]: (r["state"], r["total"]) for r in jobs.latest(spark.read.parquet(f"file://{tmp_path}/out")).collect()}
    assert last == {"a": ("completed", 3), "c": ("queued", 1)}


def test_silent_jobs_are_cancelled(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"job": "a", "seq": 1, "op": "submit", "n": 2}))
    log = spark.readStream.schema(jobs.REQUESTS).json(f"file://{tmp_path}/in")
    query = jobs.serve(log, f"file://{tmp_path}/out", f"file://{tmp_path}/check", patience_ms=500, available_now=False)
    try:  # the timer keeps batches coming, so there is no end of data to wait for
        for _ in range(90):
            time.sleep(1)
            rows = spark.read.schema(jobs.ANSWERS).parquet(f"file://{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
            if any(r["op"] == "timeout" for r in rows):
                break
    finally:
        query.stop()
    got = jobs.latest(spark.read.parquet(f"file://{tmp_path}/out")).collect()
    assert [(r["job"], r["state"]) for r in got] == [("a", "cancelled")]
