"""What is defined by an order or by an algorithm, against plain versions on the queries' own tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry import queries as Q
from quarry.operators import poses, pockets, receptors, rollups, simjoin, structure
from quarry.sources import tables

SF = "/root/testdata/sf0.001"


def test_containers_are_filled_in_order(spark):
    rows = sorted(map(tuple, Q._posed(spark, SF).select("label", "id", "x", "y", "z", "energy").collect()))
    want = {}
    for label, group in itertools.groupby(rows, lambda r: r[0]):
        held = []
        for r in group:
            d = [float(np.linalg.norm(np.subtract(h[2:5], r[2:5]))) for h in held]
            if d and min(d) < 1.0:
                k = d.index(min(d))
                if r[5] < held[k][5]:
                    held[k] = r
            elif len(held) < 9:
                held.append(r)
            elif r[5] < held[-1][5]:
                held[-1] = r
            held.sort(key=lambda h: (h[5], h[1]))
        want[label] = [h[1] for h in held]
    got = {}
    for r in catalog.QUERIES["output_container"](spark, SF).orderBy("label", "place").collect():
        got.setdefault(r["label"], []).append(r["id"])
    assert got == want


def test_decoys_are_taken_closest_first(spark):
    d = [tuple(r) for r in Q.molecules(spark, SF).select("ligand", "MW", "LogP", "HBD").collect()]
    tol = (25.0, 0.5, 1.0)
    pairs = []
    for a in d:
        for b in d:
            if a[0] % 100 == 0 and b[0] % 100 != 0:
                far = max(abs(x - y) / t for x, y, t in zip(a[1:], b[1:], tol, strict=True))
                if far <= 1:
                    pairs.append((far, a[0], b[0]))
    used, count, want = set(), {}, set()
    for far, a, b in sorted(pairs):
        if b not in used and count.get(a, 0) < 5:
            used.add(b)
            count[a] = count.get(a, 0) + 1
            want.add((a, b, round(far, 9)))
    got = {(r["active"], r["decoy"], round(r["distance"], 9)) for r in catalog.QUERIES["match_decoys"](spark, SF).collect()}
    assert got == want and want


def test_alignments_are_the_best(spark):
    def best(a, b):
        t = [[(j * -2.0, 0) for j in range(len(b) + 1)]]
        for i, x in enumerate(a, 1):
            row = [(i * -2.0, 0)]
            for j, y in enumerate(b, 1):
                ways = [(t[i - 1][j - 1][0] + (2.0 if x == y else -1.0), t[i - 1][j - 1][1] + (x == y)), (t[i - 1][j][0] - 2, t[i - 1][j][1]), (row[-1][0] - 2, row[-1][1])]
                row.append(max(ways))
            t.append(row)
        return t[-1][-1]

    got = catalog.QUERIES["align_sequences"](spark, SF).collect()
    assert got and all((r["score"], r["matched"]) == best(r["first"], r["second"]) for r in got)


def test_seeds_lead_back(spark):
    import zlib

    for r in catalog.QUERIES["ligand_seeds"](spark, SF).limit(500).collect():
        assert r["seed"] == (42 + zlib.crc32(f"{r['receptor']}|{r['ligand']}".encode())) % 2147483647 + 1 and r["base"] == 42


def test_elastic_network_of_a_chain(spark):
    rnd = np.random.default_rng(3)
    xyz = rnd.normal(size=(12, 3)) * 4
    df = spark.createDataFrame([("s", k, *map(float, p)) for k, p in enumerate(xyz)], "k string, id long, x double, y double, z double")
    h = np.zeros((36, 36))
    for i in range(12):
        for j in range(12):
            d = xyz[j] - xyz[i]
            if i != j and d @ d <= 13.0**2:
                block = np.outer(d, d) / (d @ d)
                h[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] -= block
                h[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] += block
    want = [v for v in np.linalg.eigvalsh(h)[6:] if v > 1e-8][:10]
    got = [r["eigenvalue"] for r in structure.elastic_modes(df, ["k"]).orderBy("mode").collect()]
    assert got == pytest.approx(want)


def test_assignment_is_the_cheapest():
    rnd = np.random.default_rng(4)
    for n in range(1, 7):
        for _ in range(20):
            cost = rnd.integers(0, 9, (n, n)).astype(float)
            got = poses.assignment(cost)
            assert sorted(got.tolist()) == list(range(n))
            assert cost[np.arange(n), got].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_poses_cluster_whatever_the_order_of_equal_atoms(spark):
    rnd = random.Random(5)
    base = [("C", 0.0, 0.0, 0.0), ("C", 1.5, 0.0, 0.0), ("N", 0.0, 2.0, 0.0), ("C", 3.0, 0.0, 1.0)]
    rows = []
    for i, shift in enumerate([0.0, 0.2, 9.0, 9.3, 30.0]):
        order = [0, 1, 3]
        rnd.shuffle(order)
        carbons = [base[k] for k in order]
        own = [carbons[0], carbons[1], base[2], carbons[2]]
        rows += [("r", i, float(-i), k, e, x + shift, y, z) for k, (e, x, y, z) in enumerate(own)]
    df = spark.createDataFrame(rows, "run string, id long, energy double, atom int, element string, x double, y double, z double")
    got = {r["id"]: (r["cluster"], r["representative"], round(r["mean_rmsd"], 6)) for r in poses.cluster_poses(df, ["run"]).collect()}
    assert got == {4: (0, 4, 0.0), 2: (1, 3, 0.3), 3: (1, 3, 0.3), 0: (2, 1, 0.2), 1: (2, 1, 0.2)}


def test_pockets_join_the_nearest_track(spark):
    rows = [("s", "ref", 0, 0.0, 0.0, 0.0, ["a", "b"]), ("s", "ref", 1, 9.0, 0.0, 0.0, ["c"]), ("s", "x", 0, 1.0, 0.0, 0.0, ["a", "b"]), ("s", "x", 1, 0.5, 0.0, 0.0, ["a", "b"]), ("s", "x", 2, 9.0, 1.0, 0.0, ["z"])]
    df = spark.createDataFrame(rows, "s string, conformation string, pocket int, x double, y double, z double, lining array<string>")
    got = {(r["conformation"], r["pocket"]): r["track"] for r in pockets.match_pockets(df, ["s"], "ref").collect()}
    assert got == {("ref", 0): 0, ("ref", 1): 1, ("x", 0): 0, ("x", 1): 2, ("x", 2): 3}


def test_receptors_are_cleaned_by_kind(spark):
    rows = [(1, "CA", "C", "ASP", "A", 1), (2, "O", "O", "HOH", "A", 2), (3, "O", "O", "HOH", "A", 3), (4, "ZN", "ZN", "ZN", "A", 4), (5, "FE", "FE", "HEM", "A", 5)]
    rows += [(10 + k, f"C{k}", "C", "LIG", "A", 6) for k in range(14)]
    df = spark.createDataFrame([("s", *r, float(r[0]), 0.0, 0.0, 0.0) for r in rows], "k string, atom int, name string, element string, res_name string, chain string, res_id int, x double, y double, z double, charge double")
    ids = lambda d: sorted(r["atom"] for r in d.collect())
    ligand = list(range(10, 24))
    assert ids(receptors.clean_receptor(df, ["k"])) == [1, 5]
    assert ids(receptors.clean_receptor(df, ["k"], keep=("LIG",), drop=("HEM",))) == [1, *ligand]
    assert ids(receptors.clean_receptor(df, ["k"], keep_water_within=7.0, drop_ions=False)) == [1, 3, 4, 5]
    assert {r["kind"] for r in receptors.hetero_residues(df, ["k"]).collect()} == {"solvent", "ion", "cofactor", "ligand"}
    a, b = receptors.split_crystal(df, "lig")
    assert ids(b) == ligand and ids(receptors.ligand_molecules(df, ["k"])) == ligand and len(ids(a)) == 5


def test_documents_of_settings():
    a = {"b": 1, "a": [1, 2], "seed": 7}
    assert tables.canonical_json(a) == '{"a":[1,2],"b":1,"seed":7}'
    assert tables.settings_hash(a, ["seed"]) == tables.settings_hash({"a": [1, 2], "b": 1, "seed": 9}, ["seed"]) != tables.settings_hash(a)
    assert tables.check_resume(a, {"b": 2, "a": [1, 2], "seed": 8}, ["seed"]) == ["b"]
    assert tables.validated({"engine": {"scoring": "vina"}}) and tables.columns_for(["a", "b"], ["c", "a"]) == ["a", "b", "c"]
    with pytest.raises(tables.SettingsError, match="engine.exhaustiveness"):
        tables.validated({"engine": {"exhaustiveness": 0}})


def test_broken_records_keep_their_place(spark):
    good = "m1\n\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    1.0000   -2.5000    0.0000 N   0\nM  END\n"
    text = good + "$$$$\nm2\n\n\nnot a count line\n$$$$\n" + good.replace("  1  0", "  4  0") + "$$$$\n"
    got = tables.molecule_blocks(spark.createDataFrame([(1, text)], "id int, text string"), "text").orderBy("record").collect()
    assert [(r["name"], r["error"]) for r in got] == [("m1", ""), ("m2", "counts line"), ("m1", "too few lines")]
    assert (got[0]["atoms"][0]["x"], got[0]["atoms"][0]["y"], got[0]["atoms"][0]["element"]) == (1.0, -2.5, "N")


def test_rows_without_a_home_or_a_match(spark):
    rows = spark.createDataFrame([(1, 5, -9.0, None, -9.0, 1, 1.0)], "ligand int, best_receptor int, best double, home array<string>, home_affinity double, n_within int, box_ratio double")
    from quarry.operators import rollups

    assert rollups.homes_summary(rows, 0.5).first()["n"] == 0
    empty = spark.createDataFrame([], "label int, point int, x double, y double, z double")
    cells = spark.createDataFrame([(1, "p", "pocket", 0.0, 0.0, 0.0)], "s int, label string, kind string, x double, y double, z double")
    assert receptors.classify_points(empty.withColumnRenamed("label", "s"), cells, ["s"]).count() == 0
    assert poses.displaced_waters(spark.createDataFrame([(1, 2, 0.0, 0.0, 0.0)], "s int, pose int, x double, y double, z double"), spark.createDataFrame([], "s int, site int, x double, y double, z double"), ["s", "pose"], ["s"]).first()["displaced"] == 0


def test_planes_and_rotations(spark):
    from pyspark.sql import functions as F

    from quarry.functions import geometry

    rnd = np.random.default_rng(6)
    xyz = rnd.normal(size=(9, 3)) * [3, 2, 0.2]
    df = spark.createDataFrame([("a", *map(float, p)) for p in xyz] + [("flat", float(k), float(k * k), 1.0) for k in range(5)], "k string, x double, y double, z double")
    got = {r["k"]: r["planarity"] for r in geometry.planarity(df, ["k"]).collect()}
    assert got["a"] == pytest.approx(np.sqrt(np.linalg.eigvalsh(np.cov(xyz.T, bias=True))[0])) and got["flat"] == pytest.approx(0.0, abs=1e-6)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    turned = geometry.rotated(lit(1, 0, 0), lit(0, 0, 0), lit(0, 0, 5), F.lit(90.0))
    assert [round(x, 9) for x in spark.range(1).select(*turned).first()] == [0.0, 1.0, 0.0]
    assert tuple(spark.range(1).select(*geometry.rotated(lit(1, 2, 3), lit(0, 0, 0), lit(0, 0, 0), F.lit(90.0))).first()) == (1.0, 2.0, 3.0)


def test_many_pockets_join_tracks_as_one_by_one(spark):
    """Tracks of some hundred pockets, as a plain version has them; no pocket looks at all tracks."""
    rnd = random.Random(8)
    rows = [("s", str(c), p, *(rnd.gauss(0, 2) for _ in range(3)), sorted({rnd.choice("abcd"), rnd.choice("abcd")})) for c in range(3) for p in range(150)]
    tracks, want = [], {}
    for _, c, p, x, y, z, lining in rows:
        best = None
        for number, seen in enumerate(tracks):
            if any(o[0] == c for o in seen):
                continue
            near = min(seen, key=lambda o: sum((a - b) ** 2 for a, b in zip(o[1], (x, y, z), strict=True)))
            d = sum((a - b) ** 2 for a, b in zip(near[1], (x, y, z), strict=True)) ** 0.5
            share = len(near[2] & set(lining)) / len(near[2] | set(lining))
            if d <= 1.5 and share >= 0.3 and (best is None or d + (1 - share) * 1.5 < best[0]):
                best = d + (1 - share) * 1.5, number
        if best is None:
            tracks.append([])
        number = len(tracks) - 1 if best is None else best[1]
        tracks[number].append((c, (x, y, z), set(lining)))
        want[c, p] = number
    df = spark.createDataFrame(rows, "s string, conformation string, pocket int, x double, y double, z double, lining array<string>")
    got = {(r["conformation"], r["pocket"]): r["track"] for r in pockets.match_pockets(df, ["s"], "0", 1.5, 0.3).collect()}
    assert got == want


def test_resamples_are_not_shuffled(spark):
    """ROC areas of resamples equal those of weighted rows, ties and missing labels included; nothing is exploded before it is counted."""
    from quarry.operators import evalstats

    rnd = random.Random(9)
    rows = [(rnd.choice("pq"), rnd.choice([None, float("nan"), 1.0, 2.0, 3.0, 4.5]), rnd.choice([0, 0, 1, None]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "t string, s double, y int, i long")
    drawn = evalstats.resampled(df, ["t"], "i", 7, 5)
    found = drawn.of(evalstats.auc_statistic, "s", "y", ["t"])
    want = evalstats.auc_statistic(drawn.rows(), "s", "y", ["t", "b"])
    assert {(r["t"], r["b"]): r["value"] for r in found.collect()} == {(r["t"], r["b"]): r["value"] for r in want.collect()}


def test_poses_are_pruned_in_batches(spark, monkeypatch):
    """Poses of several atoms, some of which lack one, over many batches; what goes from batch to batch are the poses that were kept."""
    monkeypatch.setattr(poses, "FIRST_POSES", 8)
    rnd = random.Random(11)
    rows = [(g, i, a, *(rnd.gauss(0, 1) for _ in range(3))) for g in "uv" for i in range(90) for a in range(2) if a == 0 or i % 7]
    want, at = {}, {}
    for g, i, a, *xyz in rows:
        at.setdefault((g, i), {})[a] = xyz
    for g, i in sorted(at):
        def far(j):
            both = at[g, i].keys() & at[g, j].keys()
            return (sum(sum((p - q) ** 2 for p, q in zip(at[g, i][a], at[g, j][a], strict=True)) for a in both) / len(both)) ** 0.5 >= 0.9
        want[g, i] = all(far(j) for k, j in at if k == g and j < i and want[g, j])
    df = spark.createDataFrame(rows, "g string, id long, atom int, x double, y double, z double")
    assert {(r["g"], r["id"]): r["kept"] for r in poses.greedy_by_distance(df, ["g"], 0.9).collect()} == want and not all(want.values())


@pytest.mark.parametrize("least", [0, 100_000])
def test_equal_decoys_are_taken_in_order(spark, monkeypatch, least):
    """Many equal actives and decoys, gone through in rounds and in one task; no pair is made of actives that are full."""
    monkeypatch.setattr(structure, "LEAST_PAIRS", least)
    a, b = [(i, float(i % 2)) for i in range(6)], [(100 + i, (i % 5) / 4) for i in range(30)]
    used, count, want = set(), {}, set()
    for d, i, j in sorted((abs(x - y), i, j) for i, x in a for j, y in b if abs(x - y) <= 1):
        if j not in used and count.get(i, 0) < 3:
            used.add(j)
            count[i] = count.get(i, 0) + 1
            want.add((i, j, d))
    monkeypatch.setattr(structure, "FIRST_BAND", 4)
    got = structure.match_decoys(spark.createDataFrame(a, "id long, w double"), spark.createDataFrame(b, "id long, w double"), {"w": 1.0}, 3)
    assert {tuple(r) for r in got.collect()} == want


def test_matched_pairs_are_dealt(spark):
    """Pairs are made in as many tasks as the session shuffles, whatever the size of the molecules."""
    assert "REPARTITION_BY_NUM" in catalog.QUERIES["matched_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_matched_pairs_repeat_in_their_file(spark, tmp_path):
    """The result grows with the square of the members, its file does not: a run of partners is written once, not for each member."""
    rows = spark.range(1600).selectExpr("'t' AS core", "CAST(id % 2 AS string) AS x", "'y' AS y", "xxhash64(id) AS id", "CAST(id % 7 AS double) AS v")
    found = rollups.matched_pairs(rows, ["core"], ["x", "y"], "id", "v")
    found.coalesce(1).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    want = rows.alias("a").join(rows.alias("b"), F.expr("a.x <> b.x AND a.id < b.id")).selectExpr("'x' AS label", "a.id AS a", "b.id AS b", "a.x AS from", "b.x AS to", "b.v - a.v AS delta", "abs(b.v - a.v) >= 1 AS significant")
    assert got.count() == 800 * 800 and got.exceptAll(want).count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 640_000


def test_rounding_in_binary_gives_the_same_numbers(spark):
    odd = [0.0, -0.0, None, float("nan"), float("inf"), -1e-9, 5e-7, -5e-7, 1.0000005, 2.5e-6, 1234567.1234565, 1e12 + 0.1234565, -0.0125, 0.1 + 0.2]
    df = spark.createDataFrame([(x,) for x in odd], "v double").union(spark.range(20000).selectExpr("(xxhash64(id) % 20000000) / 2.0E7 * (id % 50) AS v"))
    both = df.select(F.round("v", 6).alias("want"), "v")
    got = Q.rounded_often(both, "v").where("NOT (want <=> v)")
    assert got.count() == 0 and Q.rounded_often(both, "v").where("CAST(v AS string) = '-0.0'").count() == 0


@pytest.mark.parametrize("links", [0, 3])
def test_butina_meets_neighbours_anew_while_they_are_many(spark, monkeypatch, links):
    """Clusters are those of going through the members one by one; pairs are written only of what is left."""
    draw = random.Random(4)
    own = {(k % 2, 7 * k - 100): {b for b in range(40) if draw.random() < (0.5 if k % 3 else 0.1)} for k in range(90)} | {(0, 999): set(), (5, 7): {1}}
    want = {}
    for group in (0, 1, 5):
        free = {i: b for (g, i), b in own.items() if g == group}
        while free:
            near = {i: [j for j in free if j != i and len(free[i] & free[j]) >= 0.4 * len(free[i] | free[j]) > 0] for i in free}
            seed = min(free, key=lambda i: (-len(near[i]), i))
            for j in [seed, *near[seed]]:
                want[group, j] = seed
            free = {i: b for i, b in free.items() if (group, i) not in want}
    pairs, meet = [], simjoin.similar_pairs
    monkeypatch.setattr(simjoin, "LINKS", links)
    monkeypatch.setattr(simjoin, "similar_pairs", lambda *a, **k: pairs.append(meet(*a, **k)) or pairs[-1])
    got = simjoin.butina(spark.createDataFrame([(g, i, sorted(b)) for (g, i), b in own.items()], "g int, id long, bits array<int>"), ["g"], 0.4, n_bits=64)
    assert {(r["g"], r["id"]): r["representative"] for r in got.collect()} == want and got.count() == len(own)
    assert len(pairs) == 1


@pytest.mark.parametrize("apart", [0.0, 500.0])
def test_modes_of_a_large_network_need_no_whole_hessian(monkeypatch, apart):
    """Also where two parts hang together in nothing, so that twelve modes have no stiffness."""
    rnd = np.random.default_rng(8)
    xyz = rnd.normal(size=(560, 3)) * 6
    xyz[280:, 0] += apart
    values, vectors = structure._network(xyz, 13.0)
    monkeypatch.setattr(structure, "_network", None)
    got, moved = structure._softest(xyz, 13.0, 10)
    assert got == pytest.approx(values[:10], rel=1e-9)
    assert np.abs((moved**2).sum(1) - (vectors[:, :10] ** 2).sum(1)).max() < 1e-6


def test_strongest_couplings_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(structure, "NODES", 7)
    rnd = np.random.default_rng(9)
    rows = [(k, 2 * i, *map(float, rnd.normal(size=3) * 4)) for k in "st" for i in range(40)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double, z double")
    every = structure.cross_correlation(df, ["k"])
    assert every.count() == 2 * 40 * 39 // 2 and every.where("i >= j").count() == 0
    want = structure.strongest_couplings(every, ["k"], 5, 3)
    few = structure.cross_correlation(df, ["k"], top=5, apart=3)
    assert few.count() < every.count()
    got = structure.strongest_couplings(few, ["k"], 5, 3)
    assert sorted(map(tuple, got.select("k", "rank", "i", "j").collect())) == sorted(map(tuple, want.select("k", "rank", "i", "j").collect()))
    xyz = {k: np.array([r[2:] for r in rows if r[0] == k]) for k in "st"}
    for r in want.collect():
        values, vectors = structure._network(xyz[r["k"]], 13.0)
        c = sum(np.outer(a, a).reshape(40, 3, 40, 3).trace(axis1=1, axis2=3) / v for a, v in zip(vectors.T[:10], values[:10], strict=True))
        i, j = r["i"] // 2, r["j"] // 2
        assert r["c"] == pytest.approx(c[i, j] / np.sqrt(c[i, i] * c[j, j]))
