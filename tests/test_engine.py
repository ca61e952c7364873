"""Operators on small data with values worked out by hand, and the queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import catalog
from quarry import queries as Q
from quarry.functions import filters as rules
from quarry.functions import metrics as m
from quarry.functions import similarity as sim
from quarry.operators import evalstats, library, ranking, simjoin, spatial
from quarry.sources import records
from quarry.streaming import append_log

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def bits(*x):
    return F.array(*[F.lit(i) for i in x]) if x else F.array().cast("array<int>")


def test_similarity(spark):
    a, b = bits(1, 2), bits(2, 3, 4)
    assert one(spark, sim.similarity(a, b)) == pytest.approx(1 / 4)
    assert one(spark, sim.similarity(a, b, "dice")) == pytest.approx(2 / 5)
    assert one(spark, sim.similarity(a, b, "tversky", 0.5, 0.5)) == pytest.approx(1 / 2.5)
    assert one(spark, sim.similarity(a, b, "tversky", 0.5, 1.0)) == pytest.approx(1 / 3.5)
    assert one(spark, sim.similarity(bits(), bits())) == 0.0
    assert one(spark, sim.contact_similarity(bits(0, 0), bits(0, 0))) is None
    with pytest.raises(ValueError):
        sim.from_counts(F.lit(1), F.lit(1), F.lit(1), "other")


def test_metrics(spark):
    assert one(spark, m.p_activity(F.lit(-8.22))) == pytest.approx(6.0)
    assert one(spark, m.p_activity(F.lit(float("nan")))) is None
    assert one(spark, m.ligand_efficiency(F.lit(-8.0), F.lit(0))) is None
    assert one(spark, m.entropy_penalty(F.lit(1))) == pytest.approx(0.6509, abs=1e-4)
    assert one(spark, m.grid_points(F.lit(17.883), F.lit(19.95), F.lit(20.514))) == 150920
    assert one(spark, m.rotor_scaled_attempts(F.lit(0))) == 16
    assert one(spark, m.eta_text(F.lit(3725))) == "1:02:05" and one(spark, m.eta_text(F.lit(65))) == "1:05"
    seed = m.ligand_seed(F.lit(42), F.lit("rec"), F.lit("lig"))
    assert one(spark, m.base_seed_of(seed, F.lit("rec"), F.lit("lig"))) == 42
    assert one(spark, m.valid_pdb_id(F.lit(" 1abc "))) == "1ABC" and one(spark, m.valid_pdb_id(F.lit("1ab"))) is None
    assert one(spark, m.curl(F.lit(10.0), 10)) == 5.0
    assert one(spark, m.torsion_bin(F.lit(-1.0))) == 5
    points = [tuple(F.lit(float(c)) for c in p) for p in ((1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1))]
    assert abs(one(spark, m.dihedral(points))) == pytest.approx(90.0)
    assert one(spark, m.usr_similarity(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0)))) == pytest.approx(0.4)


def test_rules(spark):
    c = {"MW": F.lit(501.0), "LogP": F.lit(5.0), "HBD": F.lit(None), "HBA": F.lit(1)}
    assert one(spark, rules.violations(rules.LIPINSKI, c)) == ["MW", "HBD"]
    w = one(spark, rules.parse_window(F.lit(" :7.5")))
    assert (w["low"], w["high"]) == (None, 7.5)


def test_ranks(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 20.0), ("a", 4, 30.0), ("a", 5, float("nan")), ("b", 6, 1.0)], "k string, i int, v double")
    got = {r["i"]: r for r in ranking.z_scores(ranking.normalised_ranks(ranking.average_ranks(df, "v", ["k"]), "v", ["k"]), "v", ["k"]).collect()}
    assert [got[i]["rank"] for i in (1, 2, 3, 4, 5)] == [1, 2.5, 2.5, 4, None]
    assert got[2]["norm_rank"] == 0.5 and got[6]["norm_rank"] == 0.0 and got[6]["z"] == 0.0
    assert ranking.spearman(df.withColumn("w", F.lit(1.0)), "v", "w", ["k"]).where("k = 'a'").first()["rho"] is None
    c = ranking.consensus(df.withColumn("w", -F.col("v")), ["v", "w"], ["k"], "i").where("i = 5").first()
    assert c["missing"] == ["v", "w"] and c["consensus"] == 1.0


def test_global_positions_count_on(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("v"), "id")
    got = ranking.global_positions(df, [F.col("v")]).collect()
    assert all(r["position"] == r["v"] + 1 for r in got)


def test_evaluation(spark):
    perfect = [("p", k, float(100 - k), int(k < 10)) for k in range(100)]
    worst = [("w", k, float(k), int(k < 10)) for k in range(100)]
    df = spark.createDataFrame(perfect + worst, "t string, i int, s double, y int")
    got = {r["t"]: r for r in evalstats.metrics(df, "s", "y", ["t"], "i").collect()}
    assert (got["p"]["auc"], got["p"]["bedroc"], got["p"]["ef5"]) == (1.0, 1.0, 10.0)
    assert got["w"]["auc"] == 0.0 and got["w"]["ef1"] == 0.0
    ci = evalstats.bootstrap_interval(df, "s", "y", ["t"], "i", evalstats.mean_statistic).where("t = 'p'").first()
    assert ci["low"] < 50.5 < ci["high"]
    d = {r["t"]: r for r in evalstats.paired_difference(df.withColumn("o", -F.col("s")), "s", "o", "y", ["t"], "i", samples=20).collect()}
    assert d["p"]["difference"] == pytest.approx(1.0) and d["w"]["difference"] == pytest.approx(-1.0)
    assert evalstats.minimum_detectable_difference(1.0) == pytest.approx(2.8016, abs=1e-3)


def test_ranks_of_a_ranking(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 3.0), ("a", 4, None), ("b", 5, 1.0)], "k string, i int, s double")
    assert {r["i"]: r["rank"] for r in evalstats.ranks_of(df, "s", ["k"], "i").collect()} == {2: 1, 3: 2, 1: 3, 4: 4, 5: 1}
    assert {r["i"]: r["rank"] for r in evalstats.ranks_of(df, "s", [], "i").collect()} == {2: 1, 3: 2, 1: 3, 5: 4, 4: 5}


def test_corrected_sums_that_are_equal_are_ties(spark):
    df = spark.createDataFrame([("r", "a", -0.1, 0.4), ("r", "b", 0.1, 0.2), ("r", "c", 0.3, float("nan"))], "k string, run string, affinity double, strain double")
    got = {r["run"]: (r["rank"], r["corrected_rank"]) for r in ranking.corrected_ranking(df, "affinity", "strain", ["k"], "run").collect()}
    assert -0.1 + 0.4 > 0.3 or 0.1 + 0.2 > 0.3
    assert got == {"a": (1, 1), "b": (2, 2), "c": (3, 3)}


def test_picks(spark):
    sets = spark.createDataFrame([(1, "x", [1, 2, 3]), (2, "x", [1, 2, 3]), (3, "x", [9]), (4, "x", [1, 2, 4])], "id int, label string, bits array<int>")
    assert [r["id"] for r in simjoin.maxmin_pick(sets, ["label"], 3).orderBy("pick").collect()] == [1, 3, 4]
    assert [r["id"] for r in simjoin.sphere_exclusion(sets, ["label"], 0.6).orderBy("pick").collect()] == [1, 3, 4]
    assert {r["id"]: r["representative"] for r in simjoin.butina(sets, ["label"], 0.5).collect()} == {1: 1, 2: 1, 4: 1, 3: 3}
    pairs = {(r["a"], r["b"]): r["tanimoto"] for r in simjoin.similar_pairs(sets, 0.5).collect()}
    assert pairs == {(1, 2): 1.0, (1, 4): 0.5, (2, 4): 0.5}


def test_space(spark):
    atoms = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0, 1.7), ("t", 1, 0.0, 0.0, 0.0, 1.7), ("t", 2, 1.0, 0.0, 0.0, 1.7)], "k string, atom int, x double, y double, z double, radius double")
    area = {(r["k"], r["atom"]): r["sasa"] for r in spatial.sasa(atoms, ["k"]).collect()}
    assert area["s", 1] == pytest.approx(4 * 3.141592653589793 * 3.1**2) and area["t", 1] < area["s", 1]
    near = spatial.nearest_within(atoms, atoms.where("atom = 2"), 2.0, "atom", "atom", ["k"]).collect()
    assert {(r["k"], r["atom"]): r["nearest"] for r in near} == {("s", 1): None, ("t", 1): 2, ("t", 2): 2}
    rows = [("a", i, *p, p[1] + 5, -p[0] + 1, p[2]) for i, p in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 3.0)])]
    fit = spatial.superposed_rmsd(spark.createDataFrame(rows, "k string, i int, ax double, ay double, az double, bx double, by double, bz double"), ["k"]).first()
    assert fit["rmsd"] == pytest.approx(0.0, abs=1e-9)


def test_audit_balances(spark):
    df = spark.createDataFrame([(1, "C C"), (2, "c  c"), (3, "C C"), (4, ""), (5, None), (6, "N")], "pos int, text string")
    audit = library.standardise(df, "pos", "text", F.col("pos") != 6)
    got = {r["pos"]: (r["status"], r["reason"], r["merged_into"], r["merge_kind"]) for r in audit.collect()}
    assert got == {1: ("kept", "", None, ""), 2: ("merged", "", 1, "normalised"), 3: ("merged", "", 1, "exact"), 4: ("rejected", "invalid", None, ""), 5: ("rejected", "invalid", None, ""), 6: ("rejected", "property", None, "")}
    assert library.balance(audit).first()["balanced"]


def test_desalt(spark):
    df = spark.createDataFrame([(1, "CCO.Cl"), (2, "CC.NN"), (3, ".".join("CCCCCCCCC"))], "i int, f string")
    assert {r["i"]: (r["parent"], r["refused"]) for r in library.desalt(df, "i", "f").collect()} == {1: ("CCO", ""), 2: (None, "tie"), 3: (None, "too many parts")}


def test_structure_files(spark, tmp_path):
    line = records.format_atom(*[F.lit(v) for v in (7, "CA", "GLY", "A", 12, 1.5, -2.25, 3.0, 1.0, 0.0, -0.5, "C")])
    text = "MODEL 1\n" + one(spark, line) + "\nENDMDL\nMODEL 2\n" + one(spark, line) + "\nENDMDL\n"
    (tmp_path / "a.pdbqt").write_text(text)
    got = records.read_structures(spark, str(tmp_path / "a.pdbqt")).orderBy("model").collect()
    assert [(r["model"], r["name"], r["res_id"], r["x"], r["y"], r["charge"], r["ad_type"]) for r in got] == [(k, "CA", 12, 1.5, -2.25, -0.5, "C") for k in (1, 2)]
    assert one(spark, records.remarks(F.lit("REMARK VINA RESULT:   -7.5   1.25   2.5")))["rmsd_lb"] == 1.25
    assert one(spark, records.torsdof(F.lit("ROOT\nTORSDOF 4\n"))) == 4


def test_logs_and_libraries(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"receptor":"r","ligand":"l","seed":1,"status":"ok","affinity":-7.1}\n{"receptor":"r","lig')
    assert [r["ligand"] for r in records.read_results(spark, str(tmp_path / "r.jsonl")).collect()] == ["l"]
    (tmp_path / "l.smi").write_text("# comment\nCCO ethanol\n\nCC\n")
    assert {(r["smiles"], r["name"]) for r in records.read_smiles(spark, str(tmp_path / "l.smi")).collect()} == {("CCO", "ethanol"), ("CC", None)}
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert records.to_json_lines(df).first()["value"] == '{"a":1}'
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "m.txt").write_text("x")
    found = records.member_digests(spark, str(tmp_path / "box"))
    manifest = spark.createDataFrame([("m.txt", 1, "0"), ("n.txt", 1, "0")], "name string, size long, sha256 string")
    assert {r["name"]: r["state"] for r in records.verify_members(found, manifest).collect()} == {"m.txt": "changed", "n.txt": "missing"}


def test_append_log_writes_each_key_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "receptor string, ligand string, status string, at long"
    rows = [("r", "a", "ok", 2), ("r", "a", "failed", 1), ("r", "b", "ok", 3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(src)
    append_log.append_once(spark, src, schema, out, check, ["receptor", "ligand"], ["at"]).awaitTermination()
    spark.createDataFrame([("r", "a", "ok", 9), ("r", "c", "ok", 4)], schema).coalesce(1).write.mode("append").json(src)
    append_log.append_once(spark, src, schema, out, check, ["receptor", "ligand"], ["at"]).awaitTermination()
    got = {(r["ligand"], r["status"], r["at"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", "failed", 1), ("b", "ok", 3), ("c", "ok", 4)}
    assert {(r["status"], r["n"]) for r in append_log.progress(spark, out).collect()} == {("failed", 1), ("ok", 2)}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = tables.sql(catalog.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)

    def key(v):
        return f"{v + 0.0:.7g}" if isinstance(v, float) else str(v)

    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(key(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(key(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_structures(spark):
    from quarry.operators import structure

    assert structure.global_alignment("GATTACA", "GATTACA") == (14.0, 7)
    assert structure.global_alignment("AC", "A") == (0.0, 1)
    line = [("s", k, float(x), 0.0, 0.0, float(e), k) for k, (x, e) in enumerate([(0, 5), (1, 4), (2, 3), (9, 1), (9.5, 2)])]
    df = spark.createDataFrame(line, "k string, id long, x double, y double, z double, energy double, step int")
    got = {r["id"]: (r["cluster"], r["representative"]) for r in structure.linkage_clusters(df, ["k"], 1.0).collect()}
    assert got == {0: (2, 2), 1: (2, 2), 2: (2, 2), 3: (1, 3), 4: (1, 3)}
    assert {r["id"]: r["site"] for r in structure.leader_sites(df, ["k"], 1.0).collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
    assert [r["id"] for r in structure.bounded_poses(df, ["k"], 0.6, 2).orderBy("place").collect()] == [3, 2]
    edges = spark.createDataFrame([("s", 1, 2, 1.0), ("s", 2, 3, 1.0), ("s", 1, 3, 5.0), ("t", 1, 2, 1.0)], "k string, i int, j int, cost double")
    assert [(r["k"], r["nodes"], r["cost"]) for r in structure.shortest_paths(edges, ["k"], 1, 3).collect()] == [("s", [1, 2, 3], 2.0)]
    a = spark.createDataFrame([(1, 1.0), (2, 1.1)], "id int, w double")
    b = spark.createDataFrame([(7, 1.0), (8, 1.3), (9, 5.0)], "id int, w double")
    assert {(r["active"], r["decoy"]) for r in structure.match_decoys(a, b, {"w": 0.5}, 1).collect()} == {(1, 7), (2, 8)}
