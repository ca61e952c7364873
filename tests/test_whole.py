"""Queries take all of their input: none leaves rows out."""

import duckdb
import pytest

from quarry import catalog
from quarry import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_points(spark, tmp_path_factory):
    """2100 points in one structure, far from each other but for the last two."""
    home = str(tmp_path_factory.mktemp("points"))
    rows = [(k, "s", [float(k), 0.0, 0.0]) for k in range(2099)] + [(2099, "s", [2098.05, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{home}/embeddings.parquet")
    return home


def test_area_of_every_atom(spark, many_points):
    area = {r["atom"]: r["sasa"] for r in catalog.QUERIES["atom_sasa"](spark, many_points).collect()}
    assert sorted(area) == list(range(2100))
    assert area[2098] < area[2094]  # of one element; the last atom covers a part


def test_areas_meet_no_pairs_of_atoms(spark, monkeypatch):
    """A dense structure: points are tried against a few atoms of each cell, then against all, in blocks of any size."""
    import numpy as np
    from pyspark.sql import functions as F

    from quarry.operators import spatial

    monkeypatch.setattr(spatial, "range_join", lambda *a, **k: pytest.fail("pairs of atoms"))
    at = np.random.default_rng(3).normal(0, 2.5, (400, 3))
    rows = [("s", k, *map(float, p), 1.2 if k % 3 else 1.8) for k, p in enumerate(at)]
    atoms = spark.createDataFrame(rows, "k string, atom int, x double, y double, z double, radius double")
    one, two = atoms.where("atom % 4 = 0"), atoms.where("atom % 4 <> 0")
    sphere, r, want = spatial._sphere(92), np.array([x[5] for x in rows]) + 1.4, {}
    for k in range(0, 400, 4):
        d2 = ((at[k] + r[k] * sphere)[:, None, :] - np.delete(at, k, 0)[None]) ** 2
        want[k] = float((d2.sum(2) >= np.delete(r, k) ** 2).all(1).mean() * 4 * np.pi * r[k] ** 2)
    for name, v in (("CHUNK", 40), ("BLOCK", 110), ("PACK", 5000)):
        monkeypatch.setattr(spatial, name, v)
    got = {x["atom"]: x["sasa"] for x in spatial.sasa(one, ["k"], others=two).collect()}
    assert got == pytest.approx(want)
    lone = spark.createDataFrame([(None, 1, 0.0, 0.0, 0.0, 1.7), ("a", 2, None, 0.0, 0.0, 1.7)], atoms.schema)
    assert lone.count() == spatial.sasa(lone, ["k"]).where(F.col("sasa") > 0).count()


def test_areas_meet_what_covers_them_in_every_pack(spark, monkeypatch):
    """Atoms and what covers them are dealt alike however many packs there are: the free, the bound and the residues' areas equal their SQL."""
    from quarry.operators import spatial

    monkeypatch.setattr(spatial, "PACK", 20)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    for name in ("atom_sasa", "burial_free", "buried_contact_per_pose", "complex_desolvation", "interface_area"):
        want = con.execute(catalog.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).select(columns).collect())) == sorted(want.fetchall()), name


def test_pairs_of_sets_meet_once(spark):
    """No posting of a set meets a partner on each bit, and no pair is counted in a shuffle."""
    import random

    from quarry.operators import simjoin

    draw = random.Random(5)
    own = {(k % 2, k): {b for b in range(0, 130, 3) if draw.random() < 0.4} for k in range(60)} | {(0, 60): set()}
    sets = spark.createDataFrame([(k, i, sorted(b)) for (k, i), b in own.items()], "k int, id int, bits array<int>")
    found = simjoin.similarity_matrix(sets, ["k"], n_bits=130)
    want = {(i, j): len(x & y) for (k, i), x in own.items() for (q, j), y in own.items() if k == q and i < j and x & y}
    assert {(r["a"], r["b"]): r["common"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "ShuffledHashJoin" in plan
    low = sets.withColumn("bits", spark_filter("bits", 64))
    pairs = {(r["a"], r["b"]) for r in simjoin.similar_pairs(low, 0.3, keys=["k"], n_bits=64).collect()}
    cut = {k: {b for b in v if b < 64} for k, v in own.items()}
    assert pairs == {(i, j) for (k, i), x in cut.items() for (q, j), y in cut.items() if k == q and i < j and x & y and len(x & y) / len(x | y) >= 0.3}
    best = {r["id"]: r["score"] for r in simjoin.best_reference_scores(sets.withColumnRenamed("k", "label"), sets.withColumnRenamed("k", "label").where("id < 4"), n_bits=130).collect()}
    assert best == pytest.approx({i: max([len(x & y) / len(x | y) for (q, j), y in own.items() if j < 4 and q != k and x & y], default=0.0) for (k, i), x in own.items()})


def test_contact_pairs_are_dealt(spark):
    """A structure's pairs go through many tasks."""
    plan = catalog.QUERIES["contact_similarity"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "part_x" in plan and "part_y" in plan and "ShuffledHashJoin" in plan


def spark_filter(column, below):
    from pyspark.sql import functions as F

    return F.filter(column, lambda b: b < below)


def test_networks_have_all_nodes(spark):
    table = Q.table(spark, SF, "embeddings")
    structures = [r["label"] for r in table.select("label").distinct().collect()]
    late = {r["vec_id"] for r in table.where("vec_id >= 400").select("vec_id").collect()}
    found = Q.QUERIES["strongest_couplings"](spark, SF).collect()
    assert {r["label"] for r in found} == set(structures)
    assert late & ({r["i"] for r in found} | {r["j"] for r in found})
    want = {(r["label"], r["mode"]): r["eigenvalue"] for r in Q.structure.elastic_modes(Q._posed(spark, SF), ["label"]).collect()}
    got = {(r["label"], r["mode"]): r["eigenvalue"] for r in Q.QUERIES["elastic_modes"](spark, SF).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", ["bootstrap_interval", "paired_difference"])
def test_bootstraps_draw_a_thousand_resamples(spark, monkeypatch, name):
    drawn, draw = [], Q.evalstats.resampled

    def noted(df, keys, item, samples, seed):
        drawn.append(samples)
        return draw(df, keys, item, samples, seed)

    monkeypatch.setattr(Q.evalstats, "resampled", noted)
    Q.QUERIES[name](spark, SF)
    assert drawn == [1000]


def plain(sql):
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(sql).fetchall()


def test_panel_has_all_receptors(spark):
    got = {(r["ligand"], int(c.split(":")[0])) for r in Q.QUERIES["panel_matrix"](spark, SF).collect() for c in r["cells"].split(",")}
    assert got == {(r[0], r[1]) for r in plain(Q.CELLS + "SELECT ligand, receptor FROM cells")}


def test_pending_jobs_have_all_ligands(spark):
    got = sorted(tuple(r) for r in Q.QUERIES["pending_jobs"](spark, SF).select("receptor", "ligand").collect())
    assert got == sorted(plain("SELECT s_suppkey, p_partkey FROM supplier, part WHERE (s_suppkey, p_partkey) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem)"))


def test_pending_jobs_fill_little_disk(spark, tmp_path):
    """Runs of receptors repeat in the files of the product: a small part of a byte a pair, where receptors in full lists took more than one."""
    from quarry.operators import library

    ligands, receptors = spark.range(1000).toDF("ligand"), spark.range(3000).toDF("receptor")
    done = spark.range(40_000).selectExpr("id % 1000 AS ligand", "id * 7 % 3000 AS receptor").union(spark.sql("VALUES (CAST(NULL AS LONG), 1L), (1L, NULL)"))
    library.pending_pairs(ligands, receptors, done).write.parquet(str(tmp_path / "left"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW found AS SELECT * FROM '{tmp_path}/left/*.parquet'")
    done = "SELECT DISTINCT range % 1000 AS ligand, range * 7 % 3000 AS receptor FROM range(40000)"
    n, distinct = con.sql("SELECT count(*), count(DISTINCT ligand * 3000 + receptor) FROM found").fetchall()[0]
    assert n == distinct == 3_000_000 - con.sql(f"SELECT count(*) FROM ({done})").fetchall()[0][0]
    assert con.sql(f"SELECT count(*) FROM found SEMI JOIN ({done}) USING (ligand, receptor)").fetchall()[0][0] == 0
    assert sum(f.stat().st_size for f in (tmp_path / "left").glob("*.parquet")) < n / 2


@pytest.mark.parametrize("parts", ["3", "8"])
def test_positions_are_whole_and_distinct(spark, tmp_path, parts):
    """Borders sampled anew by each plan would number rows twice, or not at all."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quarry.operators import ranking

    rows = spark.range(300_000).select((F.pmod(F.xxhash64("id"), F.lit(500))).alias("v"), "id", (F.col("id") % 3).alias("k"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        w = Window.partitionBy("k").orderBy("v", "id")
        assert ranking.positions(rows, ["k"], ["v", "id"]).withColumn("w", F.row_number().over(w)).where("w <> position").count() == 0
        assert ranking.running_total(rows, ["k"], ["v", "id"], "v", "upto").withColumn("w", F.sum("v").over(w)).where("w <> upto").count() == 0
        got = ranking.global_positions(rows, [F.col("v").desc(), F.col("id")]).agg(F.count_distinct("position"), F.min("position"), F.max("position")).first()
        assert tuple(got) == (300_000, 1, 300_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["build_model", "detect_pockets"])
def test_tables_of_rounds_stay_off_the_driver(spark, monkeypatch, name):
    """Joins that are made in each round broadcast nothing that grows."""
    from quarry.operators import lattice, pharmacophores, simjoin
    from quarry.plans import components, stages

    plans, write = [], stages.written

    def noted(df, *a, **b):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *a, **b)

    for module in (lattice, pharmacophores, simjoin, components):
        monkeypatch.setattr(module, "written", noted)
    Q.QUERIES[name](spark, SF)
    grown = [p for p in plans if "neighbours" in p or "moves" in p or "links" in p]
    assert grown and not any("BroadcastHashJoin" in p for p in grown)


def test_pairs_of_dense_structures_take_no_paths(spark):
    """Paths of dense structures never become rows; pairs are whole across blocks, and the fewest bonds count."""
    import re

    from pyspark.sql import functions as F

    from quarry.operators import reach, receptors

    n = 2 * reach.BLOCK + 100
    chain = spark.range(n).selectExpr("'chain' AS s", "id AS i", "id + 1 AS j")
    ring = spark.range(4).selectExpr("'ring' AS s", "least(id, (id + 1) % 4) AS i", "greatest(id, (id + 1) % 4) AS j")
    clique = spark.range(300 * 300).selectExpr("'clique' AS s", "id div 300 AS i", "id % 300 AS j").where("i < j")
    found = receptors.bonded_within(chain.union(ring).union(clique), ["s"])
    assert not re.search("(?<!Object)HashAggregate", found._jdf.queryExecution().executedPlan().toString())
    found = found.cache()
    counts = {(r["s"], r["steps"]): r["n"] for r in found.groupBy("s", "steps").agg(F.count("*").alias("n")).collect()}
    assert counts == {("chain", 1): n, ("chain", 2): n - 1, ("chain", 3): n - 2, ("ring", 1): 4, ("ring", 2): 2, ("clique", 1): 300 * 299 // 2}
    assert found.where("s = 'chain' and j - i <> steps or i >= j").count() == 0
    assert found.distinct().count() == sum(counts.values())
    assert {r["steps"] for r in receptors.bonded_within(ring, ["s"], 1).collect()} == {1}
