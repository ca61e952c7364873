"""Poses, campaigns, libraries and files on the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from quarry.operators import poses, ranking, rollups
from quarry.plans.stages import new_path
from quarry.sources import tables

from .queries import CELLS, MOLECULES, POINTS, RESULTS, molecules, ok_rows, points, query, results, rounded, table
from .queries_receptors import RATOMS, atoms

# -- scores of poses -------------------------------------------------------------------------------------

VINA = "-0.035579::DOUBLE * exp(-(s / 0.5::DOUBLE) * (s / 0.5::DOUBLE)) - 0.005156::DOUBLE * exp(-((s - 3) / 2) * ((s - 3) / 2)) + CASE WHEN s < 0 THEN 0.840245::DOUBLE * s * s ELSE 0 END + CASE WHEN hyd THEN -0.035069::DOUBLE * greatest(0, least(1, 1.5::DOUBLE - s)) ELSE 0 END + CASE WHEN hb THEN -0.587439::DOUBLE * greatest(0, least(1, s / -0.7::DOUBLE)) ELSE 0 END"
VINARDO = "-0.045::DOUBLE * exp(-(s / 0.8::DOUBLE) * (s / 0.8::DOUBLE)) + CASE WHEN s < 0 THEN 0.8::DOUBLE * s * s ELSE 0 END + CASE WHEN hyd THEN -0.035::DOUBLE * greatest(0, least(1, (s - 2.5::DOUBLE) / -2.5::DOUBLE)) ELSE 0 END + CASE WHEN hb THEN -0.6::DOUBLE * greatest(0, least(1, s / -0.6::DOUBLE)) ELSE 0 END"
POSED = RATOMS + """, posed AS (SELECT label, CAST(atom % 3 AS INTEGER) AS pose, atom, radius, element = 'C' AS h, element = 'N' AS don, element = 'S' AS acc, x, y, z FROM ratoms WHERE atom % 4 = 0), wall AS (SELECT label, radius, element = 'C' AS h, element = 'N' AS don, element = 'S' AS acc, x, y, z FROM ratoms WHERE atom % 4 <> 0),
pr AS (SELECT p.label, pose, atom, sqrt(pow(p.x - w.x, 2) + pow(p.y - w.y, 2) + pow(p.z - w.z, 2)) - p.radius - w.radius AS s, p.h AND w.h AS hyd, (p.don AND w.acc) OR (p.acc AND w.don) AS hb FROM posed p JOIN wall w ON p.label = w.label AND pow(p.x - w.x, 2) + pow(p.y - w.y, 2) + pow(p.z - w.z, 2) < 64)
"""


def typed(a: DataFrame) -> DataFrame:
    return a.withColumns({"hydrophobic": F.col("element") == "C", "donor": F.col("element") == "N", "acceptor": F.col("element") == "S"})


def exact(spark, sf_dir) -> DataFrame:
    a = typed(atoms(spark, sf_dir))
    return poses.exact_scores(a.where("atom % 4 = 0").withColumn("pose", F.pmod("atom", F.lit(3)).cast("int")), a.where("atom % 4 <> 0"), ["label", "pose"], ["label"])


@query(POSED + f", byatom AS (SELECT label, pose, atom, sum({VINA}) AS vina, sum({VINARDO}) AS vinardo FROM pr GROUP BY ALL), t AS (SELECT label, pose, sum(CASE WHEN vina > 0 THEN vina * 10 / (10 + vina) ELSE vina END) AS vina, sum(CASE WHEN vinardo > 0 THEN vinardo * 10 / (10 + vinardo) ELSE vinardo END) AS vinardo FROM byatom GROUP BY ALL) SELECT label, pose, 'vina' AS field, round(vina, 5) AS inter FROM t UNION ALL SELECT label, pose, 'vinardo', round(vinardo, 5) FROM t")
def rescore_poses(spark, sf_dir):
    return rounded(exact(spark, sf_dir), "inter", places=5)


@query(RESULTS + "SELECT run, round(affinity, 6) AS affinity, round(second + third - strain, 6) AS base, round(affinity - (second + third - strain), 6) AS torsion FROM results")
def decomposition_rows(spark, sf_dir):
    d = results(spark, sf_dir).withColumnsRenamed({"second": "inter", "third": "intra", "strain": "unbound"})
    return rounded(poses.decomposition(d).select("run", "affinity", "base", "torsion"), "affinity", "base", "torsion")


SWAPS = RESULTS + ", c AS (SELECT ligand, conformation, min(affinity) AS v, min(ligand % 4 + 1) AS own FROM results GROUP BY ALL), g AS (SELECT ligand, count(v) AS n, max(v) AS w, min(v) AS l, max(v) FILTER (conformation = own) AS o, min((v, conformation))[2] AS b FROM c GROUP BY ligand)\n"


def swaps(spark, sf_dir):
    return results(spark, sf_dir).groupBy("ligand", "conformation").agg(F.min("affinity").alias("v")).withColumn("own", (F.pmod("ligand", F.lit(4)) + 1).cast("int"))


@query(SWAPS + "SELECT ligand, round(CASE WHEN n > 1 THEN w - l ELSE 0 END, 9) AS spread, round(w - o, 9) AS worst_penalty, b AS best_conformation FROM g")
def cross_rescoring(spark, sf_dir):
    return rounded(poses.swap_summary(swaps(spark, sf_dir), ["ligand"], "conformation", "v", "own"), "spread", "worst_penalty", places=9)


THREE = RESULTS + """, k AS (SELECT * FROM results WHERE status = 'ok'), r AS (SELECT *, rank() OVER (PARTITION BY receptor ORDER BY affinity) + (count(*) OVER (PARTITION BY receptor, affinity) - 1) / 2::DOUBLE AS ra, rank() OVER (PARTITION BY receptor ORDER BY second) + (count(*) OVER (PARTITION BY receptor, second) - 1) / 2::DOUBLE AS rb, rank() OVER (PARTITION BY receptor ORDER BY third) + (count(*) OVER (PARTITION BY receptor, third) - 1) / 2::DOUBLE AS rc FROM k),
rho AS (SELECT receptor, corr(ra, rb) AS ab, corr(ra, rc) AS ac, corr(rb, rc) AS bc FROM r GROUP BY receptor)
"""


@query(THREE + "SELECT receptor, unnest(['affinity', 'affinity', 'second']) AS first, unnest(['second', 'third', 'third']) AS second, round(unnest([ab, ac, bc]), 6) AS rho FROM rho")
def field_correlations(spark, sf_dir):
    return rounded(poses.agreement(ok_rows(spark, sf_dir), ["affinity", "second", "third"], ["receptor"]), "rho")


@query(THREE + "SELECT receptor, round((ab + ac + bc) / 3, 6) AS agreement FROM rho")
def consensus_agreement(spark, sf_dir):
    return rounded(poses.mean_agreement(ok_rows(spark, sf_dir), ["affinity", "second", "third"], ["receptor"]), "agreement")


@query(THREE + "SELECT receptor, unnest(['affinity', 'second', 'third']) AS field, round(unnest([1::DOUBLE, ab, ac]), 6) AS affinity, round(unnest([ab, 1::DOUBLE, bc]), 6) AS second, round(unnest([ac, bc, 1::DOUBLE]), 6) AS third FROM rho")
def consensus_matrix(spark, sf_dir):
    return rounded(poses.agreement_matrix(ok_rows(spark, sf_dir), ["affinity", "second", "third"], ["receptor"]), "affinity", "second", "third")


@query(RESULTS + """, p AS (SELECT *, row_number() OVER (PARTITION BY receptor, ligand ORDER BY run) AS mode FROM results WHERE status = 'ok'), f AS (SELECT * FROM p WHERE mode = 1),
r AS (SELECT receptor, ligand, count(*) OVER w AS n, rank() OVER (PARTITION BY receptor ORDER BY affinity) + (count(*) OVER (PARTITION BY receptor, affinity) - 1) / 2::DOUBLE AS ra, rank() OVER (PARTITION BY receptor ORDER BY second) + (count(*) OVER (PARTITION BY receptor, second) - 1) / 2::DOUBLE AS rb FROM f WINDOW w AS (PARTITION BY receptor)),
s AS (SELECT receptor, ligand, CASE WHEN n > 1 THEN ((ra - 1) / (n - 1) + (rb - 1) / (n - 1)) / 2 ELSE 0 END AS c FROM r),
i AS (SELECT receptor, ligand, mode, count(*) OVER (PARTITION BY receptor, ligand) AS n, rank() OVER (PARTITION BY receptor, ligand ORDER BY affinity) + (count(*) OVER (PARTITION BY receptor, ligand, affinity) - 1) / 2::DOUBLE AS ra, rank() OVER (PARTITION BY receptor, ligand ORDER BY second) + (count(*) OVER (PARTITION BY receptor, ligand, second) - 1) / 2::DOUBLE AS rb FROM p),
j AS (SELECT receptor, ligand, min((CASE WHEN n > 1 THEN ((ra - 1) / (n - 1) + (rb - 1) / (n - 1)) / 2 ELSE 0 END, mode))[2] AS best FROM i GROUP BY receptor, ligand)
SELECT receptor, ligand, round(c, 9) AS consensus, CAST(best AS INTEGER) AS best_mode, best = 1 AS docked_pose_agrees FROM s JOIN j USING (receptor, ligand)""")
def run_consensus(spark, sf_dir):
    d = ranking.ranked(ok_rows(spark, sf_dir), "run", ["receptor", "ligand"], [], out="mode")
    out = poses.ligand_consensus(d, ["affinity", "second"], ["receptor"], "ligand", "mode")
    return rounded(out.select("receptor", "ligand", "consensus", "best_mode", "docked_pose_agrees"), "consensus", places=9)


RANKINGS = THREE + """, o AS (SELECT receptor, run, row_number() OVER (PARTITION BY receptor ORDER BY affinity, run) AS x, row_number() OVER (PARTITION BY receptor ORDER BY second, run) AS y FROM k)
"""


@query(RANKINGS + "SELECT receptor, n, rank_changes, top1_agreement, round(ab, 6) AS rho FROM (SELECT receptor, count(*) AS n, count(*) FILTER (x <> y) AS rank_changes, bool_or(x = 1 AND y = 1) AS top1_agreement FROM o GROUP BY receptor) JOIN rho USING (receptor)")
def compare_rankings(spark, sf_dir):
    return rounded(poses.compare_rankings(ok_rows(spark, sf_dir), "affinity", "second", ["receptor"], "run"), "rho")


# -- shape -----------------------------------------------------------------------------------------------

OVERLAPS = RATOMS + ", o AS (SELECT a.label, sum(exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 4)) FILTER (a.atom % 2 = 0 AND b.atom % 2 = 1) AS ab, sum(exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 4)) FILTER (a.atom % 2 = 0 AND b.atom % 2 = 0) AS aa, sum(exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 4)) FILTER (a.atom % 2 = 1 AND b.atom % 2 = 1) AS bb FROM ratoms a JOIN ratoms b ON a.label = b.label GROUP BY a.label)\n"


@query(OVERLAPS + "SELECT label, round(ab, 5) AS overlap, round(greatest(0, least(1, ab / (aa + bb - ab))), 6) AS tanimoto, round(ab / sqrt(aa * bb), 6) AS carbo FROM o")
def shape_overlap(spark, sf_dir):
    a = atoms(spark, sf_dir)
    x, y = a.where("atom % 2 = 0"), a.where("atom % 2 = 1")
    o = poses.gaussian_overlap(x, y, ["label"]).join(poses.gaussian_overlap(x, x, ["label"]).withColumnRenamed("overlap", "aa"), "label").join(poses.gaussian_overlap(y, y, ["label"]).withColumnRenamed("overlap", "bb"), "label")
    ab, aa, bb = F.col("overlap"), F.col("aa"), F.col("bb")
    return rounded(rounded(o.select("label", "overlap", poses.shape_tanimoto(ab, aa, bb).alias("tanimoto"), poses.carbo_index(ab, aa, bb).alias("carbo")), "tanimoto", "carbo"), "overlap", places=5)


USR = RATOMS + """, m AS (SELECT res_id AS k, label, atom, x, y, z FROM ratoms), c AS (SELECT label, k, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n FROM m GROUP BY ALL), d AS (SELECT *, sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)) AS d0 FROM m JOIN c USING (label, k) WHERE n > 1),
e AS (SELECT label, k, arg_min([x, y, z], (round(d0, 12), atom)) AS p, arg_max([x, y, z], (round(d0, 12), -atom)) AS q FROM d GROUP BY ALL), f AS (SELECT *, sqrt(pow(x - p[1], 2) + pow(y - p[2], 2) + pow(z - p[3], 2)) AS d1, sqrt(pow(x - q[1], 2) + pow(y - q[2], 2) + pow(z - q[3], 2)) AS d2 FROM d JOIN e USING (label, k)),
g AS (SELECT label, k, arg_max([x, y, z], (round(d2, 12), -atom)) AS r FROM f GROUP BY ALL), h AS (SELECT *, sqrt(pow(x - r[1], 2) + pow(y - r[2], 2) + pow(z - r[3], 2)) AS d3 FROM f JOIN g USING (label, k)),
usr AS (SELECT label, k, [avg(d0), stddev_pop(d0), max(d0), avg(d1), stddev_pop(d1), max(d1), avg(d2), stddev_pop(d2), max(d2), avg(d3), stddev_pop(d3), max(d3)] AS u FROM h GROUP BY ALL)
"""


def shapes(spark, sf_dir):
    return poses.usr_descriptors(atoms(spark, sf_dir).select("label", F.col("res_id").alias("k"), "atom", "x", "y", "z"), ["label", "k"])


@query(USR + "SELECT label, k, " + ", ".join(f"round(u[{i + 1}], 5) AS u{i}" for i in range(12)) + " FROM usr")
def usr_descriptors(spark, sf_dir):
    return shapes(spark, sf_dir).select("label", "k", *[F.round(F.col("usr")[i], 5).alias(f"u{i}") for i in range(12)])


@query(USR + """, v AS (SELECT label, k * 100 + label AS id, u FROM usr), s AS (SELECT a.id, max(1 / (1 + list_sum(list_transform(list_zip(a.u, b.u), lambda p: abs(p[1] - p[2]))) / 12)) AS score FROM v a JOIN v b ON b.id % 100 = 0 AND a.label <> b.label AND a.id <> b.id GROUP BY a.id)
SELECT v.id, v.label, round(coalesce(score, 0), 6) AS score FROM v LEFT JOIN s USING (id)""")
def usr_prefilter(spark, sf_dir):
    v = shapes(spark, sf_dir).select((F.col("k") * 100 + F.col("label")).alias("id"), "label", "usr")
    return rounded(poses.usr_scores(v, v.where("id % 100 = 0"), "label"), "score")


# -- clusters of poses -----------------------------------------------------------------------------------

MEMBERS = RESULTS + ", p AS (SELECT receptor, CAST(ligand % 5 AS INTEGER) AS cluster, run AS id, CAST(conformation AS VARCHAR) AS conformation, ligand % 3 AS batch, affinity FROM results WHERE status = 'ok')\n"


def members(spark, sf_dir):
    return ok_rows(spark, sf_dir).select("receptor", F.pmod("ligand", F.lit(5)).cast("int").alias("cluster"), F.col("run").alias("id"), F.col("conformation").cast("string").alias("conformation"), F.pmod("ligand", F.lit(3)).alias("batch"), "affinity")


@query(MEMBERS + "SELECT receptor, cluster, count(*) AS size, round(min(affinity), 6) AS best, round(avg(affinity), 11) AS mean, round(max(affinity) - min(affinity), 6) AS spread, count(DISTINCT conformation) AS conformations, round(count(DISTINCT conformation) / (SELECT count(DISTINCT conformation) FROM p q WHERE q.receptor = p.receptor), 6) AS support FROM p GROUP BY receptor, cluster")
def cluster_ensemble_poses(spark, sf_dir):
    return rounded(rounded(poses.cluster_support(members(spark, sf_dir), ["receptor"]), "best", "spread", "support"), "mean", places=11)


@query(MEMBERS + """, t AS (SELECT receptor, min((affinity, id, cluster))[3] AS c, count(DISTINCT batch) AS n_runs, count(*) AS n_poses FROM p GROUP BY receptor), b AS (SELECT receptor, batch, min((affinity, id, cluster))[3] AS c FROM p GROUP BY receptor, batch)
SELECT t.receptor, n_runs, n_poses, (SELECT count(*) FROM p WHERE p.receptor = t.receptor AND p.cluster = t.c) AS top_size, (SELECT count(DISTINCT batch) FROM p WHERE p.receptor = t.receptor AND p.cluster = t.c) AS runs_in_top, (SELECT count(*) FROM b WHERE b.receptor = t.receptor AND b.c = t.c) AS best_in_top,
round(CASE WHEN n_runs > 1 THEN (SELECT count(DISTINCT batch) FROM p WHERE p.receptor = t.receptor AND p.cluster = t.c) / n_runs END, 6) AS reproducibility FROM t""")
def reproducibility(spark, sf_dir):
    return rounded(poses.reproducibility(members(spark, sf_dir).withColumnsRenamed({"batch": "run", "affinity": "energy"}), ["receptor"]), "reproducibility")


@query(MEMBERS + """, t AS (SELECT receptor, min(cluster) AS c, count(DISTINCT conformation) AS n FROM p GROUP BY receptor), s AS (SELECT p.receptor, count(DISTINCT conformation) AS k, max(affinity) - min(affinity) AS r FROM p JOIN t ON p.receptor = t.receptor AND cluster = c GROUP BY p.receptor),
b AS (SELECT receptor, conformation, min((affinity, id, cluster))[3] AS c FROM p GROUP BY ALL), q AS (SELECT t.receptor, count(b.c) AS m FROM t LEFT JOIN b ON b.receptor = t.receptor AND b.c = t.c GROUP BY t.receptor)
SELECT receptor, k AS supporting, m AS persisting, n AS conformations, round(r, 6) AS movement, round(k / n * (m / n) * exp(-greatest(0, r) / 2), 6) AS robustness FROM t JOIN s USING (receptor) JOIN q USING (receptor)""")
def robustness_score(spark, sf_dir):
    return rounded(poses.robustness(members(spark, sf_dir), ["receptor"]), "movement", "robustness")


@query(RATOMS + ", s AS (SELECT label, atom AS site, x, y, z FROM ratoms WHERE atom % 11 = 0), p AS (SELECT label, CAST(atom % 3 AS INTEGER) AS pose, x, y, z FROM ratoms WHERE atom % 4 = 1) SELECT label, pose, count(DISTINCT site) FILTER (pow(p.x - s.x, 2) + pow(p.y - s.y, 2) + pow(p.z - s.z, 2) <= 1) AS displaced FROM p LEFT JOIN s USING (label) GROUP BY label, pose")
def pose_displacement(spark, sf_dir):
    a = atoms(spark, sf_dir)
    p = a.where("atom % 4 = 1").withColumn("pose", F.pmod("atom", F.lit(3)).cast("int"))
    return poses.displaced_waters(p, a.where("atom % 11 = 0").withColumnRenamed("atom", "site"), ["label", "pose"], ["label"], 1.0)


@query(POINTS + ", f AS (SELECT a.label, a.atom // 10 AS node, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM points a JOIN points b ON a.label = b.label AND a.atom % 10 = 0 AND b.atom = a.atom + 10) SELECT label, node, x, y, z FROM f")
def experimental_field(spark, sf_dir):
    p = points(spark, sf_dir).where("atom % 10 = 0")
    first = p.withColumn("node", F.floor(F.col("atom") / 10))
    return poses.displacement_field(first, first.withColumn("node", F.col("node") - 1), ["label"], "node")


@query(POINTS + ", f AS (SELECT label, atom AS node, x, y, z FROM points), d AS (SELECT label, CAST(m AS INTEGER) AS mode, node, CASE m WHEN 0 THEN y ELSE x END AS dx, CASE m WHEN 0 THEN z ELSE y END AS dy, CASE m WHEN 0 THEN x ELSE -z END AS dz FROM f, (SELECT unnest([0, 1]) AS m)) SELECT label, mode, round(abs(sum(dx * x + dy * y + dz * z)) / sqrt(sum(dx * dx + dy * dy + dz * dz) * sum(x * x + y * y + z * z)), 6) AS overlap FROM d JOIN f USING (label, node) GROUP BY label, mode")
def direction_overlap(spark, sf_dir):
    f = points(spark, sf_dir).withColumnRenamed("atom", "node")
    one = f.select("label", F.lit(0).alias("mode"), "node", F.col("y").alias("dx"), F.col("z").alias("dy"), F.col("x").alias("dz"))
    two = f.select("label", F.lit(1).alias("mode"), "node", F.col("x").alias("dx"), F.col("y").alias("dy"), (-F.col("z")).alias("dz"))
    return rounded(poses.direction_overlap(one.unionByName(two), f, ["label"]), "overlap")


# -- panels and campaigns --------------------------------------------------------------------------------

HOMES = CELLS + """, r AS (SELECT *, row_number() OVER (PARTITION BY ligand ORDER BY affinity, CAST(receptor AS VARCHAR)) AS k, min(affinity) OVER (PARTITION BY ligand) AS b FROM cells)
"""


def profile(spark, sf_dir):
    return rollups.panel_profile(rollups.panel_cells(results(spark, sf_dir)), 0.5)


@query(HOMES + """, p AS (SELECT ligand, min(affinity) AS best, max(receptor) FILTER (k = 1) AS br, [(ligand % 7 + 1)::VARCHAR, (ligand % 5 + 1)::VARCHAR] AS home, 1 + ligand % 3 AS ratio, min(affinity) + (ligand % 10) / 10::DOUBLE AS ha FROM r GROUP BY ligand), q AS (SELECT *, list_contains(home, br::VARCHAR) AS hit, br::VARCHAR = list_min(home) AS strict FROM p)
SELECT count(*) AS n, count(*) FILTER (strict) AS strict_hits, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit AND ha - best <= 0.5) AS promiscuous, count(*) FILTER (NOT hit AND NOT ha - best <= 0.5 AND ratio >= 1.25) AS box, count(*) FILTER (NOT hit AND NOT ha - best <= 0.5 AND ratio < 1.25) AS score, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM q""")
def hit_rate(spark, sf_dir):
    k = F.col("ligand")
    p = profile(spark, sf_dir).withColumns({"home": F.array(*[(F.pmod(k, F.lit(n)) + 1).cast("string") for n in (7, 5)]), "box_ratio": 1 + F.pmod(k, F.lit(3)), "home_affinity": F.col("best") + F.pmod(k, F.lit(10)) / 10.0})
    return rounded(rollups.homes_summary(p, 0.5), "rate")


@query(HOMES + "SELECT ligand, receptor AS home, CAST(k AS INTEGER) AS home_rank, round(affinity, 9) AS affinity FROM r WHERE receptor = ligand % 7 + 1")
def home_rank(spark, sf_dir):
    cells = rollups.panel_cells(results(spark, sf_dir))
    homes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ligand"), (F.pmod("p_partkey", F.lit(7)) + 1).alias("receptor"))
    return rounded(rollups.home_ranks(cells, homes), "affinity", places=9)


@query(HOMES + """, p AS (SELECT ligand, max(affinity) FILTER (k = 2) - min(affinity) AS gap, count(*) FILTER (affinity <= b + 0.5) AS n FROM r GROUP BY ligand) SELECT ligand, CASE WHEN gap IS NULL THEN 'only one receptor' WHEN n = 1 AND gap >= 0.5 THEN 'selective' WHEN n >= 2 THEN 'preference' ELSE 'best' END AS outcome FROM p""")
def selectivity_profile(spark, sf_dir):
    return rollups.selectivity(profile(spark, sf_dir), 0.5).select("ligand", "outcome")


@query(RESULTS + "SELECT ligand, round(min(affinity), 9) AS affinity FROM results GROUP BY ligand")
def affinities_from_records(spark, sf_dir):
    return rounded(rollups.best_by_name(results(spark, sf_dir), "ligand", "affinity"), "affinity", places=9)


@query(RESULTS + "SELECT receptor, string_agg(ligand::VARCHAR, ',' ORDER BY affinity, ligand) AS members FROM (SELECT *, row_number() OVER (PARTITION BY receptor ORDER BY affinity, ligand) AS k FROM results WHERE status = 'ok') WHERE k <= 5 GROUP BY receptor")
def write_shortlist(spark, sf_dir):
    return rollups.shortlist(results(spark, sf_dir), "receptor", "affinity", "ligand", 5).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query(RESULTS + "SELECT receptor, run, CAST(row_number() OVER (PARTITION BY receptor ORDER BY status <> 'ok', affinity, run) AS INTEGER) AS row FROM results")
def write_summary(spark, sf_dir):
    return rollups.summary_rows(results(spark, sf_dir), "affinity", "run").select("receptor", "run", "row")


@query(RESULTS + "SELECT run, ligand, round(-affinity / p_size, 11) AS le, 'heavy atoms' AS le_source FROM results JOIN part ON p_partkey = ligand")
def make_records(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ligand"), F.col("p_size").alias("n_heavy"))
    return rounded(rollups.fact_rows(results(spark, sf_dir), p, "ligand").select("run", "ligand", "le", "le_source"), "le", places=11)


STUDY = "WITH m AS (SELECT o_orderpriority AS study, o_custkey AS name, min(-o_totalprice) AS best FROM orders GROUP BY ALL)\n"


def study(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("study"), F.col("o_custkey").alias("name")).agg(F.min(-F.col("o_totalprice")).alias("best"))


@query(STUDY + "SELECT study, name, best, rank, members, round(mean, 4) AS mean FROM (SELECT *, CAST(row_number() OVER (PARTITION BY study ORDER BY best, name) AS INTEGER) AS rank, count(*) OVER (PARTITION BY study) AS members, avg(best) OVER (PARTITION BY study) AS mean FROM m) WHERE rank <= 10")
def study_report(spark, sf_dir):
    return rounded(rollups.study_report(study(spark, sf_dir), ["study"], "name", "best", 10), "mean", places=4)


@query(RESULTS + """, m AS (SELECT receptor, conformation AS run, ligand % 50 AS mode, min(affinity) AS v FROM results GROUP BY ALL)
SELECT a.receptor, a.run, count(*) AS modes, round(max(abs(a.v - b.v)), 6) AS max_change, round(avg(a.v - b.v), 11) AS mean_change FROM m a JOIN m b ON a.receptor = b.receptor AND a.mode = b.mode AND b.run = 1 WHERE a.run <> 1 GROUP BY a.receptor, a.run""")
def compare_projects(spark, sf_dir):
    runs = results(spark, sf_dir).groupBy("receptor", F.col("conformation").alias("run"), F.pmod("ligand", F.lit(50)).alias("mode")).agg(F.min("affinity").alias("v"))
    return rounded(rounded(rollups.compare_runs(runs, 1, ["receptor"], "run", "mode", "v"), "max_change"), "mean_change", places=11)


@query(RESULTS + "SELECT receptor, poses, round(best, 9) AS best, row_number() OVER (ORDER BY best NULLS LAST, receptor) AS rank FROM (SELECT receptor, count(*) AS poses, min(affinity) FILTER (receptor % 9 <> 0) AS best FROM results GROUP BY receptor)")
def campaign_index(spark, sf_dir):
    runs = results(spark, sf_dir).withColumn("affinity", F.when(F.pmod("receptor", F.lit(9)) == 0, F.lit(float("nan"))).otherwise(F.col("affinity")))
    return rounded(rollups.campaign_index(runs, ["receptor"], "affinity"), "best", places=9)


BENCH = """WITH r AS (SELECT l_suppkey AS system, l_linenumber AS seed, min(l_quantity) / 10 AS top, min(l_tax) * 10 AS near, max(l_discount) AS rho, bool_and(l_returnflag <> 'A' OR l_suppkey % 3 > 0) AS ok FROM lineitem GROUP BY ALL),
b AS (SELECT system, count(DISTINCT seed) AS seeds, min(top) AS top_rmsd, max(top) - min(top) AS top_rmsd_spread, min(near) AS best_within, min(rho) AS rho_low, max(rho) AS rho_high, bool_and(ok) AS correct FROM r GROUP BY system)
"""


def bench_runs(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    ok = F.bool_and((F.col("l_returnflag") != "A") | (F.pmod("l_suppkey", F.lit(3)) > 0))
    return line.groupBy(F.col("l_suppkey").alias("system"), F.col("l_linenumber").alias("seed")).agg((F.min("l_quantity") / 10).alias("top"), (F.min("l_tax") * 10).alias("near"), F.max("l_discount").alias("rho"), ok.alias("ok"))


@query(BENCH + "SELECT system, seeds, round(top_rmsd, 6) AS top_rmsd, round(top_rmsd_spread, 6) AS top_rmsd_spread, round(best_within, 6) AS best_within, rho_low, rho_high, correct AS correct_in_all_runs FROM b")
def baseline_document(spark, sf_dir):
    return rounded(rollups.baseline(bench_runs(spark, sf_dir), "system", "seed", "top", "near", "rho", "ok"), "top_rmsd", "top_rmsd_spread", "best_within")


@query(BENCH + """, n AS (SELECT system, top_rmsd + (system % 5) / 10::DOUBLE AS t, best_within + (system % 7) / 10::DOUBLE AS w, rho_high + (system % 2) AS h, correct AND system % 4 <> 0 AS c FROM b)
SELECT n.system, 'top_rmsd' AS failure FROM n JOIN b USING (system) WHERE t > top_rmsd + 0.35::DOUBLE UNION ALL SELECT n.system, 'best_within' FROM n JOIN b USING (system) WHERE w > best_within + 0.35::DOUBLE UNION ALL SELECT n.system, 'rho' FROM n JOIN b USING (system) WHERE h > rho_high + 0.5::DOUBLE UNION ALL SELECT n.system, 'correct_in_all_runs' FROM n JOIN b USING (system) WHERE correct AND NOT c""")
def check_baseline(spark, sf_dir):
    b = rollups.baseline(bench_runs(spark, sf_dir), "system", "seed", "top", "near", "rho", "ok")
    k = F.col("system")
    now = b.withColumns({"top_rmsd": F.col("top_rmsd") + F.pmod(k, F.lit(5)) / 10.0, "best_within": F.col("best_within") + F.pmod(k, F.lit(7)) / 10.0, "rho_high": F.col("rho_high") + F.pmod(k, F.lit(2)), "correct_in_all_runs": F.col("correct_in_all_runs") & (F.pmod(k, F.lit(4)) != 0)})
    return rollups.check_baseline(now, b, "system")


# -- libraries -------------------------------------------------------------------------------------------


@query(MOLECULES + "SELECT p_type AS key, count(*) AS n FROM molecules GROUP BY p_type ORDER BY n DESC, key LIMIT 1")
def most_common_scaffold(spark, sf_dir):
    return rollups.most_common(molecules(spark, sf_dir), "p_type")


@query("SELECT l_orderkey AS molecule, min(l_shipmode) AS r FROM (SELECT l_orderkey, l_returnflag AS l_shipmode FROM lineitem) GROUP BY l_orderkey".replace("min(l_shipmode) AS r", "min(l_shipmode) FILTER (l_shipmode = 'A') AS \"R1\", min(l_shipmode) FILTER (l_shipmode = 'N') AS \"R2\""))
def rgroup_matrix(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("molecule"), F.when(F.col("l_returnflag") == "A", "R1").when(F.col("l_returnflag") == "N", "R2").alias("label"), F.col("l_returnflag").alias("group"))
    return rollups.group_matrix(rows, "molecule", "label", "group", ["R1", "R2"])


@query(MOLECULES + ", f AS (SELECT DISTINCT ligand FROM molecules WHERE HBD > 5 OR RotB > 10) SELECT p_type AS scaffold, count(*) AS n, count(f.ligand) AS flagged, round(count(f.ligand) / count(*), 6) AS share, count(f.ligand) / count(*) > 0.25 AS noted FROM molecules m LEFT JOIN f USING (ligand) GROUP BY p_type")
def triage_library(spark, sf_dir):
    d = molecules(spark, sf_dir)
    hits = d.where("HBD > 5").select("ligand", F.lit("donors").alias("alert")).unionByName(d.where("RotB > 10").select("ligand", F.lit("flexible").alias("alert")))
    return rounded(rollups.triage(hits, d, "ligand", "p_type"), "share")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'scaffold' WHEN 2 THEN 'substituent' ELSE 'mixed' END AS location FROM part")
def alert_location(spark, sf_dir):
    k = F.pmod("p_partkey", F.lit(4))
    atoms_ = F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(1), F.lit(2))).when(k == 2, F.array(F.lit(8))).otherwise(F.array(F.lit(1), F.lit(9)))
    return table(spark, sf_dir, "part").select("p_partkey", rollups.alert_location(atoms_, F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("location"))


@query(MOLECULES + """SELECT ligand, round(MW, 6) AS MW, LogP, HBD, HBA, RotB, TPSA, MR, n_heavy, MW <= 500 AND LogP <= 5 AND HBD <= 5 AND HBA <= 10 AS lipinski, RotB <= 10 AND TPSA <= 140 AS veber, TPSA <= 131.6 AND LogP <= 5.88 AS egan, MW BETWEEN 160 AND 480 AND LogP BETWEEN -0.4 AND 5.6 AND n_heavy BETWEEN 20 AND 70 AND MR BETWEEN 40 AND 130 AS ghose FROM molecules""")
def property_panel(spark, sf_dir):
    from .queries import _verdicts

    v = dict(_verdicts())
    return rounded(molecules(spark, sf_dir).select("ligand", "MW", "LogP", "HBD", "HBA", "RotB", "TPSA", "MR", "n_heavy", *[c.alias(n.lower()) for n, c in v.items()]), "MW")


@query(MOLECULES + "SELECT ligand, n_heavy FROM molecules WHERE n_heavy BETWEEN 8 AND 20")
def fragment_library(spark, sf_dir):
    return molecules(spark, sf_dir).where(F.col("n_heavy").between(8, 20)).select("ligand", "n_heavy")


AUDITS = """WITH a AS (SELECT p_partkey AS position, p_size, CASE WHEN p_size % 5 = 0 THEN 'rejected' ELSE 'kept' END AS status, CASE WHEN p_size % 10 = 0 THEN 'parse' ELSE 'filter' END AS category, 'heavy_atoms ' || CASE WHEN p_size % 3 = 0 THEN 'net_charge' ELSE '' END AS reason, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS ok FROM part)
"""


def audits(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("position"), s, F.when(s % 5 == 0, "rejected").otherwise("kept").alias("status"), F.when(s % 10 == 0, "parse").otherwise("filter").alias("category"), F.concat(F.lit("heavy_atoms "), F.when(s % 3 == 0, "net_charge").otherwise("")).alias("reason"), F.when(F.pmod(k, F.lit(3)) == 0, None).otherwise(F.pmod(k, F.lit(3)) == 1).alias("ok"))
    finding = lambda step, kind, when: F.when(when, F.struct(F.lit(step).alias("step"), F.lit("").alias("detail"), F.lit(kind).alias("kind")))
    return p.withColumn("findings", F.array_compact(F.array(finding("desalt", "change", s % 2 == 0), finding("desalt", "change", s % 4 == 0), finding("charge", "change", s % 3 == 0), finding("stereo", "note", s % 2 == 1))))


@query(AUDITS + "SELECT 'desalt' AS step, count(*) FILTER (p_size % 2 = 0) AS n FROM a UNION ALL SELECT 'charge', count(*) FILTER (p_size % 3 = 0) FROM a")
def changed_by_step(spark, sf_dir):
    return rollups.findings_by_step(audits(spark, sf_dir))


@query(AUDITS + "SELECT 'heavy_atoms' AS property, count(*) AS n FROM a WHERE status = 'rejected' AND category = 'filter' UNION ALL SELECT 'net_charge', count(*) FROM a WHERE status = 'rejected' AND category = 'filter' AND p_size % 3 = 0")
def rejected_by_property(spark, sf_dir):
    return rollups.rejected_by_property(audits(spark, sf_dir), ["heavy_atoms", "molecular_weight", "net_charge", "rotatable_bonds"])


@query(AUDITS + "SELECT count(*) FILTER (ok) AS consistent, count(*) FILTER (NOT ok) AS inconsistent, count(*) FILTER (ok IS NULL) AS unknown FROM a WHERE status = 'kept'")
def charge_observations(spark, sf_dir):
    return rollups.charge_observations(audits(spark, sf_dir), "ok")


@query("""WITH e AS (SELECT p_size + 10 AS requested, p_size + 10 - p_size % 7 AS embedded, greatest(0, p_size - 5) AS n, p_size % 4 AS pe, p_size % 6 AS pr, p_size % 9 AS rotors, p_partkey % 25 = 0 AS bad FROM part)
SELECT count(*) AS n_molecules, count(*) FILTER (NOT bad) AS n_embedded, round(avg(n) FILTER (NOT bad), 6) AS conformers_mean, round(median(n) FILTER (NOT bad), 6) AS conformers_median, min(n) FILTER (NOT bad) AS conformers_min, round(avg(rotors), 6) AS rotors_mean, CAST(sum(requested) AS BIGINT) AS attempts, CAST(sum(requested) - sum(embedded) AS BIGINT) AS lost_embedding, CAST(sum(pe) AS BIGINT) AS lost_energy, CAST(sum(pr) AS BIGINT) AS lost_rmsd,
round(count(*) FILTER (NOT bad) / count(*), 6) AS embed_rate, CASE WHEN sum(requested) - sum(embedded) >= greatest(sum(pe), sum(pr)) THEN 'embedding' WHEN sum(pe) >= sum(pr) THEN 'energy_window' ELSE 'rmsd_prune' END AS dominant_loss FROM e""")
def ensemble_quality(spark, sf_dir):
    s = F.col("p_size")
    e = table(spark, sf_dir, "part").select((s + 10).alias("requested"), (s + 10 - s % 7).alias("embedded"), F.greatest(F.lit(0), s - 5).alias("n_conformers"), (s % 4).alias("pruned_energy"), (s % 6).alias("pruned_rmsd"), (s % 9).alias("rotors"), F.when(F.pmod("p_partkey", F.lit(25)) == 0, "failed").otherwise("").alias("error"))
    return rounded(rollups.ensemble_quality(e), "conformers_mean", "conformers_median", "rotors_mean", "embed_rate")


# -- files -----------------------------------------------------------------------------------------------

FACTS = "SELECT l_suppkey::VARCHAR AS receptor, l_partkey::VARCHAR AS ligand, CASE WHEN l_linenumber = 3 THEN 'a, \"b\"' ELSE 'n' || l_orderkey END AS name, l_linenumber AS index, l_returnflag AS status, CASE WHEN l_linenumber = 2 THEN NULL ELSE round(-l_extendedprice / 10000, 6) END AS affinity, CASE WHEN l_quantity > 25 THEN 'MW; LogP' ELSE '' END AS violations, l_linestatus = 'O' AS in_box, l_orderkey AS seed FROM lineitem"
SCHEMA = "receptor string, ligand string, name string, index int, status string, affinity double, violations array<string>, in_box boolean, seed long"


def facts(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    name = F.when(n == 3, 'a, "b"').otherwise(F.concat(F.lit("n"), F.col("l_orderkey").cast("string")))
    affinity = F.when(n == 2, F.lit(float("nan"))).otherwise(F.round(-F.col("l_extendedprice") / 10000, 6))
    violations = F.when(F.col("l_quantity") > 25, F.array(F.lit("MW"), F.lit("LogP"))).otherwise(F.array().cast("array<string>"))
    return line.select(F.col("l_suppkey").cast("string").alias("receptor"), F.col("l_partkey").cast("string").alias("ligand"), name.alias("name"), n.alias("index"), F.col("l_returnflag").alias("status"), affinity.alias("affinity"), violations.alias("violations"), (F.col("l_linestatus") == "O").alias("in_box"), F.col("l_orderkey").alias("seed"))


def _round_trip(spark, sf_dir, ending: str) -> DataFrame:
    path = new_path(spark, "facts") + ending
    got = tables.read_rows(spark, tables.write_rows(facts(spark, sf_dir), path), SCHEMA)
    return got.withColumn("violations", F.array_join("violations", "; "))


@query(FACTS)
def results_csv(spark, sf_dir):
    """Results written as CSV and read back: values that are not finite are gone, lists and flags are as they were."""
    return _round_trip(spark, sf_dir, ".csv")


@query(FACTS)
def results_tsv(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".tsv")


@query(FACTS)
def results_jsonl(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".jsonl")


@query("SELECT p_partkey AS line, p_name AS smiles_name, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def smiles_records(spark, sf_dir):
    """Lines of molecules: every fifth is blank, every seventh a comment."""
    k = F.col("p_partkey")
    line = F.when(F.pmod(k, F.lit(5)) == 0, "   ").when(F.pmod(k, F.lit(7)) == 0, F.lit("# a comment")).otherwise(F.concat(F.lit(" C"), k.cast("string"), F.lit("\t "), F.col("p_name"), F.lit(" ")))
    out = tables.smiles_records(table(spark, sf_dir, "part").select("p_partkey", line.alias("value")), order=["p_partkey"])
    return out.select(F.substring("smiles", 2, 20).cast("long").alias("line"), F.col("name").alias("smiles_name"), F.col("position").cast("long").alias("position"))


@query("SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'a.smi' ELSE 'b.smi' END || '#' || (row_number() OVER (ORDER BY CASE s_suppkey % 2 WHEN 0 THEN 'x/a.smi' ELSE 'y/b.smi' END, s_suppkey) - 1) AS key FROM supplier")
def member_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "x/a.smi").otherwise("y/b.smi").alias("file"))
    return tables.member_keys(rows, "file", ["s_suppkey"]).select("s_suppkey", "key")


@query("SELECT conv_id, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS model, role FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def pdbqt_models(spark, sf_dir):
    """Turns of a conversation as the models of one document, with a line outside of them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    one = F.concat(F.lit("MODEL "), F.col("turn").cast("string"), F.lit("\nREMARK "), F.col("role"), F.lit("\nENDMDL"))
    docs = c.withColumn("body", one).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"]), "\nTER\n").alias("text"))
    lines = tables.models_of(docs, "text").where(F.col("line").startswith("REMARK"))
    return lines.select("conv_id", F.col("model").cast("int").alias("model"), F.substring("line", 8, 20).alias("role"))


@query("SELECT vec_id // 5 AS id, count(*) AS n_atoms, count(*) - 1 AS n_bonds, round(sum(round(CAST(embedding[1] AS DOUBLE) * 20, 4)), 4) AS sx FROM embeddings GROUP BY vec_id // 5")
def molecule_blocks(spark, sf_dir):
    """Five points each as a record of an SD file, written as text and read again."""
    p = points(spark, sf_dir).withColumn("id", F.floor(F.col("atom") / 5))
    atom = F.concat(*[F.format_string("%10.4f", F.round(F.col(c), 4)) for c in "xyz"], F.lit(" C   0  0"))
    g = p.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("atom", atom.alias("line")))), lambda x: x["line"]).alias("l"))
    n = F.size("l")
    bonds_ = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.format_string("%3d%3d%3d", i, i + 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    text = F.concat(F.lit("mol\n\n\n"), F.format_string("%3d%3d", n, n - 1), F.lit("  0  0  0  0  0  0  0  0999 V2000\n"), F.array_join(F.concat("l", bonds_), "\n"), F.lit("\nM  END\n$$$$\n"))
    got = tables.molecule_blocks(g.select("id", text.alias("text")), "text")
    total = F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a["x"])
    return got.select("id", F.col("n_atoms").cast("long").alias("n_atoms"), F.col("n_bonds").cast("long").alias("n_bonds"), F.round(total, 4).alias("sx"))


# -- clusters that SQL reaches by recursion ---------------------------------------------------------------


@query(POINTS + """, near AS (SELECT a.label, a.atom AS i, b.atom AS j FROM points a JOIN points b ON a.label = b.label WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 0.49), ids AS (SELECT label, atom, row_number() OVER (PARTITION BY label ORDER BY atom) AS k FROM points), low AS (SELECT i.label, i.atom, i.k, list(n.j) FILTER (n.j < i.atom) AS lower FROM ids i LEFT JOIN near n ON n.label = i.label AND n.i = i.atom GROUP BY ALL),
walk AS (WITH RECURSIVE w AS (SELECT label, 0::BIGINT AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT label FROM points) UNION ALL SELECT w.label, w.k + 1, CASE WHEN lower IS NULL OR NOT list_has_any(lower, kept) THEN list_append(kept, l.atom) ELSE kept END FROM w JOIN low l ON l.label = w.label AND l.k = w.k + 1) SELECT * FROM w)
SELECT label, atom AS id, list_contains((SELECT arg_max(kept, k) FROM walk WHERE walk.label = p.label), atom) AS kept FROM points p""".replace("WITH points", "WITH RECURSIVE points"))
def prune_by_rmsd(spark, sf_dir):
    p = points(spark, sf_dir).select("label", F.col("atom").alias("id"), F.lit(0).alias("atom"), "x", "y", "z")
    return poses.greedy_by_distance(p, ["label"], 0.7000001)



