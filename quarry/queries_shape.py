"""Queries of pharmacophores, with their SQL. Eight vectors are the features of a molecule; every tenth molecule is a member of the series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import pharmacophores as ph

from .queries import query, rounded, table

FAMILIES = ("donor", "acceptor", "aromatic", "hydrophobic")


def features(spark, sf_dir) -> DataFrame:
    k = F.col("vec_id")
    family = F.array(*[F.lit(f) for f in FAMILIES])[F.pmod(k, F.lit(4)).cast("int")]
    return table(spark, sf_dir, "embeddings").select(F.floor(k / 8).alias("molecule"), F.pmod(k, F.lit(8)).alias("feature"), family.alias("family"), *[(F.col("embedding")[n].cast("double") * 20).alias(c) for n, c in enumerate("xyz")])


def members(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir).where(F.pmod("molecule", F.lit(10)) == 0)


def model(spark, sf_dir) -> DataFrame:
    return ph.build_model(members(spark, sf_dir), 3.0, 0.3)


FEATURES = """WITH RECURSIVE features AS (SELECT vec_id // 8 AS molecule, vec_id % 8 AS feature, ['donor', 'acceptor', 'aromatic', 'hydrophobic'][vec_id % 4 + 1] AS family, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y, CAST(embedding[3] AS DOUBLE) * 20 AS z FROM embeddings),
pts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY family ORDER BY molecule, feature) AS id FROM features WHERE molecule % 10 = 0),
nb AS MATERIALIZED (SELECT a.family, a.id, list(b.id) AS near FROM pts a JOIN pts b ON a.family = b.family AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 9 GROUP BY a.family, a.id),
w AS (SELECT family, 0 AS k, list(id) AS free, NULL::BIGINT AS seed, []::BIGINT[] AS got FROM pts GROUP BY family UNION ALL
SELECT x.family, x.k + 1, list_filter(x.free, lambda i: NOT list_contains(n.near, i)), x.s, list_intersect(n.near, x.free) FROM (SELECT w.family, w.k, w.free, (SELECT -max((len(list_intersect(c.near, w.free)), -c.id))[2] FROM nb c WHERE c.family = w.family AND list_contains(w.free, c.id)) AS s FROM w WHERE len(w.free) > 0) x JOIN nb n ON n.family = x.family AND n.id = x.s),
clusters AS (SELECT family, unnest(got) AS id, seed FROM w WHERE seed IS NOT NULL),
sums AS (SELECT family, seed, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(DISTINCT molecule) AS support FROM pts JOIN clusters USING (family, id) GROUP BY family, seed),
model AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY support DESC, family, seed) - 1 AS INTEGER) AS number, family, x, y, z, support, (SELECT count(DISTINCT molecule) FROM pts) AS members FROM sums WHERE support >= 0.3::DOUBLE * (SELECT count(DISTINCT molecule) FROM pts))
"""

#: Triangles of the model and of each molecule, their sides, areas, and the deviation of the best superposition.
TRIANGLES = FEATURES + """, mp AS (SELECT p.molecule, p.feature AS p, q.feature AS q, p.family AS fp, q.family AS fq, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM features p JOIN features q ON p.molecule = q.molecule AND p.feature <> q.feature),
tp AS (SELECT p.number AS p, q.number AS q, p.family AS fp, q.family AS fq, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM model p JOIN model q ON p.number < q.number),
mt AS (SELECT u.molecule, u.p AS a, u.q AS b, v.q AS c, u.fp AS f1, u.fq AS f2, v.fq AS f3, u.d AS a1, v.d AS a2, x.d AS a3 FROM mp u JOIN mp v ON u.molecule = v.molecule AND u.p = v.p AND u.q <> v.q JOIN mp x ON x.molecule = u.molecule AND x.p = u.q AND x.q = v.q),
tt AS (SELECT u.p AS i, u.q AS j, v.q AS k, u.fp AS f1, u.fq AS f2, v.fq AS f3, u.d AS b1, v.d AS b2, x.d AS b3 FROM tp u JOIN tp v ON u.p = v.p AND u.q < v.q JOIN tp x ON x.p = u.q AND x.q = v.q WHERE u.fp <> u.fq AND u.fp <> v.fq AND u.fq <> v.fq),
sides AS (SELECT molecule, i, j, k, a, b, c, a1 * a1 AS s1, a2 * a2 AS s2, a3 * a3 AS s3, b1 * b1 AS t1, b2 * b2 AS t2, b3 * b3 AS t3 FROM mt JOIN tt USING (f1, f2, f3)),
-- squared lengths from the centre, and inner products of the corners
grams AS (SELECT *, (s1 + s2) / 3 AS r1, (s1 + s3) / 3 AS r2, (s2 + s3) / 3 AS r3, (t1 + t2) / 3 AS q1, (t1 + t3) / 3 AS q2, (t2 + t3) / 3 AS q3, (2 * (s1 * s2 + s2 * s3 + s3 * s1) - s1 * s1 - s2 * s2 - s3 * s3) / 16 AS ma, (2 * (t1 * t2 + t2 * t3 + t3 * t1) - t1 * t1 - t2 * t2 - t3 * t3) / 16 AS ta FROM sides),
means AS (SELECT *, (r1 + r2 + r3) / 3 AS rm, (q1 + q2 + q3) / 3 AS qm FROM grams WHERE ma > 1e-6 AND ta > 1e-6),
inner_ AS (SELECT *, r1 - rm / 2 AS g11, r2 - rm / 2 AS g22, r3 - rm / 2 AS g33, (r1 + r2 - rm - s1) / 2 AS g12, (r1 + r3 - rm - s2) / 2 AS g13, (r2 + r3 - rm - s3) / 2 AS g23,
  q1 - qm / 2 AS h11, q2 - qm / 2 AS h22, q3 - qm / 2 AS h33, (q1 + q2 - qm - t1) / 2 AS h12, (q1 + q3 - qm - t2) / 2 AS h13, (q2 + q3 - qm - t3) / 2 AS h23 FROM means),
fits AS (SELECT molecule, i, j, k, a, b, c, round(sqrt(greatest(g11 + g22 + g33 + h11 + h22 + h33 - 2 * sqrt(greatest(g11 * h11 + g22 * h22 + g33 * h33 + 2 * (g12 * h12 + g13 * h13 + g23 * h23) + 8 / 3::DOUBLE * sqrt(ma * ta), 0)), 0) / 3), 6) AS rmsd FROM inner_),
best AS MATERIALIZED (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY molecule ORDER BY rmsd, i, j, k, a, b, c) = 1)
"""


def vector(name: str, *parts: str) -> str:
    return ", ".join(f"{p} AS {name}{c}" for p, c in zip(parts, "xyz", strict=True))


def frames_sql(s: str) -> str:
    """The frame of a triangle ``{s}1 .. {s}3``: centre, first side, normal, and what is across."""
    one = [f"{s}2{c} - {s}1{c}" for c in "xyz"]
    two = [f"{s}3{c} - {s}1{c}" for c in "xyz"]
    cross = [f"({one[1]}) * ({two[2]}) - ({one[2]}) * ({two[1]})", f"({one[2]}) * ({two[0]}) - ({one[0]}) * ({two[2]})", f"({one[0]}) * ({two[1]}) - ({one[1]}) * ({two[0]})"]
    return ", ".join([vector(f"{s}c", *[f"({s}1{c} + {s}2{c} + {s}3{c}) / 3" for c in "xyz"]), vector(f"{s}e", *one), vector(f"{s}n", *cross)])


def unit_sql(s: str) -> str:
    return vector(s, *[f"{s}{c} / sqrt({s}x * {s}x + {s}y * {s}y + {s}z * {s}z)" for c in "xyz"])


def flat_sql(s: str, n: int, axis: str) -> str:
    return "(" + " + ".join(f"({s}{n}{c} - {s}c{c}) * {s}{axis}{c}" for c in "xyz") + ")"


PLACED = TRIANGLES + f""", corners AS (SELECT best.molecule, rmsd, {', '.join(vector(f'm{n}', *[f'{p}.{c}' for c in 'xyz']) for n, p in ((1, 'fa'), (2, 'fb'), (3, 'fc')))}, {', '.join(vector(f't{n}', *[f'{p}.{c}' for c in 'xyz']) for n, p in ((1, 'ti'), (2, 'tj'), (3, 'tk')))} FROM best
  JOIN features fa ON fa.molecule = best.molecule AND fa.feature = a JOIN features fb ON fb.molecule = best.molecule AND fb.feature = b JOIN features fc ON fc.molecule = best.molecule AND fc.feature = c JOIN model ti ON ti.number = i JOIN model tj ON tj.number = j JOIN model tk ON tk.number = k),
f1 AS (SELECT *, {frames_sql('m')}, {frames_sql('t')} FROM corners),
f2 AS (SELECT * EXCLUDE (mex, mey, mez, mnx, mny, mnz, tex, tey, tez, tnx, tny, tnz), {unit_sql('me')}, {unit_sql('mn')}, {unit_sql('te')}, {unit_sql('tn')} FROM f1),
f3 AS (SELECT *, {', '.join(vector(f'{s}f', f'{s}ny * {s}ez - {s}nz * {s}ey', f'{s}nz * {s}ex - {s}nx * {s}ez', f'{s}nx * {s}ey - {s}ny * {s}ex') for s in 'mt')} FROM f2),
f4 AS (SELECT *, atan2({' + '.join(f"{flat_sql('m', n, 'e')} * {flat_sql('t', n, 'f')} - {flat_sql('m', n, 'f')} * {flat_sql('t', n, 'e')}" for n in (1, 2, 3))}, {' + '.join(f"{flat_sql('m', n, 'e')} * {flat_sql('t', n, 'e')} + {flat_sql('m', n, 'f')} * {flat_sql('t', n, 'f')}" for n in (1, 2, 3))}) AS turn FROM f3),
turned AS (SELECT p.molecule, feature, family, (p.x - mcx) * mex + (p.y - mcy) * mey + (p.z - mcz) * mez AS u, (p.x - mcx) * mfx + (p.y - mcy) * mfy + (p.z - mcz) * mfz AS v, (p.x - mcx) * mnx + (p.y - mcy) * mny + (p.z - mcz) * mnz AS w, f4.* EXCLUDE (molecule) FROM features p JOIN f4 ON f4.molecule = p.molecule),
moved AS MATERIALIZED (SELECT molecule, feature, family, {', '.join(f'u * (cos(turn) * te{c} + sin(turn) * tf{c}) + v * (cos(turn) * tf{c} - sin(turn) * te{c}) + w * tn{c} + tc{c} AS {c}' for c in 'xyz')} FROM turned)
"""


def matched_sql(points: str) -> str:
    return f""", gaps AS MATERIALIZED (SELECT molecule, number, feature, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z)) AS d FROM {points} p JOIN model t ON t.family = p.family),
taken AS (SELECT molecule, -1 AS number, []::BIGINT[] AS used, 0::DOUBLE AS total FROM (SELECT DISTINCT molecule FROM {points}) UNION ALL
SELECT molecule, number + 1, CASE WHEN hit[1] <= 1.5::DOUBLE THEN list_append(used, hit[2]) ELSE used END, total + CASE WHEN hit[1] <= 1.5::DOUBLE THEN 1 - hit[1] / 1.5::DOUBLE ELSE 0 END FROM (SELECT *, (SELECT min((d, feature)) FROM gaps g WHERE g.molecule = t.molecule AND g.number = t.number + 1 AND NOT list_contains(t.used, g.feature)) AS hit FROM taken t WHERE t.number + 1 < (SELECT count(*) FROM model))),
scored AS (SELECT molecule, greatest(0, least(1, (total - 0.25::DOUBLE * (n - len(used))) / n)) AS fit, len(used) / n AS coverage, CAST(len(used) AS INTEGER) AS n_matched FROM taken, (SELECT count(*)::DOUBLE AS n FROM model) WHERE number = n - 1)
"""


@query(FEATURES + "SELECT number, family, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, support, members FROM model")
def build_model(spark, sf_dir):
    return rounded(model(spark, sf_dir), "x", "y", "z")


@query(TRIANGLES + "SELECT molecule, i, j, k, a, b, c, rmsd FROM best")
def best_triangles(spark, sf_dir):
    return ph.best_triangles(features(spark, sf_dir), model(spark, sf_dir))


@query(FEATURES + matched_sql("features") + "SELECT molecule, round(fit, 6) AS fit, round(coverage, 6) AS coverage, n_matched FROM scored")
def fit_score(spark, sf_dir):
    """Molecules that lie in the model's frame as they are."""
    return rounded(ph.matched(features(spark, sf_dir), model(spark, sf_dir), miss_penalty=0.25), "fit", "coverage")


@query(PLACED + matched_sql("moved") + """, near AS (SELECT molecule, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM pts e WHERE (m.x - e.x) * (m.x - e.x) + (m.y - e.y) * (m.y - e.y) + (m.z - e.z) * (m.z - e.z) <= 4)) AS n_outside FROM moved m GROUP BY molecule)
SELECT molecule, round(CASE WHEN s.molecule IS NOT NULL AND (n - n_outside) / n >= 0.6::DOUBLE THEN fit ELSE 0 END, 5) AS fit, round(coalesce(coverage, 0), 6) AS coverage, coalesce(n_matched, 0) AS n_matched, coalesce(n_outside, 0) AS n_outside, NOT (s.molecule IS NOT NULL AND (n - n_outside) / n >= 0.6::DOUBLE) AS rejected,
  CASE WHEN s.molecule IS NULL THEN 'no alignment' WHEN (n - n_outside) / n >= 0.6::DOUBLE THEN '' ELSE 'shape' END AS reason FROM (SELECT DISTINCT molecule FROM features) LEFT JOIN scored s USING (molecule) LEFT JOIN near USING (molecule)""")
def screen_pharmacophore(spark, sf_dir):
    f = features(spark, sf_dir)
    atoms = f.withColumnRenamed("feature", "atom").drop("family")
    found = ph.screen(f, atoms, model(spark, sf_dir), members(spark, sf_dir), miss_penalty=0.25, shape_tolerance=2.0)
    return rounded(rounded(found, "fit", places=5), "coverage")
