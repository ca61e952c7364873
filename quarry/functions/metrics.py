"""Column functions: efficiency metrics, cost model, seeds, physics terms and geometry.

All are plain column expressions, so they stay inside generated code and push down like any other.
Null stands where a value is not defined (the division of zero, a size that is not positive).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that results depend on.
KCAL_PER_LOG = 1.37
GAS_CONSTANT = 1.98720425864083e-3
TEMPERATURE = 298.15
STATES_PER_ROTOR = 3
COULOMB = 332.0637
GAMMA = 0.0072
SEED_MODULUS = 2147483647
VINA = {"gauss1": -0.035579, "gauss2": -0.005156, "repulsion": 0.840245, "hydrophobic": -0.035069, "hbond": -0.587439, "glue": 50.0, "rotor": 0.05846}
VINARDO = {"gauss": -0.045, "repulsion": 0.8, "hydrophobic": -0.035, "hbond": -0.6, "glue": 50.0, "rotor": 0.05846}
AD4 = {"vdw": 0.1662, "hbond": 0.1209, "electrostatic": 0.1406, "solvation": 0.1322, "glue": 50.0, "rotor": 0.2983}
BONDI = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "F": 1.47, "CL": 1.75, "BR": 1.85, "I": 1.98}
DEFAULT_RADIUS = 1.70


def _d(c: Column) -> Column:
    return c.cast("double")


def finite(c: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(F.isnan(_d(c)) | (F.abs(_d(c)) == float("inf")), None).otherwise(_d(c))


def p_activity(dg: Column) -> Column:
    return -finite(dg) / KCAL_PER_LOG


def ligand_efficiency(dg: Column, heavy: Column) -> Column:
    return F.when(heavy > 0, -finite(dg) / _d(heavy))


def lipophilic_efficiency(dg: Column, logp: Column) -> Column:
    return p_activity(dg) - _d(logp)


def binding_efficiency_index(dg: Column, weight: Column) -> Column:
    return F.when(weight > 0, 1000 * p_activity(dg) / _d(weight))


def surface_efficiency_index(dg: Column, tpsa: Column) -> Column:
    return F.when(tpsa > 0, 100 * p_activity(dg) / _d(tpsa))


def entropy_penalty(torsions: Column, temperature: float = TEMPERATURE, states: int = STATES_PER_ROTOR) -> Column:
    return _d(torsions) * (GAS_CONSTANT * temperature * math.log(states))


def search_seconds(atoms: Column, torsions: Column) -> Column:
    return 0.003 + 0.0025 * _d(atoms) * (1 + F.pow(_d(torsions), F.lit(1.6)))


def fixed_seconds(grid: Column) -> Column:
    return 0.10 + 1.5e-6 * _d(grid)


def job_seconds(atoms: Column, torsions: Column, grid: Column, exhaustiveness: int = 8, cores: int = 16) -> Column:
    return (fixed_seconds(grid) + exhaustiveness * search_seconds(atoms, torsions)) * (16.0 / cores)


def grid_points(sx: Column, sy: Column, sz: Column, spacing: float = 0.375) -> Column:
    out = F.lit(1).cast("long")
    for s in (sx, sy, sz):
        out = out * (F.ceil(_d(s) / spacing) + 1)
    return out


def ligand_seed(base: Column, receptor: Column, key: Column) -> Column:
    """The seed of a job: the base moved by a checksum of receptor and ligand."""
    return F.pmod(base.cast("long") + F.crc32(F.concat_ws("|", receptor, key).cast("binary")), F.lit(SEED_MODULUS)) + 1


def base_seed_of(seed: Column, receptor: Column, key: Column) -> Column:
    """The base that leads to a seed."""
    return F.pmod(seed.cast("long") - 1 - F.crc32(F.concat_ws("|", receptor, key).cast("binary")), F.lit(SEED_MODULUS))


def eta_text(seconds: Column) -> Column:
    """Seconds as m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def radius_of(element: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in BONDI.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(element))), F.lit(DEFAULT_RADIUS))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def slope(bad: float, good: float, x: Column) -> Column:
    """0 at bad, 1 at good, linear between."""
    return clamp((x - bad) / (good - bad))


def burial(sasa: Column, full: float = 35.0) -> Column:
    return 1 - F.least(F.lit(1.0), _d(sasa) / full)


def polarity(element: Column, charge: Column) -> Column:
    q = F.abs(_d(charge))
    return F.when(q > 0, F.least(F.lit(1.0), q / 0.5)).when(F.upper(element).isin("N", "O", "S"), 0.35).otherwise(0.0)


def repulsion(field: Column) -> Column:
    return clamp((-9.93 - _d(field)) / (-9.93 + 42.19))


def physical_score(shape: Column, esp: Column, desolvation: Column, repulsed: Column, w: float = 0.5, wd: float = 0.5, wr: float = 0.5) -> Column:
    return clamp(w * _d(shape) + (1 - w) * _d(esp) - wd * _d(desolvation) - wr * _d(repulsed))


def geometric_score(enclosure: Column, volume: Column, hydrophobicity: Column) -> Column:
    return 0.45 * clamp(_d(enclosure)) + 0.35 * F.least(F.lit(1.0), _d(volume) / 400) + 0.20 * clamp(_d(hydrophobicity))


def distance(ax, ay, az, bx, by, bz) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))


def vina_pair(surface: Column, hydrophobic: Column, hbond: Column, w: dict = VINA) -> Column:
    """Weighted terms of an atom pair from its surface distance; the flags say whether both kinds can take part."""
    g1 = F.exp(-(surface / 0.5) * (surface / 0.5))
    g2 = F.exp(-((surface - 3) / 2) * ((surface - 3) / 2))
    rep = F.when(surface < 0, surface * surface).otherwise(0.0)
    hyd = F.when(hydrophobic, slope(1.5, 0.5, surface)).otherwise(0.0)
    hb = F.when(hbond, slope(0.0, -0.7, surface)).otherwise(0.0)
    return w["gauss1"] * g1 + w["gauss2"] * g2 + w["repulsion"] * rep + w["hydrophobic"] * hyd + w["hbond"] * hb


def vinardo_pair(surface: Column, hydrophobic: Column, hbond: Column, w: dict = VINARDO) -> Column:
    g = F.exp(-(surface / 0.8) * (surface / 0.8))
    rep = F.when(surface < 0, surface * surface).otherwise(0.0)
    hyd = F.when(hydrophobic, slope(2.5, 0.0, surface)).otherwise(0.0)
    hb = F.when(hbond, slope(0.0, -0.6, surface)).otherwise(0.0)
    return w["gauss"] * g + w["repulsion"] * rep + w["hydrophobic"] * hyd + w["hbond"] * hb


def ad4_dielectric(r: Column) -> Column:
    b = 78.4 + 8.5525
    return -8.5525 + b / (1 + 7.7839 * F.exp(-b * 0.003627 * r))


def conf_independent(e: Column, torsions: Column, rotor: float = VINA["rotor"], additive: bool = False) -> Column:
    """Energy with the cost of torsions: divided for the first two force fields, added for the third."""
    if additive:
        return e + rotor * _d(torsions)
    return F.when(torsions == 0, e).otherwise(e / (1 + rotor * _d(torsions)))


def curl(e: Column, v: float) -> Column:
    """A soft cap of positive energies."""
    return F.when(e > 0, e * v / (v + e)).otherwise(e)


def covalent_term(quality: Column, bond: Column, excess: Column) -> Column:
    return -(3 * quality + 5 * bond * quality) + 0.03 * excess * excess * bond


def rotor_scaled_attempts(rotors: Column) -> Column:
    return F.least(F.lit(128), F.greatest(F.lit(16), 8 * (1 + rotors)))


def cryptic_score(support: Column, absent_in_reference: Column, ratio: Column) -> Column:
    return (0.5 + 0.5 * support) * F.when(absent_in_reference, 2.0).otherwise(1.0) * F.least(ratio, F.lit(20.0))


def dihedral(p: list[tuple[Column, Column, Column]]) -> Column:
    """Signed angle in degrees of four points."""

    def sub(a, b):
        return [x - y for x, y in zip(a, b, strict=True)]

    def cross(a, b):
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    def dot(a, b):
        return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    b1, b2, b3 = sub(p[1], p[0]), sub(p[2], p[1]), sub(p[3], p[2])
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.degrees(F.atan2(F.sqrt(dot(b2, b2)) * dot(b1, n2), dot(n1, n2)))


def valid_pdb_id(c: Column) -> Column:
    """The identifier in upper case, or null if it is not four ASCII letters or digits."""
    t = F.trim(c)
    return F.when(t.rlike("^[A-Za-z0-9]{4}$"), F.upper(t))


def torsion_bin(angle: Column, degrees: int = 60) -> Column:
    return F.floor(F.pmod(angle + 360, F.lit(360.0)) / degrees).cast("int")


def usr_similarity(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return 1 / (1 + F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def interpolate(a: Column, b: Column, t: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (y - x) * t)
