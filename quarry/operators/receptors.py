"""Receptor structures: classes of residues, cleaning, missing atoms, hydrogens, charged groups, sites and nucleophiles.

Atoms are ``(keys, atom, name, element, res_name, chain, res_id, x, y, z, charge)``; bonds are ``(keys, i, j)`` with i < j.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reach import within
from .spatial import range_join, squared

#: Names that results depend on.
SOLVENT = ("HOH", "WAT", "DOD", "TIP3", "H2O", "TIP4", "SPC", "SOL", "D2O")
SOLVENT_PREFIXES = ("HOH", "WAT", "DOD", "TIP", "SPC", "SOL", "T3P", "T4P", "D2O")
METALS = ("ZN", "MG", "CA", "MN", "FE", "CU", "CO", "NI", "CD", "HG", "NA", "K", "CS", "RB", "SR", "BA")
COUNTERIONS = ("CL", "BR", "IOD", "F", "SO4", "PO4", "NO3", "ACT", "EDO", "GOL", "FMT", "MES", "TRS")
COFACTORS = ("HEM", "HEC", "HEME", "NAD", "NAP", "NADH", "NAH", "FAD", "FMN", "PLP", "PMP", "ATP", "ADP", "AMP", "GTP", "GDP", "SAM", "SAH", "COA", "TPP", "THF", "UQ", "MQ", "PQQ", "B12", "CLA", "BCL", "HTH")
AMINO_ACIDS = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "ASX", "GLX")
MODIFIED = ("MSE", "SEC", "PYL", "SEP", "TPO", "PTR", "CSO", "KCX", "MLY", "M3L", "HYP", "PCA", "FME", "LLP", "CME", "CSD", "OCS", "SAC", "CAS", "ALY", "NEP", "HIC", "MHO", "SME", "YCM")
NUCLEOTIDES = ("A", "C", "G", "U", "I", "DA", "DC", "DG", "DT", "DU", "DI", "ADE", "CYT", "GUA", "THY", "URI", "PSU", "5MC", "1MA", "5MU", "7MG")
#: Heavy atoms of side chains; every residue has the backbone's too.
BACKBONE = ("N", "CA", "C", "O")
SIDE_CHAINS = {
    "ALA": "CB", "ARG": "CB CG CD NE CZ NH1 NH2", "ASN": "CB CG OD1 ND2", "ASP": "CB CG OD1 OD2", "CYS": "CB SG", "GLN": "CB CG CD OE1 NE2", "GLU": "CB CG CD OE1 OE2", "GLY": "",
    "HIS": "CB CG ND1 CD2 CE1 NE2", "ILE": "CB CG1 CG2 CD1", "LEU": "CB CG CD1 CD2", "LYS": "CB CG CD CE NZ", "MET": "CB CG SD CE", "PHE": "CB CG CD1 CD2 CE1 CE2 CZ", "PRO": "CB CG CD",
    "SER": "CB OG", "THR": "CB OG1 CG2", "TRP": "CB CG CD1 CD2 NE1 CE2 CE3 CZ2 CZ3 CH2", "TYR": "CB CG CD1 CD2 CE1 CE2 CZ OH", "VAL": "CB CG1 CG2",
}
#: Atomic masses of the elements that ligands are made of.
MASSES = {"C": 12.011, "N": 14.007, "O": 15.999, "S": 32.06, "P": 30.974, "F": 18.998, "CL": 35.45, "BR": 79.904, "I": 126.904, "B": 10.81, "SE": 78.971, "SI": 28.085}
LIGAND_MASS = 150.0
#: Greatest distance of a salt bridge, of a hydrogen bond over water, and of a site's residues.
SALT_BRIDGE, WATER_LEG, SITE_RADIUS, SITE_RESIDUES = 4.0, 3.5, 8.0, 40

RESIDUE = ["chain", "res_id", "res_name"]


def is_solvent(name: Column) -> Column:
    n = F.upper(F.trim(name))
    out = n.isin(*SOLVENT)
    for p in SOLVENT_PREFIXES:
        out = out | n.startswith(p)
    return out


def mass_of(element: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(element))), F.lit(0.0))


def kind_of(name: Column, heavy: Column, mass: Column) -> Column:
    """Solvent, cofactor, ion, ligand or other; null for a polymer's own residues."""
    n = F.upper(F.trim(name))
    return (
        F.when(is_solvent(name), "solvent").when(n.isin(*COFACTORS), "cofactor").when(n.isin(*METALS, *COUNTERIONS), "ion").when(n.isin(*AMINO_ACIDS, *MODIFIED, *NUCLEOTIDES), None)
        .when((heavy > 1) & (mass > LIGAND_MASS), "ligand").otherwise("other")
    )


def hetero_residues(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, chain, res_id, res_name, kind, atoms, heavy_atoms, mass)`` of residues that are not the polymer's."""
    heavy = F.upper(F.col("element")) != "H"
    g = atoms.groupBy(*keys, *RESIDUE).agg(F.count("*").alias("atoms"), F.count_if(heavy).alias("heavy_atoms"), F.sum(F.when(heavy, mass_of(F.col("element"))).otherwise(0.0)).alias("mass"))
    return g.withColumn("kind", kind_of(F.col("res_name"), F.col("heavy_atoms"), F.col("mass"))).where("kind is not null")


def clean_receptor(atoms: DataFrame, keys: list[str], keep_water_within: float | None = None, drop_ligands: bool = True, drop_ions: bool = True, keep_cofactors: bool = True, keep: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """The atoms that stay. Named residues to drop come first, then named ones to keep, then the rules by kind.

    With ``keep_water_within``, waters stay that have an atom so near to a ligand's; without a ligand none does.
    """
    kinds = hetero_residues(atoms, keys).select(*keys, *RESIDUE, "kind")
    rows = atoms.join(kinds, [*keys, *RESIDUE], "left")
    name = F.upper(F.trim("res_name"))
    kind = F.col("kind")
    forced, kept = (name.isin(*drop) if drop else F.lit(False)), (name.isin(*keep) if keep else F.lit(False))
    water = kind == "solvent"
    near = F.lit(False)
    if keep_water_within is not None:
        ligand = rows.where((kind == "ligand") & ~forced).select(*keys, "x", "y", "z")
        wet = rows.where(water).select(*keys, *RESIDUE, "x", "y", "z")
        close = range_join(wet, ligand, keep_water_within, keys).select(*keys, *[F.col(f"a_{c}").alias(c) for c in RESIDUE]).distinct().withColumn("close", F.lit(True))
        rows = rows.join(close, [*keys, *RESIDUE], "left")
        near = F.coalesce("close", F.lit(False))
    goes = (
        F.when(kind.isNull(), False).when(forced, True).when(water, ~near).when(kept, False).when(kind == "ligand", drop_ligands).when(kind == "ion", drop_ions).when(kind == "cofactor", not keep_cofactors).otherwise(False)
    )
    return rows.where(~goes).select(*atoms.columns)


def split_crystal(atoms: DataFrame, ligand: str) -> tuple[DataFrame, DataFrame]:
    """The receptor's atoms and the named ligand's."""
    own = F.upper(F.trim("res_name")) == ligand.upper()
    return atoms.where(~own), atoms.where(own)


def ligand_molecules(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Atoms of co-crystallised ligands, numbered as molecules of their structure."""
    found = hetero_residues(atoms, keys).where("kind = 'ligand'").select(*keys, *RESIDUE)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*RESIDUE))
    return atoms.join(found.withColumn("molecule", number), [*keys, *RESIDUE])


def templates(spark) -> DataFrame:
    """``(res_name, name)``: the heavy atoms of each standard residue."""
    rows = [(r, a) for r, side in SIDE_CHAINS.items() for a in (*BACKBONE, *side.split())]
    return spark.createDataFrame(rows, "res_name string, name string")


def missing_atoms(atoms: DataFrame, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    """``(keys, chain, res_id, res_name, missing)``: what residues lack of their template, in the template's names; others are skipped."""
    expected = templates(atoms.sparkSession) if expected is None else expected
    residues = atoms.select(*keys, *RESIDUE).distinct()
    wanted = residues.join(F.broadcast(expected), "res_name")  # a fixed table
    lost = wanted.join(atoms.select(*keys, *RESIDUE, F.trim("name").alias("name")).distinct(), [*keys, *RESIDUE, "name"], "left_anti")
    return lost.groupBy(*keys, *RESIDUE).agg(F.array_sort(F.collect_list("name")).alias("missing"))


def hydrogens(atoms: DataFrame, bonds: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, atom, parent, parent_element, polar)`` of each hydrogen; polar on N, O or S."""
    both = bonds.select(*keys, F.col("i").alias("atom"), F.col("j").alias("parent")).unionByName(bonds.select(*keys, F.col("j").alias("atom"), F.col("i").alias("parent")))
    element = F.upper(F.col("element"))
    h = atoms.where(element == "H").select(*keys, "atom")
    rows = h.join(both, [*keys, "atom"]).join(atoms.select(*keys, F.col("atom").alias("parent"), element.alias("parent_element")), [*keys, "parent"])
    return rows.select(*keys, "atom", "parent", "parent_element", F.col("parent_element").isin("N", "O", "S").alias("polar"))


def without_nonpolar_hydrogens(atoms: DataFrame, bonds: DataFrame, keys: list[str], fold: bool = True) -> DataFrame:
    """Atoms without the hydrogens on carbon; their charges are added to that carbon."""
    gone = hydrogens(atoms, bonds, keys).where("parent_element = 'C'")
    out = atoms.join(gone.select(*keys, "atom"), [*keys, "atom"], "left_anti")
    if not fold:
        return out
    extra = gone.join(atoms.select(*keys, "atom", "charge"), [*keys, "atom"]).groupBy(*keys, F.col("parent").alias("atom")).agg(F.sum("charge").alias("extra"))
    return out.join(extra, [*keys, "atom"], "left").withColumn("charge", F.col("charge") + F.coalesce("extra", F.lit(0.0))).select(*atoms.columns)


def group_charges(members: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, group, atom, expected, charge)`` -> what each group should carry, carries, and whether its charges can stand for that:
    not if they are zero, of the other sign, or less than half a charge."""
    g = members.groupBy(*keys, "group").agg(F.first("expected").alias("expected"), F.sum("charge").alias("observed"), F.count("*").alias("n"))
    ok = F.when(F.col("expected") == 0, True).otherwise((F.signum("observed") == F.signum("expected")) & (F.abs("observed") >= 0.5))
    return g.withColumn("possible", ok).withColumn("disagrees", F.abs(F.col("expected") - F.col("observed")) >= 1e-9)


def corrected_charges(members: DataFrame, keys: list[str]) -> DataFrame:
    """Charges moved so that each group with an expected charge carries it, in equal parts."""
    w = Window.partitionBy(*keys, "group")
    gap = F.col("expected") - F.sum("charge").over(w)
    moved = F.col("charge") + gap / F.count("*").over(w)
    return members.withColumn("charge", F.when((F.col("expected") != 0) & (F.abs(gap) >= 1e-9), moved).otherwise(F.col("charge")))


def salt_bridges(groups: DataFrame, receptor: DataFrame, keys: list[str], distance: float = SALT_BRIDGE) -> DataFrame:
    """``(keys, group, atom, distance)``: charged groups ``(.., group, x, y, z, charge)`` and receptor atoms of the opposite charge."""
    near = range_join(groups, receptor.select(*keys, "atom", "x", "y", "z", "charge"), distance, keys).where("a_charge * b_charge < 0")
    return near.groupBy(*keys, F.col("a_group").alias("group"), F.col("b_atom").alias("atom")).agg(F.sqrt(F.min("d2")).alias("distance"))


def residues_within(atoms: DataFrame, centres: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """``(keys, chain, res_id, res_name, distance)``: residues with an atom within the radius of a centre, and how near it is."""
    near = range_join(atoms.where("res_name <> ''").select(*keys, *RESIDUE, "x", "y", "z"), centres.select(*keys, "x", "y", "z"), radius, keys)
    return near.groupBy(*keys, *[F.col(f"a_{c}").alias(c) for c in RESIDUE]).agg(F.sqrt(F.min("d2")).alias("distance"))


def site_residues(atoms: DataFrame, centres: DataFrame, keys: list[str], radius: float = SITE_RADIUS, most: int = SITE_RESIDUES) -> DataFrame:
    """The nearest residues of a site, at most ``most``, ties by chain and number."""
    near = residues_within(atoms, centres, keys, radius)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", *RESIDUE))).where(F.col("rank") <= most)


def site_spec(spec: Column) -> Column:
    """A list of residues such as ``A:ASP189,190`` as structs of chain, res_id and res_name; null names and numbers that are missing."""
    tokens = F.filter(F.transform(F.split(F.replace(spec, F.lit(";"), F.lit(",")), ","), lambda t: F.trim(t)), lambda t: t != "")

    def one(t: Column) -> Column:
        body = F.trim(F.regexp_replace(t, "^[^:/]*[^:/ ]\\s*[:/]", ""))
        chain = F.upper(F.trim(F.regexp_extract(t, "^([^:/]*[^:/ ])\\s*[:/]", 1)))
        return F.struct(chain.alias("chain"), F.nullif(F.regexp_replace(body, "[^0-9]", ""), F.lit("")).cast("int").alias("res_id"), F.nullif(F.upper(F.regexp_replace(body, "[^A-Za-z]", "")), F.lit("")).alias("res_name"))

    return F.transform(tokens, one)


def water_bridges(waters: DataFrame, receptor: DataFrame, ligand: DataFrame, keys: list[str], cutoff: float = WATER_LEG) -> DataFrame:
    """``(keys, water, a, b, distance)``: waters whose nearest polar atoms of receptor and ligand are both within the cutoff."""

    def leg(side: DataFrame, name: str) -> DataFrame:
        near = range_join(waters.select(*keys, "atom", "x", "y", "z"), side.select(*keys, "atom", "x", "y", "z"), cutoff, keys)
        best = near.groupBy(*keys, F.col("a_atom").alias("water")).agg(F.min(F.struct("d2", "b_atom")).alias("m"))
        return best.select(*keys, "water", F.col("m.b_atom").alias(name), F.sqrt("m.d2").alias(f"d_{name}"))

    both = leg(receptor, "a").join(leg(ligand, "b"), [*keys, "water"])
    return both.select(*keys, "water", "a", "b", F.least("d_a", "d_b").alias("distance"))


def nucleophiles(atoms: DataFrame, keys: list[str], residues: tuple[str, ...] = ("CYS", "SEC"), names: tuple[str, ...] = ("SG", "SE")) -> DataFrame:
    """The attacking atom of each reactive residue, with its neighbour on the chain (CB) where that is there."""
    own = F.upper(F.trim("res_name")).isin(*residues)
    hit = atoms.where(own & F.trim("name").isin(*names)).select(*keys, *RESIDUE, "atom", "x", "y", "z")
    cb = atoms.where(own & (F.trim("name") == "CB")).select(*keys, *RESIDUE, F.col("atom").alias("anchor"))
    return hit.join(cb, [*keys, *RESIDUE], "left")


def classify_points(points: DataFrame, cells: DataFrame, keys: list[str], tolerance: float = 2.5) -> DataFrame:
    """``(keys, point, label, kind)``: the pocket of the nearest cell within the tolerance, else none and ``bulk``."""
    near = range_join(points, cells, tolerance, keys)
    best = near.groupBy(*keys, F.col("a_point").alias("point")).agg(F.min(F.struct("d2", "b_label", "b_kind")).alias("m"))
    out = points.select(*keys, "point").join(best, [*keys, "point"], "left")
    return out.select(*keys, "point", F.col("m.b_label").alias("label"), F.coalesce("m.b_kind", F.lit("bulk")).alias("kind"))


def clearest_points(points: DataFrame, atoms: DataFrame, keys: list[str]) -> DataFrame:
    """The point of each group that is farthest from all atoms' surfaces, ties by number."""
    x = points.select(*keys, F.col("point"), *[F.col(c).alias(f"a_{c}") for c in "xyz"])
    y = atoms.select(*keys, "radius", *[F.col(c).alias(f"b_{c}") for c in "xyz"])
    clear = x.join(y, keys).groupBy(*keys, "point").agg(F.min(F.sqrt(squared()) - F.col("radius")).alias("clearance"))
    best = clear.groupBy(*keys).agg(F.min(F.struct((-F.col("clearance")).alias("c"), "point")).alias("m"))
    return best.select(*keys, F.col("m.point").alias("point"), (-F.col("m.c")).alias("clearance"))


def perceived_bonds(atoms: DataFrame, keys: list[str], factor: float = 1.1, most: float = 2.2) -> DataFrame:
    """Pairs whose distance is below ``factor`` times the sum of their covalent radii (column ``covalent``)."""
    near = range_join(atoms.select(*keys, "atom", "covalent", "x", "y", "z"), atoms.select(*keys, "atom", "covalent", "x", "y", "z"), most * factor, keys, inclusive=False)
    limit = factor * (F.col("a_covalent") + F.col("b_covalent"))
    return near.where((F.col("a_atom") < F.col("b_atom")) & (F.sqrt("d2") < limit)).select(*keys, F.col("a_atom").alias("i"), F.col("b_atom").alias("j"), F.sqrt("d2").alias("length"))


def bonded_within(bonds: DataFrame, keys: list[str], steps: int = 3) -> DataFrame:
    """``(keys, i, j, steps)`` with i < j: pairs that so few bonds connect, and the fewest."""
    return within(bonds, keys, steps)
