"""Accessible surface: by atom, by residue, and what a partner buries.

Atoms are ``(keys, atom, x, y, z, radius)``, residues add ``chain``, ``res_id`` and ``res_name``. Areas come from
``spatial.sasa``; the atoms of a partner cover points but have no area of their own there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import sasa

RESIDUE = ["chain", "res_id", "res_name"]


def residue_areas(atoms: DataFrame, keys: list[str], other: DataFrame | None = None) -> DataFrame:
    """``(keys, chain, res_id, res_name, atoms, area)``: areas summed by residue, with or without a partner."""
    area = sasa(atoms, keys, others=other)
    named = atoms.select(*keys, "atom", *RESIDUE)
    return area.join(named, [*keys, "atom"]).groupBy(*keys, *RESIDUE).agg(F.count("*").alias("atoms"), F.sum("sasa").alias("area"))


def burial(atoms: DataFrame, keys: list[str], other: DataFrame | None = None, reference: str = "free") -> DataFrame:
    """Areas by residue beside a reference: the residue cut out (``free``) or the structure without its partner (``unbound``)."""
    now = residue_areas(atoms, keys, other)
    if reference == "free":
        alone = sasa(atoms.select(*keys, *RESIDUE, "atom", "x", "y", "z", "radius"), [*keys, *RESIDUE])
        ref = alone.groupBy(*keys, *RESIDUE).agg(F.sum("sasa").alias("reference_area"))
    elif reference == "unbound":
        ref = residue_areas(atoms, keys).select(*keys, *RESIDUE, F.col("area").alias("reference_area"))
    else:
        raise ValueError(f"reference must be 'free' or 'unbound', got {reference!r}")
    out = now.join(ref, [*keys, *RESIDUE])
    buried = F.greatest(F.lit(0.0), F.col("reference_area") - F.col("area"))
    return out.withColumn("buried_area", buried).withColumn("buried_fraction", F.when(F.col("reference_area") > 0, F.least(F.lit(1.0), F.col("buried_area") / F.col("reference_area"))))


def most_buried(report: DataFrame, keys: list[str], count: int = 10) -> DataFrame:
    """The residues that lose the most area, largest first, ties by label."""
    from pyspark.sql import Window

    label = F.concat_ws("/", F.nullif(F.col("chain"), F.lit("")), F.concat("res_name", F.col("res_id").cast("string")))
    w = Window.partitionBy(*keys).orderBy(F.col("buried_area").desc(), label)
    return report.where("buried_area > 0").withColumn("label", label).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def buried_contact(ligand: DataFrame, receptor: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """Per group: the ligand's area alone and beside the receptor, what is buried, and the atoms in contact.

    ``on`` are the keys that the receptor has too (all by default); further keys are poses of one receptor.
    """
    shared = keys if on is None else on
    partner = receptor
    if shared != keys:  # each pose meets its receptor
        partner = ligand.select(*keys).distinct().join(receptor, shared)
    free = sasa(ligand, keys).withColumnRenamed("sasa", "free")
    bound = sasa(ligand, keys, others=partner).withColumnRenamed("sasa", "bound")
    both = free.join(bound, [*keys, "atom"])
    g = both.groupBy(*keys).agg(F.sum("free").alias("free_area"), F.sum("bound").alias("complex_area"), F.count("*").alias("ligand_atoms"), F.count_if(F.col("bound") < F.col("free") - 1e-9).alias("contact_atoms"))
    g = g.withColumn("buried_area", F.greatest(F.lit(0.0), F.col("free_area") - F.col("complex_area")))
    share = F.when(F.col("free_area") > 0, F.col("buried_area") / F.col("free_area")).otherwise(F.lit(0.0))
    return g.withColumn("buried_fraction", share)


def interface_area(receptor: DataFrame, ligand: DataFrame, keys: list[str]) -> DataFrame:
    """The receptor's side: its area alone, beside the ligand, and what is buried."""
    free = sasa(receptor, keys).groupBy(*keys).agg(F.sum("sasa").alias("free_area"), F.count("*").alias("receptor_atoms"))
    bound = sasa(receptor, keys, others=ligand).groupBy(*keys).agg(F.sum("sasa").alias("complex_area"))
    return free.join(bound, keys).withColumn("buried_area", F.greatest(F.lit(0.0), F.col("free_area") - F.col("complex_area")))


def buried_area(ligand: DataFrame, receptor: DataFrame, keys: list[str]) -> DataFrame:
    """What both sides of a complex lose: ``(keys, ligand, receptor, total)``."""
    x = buried_contact(ligand, receptor, keys).select(*keys, F.col("buried_area").alias("ligand"))
    y = interface_area(receptor, ligand, keys).select(*keys, F.col("buried_area").alias("receptor"))
    return x.join(y, keys).withColumn("total", F.col("ligand") + F.col("receptor"))


def polar_burial(atoms: DataFrame, keys: list[str], receptor: DataFrame | None = None, full: float = 35.0) -> DataFrame:
    """Desolvation: the mean over atoms ``(.., polarity)`` of polarity times burial, alone or inside a complex; and how many atoms are
    both half polar and half buried."""
    area = sasa(atoms, keys, others=receptor)
    rows = area.join(atoms.select(*keys, "atom", "polarity"), [*keys, "atom"]).withColumn("burial", 1 - F.least(F.lit(1.0), F.col("sasa") / full))
    return rows.groupBy(*keys).agg(F.avg(F.col("polarity") * F.col("burial")).alias("desolvation"), F.count_if((F.col("polarity") >= 0.5) & (F.col("burial") >= 0.5)).alias("buried_polar"), F.count("*").alias("n_atoms"))


def overlap_penalty(ligand: DataFrame, receptor: DataFrame, keys: list[str], reference: float = 1.0, threshold: float = 0.9, most: float = 2.0) -> DataFrame:
    """The mean over ligand atoms of how far they stand inside receptor atoms, each at most 1; ``most`` is the greatest radius."""
    from .spatial import range_join

    near = range_join(ligand.select(*keys, "atom", "x", "y", "z", "radius"), receptor.select(*keys, "atom", "x", "y", "z", "radius"), 2 * most * threshold, keys)
    depth = F.greatest(F.lit(0.0), threshold * (F.col("a_radius") + F.col("b_radius")) - F.sqrt("d2"))
    inside = near.groupBy(*keys, F.col("a_atom").alias("atom")).agg(F.least(F.lit(1.0), F.sum(depth) / reference).alias("inside"))
    rows = ligand.select(*keys, "atom").join(inside, [*keys, "atom"], "left")
    return rows.groupBy(*keys).agg(F.avg(F.coalesce("inside", F.lit(0.0))).alias("overlap"))
