"""Covalent attack: geometry of a warhead and a nucleophile, its class, and the energy term."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import clamp

#: Limits of distance, ramps, rewards and the adduct's strain.
BONDED, NEAR_ATTACK, DISTANCE_RAMP, ANGLE_RAMP, BOND_RAMP = 2.0, 4.0, 0.6, 20.0, 0.5
NEAR_REWARD, BOND_REWARD, STRAIN_K, IDEAL_ANGLE, ANGLE_TOLERANCE = 3.0, 5.0, 0.03, 109.5, 10.0

Point = tuple[Column, Column, Column]


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def angle(a: Point, b: Point, c: Point) -> Column:
    """The angle at b in degrees; null where two points coincide."""
    u, v = [x - y for x, y in zip(a, b, strict=True)], [x - y for x, y in zip(c, b, strict=True)]
    dot = u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    below = distance(a, b) * distance(c, b)
    return F.when(below > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / below)))))


def soft_window(x: Column, low: float | Column, high: float | Column, ramp: float) -> Column:
    """1 inside the window, falling to 0 over the ramp outside of it by half a cosine."""
    out = F.greatest(F.lit(0.0), low - x, x - high)
    return F.when(out >= ramp, 0.0).otherwise(0.5 * (1 + F.cos(math.pi * out / ramp)))


def bond_fraction(d: Column) -> Column:
    """0 at the greatest bonded distance, 1 from half an angstrom below it, by half a cosine between."""
    return 0.5 * (1 - F.cos(math.pi * clamp((BONDED - d) / BOND_RAMP)))


def quality(d: Column, a: Column, low: float | Column, high: float | Column) -> Column:
    return F.when(a.isNull(), 0.0).otherwise(soft_window(d, F.lit(0.0), F.lit(NEAR_ATTACK), DISTANCE_RAMP) * soft_window(a, low, high, ANGLE_RAMP))


def attack_class(d: Column, a: Column, low: float | Column, high: float | Column) -> Column:
    inside = (a >= low) & (a <= high)
    return F.when(a.isNull(), "non_productive").when((d <= BONDED + 1e-9) & inside, "bonded").when((d <= NEAR_ATTACK + 1e-9) & inside, "near_attack").otherwise("non_productive")


def attack_reason(d: Column, a: Column, low: float | Column, high: float | Column) -> Column:
    """Why an attack is not productive; empty for one that is."""
    return F.when(attack_class(d, a, low, high) != "non_productive", "").when(a.isNull(), "undefined angle").when(d > NEAR_ATTACK, "out of reach").otherwise("angle outside the window")


def covalent_term(q: Column, bond: Column, a: Column) -> Column:
    """The reward of an approach and of a bond, and the strain of an adduct angle outside its tolerance."""
    q, bond = clamp(q), clamp(bond)
    excess = F.coalesce(F.greatest(F.lit(0.0), F.abs(a - IDEAL_ANGLE) - ANGLE_TOLERANCE), F.lit(0.0))
    return -(NEAR_REWARD * q + BOND_REWARD * bond * q) + STRAIN_K * excess * excess * bond


def covalent_score(non_covalent: Column, q: Column, bond: Column, a: Column) -> Column:
    return non_covalent + covalent_term(q, bond, a)


def measure_ok(x: Column, low: float, high: float) -> Column:
    """Whether a measure of an adduct lies in its range."""
    return F.coalesce(x.between(low, high), F.lit(False))
