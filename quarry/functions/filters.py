"""Rule filters: each gives the names of the properties that break it; an empty list passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed limits: property -> (least, greatest), inclusive.
LIPINSKI = {"MW": (None, 500.0), "LogP": (None, 5.0), "HBD": (None, 5.0), "HBA": (None, 10.0)}
VEBER = {"RotB": (None, 10.0), "TPSA": (None, 140.0)}
EGAN = {"TPSA": (None, 131.6), "LogP": (None, 5.88)}
GHOSE = {"MW": (160.0, 480.0), "LogP": (-0.4, 5.6), "n_heavy": (20.0, 70.0), "MR": (40.0, 130.0)}


def violations(limits: dict[str, tuple[float | None, float | None]], columns: dict[str, Column]) -> Column:
    """Names of the properties outside their window, in the order of the limits; a missing value breaks its window."""
    checks = []
    for name, (low, high) in limits.items():
        c = columns[name].cast("double")
        out = c.isNull() | F.isnan(c)
        if low is not None:
            out = out | (c < low)
        if high is not None:
            out = out | (c > high)
        checks.append(F.when(out, F.lit(name)))
    return F.array_compact(F.array(*checks))


def passes(limits, columns) -> Column:
    return F.size(violations(limits, columns)) == 0


def first_failed(named: list[tuple[str, Column]]) -> Column:
    """The first of the named verdicts that does not hold, or null."""
    out = F
    for name, ok in named:
        out = out.when(~ok, F.lit(name))
    return out.otherwise(None)


def parse_window(text: Column) -> Column:
    """``MIN:MAX`` as a struct of two numbers; either side may be empty."""
    parts = F.split(text, ":")

    def side(k):
        return F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit("")).try_cast("double")

    return F.struct(side(0).alias("low"), side(1).alias("high"))
