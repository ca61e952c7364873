"""Ranks, normalised ranks, z-scores, rank correlation and consensus.

Ranks within many groups are windows over one group. Where groups are few or huge, ``positions`` and ``running_total`` count
over ranges instead: rows are dealt into sorted ranges and written once with the number of their range, and each range
goes on from the ranges before it, so that no task holds a group. Only finite values take part; others keep a null rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.stages import tasks_for, written


def finite(c: str | Column) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def _by(partition):
    return Window.partitionBy(*partition)


def average_ranks(df: DataFrame, value: str, partition: list[str], out: str = "rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean."""
    v = finite(value)
    within = Window.partitionBy(*partition, v.isNull()).orderBy(v)
    ties = Window.partitionBy(*partition, v)
    return df.withColumn(out, F.when(v.isNotNull(), F.rank().over(within) + (F.count("*").over(ties) - 1) / 2.0))


def normalised_ranks(df: DataFrame, value: str, partition: list[str], out: str = "norm_rank") -> DataFrame:
    """Average ranks scaled to 0..1; a single value has 0."""
    n = F.count(finite(value)).over(_by(partition))
    ranked = average_ranks(df, value, partition, "__r")
    scaled = F.when(F.col("__r").isNotNull(), F.when(n > 1, (F.col("__r") - 1) / (n - 1)).otherwise(0.0))
    return ranked.withColumn(out, scaled).drop("__r")


def z_scores(df: DataFrame, value: str, partition: list[str], out: str = "z") -> DataFrame:
    """Population z-scores; 0 where nothing varies."""
    v, w = finite(value), _by(partition)
    sd = F.stddev_pop(v).over(w)
    return df.withColumn(out, F.when(v.isNotNull(), F.when(sd > 0, (v - F.avg(v).over(w)) / sd).otherwise(0.0)))


def spearman(df: DataFrame, a: str, b: str, keys: list[str], out: str = "rho") -> DataFrame:
    """Pearson correlation of average ranks over rows where both are finite; null for constants and fewer than two rows."""
    rows = df.where(finite(a).isNotNull() & finite(b).isNotNull())
    rows = average_ranks(average_ranks(rows, a, keys, "__ra"), b, keys, "__rb")
    g = rows.groupBy(*keys).agg(F.covar_pop("__ra", "__rb").alias("__c"), F.stddev_pop("__ra").alias("__sa"), F.stddev_pop("__rb").alias("__sb"), F.count("*").alias("n"))
    return g.select(*keys, "n", F.when((F.col("n") > 1) & (F.col("__sa") > 0) & (F.col("__sb") > 0), F.col("__c") / (F.col("__sa") * F.col("__sb"))).alias(out))  # corr() raises for constants


def consensus(df: DataFrame, fields: list[str], keys: list[str], pose: str, method: str = "rank", weights: dict[str, float] | None = None) -> DataFrame:
    """A weighted mean of each pose's badness over scores (lower is better), its rank, and the scores it lacks.

    rank: normalised average rank; borda: average rank; z: z-score. A score that is not finite counts as 1.
    """
    weights = weights or {f: 1.0 for f in fields}
    out = df
    for f in fields:
        if method == "rank":
            out = normalised_ranks(out, f, keys, f"__b_{f}")
        elif method == "z":
            out = z_scores(out, f, keys, f"__b_{f}")
        elif method == "borda":
            out = average_ranks(out, f, keys, f"__b_{f}")
        else:
            raise ValueError(f"unknown method {method!r}")
    total = sum(weights.values())
    score = sum((F.coalesce(F.col(f"__b_{f}"), F.lit(1.0)) * weights[f] for f in fields), F.lit(0.0)) / total
    missing = F.array_compact(F.array(*[F.when(finite(f).isNull(), F.lit(f)) for f in fields]))
    out = out.withColumn("consensus", score).withColumn("missing", missing)
    order = Window.partitionBy(*keys).orderBy("consensus", pose)
    return out.withColumn("consensus_rank", F.row_number().over(order)).drop(*[f"__b_{f}" for f in fields])


def kendall_tau(df: DataFrame, a: str, b: str, keys: list[str], item: str) -> DataFrame:
    """Tau with ties of either list, pairs tied in both counting for both.

    Pairs are formed within a key, where lists are short; the statistic is defined on pairs.
    """
    x = df.select(*keys, F.col(item).alias("i1"), F.col(a).alias("a1"), F.col(b).alias("b1"))
    y = df.select(*keys, F.col(item).alias("i2"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    p = x.join(y, keys).where("i1 < i2").withColumn("da", F.signum(F.col("a1") - F.col("a2"))).withColumn("db", F.signum(F.col("b1") - F.col("b2")))
    g = p.groupBy(*keys).agg(
        F.count_if(F.col("da") * F.col("db") > 0).alias("conc"), F.count_if(F.col("da") * F.col("db") < 0).alias("disc"), F.count_if(F.col("da") == 0).alias("ta"), F.count_if(F.col("db") == 0).alias("tb"), F.count("*").alias("n")
    )
    below = F.sqrt((F.col("n") - F.col("ta")).cast("double") * (F.col("n") - F.col("tb")))
    return g.select(*keys, F.when(below > 0, (F.col("conc") - F.col("disc")) / below).alias("tau"))


def corrected_ranking(df: DataFrame, affinity: str, strain: str, keys: list[str], item: str) -> DataFrame:
    """Ranks by affinity, and by affinity plus strain where the strain is known; sums are equal to nine places."""
    corrected = F.round(F.col(affinity) + F.coalesce(finite(strain), F.lit(0.0)), 9)
    out = df.withColumn("corrected", corrected)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(affinity, item))).withColumn("corrected_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("corrected", item)))


def ranked(df: DataFrame, value: str, keys: list[str], ties: list[str], descending: bool = False, out: str = "rank") -> DataFrame:
    """Row numbers within groups; null values last, ties by the given columns."""
    v = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(v, *ties)))


def top_k(df: DataFrame, value: str, keys: list[str], ties: list[str], k: int, descending: bool = False) -> DataFrame:
    return ranked(df, value, keys, ties, descending).where(F.col("rank") <= k)


def _ranged(df: DataFrame, keys: list[str], order: list):
    """Rows in sorted ranges, written once with their range ``__p`` and place ``__i`` in it; and the same grouped by range and group."""
    n = tasks_for(df.sparkSession)
    by = [*keys, *order] or [F.lit(0)]
    place = F.monotonically_increasing_id()  # the range in the upper bits, the place below
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__m", place)
    rows, _ = written(dealt.withColumns({"__p": F.shiftright("__m", 33).cast("int"), "__i": F.col("__m").bitwiseAND((1 << 33) - 1)}).drop("__m"), "ranges")
    return rows, rows.groupBy("__p", *keys)


def _before(extents: DataFrame, keys: list[str], value: str) -> Column:
    """What the ranges before hold of the same group: one row a range and group is looked at."""
    w = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _same(keys: list[str], a: str, b: str) -> Column:
    on = F.col(f"{a}.__p") == F.col(f"{b}.__p")
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def positions(df: DataFrame, keys: list[str], order: list, out: str = "position") -> DataFrame:
    """Row numbers from 1 within groups (or over the whole table, without keys), however large a group is.

    Rows are sorted by range, so a row's number in its group and range is its place less the group's first one there;
    the groups of earlier ranges are added from a table of one row for each range and group. Rows equal in the order
    are numbered as they lie.
    """
    rows, grouped = _ranged(df, keys, order)
    extents = grouped.agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    extents = extents.withColumn("__base", _before(extents, keys, "__n") - F.col("__first") + 1).select("__p", *keys, "__base")
    found = rows.alias("r").join(extents.alias("e"), _same(keys, "r", "e"))
    return found.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r.__i") + F.col("e.__base")).cast("long").alias(out))


def running_total(df: DataFrame, keys: list[str], order: list, value: str, out: str) -> DataFrame:
    """The sum of ``value`` up to each row, itself included, in its group; no task holds more of a group than one range."""
    rows, grouped = _ranged(df, keys, order)
    extents = grouped.agg(F.sum(value).alias("__sum"))
    extents = extents.withColumn("__base", _before(extents, keys, "__sum")).select("__p", *keys, "__base")
    within = Window.partitionBy("__p", *keys).orderBy("__i")
    summed = rows.withColumn("__within", F.sum(value).over(within))
    found = summed.alias("r").join(extents.alias("e"), _same(keys, "r", "e"))
    return found.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r.__within") + F.col("e.__base")).alias(out))


def global_positions(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Positions from 1 over the whole table."""
    return positions(df, [], order, out)
