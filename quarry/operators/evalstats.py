"""Evaluation of rankings: enrichment, ROC area, BEDROC, bootstraps and detectable differences.

Everything is per group of ``keys``. Scores order descending, ties by the item. Places are counted over ranges
(``ranking.positions``), so that four groups are not four tasks. Draws of the bootstraps are arithmetic on the item's number, so
results do not depend on partitions. A resampled ROC area is counted over sorted ranges, all resamples of a row at once; other
statistics are declarative aggregates over weighted rows by (keys, resample). No group of all scores is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.stages import tasks_for, written

from .ranking import positions, running_total

EF_FRACTIONS = (0.01, 0.05)
BEDROC_ALPHA = 20.0
BOOTSTRAP_SAMPLES = 1000
SEED = 20240101

#: A statistic of weighted rows ``(keys, score, label, w)``: a frame ``(keys, value)``.
Statistic = Callable[[DataFrame, str, str, list[str]], DataFrame]


def placed(df: DataFrame, score: str, label: str, keys: list[str], item: str) -> DataFrame:
    """``(keys, score, label, place, n, a)``: places from 1, rows and actives of each group; written once for all statistics."""
    rows = df.select(*keys, F.col(score).alias("__s"), F.col(label).cast("long").alias("__y"), F.col(item).alias("__item"))
    rows = positions(rows, keys, [F.col("__s").desc_nulls_last(), F.col("__item")], "__place").drop("__item")
    totals = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("__y").alias("__a"))
    return rows.join(totals, keys)


def _depth(fraction: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("__n"))).cast("long")


def _enrichment(fraction: float) -> list[Column]:
    k = _depth(fraction)
    return [F.max(k).alias("k"), F.sum(F.when(F.col("__place") <= k, F.col("__y")).otherwise(0)).alias("hits")]


def _ratio(hits: str, k: str) -> Column:
    """Enrichment over the base rate; 0 where there are no actives."""
    return F.when(F.col("actives") > 0, (F.col(hits) / F.col(k)) / (F.col("actives") / F.col("n"))).otherwise(F.lit(0.0))


def ef_at(df: DataFrame, score: str, label: str, keys: list[str], item: str, fraction: float) -> DataFrame:
    """Hits among the best k = max(1, ceil(fraction * n)), their share, and their enrichment over the base rate."""
    g = placed(df, score, label, keys, item).groupBy(*keys).agg(F.max("__n").alias("n"), F.max("__a").alias("actives"), *_enrichment(fraction))
    recall = F.when(F.col("actives") > 0, F.col("hits") / F.col("actives")).otherwise(F.lit(0.0))
    return g.select(*keys, "n", "k", "actives", "hits", (F.col("hits") / F.col("k")).alias("precision"), recall.alias("recall"), (F.col("actives") / F.col("n")).alias("base_rate"), _ratio("hits", "k").alias("ef"))


def auc(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """Area under the ROC curve; null where a class is missing. Ties count half."""
    return weighted_auc(df.withColumn("w", F.lit(1)), score, label, keys)


def _weight(alpha: float) -> Column:
    return F.exp(-alpha * (F.col("__place") - 0.5) / F.col("__n"))


def _bedroc(alpha: float) -> list[Column]:
    w = _weight(alpha)
    return [F.sum(F.when(F.col("__y") == 1, w)).alias("f"), F.avg(w).alias("rand"), F.sum(F.when(F.col("__place") <= F.col("__a"), w)).alias("best")]


def _recognition() -> Column:
    mean, best = F.col("f") / F.col("actives"), F.col("best") / F.col("actives")
    value = 0.5 + 0.5 * (mean - F.col("rand")) / (best - F.col("rand"))
    return F.when((F.col("actives") > 0) & (F.col("actives") < F.col("n")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def bedroc(df: DataFrame, score: str, label: str, keys: list[str], item: str, alpha: float = BEDROC_ALPHA) -> DataFrame:
    """Exponentially weighted early recognition, 1 for a perfect and 0.5 for a random order; null where a class is missing.

    Weights fall with the middle of a row's place. The random value is the mean weight, the perfect one the
    mean of the first weights.
    """
    g = placed(df, score, label, keys, item).groupBy(*keys).agg(F.max("__n").alias("n"), F.max("__a").alias("actives"), *_bedroc(alpha))
    return g.select(*keys, _recognition().alias("bedroc"))


def metrics(df: DataFrame, score: str, label: str, keys: list[str], item: str) -> DataFrame:
    """EF at 1 % and 5 %, ROC area and BEDROC, to four places, from one table of places."""
    rows = placed(df, score, label, keys, item)
    aggs = [F.max("__n").alias("n"), F.max("__a").alias("actives"), *_bedroc(BEDROC_ALPHA)]
    for k, f in enumerate(EF_FRACTIONS):
        depth, hits = _enrichment(f)
        aggs += [depth.alias(f"k{k}"), hits.alias(f"hits{k}")]
    g = rows.groupBy(*keys).agg(*aggs)
    # of one score, the mean place is its rank from the top; from the bottom it is n + 1 less that
    ties = rows.groupBy(*keys, "__s").agg(F.sum("__y").alias("p"), (F.max("__n") + 1 - F.avg("__place")).alias("r"), F.count("*").alias("c"))
    ranks = ties.groupBy(*keys).agg(F.sum(F.col("p") * F.col("r")).alias("s"), F.sum("p").alias("p"), F.sum("c").alias("c"))
    q = F.col("c") - F.col("p")
    area = F.when((F.col("p") > 0) & (q > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p").cast("double") * q))
    out = g.join(ranks.select(*keys, area.alias("auc")), keys).withColumn("bedroc", _recognition())
    return out.select(*keys, *[F.round(_ratio(f"hits{k}", f"k{k}"), 4).alias(f"ef{int(f * 100)}") for k, f in enumerate(EF_FRACTIONS)], *[F.round(c, 4).alias(c) for c in ("auc", "bedroc")])


def minimum_detectable_difference(standard_error: float, power: float = 0.8, level: float = 0.95) -> float:
    d = NormalDist()
    return (d.inv_cdf(0.5 + level / 2) + d.inv_cdf(power)) * standard_error


PRIME = 2147483647


def uniform(item: Column, b: Column, seed: int) -> Column:
    """A number in (0, 1) from an item's number, a resample and a seed, by integer arithmetic that any engine repeats."""
    x = F.pmod(F.pmod(item, F.lit(PRIME)) * 1000003 + b * 104729 + seed, F.lit(PRIME))
    for step in (48271, 69621, 16807):
        x = F.pmod(x * x + x * step + 1, F.lit(PRIME))
    return (x + 0.5) / float(PRIME)


def _shares(most: int = 12) -> list[float]:
    """Above which numbers in (0, 1) a row is drawn once, twice and so on."""
    cut, total, out = math.exp(-1), 0.0, []
    for k in range(most):
        total += cut
        out.append(total)
        cut /= k + 1
    return out


@dataclass
class Resamples:
    """Poisson bootstrap: each row enters resample ``b`` a Poisson(1) number of times, drawn by its number and the resample's.

    Needs no index of rows and no gathered group; draws are made where they are used. The chance of more than eleven draws is below
    1e-9 and left out.
    """

    df: DataFrame
    item: str
    samples: int
    seed: int

    def rows(self) -> DataFrame:
        """Each row once for each resample that it enters, with ``b`` and its weight ``w``."""
        draws = sum((F.when(F.col("__u") > total, 1).otherwise(0) for total in _shares()), F.lit(0))
        rows = self.df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(self.samples))))
        return rows.withColumn("__u", uniform(F.col(self.item).cast("long"), F.col("b"), self.seed)).withColumn("w", draws).drop("__u").where("w > 0")

    def of(self, statistic: Statistic, score: str, label: str, keys: list[str]) -> DataFrame:
        """``(keys, b, value)``."""
        if statistic is auc_statistic:
            return resampled_auc(self, score, label, keys)
        return statistic(self.rows(), score, label, [*keys, "b"])


def resampled(df: DataFrame, keys: list[str], item: str, samples: int, seed: int) -> Resamples:
    return Resamples(df, item, samples, seed)


def draws(items: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Weights of rows (by number) in all resamples: what ``Resamples.rows`` draws."""
    x = np.mod(np.mod(items, PRIME)[:, None] * 1000003 + np.arange(1, samples + 1)[None, :] * 104729 + seed, PRIME)
    for step in (48271, 69621, 16807):
        x = np.mod(x * x + x * step + 1, PRIME)
    return np.searchsorted(_shares(), (x + 0.5) / float(PRIME)).astype(np.float64)


#: Rows whose draws for all resamples are made at once.
DRAWN_ROWS = 256


def resampled_auc(drawn: Resamples, score: str, label: str, keys: list[str]) -> DataFrame:
    """``(keys, b, value)``: ROC areas of all resamples, null where a class is missing. Rows are sorted by range once; each range gives
    a row of counts for each of its groups, so neither draws nor weights are ever shuffled."""
    samples, seed, width = drawn.samples, drawn.seed, len(keys)
    rows = drawn.df.where(F.col(drawn.item).isNotNull()).select(*keys, F.col(score).alias("__v"), F.col(label).cast("long").alias("__y"), F.col(drawn.item).cast("long").alias("__item"))
    dealt = rows.repartitionByRange(tasks_for(rows.sparkSession), *keys, "__v").sortWithinPartitions(*keys, "__v").withColumn("__p", F.spark_partition_id())
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "__p int, p array<double>, q array<double>, u array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = at = last = None  # counts of the group so far; its keys; the value that may go on, with its counts

        def close() -> None:
            if last is not None:
                held[2] += last[1] * (held[1] + last[2] / 2.0)
                held[0] += last[1]
                held[1] += last[2]

        def row(part: int) -> pa.RecordBatch:
            own = [pa.array([k], t) for k, t in zip(at, types, strict=True)]
            return pa.RecordBatch.from_arrays([*own, pa.array([part], pa.int32()), *(pa.array([x], pa.list_(pa.float64())) for x in held)], names=[*keys, "__p", "p", "q", "u"])

        part, types = 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            types, names = [batch.column(k).type for k in range(width)], list(zip(*(batch.column(k).to_pylist() for k in range(width)), strict=True)) or [()] * batch.num_rows
            value, known = batch.column(width).fill_null(0).to_numpy(zero_copy_only=False), batch.column(width).is_valid().to_numpy(zero_copy_only=False)
            y, item = batch.column(width + 1).fill_null(-1).to_numpy(zero_copy_only=False), batch.column(width + 2).to_numpy(zero_copy_only=False)
            part = batch.column(width + 3)[0].as_py()
            same = (known[1:] == known[:-1]) & ((value[1:] == value[:-1]) | ((value[1:] != value[1:]) & (value[:-1] != value[:-1])))
            ends = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                if at != names[low]:
                    close()
                    if at is not None:
                        yield row(part)
                    at, held, last = names[low], np.zeros((3, samples)), None
                for k in range(low, high, DRAWN_ROWS):
                    e = min(high, k + DRAWN_ROWS)
                    w = draws(item[k:e], samples, seed)
                    starts = np.concatenate([[0], np.flatnonzero(~same[k : e - 1]) + 1])
                    p, q = (np.add.reduceat(w * (y[k:e] == c)[:, None], starts, axis=0) for c in (1, 0))
                    first = (bool(known[k]), value[k])
                    if last is not None and (last[0] == first or (last[0][0] == first[0] and last[0][1] != last[0][1] and first[1] != first[1])):
                        p[0] += last[1]
                        q[0] += last[2]
                    else:
                        close()
                    before = np.cumsum(q[:-1], axis=0)
                    upto = held[1] + np.concatenate([np.zeros((1, samples)), before])[:-1] if len(p) > 1 else np.zeros((0, samples))
                    held[2] += (p[:-1] * (upto + q[:-1] / 2.0)).sum(0)
                    held[0] += p[:-1].sum(0)
                    held[1] += q[:-1].sum(0)
                    last = (bool(known[e - 1]), value[e - 1]), p[-1], q[-1]
        if at is not None:
            close()
            yield row(part)

    found, _ = written(dealt.mapInArrow(run, schema), "areas")
    each = found.select(*keys, "__p", F.posexplode(F.arrays_zip("p", "q", "u")).alias("b", "c")).select(*keys, "__p", (F.col("b") + 1).alias("b"), "c.*")
    before = F.coalesce(F.sum("q").over(Window.partitionBy(*keys, "b").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    g = each.withColumn("u", F.col("u") + F.col("p") * before).groupBy(*keys, "b").agg(*[F.sum(c).alias(c) for c in "puq"])
    return g.select(*keys, "b", F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).alias("value"))


def percentile(values: str, share: float, upper: bool) -> Column:
    """The order statistic that an interval ends with: its index is rounded outwards."""
    v = F.array_sort(F.collect_list(values))
    n = F.size(v)
    at = F.least(n, F.greatest(F.lit(1), F.ceil(F.lit(share) * n - 1e-9))) if upper else F.least(n, F.floor(F.lit(share) * n + 1e-9) + 1)
    return F.when(n > 0, F.get(v, at.cast("int") - 1))


def interval(values: DataFrame, value: str, keys: list[str], level: float = 0.95) -> DataFrame:
    """``(keys, low, high, se, samples)`` of finite resampled values; each group has at most as many as there are resamples."""
    tail = (1 - level) / 2
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.groupBy(*keys).agg(percentile(value, tail, False).alias("low"), percentile(value, 1 - tail, True).alias("high"), F.stddev_samp(value).alias("se"), F.count("*").alias("samples"))


def weighted_auc(rows: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """ROC area of weighted rows: weights below each value, ties by half. Counted over ranges of values."""
    v = rows.groupBy(*keys, F.col(score).alias("__v")).agg(F.sum(F.when(F.col(label) == 1, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, F.col("w")).otherwise(0)).alias("q"))
    upto = running_total(v, keys, ["__v"], "q", "upto")
    g = upto.withColumn("u", F.col("p") * (F.col("upto") - F.col("q") / 2.0)).groupBy(*keys).agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return g.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p").cast("double") * F.col("q"))).alias("auc"))


def auc_statistic(rows: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    return weighted_auc(rows, score, label, keys).withColumnRenamed("auc", "value")


def mean_statistic(rows: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(F.col(score) * F.col("w")) / F.sum("w")).alias("value"))


def hit_statistic(threshold: float) -> Statistic:
    """The share of actives among rows that score at least the threshold."""

    def statistic(rows: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
        above = F.col(score) >= threshold
        return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.when(above & (F.col(label) == 1), F.col("w"))).cast("double"), F.sum(F.when(above, F.col("w")))).alias("value"))

    return statistic


def bootstrap_interval(df: DataFrame, score: str, label: str, keys: list[str], item: str, statistic: Statistic = auc_statistic, samples: int = BOOTSTRAP_SAMPLES, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """Percentile interval of any statistic of weighted rows."""
    drawn = resampled(df, keys, item, samples, seed)
    return interval(drawn.of(statistic, score, label, keys), "value", keys, level)


def paired_difference(df: DataFrame, a: str, b: str, label: str, keys: list[str], item: str, samples: int = BOOTSTRAP_SAMPLES, level: float = 0.95, seed: int = SEED, statistic: Statistic = auc_statistic) -> DataFrame:
    """Difference of two scores' statistics (ROC areas by default) on the same resamples: observed, its interval and standard error,
    the least difference that the data could show, and whether the interval leaves 0 out."""
    drawn = resampled(df, keys, item, samples, seed)
    whole = df.withColumn("w", F.lit(1))
    seen = statistic(whole, a, label, keys).withColumnRenamed("value", "x").join(statistic(whole, b, label, keys).withColumnRenamed("value", "y"), keys)
    x = drawn.of(statistic, a, label, keys).withColumnRenamed("value", "x")
    y = drawn.of(statistic, b, label, keys).withColumnRenamed("value", "y")
    g = interval(x.join(y, [*keys, "b"]).withColumn("d", F.col("x") - F.col("y")), "d", keys, level)
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("n_actives"))
    factor = minimum_detectable_difference(1.0, level=level)
    out = seen.select(*keys, (F.col("x") - F.col("y")).alias("difference")).join(g, keys, "left").join(counts, keys)
    return out.select(*keys, "difference", "low", "high", "se", (F.col("se") * factor).alias("mdd"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("resolvable"), F.coalesce("samples", F.lit(0)).alias("samples"), "n", "n_actives")


def stratified_difference(df: DataFrame, a: str, b: str, label: str, strata: list[str], item: str, samples: int = BOOTSTRAP_SAMPLES, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """One row: mean ROC areas over strata and their difference, with an interval from resampling inside each stratum."""
    drawn = resampled(df, strata, item, samples, seed)
    whole = df.withColumn("w", F.lit(1))

    def mean(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        both = x.withColumnRenamed("value", "x").join(y.withColumnRenamed("value", "y"), [*strata, *keys]).where("x is not null and y is not null")
        return both.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("strata"))

    seen = mean(auc_statistic(whole, a, label, strata), auc_statistic(whole, b, label, strata), []).select(F.lit(1).alias("one"), F.col("x").alias("auc_a"), F.col("y").alias("auc_b"), (F.col("x") - F.col("y")).alias("difference"), F.col("strata").alias("n_strata"))
    g = interval(mean(drawn.of(auc_statistic, a, label, strata), drawn.of(auc_statistic, b, label, strata), ["b"]).withColumn("d", F.col("x") - F.col("y")).withColumn("one", F.lit(1)), "d", ["one"], level)
    factor = minimum_detectable_difference(1.0, level=level)
    return seen.join(g, "one").select("auc_a", "auc_b", "difference", "low", "high", "se", (F.col("se") * factor).alias("mdd"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("resolvable"), "samples", "n_strata")


def enrichment(df: DataFrame, score: str, label: str, keys: list[str], item: str, k: int) -> DataFrame:
    """Precision and recall of the best k."""
    g = placed(df, score, label, keys, item).groupBy(*keys).agg(F.sum(F.when(F.col("__place") <= k, F.col("__y")).otherwise(0)).alias("hits"), F.max("__a").alias("actives"), F.max("__n").alias("n"))
    at = F.least(F.lit(k), F.col("n"))
    return g.select(*keys, "hits", (F.col("hits") / at).alias("precision"), F.when(F.col("actives") > 0, F.col("hits") / F.col("actives")).alias("recall"))


def random_scores(library: DataFrame, item: str, seed: int = SEED) -> DataFrame:
    """A control ranking: scores that depend on the item's number and the seed alone."""
    return library.select(item, uniform(F.col(item).cast("long"), F.lit(0), seed).alias("score"))


def property_scores(library: DataFrame, item: str, by: str) -> DataFrame:
    """A ranking by one property, the smallest first."""
    return library.select(item, (-F.col(by).cast("double")).alias("score"))


def ranks_of(df: DataFrame, score: str, keys: list[str], item: str) -> DataFrame:
    """Each item's rank in its ranking, however large that is."""
    found = positions(df.select(*keys, item, score), keys, [F.col(score).desc_nulls_last(), item], "rank")
    return found.withColumn("rank", F.col("rank").cast("int"))


def per_target(scores: DataFrame, keys: list[str], target: str, item: str, label: str) -> DataFrame:
    """Means over targets of each method's metrics, and how many targets could be measured: ``scores`` is ``(keys, target, item,
    score, label)``."""
    m = metrics(scores, "score", label, [*keys, target], item)
    return m.groupBy(*keys).agg(F.count("auc").alias("n_targets"), *[F.avg(c).alias(f"mean_{c}") for c in ("ef1", "ef5", "auc", "bedroc")])
