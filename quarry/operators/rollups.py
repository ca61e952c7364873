"""Campaign results rolled up: leaderboards, ensembles, panels, studies, scaffold groups and matched pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.stages import tasks_for

from .ranking import finite, positions, ranked

#: Parts into which the members of a core are dealt, so that no group of pairs is one task.
DEALS = 4
#: Members of a tile and of a run where pairs of one core are made; runs in multiples of eight, as files pack numbers.
TILE, RUN = 256, 16


def status_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "timeout").alias("n_timeout"), F.count_if(~F.col("status").isin("ok", "timeout")).alias("n_failed"), F.count("*").alias("n")
    )


def leaderboard(results: DataFrame, k: int, value: str = "affinity") -> DataFrame:
    """The best k of each receptor among successful rows; missing values last, ties by ligand and run."""
    return ranked(results.where(F.col("status") == "ok"), value, ["receptor"], ["ligand", "run"]).where(F.col("rank") <= k)


def ensemble_rollup(results: DataFrame) -> DataFrame:
    """Per ligand over receptors: counts, best with its receptor, mean, worst and spread of successful rows."""
    ok = F.when(F.col("status") == "ok", finite("affinity"))
    g = results.withColumn("__a", ok).groupBy("ligand").agg(
        F.count_distinct("receptor").alias("n_receptors"),
        F.count("__a").alias("n_ok"),
        F.min("__a").alias("best"),
        F.min(F.when(F.col("__a").isNotNull(), F.struct("__a", "receptor"))).alias("__b"),
        F.avg("__a").alias("mean"),
        F.max("__a").alias("worst"),
    )
    return g.select("ligand", "n_receptors", "n_ok", "best", F.col("__b.receptor").alias("best_receptor"), "mean", "worst", (F.col("worst") - F.col("best")).alias("spread"))


def robustness(results: DataFrame, conformations: str, scale: float = 2.0) -> DataFrame:
    """Share of conformations with a success, times the decay of the exact median spread."""
    ok = results.where(F.col("status") == "ok")
    per = ok.groupBy("ligand", conformations).agg((F.max("affinity") - F.min("affinity")).alias("spread"))
    total = results.select(conformations).distinct().agg(F.count("*").alias("total"))
    g = per.groupBy("ligand").agg(F.count("*").alias("supported"), F.median("spread").alias("median_spread"))
    return g.join(F.broadcast(total)).select("ligand", "supported", "median_spread", ((F.col("supported") / F.col("total")) * F.exp(-F.col("median_spread") / scale)).alias("robustness"))


def panel_cells(results: DataFrame) -> DataFrame:
    """Ligand by receptor: mean over seeds, their spread and number."""
    ok = results.where(F.col("status") == "ok")
    return ok.groupBy("ligand", "receptor").agg(F.avg("affinity").alias("affinity"), (F.max("affinity") - F.min("affinity")).alias("spread"), F.count("*").alias("n_seeds"))


def panel_profile(cells: DataFrame, window: float, home: str | None = None) -> DataFrame:
    """Per ligand: best receptor, gap to the next, how many lie within the window, and the home receptor's rank."""
    order = Window.partitionBy("ligand").orderBy("affinity", F.upper(F.col("receptor").cast("string")))
    w = Window.partitionBy("ligand")
    rows = cells.withColumn("rank", F.row_number().over(order)).withColumn("best", F.min("affinity").over(w))
    aggs = [
        F.min("affinity").alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col("receptor"))).alias("best_receptor"),
        (F.max(F.when(F.col("rank") == 2, F.col("affinity"))) - F.min("affinity")).alias("gap"),
        F.count_if(F.col("affinity") <= F.col("best") + window).alias("n_within"),
    ]
    if home:
        aggs.append(F.min(F.when(F.col("receptor") == F.col(home), F.col("rank"))).alias("home_rank"))
    return rows.groupBy("ligand").agg(*aggs)


def matrix(cells: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """Cells as a table, one column for each of the given values."""
    return cells.groupBy(row).pivot(column, values).agg(F.avg(value))


def cells_by_row(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Cells as one array for each row, by column; however many columns there are."""
    return cells.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(column, value))).alias("cells"))


def study_diff(first: DataFrame, second: DataFrame, top: int = 10) -> DataFrame:
    """Two studies ``(name, best)`` by member: change, ranks, change of rank, kind of movement, top list entered or left."""

    def side(df, s):
        n = df.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.col("best").asc_nulls_last(), "name")))
        return n.select("part", "name", F.col("best").alias(f"best_{s}"), F.col("r").alias(f"rank_{s}"))

    j = side(first, "a").join(side(second, "b"), ["part", "name"], "full_outer")
    move = F.when(F.col("rank_a").isNull(), "added").when(F.col("rank_b").isNull(), "removed").when(F.col("rank_b") < F.col("rank_a"), "up").when(F.col("rank_b") > F.col("rank_a"), "down").otherwise("same")
    topped = F.when((F.coalesce("rank_b", F.lit(1 << 30)) <= top) & (F.coalesce("rank_a", F.lit(1 << 30)) > top), "entered").when((F.coalesce("rank_a", F.lit(1 << 30)) <= top) & (F.coalesce("rank_b", F.lit(1 << 30)) > top), "left").otherwise("")
    return j.select("part", "name", "best_a", "best_b", (F.col("best_b") - F.col("best_a")).alias("delta"), "rank_a", "rank_b", (F.col("rank_b") - F.col("rank_a")).alias("rank_delta"), move.alias("movement"), topped.alias("top"))


def settings_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(key, value)`` tables, only what differs; a key that one side lacks has null there and a note."""
    j = first.select("key", F.col("value").alias("first")).join(second.select("key", F.col("value").alias("second")), "key", "full_outer")
    note = F.when(F.col("first").isNull(), "only in second").when(F.col("second").isNull(), "only in first").otherwise("")
    return j.where(~F.col("first").eqNullSafe(F.col("second"))).withColumn("note", note)


def scaffold_groups(molecules: DataFrame, key: str, item: str, weight: str, affinity: str | None = None) -> DataFrame:
    """Members by scaffold: count, heaviest representative (ties: lowest item), best affinity."""
    aggs = [F.count("*").alias("n"), F.max(F.struct(F.col(weight), (-F.col(item)).alias("i"))).alias("__r")]
    if affinity:
        aggs.append(F.min(finite(affinity)).alias("best"))
    g = molecules.groupBy(F.coalesce(F.col(key), F.lit("")).alias("scaffold")).agg(*aggs)
    return g.withColumn("representative", -F.col("__r.i")).drop("__r")


def scaffold_coverage(selection: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """Distinct scaffolds of a subset and of the library; members without one share a single scaffold."""
    k = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("(no scaffold)"))
    a = selection.agg(F.count_distinct(k).alias("covered"))
    b = library.agg(F.count_distinct(k).alias("scaffolds"))
    return a.join(b).withColumn("coverage", F.when(F.col("scaffolds") > 0, F.col("covered") / F.col("scaffolds")))


def matched_pairs(molecules: DataFrame, core: list[str], groups: list[str], item: str, value: str, noise: float = 1.0) -> DataFrame:
    """Pairs of one core that differ in exactly one of the groups: joined on the core and all other groups.

    There are many more pairs than members, so tasks are set by number (by size, Spark would join in a few), and pairs are made in an order
    in which a file holds them in little: tiles of members with one value of the open group meet short runs of those with another, all pairs
    of a tile and a run after each other. So a run is repeated for each member of the tile, and both are in the order of their values.
    """
    out, n = None, tasks_for(molecules.sparkSession)
    for g in groups:
        same = core + [x for x in groups if x != g]
        rows = molecules.select(*same, F.col(g).alias("of"), F.struct(F.col(value).alias("v"), F.col(item).alias("id")).alias("m"))
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*same, "of").orderBy("m.id")) - 1)

        def cut(size: int) -> DataFrame:
            members = F.sort_array(F.collect_list("m"))
            return rows.groupBy(*same, "of", F.floor(F.col("at") / size).alias("cut")).agg(members.alias("ms"), F.min("m.id").alias("low"), F.max("m.id").alias("high"))

        a = cut(TILE).select(*same, F.col("of").alias("from"), F.col("ms").alias("as"), "low", F.pmod(F.xxhash64("of", "cut"), F.lit(DEALS)).alias("part"))
        b = cut(RUN).select(*same, F.col("of").alias("to"), F.col("ms").alias("bs"), "high", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))).alias("part"))
        a, b = a.repartition(n, *same, "part"), b.repartition(n, *same, "part")
        met = a.join(b.hint("shuffle_hash"), [*same, "part"]).where((F.col("from") != F.col("to")) & (F.col("low") < F.col("high")))
        pairs = met.select("from", "to", "bs", F.explode("as").alias("a")).select("from", "to", "a", F.explode("bs").alias("b")).where("a.id < b.id")
        found = pairs.select(F.lit(g).alias("label"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), "from", "to", (F.col("b.v") - F.col("a.v")).alias("delta"))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("significant", F.abs("delta") >= noise)


def alert_rates(molecules: DataFrame, text: Column, alerts: dict[str, str], item: str) -> DataFrame:
    """The share of members that each named pattern matches; all patterns are tried in one pass over the text."""
    n = F.count("*")
    aggs = [F.count_if(F.coalesce(text.rlike(p), F.lit(False))).alias(a) for a, p in alerts.items()]
    g = molecules.agg(n.alias("n"), *aggs)
    pairs = ", ".join(f"'{a}', `{a}`" for a in alerts)
    return g.selectExpr("n", f"stack({len(alerts)}, {pairs}) as (alert, flagged)").withColumn("rate", F.when(F.col("n") > 0, F.col("flagged") / F.col("n"))).drop("n")


def within_best(df: DataFrame, keys: list[str], value: str, span: float) -> DataFrame:
    """Rows no worse than the group's best plus a span."""
    return df.withColumn("__b", F.min(value).over(Window.partitionBy(*keys))).where(F.col(value) <= F.col("__b") + span).drop("__b")


def property_balance(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Standardised mean differences of two groups (1 and 0) by property, and whether they are matched (<= 0.5)."""
    aggs = []
    for c in columns:
        for g in (0, 1):
            v = F.when(F.col(group) == g, F.col(c).cast("double"))
            aggs += [F.avg(v).alias(f"{c}_m{g}"), F.var_samp(v).alias(f"{c}_v{g}")]
    one = df.agg(*aggs)
    parts = ", ".join(f"'{c}', {c}_m1, {c}_m0, {c}_v1, {c}_v0" for c in columns)
    rows = one.selectExpr(f"stack({len(columns)}, {parts}) as (property, mean_1, mean_0, v1, v0)")
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    smd = F.when(pooled > 0, F.abs(F.col("mean_1") - F.col("mean_0")) / pooled).otherwise(0.0)
    return rows.select("property", "mean_1", "mean_0", smd.alias("smd"), (smd <= 0.5).alias("matched"))


# -- panels, libraries, audits and baselines ------------------------------------------------------------------

BOX_RATIO = 1.25


def homes_summary(profiles: DataFrame, window: float) -> DataFrame:
    """One row over profiles ``(ligand, best_receptor, best, home, home_affinity, n_within, box_ratio)``, home an array of receptors: ligands
    with a home, hits on any of it, hits on its first, and misses by reason (several receptors within the window, a far larger box, score).
    """
    rows = profiles.where((F.size("home") > 0) & F.col("best_receptor").isNotNull())
    upper = F.transform("home", lambda h: F.upper(h.cast("string")))
    best = F.upper(F.col("best_receptor").cast("string"))
    hit = F.array_contains(upper, best)
    reason = F.when(hit, "hit").when(F.col("home_affinity") - F.col("best") <= window, "promiscuous").when(F.col("box_ratio") >= BOX_RATIO, "box").otherwise("score")
    g = rows.select(reason.alias("r"), (best == F.array_min(upper)).alias("strict"))
    out = g.agg(F.count("*").alias("n"), F.count_if("strict").alias("strict_hits"), *[F.count_if(F.col("r") == r).alias(n) for r, n in (("hit", "hits"), ("promiscuous", "promiscuous"), ("box", "box"), ("score", "score"))])
    return out.withColumn("rate", F.when(F.col("n") > 0, F.col("hits") / F.col("n")))


def home_ranks(cells: DataFrame, homes: DataFrame) -> DataFrame:
    """The rank of each ligand's home receptor among its scores, ties by the receptor's name in upper case; and the outcome in words."""
    order = Window.partitionBy("ligand").orderBy("affinity", F.upper(F.col("receptor").cast("string")))
    ranked_ = cells.where(finite("affinity").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked_.join(homes, ["ligand", "receptor"]).select("ligand", F.col("receptor").alias("home"), F.col("rank").alias("home_rank"), "affinity")


def selectivity(profile: DataFrame, window: float) -> DataFrame:
    """What a profile ``(ligand, best_receptor, gap, n_within)`` amounts to: selective, a preference, or only one receptor."""
    word = F.when(F.col("gap").isNull(), "only one receptor").when((F.col("n_within") == 1) & (F.col("gap") >= window), "selective").when(F.col("n_within") >= 2, "preference").otherwise("best")
    return profile.withColumn("outcome", word)


def best_by_name(records: DataFrame, name: str, value: str) -> DataFrame:
    """The best finite value of each name over all its records."""
    return records.where(finite(value).isNotNull()).groupBy(name).agg(F.min(value).alias(value))


def most_common(df: DataFrame, key: str) -> DataFrame:
    """The most frequent key and its count; ties by key, the empty one last."""
    g = df.groupBy(F.coalesce(F.col(key), F.lit("")).alias("key")).agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), F.col("key") == "", "key").limit(1)


def group_matrix(rows: DataFrame, item: str, label: str, value: str, labels: list[str]) -> DataFrame:
    """Members by label: the first substituent of each."""
    return rows.groupBy(item).pivot(label, labels).agg(F.min(value))


def triage(alerts: DataFrame, molecules: DataFrame, item: str, scaffold: str, note: float = 0.25) -> DataFrame:
    """Alert hits ``(item, alert)`` by scaffold: members, flagged members, their share, and whether it is above the note's limit."""
    flagged = alerts.select(item).distinct().withColumn("flag", F.lit(1))
    rows = molecules.select(item, F.coalesce(F.col(scaffold), F.lit("")).alias("scaffold")).join(flagged, item, "left")
    g = rows.groupBy("scaffold").agg(F.count("*").alias("n"), F.count("flag").alias("flagged"))
    return g.withColumn("share", F.col("flagged") / F.col("n")).withColumn("noted", F.col("share") > note)


def alert_location(atoms: Column, scaffold: Column) -> Column:
    """Where an alert's atoms lie: scaffold, substituent, mixed, or none without atoms."""
    inside = F.size(F.array_intersect(atoms, scaffold))
    return F.when(F.size(atoms) == 0, "none").when(inside == F.size(atoms), "scaffold").when(inside == 0, "substituent").otherwise("mixed")


def findings_by_step(audits: DataFrame, kind: str = "change") -> DataFrame:
    """From ``(position, findings array<struct<step, detail, kind>>)``: records with a finding of the kind, by step."""
    rows = audits.select("position", F.explode("findings").alias("f")).where(F.col("f.kind") == kind)
    return rows.groupBy(F.col("f.step").alias("step")).agg(F.count_distinct("position").alias("n"))


def rejected_by_property(audits: DataFrame, properties: list[str]) -> DataFrame:
    """Rejected records whose reason names a property, by property; a record may name several."""
    rows = audits.where("status = 'rejected' and category = 'filter'").select(F.explode(F.array(*[F.when(F.col("reason").contains(p), F.lit(p)) for p in properties])).alias("property"))
    return rows.where("property is not null").groupBy("property").agg(F.count("*").alias("n"))


def charge_observations(audits: DataFrame, flag: str) -> DataFrame:
    """Kept records whose charge agrees, does not, or was not looked at."""
    kept = audits.where("status = 'kept'")
    return kept.agg(F.count_if(F.col(flag)).alias("consistent"), F.count_if(~F.col(flag)).alias("inconsistent"), F.count_if(F.col(flag).isNull()).alias("unknown"))


def ensemble_quality(rows: DataFrame) -> DataFrame:
    """One row over conformer ensembles ``(requested, embedded, n_conformers, pruned_energy, pruned_rmsd, rotors, error)``: how many embedded,
    mean, median and least conformers, where attempts were lost, and the greatest loss."""
    ok = F.col("error") == ""
    n = F.when(ok, F.col("n_conformers"))
    g = rows.agg(
        F.count("*").alias("n_molecules"), F.count_if(ok).alias("n_embedded"), F.avg(n).alias("conformers_mean"), F.median(n).alias("conformers_median"), F.min(n).alias("conformers_min"), F.avg("rotors").alias("rotors_mean"),
        F.sum("requested").alias("attempts"), (F.sum("requested") - F.sum("embedded")).alias("lost_embedding"), F.sum("pruned_energy").alias("lost_energy"), F.sum("pruned_rmsd").alias("lost_rmsd"),
    )
    most = F.greatest("lost_embedding", "lost_energy", "lost_rmsd")
    word = F.when(most == 0, "none").when(F.col("lost_embedding") == most, "embedding").when(F.col("lost_energy") == most, "energy_window").otherwise("rmsd_prune")
    return g.withColumn("embed_rate", F.when(F.col("n_molecules") > 0, F.col("n_embedded") / F.col("n_molecules")).otherwise(0.0)).withColumn("dominant_loss", word)


def baseline(runs: DataFrame, system: str, seed: str, top: str, near: str, rho: str, correct: str) -> DataFrame:
    """Per system over seeds: the best and worst of each measure, the spread of the first, and whether all runs were correct."""
    return runs.groupBy(system).agg(
        F.count_distinct(seed).alias("seeds"), F.min(top).alias("top_rmsd"), (F.max(top) - F.min(top)).alias("top_rmsd_spread"), F.min(near).alias("best_within"), F.min(rho).alias("rho_low"), F.max(rho).alias("rho_high"), F.bool_and(F.col(correct)).alias("correct_in_all_runs")
    )


def check_baseline(now: DataFrame, stored: DataFrame, system: str, distance: float = 0.35, rho: float = 0.5) -> DataFrame:
    """``(system, failure)``: measures that are worse than the stored ones by more than the tolerance; systems without a baseline are skipped."""
    j = now.alias("a").join(stored.alias("b"), F.col(f"a.{system}") == F.col(f"b.{system}"))
    checks = F.array_compact(F.array(
        F.when(F.col("a.top_rmsd") > F.col("b.top_rmsd") + distance, "top_rmsd"), F.when(F.col("a.best_within") > F.col("b.best_within") + distance, "best_within"),
        F.when(F.col("a.rho_high") > F.col("b.rho_high") + rho, "rho"), F.when(F.col("b.correct_in_all_runs") & ~F.col("a.correct_in_all_runs"), "correct_in_all_runs"),
    ))
    return j.select(F.col(f"a.{system}").alias(system), F.explode(checks).alias("failure"))


def study_report(results: DataFrame, keys: list[str], name: str, value: str, top: int) -> DataFrame:
    """The best of each study with its rank, and the study's size and mean beside it."""
    n = Window.partitionBy(*keys)
    rows = ranked(results, value, keys, [name]).withColumn("members", F.count("*").over(n)).withColumn("mean", F.avg(value).over(n))
    return rows.where(F.col("rank") <= top)


def compare_runs(runs: DataFrame, base: str, keys: list[str], run: str, mode: str, value: str) -> DataFrame:
    """Every run beside the baseline run, mode by mode: modes in both, greatest and mean change."""
    b = runs.where(F.col(run) == base).select(*keys, mode, F.col(value).alias("__b"))
    j = runs.where(F.col(run) != base).join(b, [*keys, mode]).withColumn("__d", F.col(value) - F.col("__b"))
    return j.groupBy(*keys, run).agg(F.count("*").alias("modes"), F.max(F.abs("__d")).alias("max_change"), F.avg("__d").alias("mean_change"))


def campaign_index(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of a campaign by their best value; those without one come last."""
    g = runs.groupBy(*keys).agg(F.count("*").alias("poses"), F.min(finite(value)).alias("best"))
    return positions(g, [], [F.col("best").asc_nulls_last(), *keys], "rank")


def shortlist(results: DataFrame, receptor: str, value: str, item: str, top: int) -> DataFrame:
    """The first of each receptor's successful results as one ordered list."""
    best = ranked(results.where(F.col("status") == "ok"), value, [receptor], [item]).where(F.col("rank") <= top)
    return best.groupBy(receptor).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("members"))


def consensus_limit(top: int, available: int) -> int:
    """How many members a consensus takes."""
    return min(top or 50, available)


def summary_rows(results: DataFrame, value: str, item: str) -> DataFrame:
    """All results in the order of a summary: by receptor, successful ones by value, then the rest."""
    order = Window.partitionBy("receptor").orderBy(F.col("status") != "ok", F.col(value).asc_nulls_last(), item)
    return results.withColumn("row", F.row_number().over(order))


def fact_rows(outcomes: DataFrame, members: DataFrame, item: str) -> DataFrame:
    """Outcomes of jobs with their library member's columns; efficiency and where it comes from."""
    j = outcomes.join(members, item)
    ok = finite("affinity").isNotNull() & (F.col("n_heavy") > 0)
    return j.withColumn("le", F.when(ok, -finite("affinity") / F.col("n_heavy"))).withColumn("le_source", F.when(ok, "heavy atoms").otherwise(""))
