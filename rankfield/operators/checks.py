"""Data checks: each returns offending rows (series, season, round, detail).

``findings`` turns any of them into one line (check, severity, n, first, last)
with partial aggregates only. ERROR stops a pipeline, WARN reports.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

EVENT = ["series", "season", "round"]
ERROR, WARN = "ERROR", "WARN"


@dataclass
class Landed:
    """The landed tables the checks read."""

    races: DataFrame
    results: DataFrame
    drivers: DataFrame
    qualifying: DataFrame
    sprint: DataFrame
    standings: DataFrame
    pace: DataFrame
    official_grid: DataFrame
    log: DataFrame


def _rows(df: DataFrame, *detail: str | Column) -> DataFrame:
    keys = [F.col(k) if k in df.columns else F.lit(None).cast("int").alias(k) for k in EVENT]
    parts = [(F.col(d) if isinstance(d, str) else d).cast("string") for d in detail]
    return df.select(*keys, F.concat_ws(":", *[F.coalesce(p, F.lit("null")) for p in parts]).alias("detail"))


def tables_populated(d: Landed) -> DataFrame:
    out = None
    for name in ("races", "results", "qualifying", "drivers"):
        n = getattr(d, name).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
        part = _rows(n, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def rounds_contiguous(d: Landed) -> DataFrame:
    s = d.races.groupBy("series", "season").agg(
        F.min("round").alias("lo"), F.max("round").alias("hi"), F.count_distinct("round").alias("n")
    )
    return _rows(s.where("lo <> 1 or hi <> n"), "lo", "hi", "n")


def every_race_has_results(d: Landed, today: Column) -> DataFrame:
    missing = d.races.join(d.results.select(*EVENT).distinct(), EVENT, "left_anti")
    return _rows(missing.where(F.col("race_date") <= today), F.lit("no results"))


def field_size_plausible(d: Landed, low: int = 10, high: int = 26) -> DataFrame:
    n = d.results.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("n"))
    return _rows(n.where((F.col("n") < low) | (F.col("n") > high)), "n")


def results_reference_a_race(d: Landed) -> DataFrame:
    orphans = d.results.select(*EVENT).distinct().join(d.races, EVENT, "left_anti")
    return _rows(orphans, F.lit("no race"))


def drivers_are_known(d: Landed) -> DataFrame:
    people = d.results.select("series", "season", "entity").distinct()
    return _rows(people.join(d.drivers, ["series", "season", "entity"], "left_anti"), "entity")


def positions_in_range(d: Landed, top: int = 30) -> DataFrame:
    r = d.results
    outside = r.where(~F.col("position").between(1, top) | ~F.col("grid").between(0, top))
    negative = r.where("points < 0")
    return _rows(outside, "entity", "position", "grid").unionByName(
        _rows(negative, "entity", F.lit("negative points"), "points")
    )


def one_winner_per_race(d: Landed) -> DataFrame:
    n = d.results.groupBy(*EVENT).agg(F.count(F.when(F.col("position") == 1, 1)).alias("n"))
    return _rows(n.where("n <> 1"), "n")


def finishing_positions_unique(d: Landed) -> DataFrame:
    n = d.results.where("position is not null").groupBy(*EVENT, "position").agg(F.count(F.lit(1)).alias("n"))
    return _rows(n.where("n > 1"), "position", "n")


def quali_positions_contiguous(d: Landed) -> DataFrame:
    n = d.qualifying.where("quali_position is not null").groupBy(*EVENT).agg(
        F.count(F.lit(1)).alias("n"), F.max("quali_position").alias("top")
    )
    return _rows(n.where("n <> top"), "n", "top")


def classified_implies_finished_ahead(d: Landed) -> DataFrame:
    """A classified finisher behind a retirement on fewer laps.

    The fewest laps of any retirement ranked ahead decides it; no pairs are formed."""
    ahead = W.partitionBy(*EVENT).orderBy("position").rangeBetween(W.unboundedPreceding, -1)
    r = d.results.where("position is not null and laps is not null").withColumn(
        "fewest", F.min(F.when(~F.col("classified"), F.col("laps"))).over(ahead)
    )
    return _rows(r.where("classified and fewest < laps"), "entity", "laps", "fewest")


def dnf_rate_plausible(d: Landed, limit: float = 70.0) -> DataFrame:
    n = d.results.groupBy(*EVENT).agg(
        F.count(F.when(F.col("dnf"), 1)).alias("out"), F.count(F.lit(1)).alias("n")
    )
    return _rows(n.where(F.col("out") * 100.0 > F.col("n") * limit), "out", "n")


def points_awarded_to_finishers(d: Landed, last: int = 11) -> DataFrame:
    bad = d.results.where((F.col("points") > 0) & (F.col("position").isNull() | (F.col("position") > last)))
    return _rows(bad, "entity", "position", "points")


def races_chronological(d: Landed) -> DataFrame:
    w = W.partitionBy("series", "season").orderBy("round")
    r = d.races.withColumn("previous", F.lag("race_date").over(w))
    return _rows(r.where("race_date < previous"), "race_date", "previous")


def _late_sessions(d: Landed, start: str, sessions: tuple[str, ...]) -> DataFrame:
    p = d.pace.where(F.col("session").isin(*sessions)).join(d.races.select(*EVENT, start), EVENT)
    return _rows(p.where(F.col("session_start") > F.col(start)), "entity", "session")


def practice_predates_race(d: Landed) -> DataFrame:
    return _late_sessions(d, "race_start", ("FP1", "FP2", "FP3", "Q"))


def practice_predates_qualifying(d: Landed) -> DataFrame:
    return _late_sessions(d, "quali_start", ("FP1", "FP2", "FP3"))


def grid_slots_unique(d: Landed) -> DataFrame:
    n = d.results.where("grid > 0").groupBy(*EVENT, "grid").agg(F.count(F.lit(1)).alias("n"))
    return _rows(n.where("n > 1"), "grid", "n")


def grid_present_for_completed_races(d: Landed, share: float = 0.9) -> DataFrame:
    n = d.results.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("n"), F.count("grid").alias("listed"))
    second = d.official_grid.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("second"))
    bad = n.where(F.col("listed") < share * F.col("n")).join(second, EVENT, "left")
    covered = F.when(F.coalesce("second", F.lit(0)) > 0, "covered").otherwise("uncovered")
    return _rows(bad, "n", "listed", covered)


def official_grid_matches_the_field(d: Landed) -> DataFrame:
    run = d.official_grid.join(d.results.select(*EVENT).distinct(), EVENT, "left_semi")
    return _rows(run.join(d.results, [*EVENT, "entity"], "left_anti"), "entity")


def no_failed_ingests(d: Landed) -> DataFrame:
    failed = d.log.where("status = 'failed'")
    return _rows(failed, "source", "scope", F.substring("detail", 1, 60))


def standings_behind_results(d: Landed, tolerance: float = 0.5) -> DataFrame:
    """Rounds whose stored standings differ from the points awarded so far."""
    scored = d.results.select(*EVENT, "points").unionByName(d.sprint.select(*EVENT, "points"))
    per_round = scored.groupBy(*EVENT).agg(F.sum("points").alias("p"))
    w = W.partitionBy("series", "season").orderBy("round")
    total = per_round.select(*EVENT, F.sum("p").over(w).alias("awarded"))
    stored = d.standings.groupBy(*EVENT).agg(F.sum("points").alias("stored"))
    both = stored.join(total, EVENT)
    return _rows(both.where(F.abs(F.col("stored") - F.col("awarded")) > tolerance), "stored", "awarded")


def retirement_flag_matches_laps(d: Landed, within: int = 2) -> DataFrame:
    """Retirements within two laps of the longest distance, per status."""
    distance = F.max("laps").over(W.partitionBy(*EVENT))
    r = d.results.withColumn("distance", distance)
    near = r.where(F.col("dnf") & (F.col("laps") >= F.col("distance") - within))
    return near.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(
        *[F.lit(None).cast("int").alias(k) for k in EVENT],
        F.concat_ws(":", "status", F.col("n").cast("string")).alias("detail"),
        F.when(F.col("n") >= 20, ERROR).otherwise(WARN).alias("severity"),
        "n",
    )


CHECKS = {
    "tables_populated": (ERROR, tables_populated),
    "rounds_contiguous": (ERROR, rounds_contiguous),
    "every_race_has_results": (WARN, every_race_has_results),
    "field_size_plausible": (ERROR, field_size_plausible),
    "results_reference_a_race": (ERROR, results_reference_a_race),
    "drivers_are_known": (ERROR, drivers_are_known),
    "positions_in_range": (ERROR, positions_in_range),
    "one_winner_per_race": (ERROR, one_winner_per_race),
    "finishing_positions_unique": (ERROR, finishing_positions_unique),
    "quali_positions_contiguous": (WARN, quali_positions_contiguous),
    "classified_implies_finished_ahead": (WARN, classified_implies_finished_ahead),
    "dnf_rate_plausible": (WARN, dnf_rate_plausible),
    "points_awarded_to_finishers": (WARN, points_awarded_to_finishers),
    "races_chronological": (ERROR, races_chronological),
    "practice_predates_race": (ERROR, practice_predates_race),
    "practice_predates_qualifying": (ERROR, practice_predates_qualifying),
    "grid_slots_unique": (ERROR, grid_slots_unique),
    "grid_present_for_completed_races": (WARN, grid_present_for_completed_races),
    "official_grid_matches_the_field": (WARN, official_grid_matches_the_field),
    "no_failed_ingests": (WARN, no_failed_ingests),
    "standings_match_results": (WARN, standings_behind_results),
    "retirement_flag_matches_laps": (None, retirement_flag_matches_laps),
}


def findings(d: Landed, today: Column) -> DataFrame:
    """One line per check that fired: (check, severity, n, first, last)."""
    out = None
    for name, (severity, check) in CHECKS.items():
        rows = check(d, today) if name == "every_race_has_results" else check(d)
        if severity is None:
            worst = F.when(F.max(F.col("severity") == ERROR), ERROR).otherwise(WARN)
        else:
            worst = F.lit(severity)
        line = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.min("detail").alias("first"),
            F.max("detail").alias("last"),
            *([worst.alias("severity")] if severity is None else []),
        )
        if severity is not None:
            line = line.withColumn("severity", worst)
        line = line.where("n > 0").select(F.lit(name).alias("check"), "severity", "n", "first", "last")
        out = line if out is None else out.unionByName(line)
    return out
