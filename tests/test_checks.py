"""Clean tables raise nothing; each planted defect raises its own check."""

import pytest
from pyspark.sql import functions as F

from rankfield.operators import checks as op

K = "series int, season int, round int"
def today():
    return F.lit("2001-12-31").cast("date")


def tables(spark):
    results = [
        (0, 2001, r, i, i // 2, i + 1, i + 1, False, True, 50, "Finished", 10 if i < 8 else 0) for r in (1, 2) for i in range(20)
    ]
    res = spark.createDataFrame(results, f"{K}, entity int, team int, position int, grid int, dnf boolean, classified boolean, laps int, status string, points int")
    races = spark.createDataFrame([(0, 2001, 1), (0, 2001, 2)], K).withColumns(
        {
            "race_date": F.make_date("season", "round", F.lit(20)),
            "race_start": F.make_timestamp_ntz("season", "round", F.lit(20), F.lit(14), F.lit(0), F.lit(0)),
            "quali_start": F.make_timestamp_ntz("season", "round", F.lit(19), F.lit(14), F.lit(0), F.lit(0)),
        }
    )
    quali = res.select("series", "season", "round", "entity", F.col("grid").alias("quali_position"))
    sprint = spark.createDataFrame([], f"{K}, entity int, team int, points int")
    standings = res.select("series", "season", "round", "entity", (F.col("points") * F.col("round")).alias("points"))
    pace = res.select("series", "season", "round", "entity", F.lit("FP1").alias("session")).withColumn(
        "session_start", F.make_timestamp_ntz("season", "round", F.lit(18), F.lit(9), F.lit(0), F.lit(0))
    )
    official = res.select("series", "season", "round", "entity", F.col("grid").alias("position"))
    log = spark.createDataFrame([("results", "1", "ok", "")], "source string, scope string, status string, detail string")
    return op.Landed(races, res, res.select("series", "season", "entity").distinct(), quali, sprint, standings, pace, official, log)


def found(d):
    return {r.check for r in op.findings(d, today()).collect()}


def test_clean_tables_raise_nothing(spark):
    assert found(tables(spark)) == set()


def _when(col, cond, value):
    return lambda df: df.withColumn(col, F.when(F.expr(cond), F.expr(value)).otherwise(F.col(col)))


FIRST = "round = 1 and entity = 0"
DEFECTS = {
    "field_size_plausible": ("results", lambda d: d.where("not (round = 1 and entity >= 9)")),
    "positions_in_range": ("results", _when("position", FIRST, "40")),
    "one_winner_per_race": ("results", _when("position", FIRST, "25")),
    "finishing_positions_unique": ("results", _when("position", "round = 1 and entity = 5", "3")),
    "grid_slots_unique": ("results", _when("grid", "round = 1 and entity = 5", "3")),
    "grid_present_for_completed_races": ("results", _when("grid", "round = 1", "null")),
    "points_awarded_to_finishers": ("results", _when("points", "round = 1 and entity = 15", "4")),
    "retirement_flag_matches_laps": ("results", _when("dnf", FIRST, "true")),
    "dnf_rate_plausible": ("results", _when("dnf", "round = 1 and entity < 15", "true")),
    "every_race_has_results": ("results", lambda d: d.where("round = 1")),
    "results_reference_a_race": ("races", lambda d: d.where("round = 1")),
    "rounds_contiguous": ("races", lambda d: d.where("round = 2")),
    "races_chronological": ("races", _when("race_date", "round = 2", "date'2000-01-01'")),
    "drivers_are_known": ("drivers", lambda d: d.where("entity > 0")),
    "quali_positions_contiguous": ("qualifying", lambda d: d.where("quali_position <> 4")),
    "practice_predates_race": ("pace", _when("session_start", FIRST, "timestamp_ntz'2001-06-01'")),
    "practice_predates_qualifying": ("pace", _when("session_start", FIRST, "timestamp_ntz'2001-01-19 18:00:00'")),
    "official_grid_matches_the_field": ("official_grid", _when("entity", FIRST, "99")),
    "standings_match_results": ("standings", _when("points", FIRST, "points - 1")),
    "no_failed_ingests": ("log", _when("status", "true", "'failed'")),
    "tables_populated": ("qualifying", lambda d: d.limit(0)),
}


@pytest.mark.parametrize("name", DEFECTS)
def test_each_defect_fires_its_check(spark, name):
    d = tables(spark)
    table, damage = DEFECTS[name]
    setattr(d, table, damage(getattr(d, table)))
    rows = op.CHECKS[name][1](d, today()) if name == "every_race_has_results" else op.CHECKS[name][1](d)
    assert rows.count() > 0


def test_retirement_ahead_of_a_finisher(spark):
    d = tables(spark)
    d.results = d.results.withColumns(
        {"classified": F.expr("not (round = 1 and entity = 3)"), "laps": F.expr("case when round = 1 and entity = 3 then 40 else 50 end")}
    )
    got = {r.detail for r in op.classified_implies_finished_ahead(d).collect()}
    assert len(got) == 16 and "4:50:40" in got
