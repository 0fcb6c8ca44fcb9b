import pytest
from pyspark.sql import functions as F

from rankfield.plans import evaluate as ev, live

ROW = """series int, race_seq int, version string, season int, round int, entity int, grid int, grid_source string, quali_position int,
  quali_gap_to_pole_pct double, quali_gap_to_teammate_pct double, fp_best_gap_pct double, practice_available int, drv_pace_gap_pct double,
  drv_teammate_quali_edge double, quali_score double, drop double"""


def field(spark, source="qualifying", drops=()):
    rows = [(0, 9, "landed", 2001, 9, i, i, source, i, i / 10, 0.1, i / 5, 1, 0.5, 0.2, float(i), dict(drops).get(i, 0.0)) for i in range(1, 6)]
    return spark.createDataFrame(rows, ROW)


def test_a_stage_is_read_off_what_has_landed(spark):
    d = field(spark)
    got = {}
    for s in live.STAGES:
        seen = live.as_of(d, s)
        assert dict(seen.dtypes) == dict(d.dtypes)
        got[s] = tuple(live.stage_of(seen).select("stage", "start_source").first())
    assert got == {"post_quali": ("post_quali", "qualifying"), "pre_quali": ("pre_quali", "projected"), "pre_practice": ("pre_practice", "projected")}
    assert live.as_of(d, "pre_quali").where("fp_best_gap_pct is null or grid is not null").count() == 0
    assert live.as_of(d, "pre_practice").where("fp_best_gap_pct is not null or practice_available <> 0").count() == 0


def test_a_grid_of_too_few_entrants_is_not_known(spark):
    d = field(spark).withColumn("grid_source", F.when(F.col("entity") > 1, F.col("grid_source")))
    assert live.stage_of(d).first().stage == "pre_quali"


def grids(spark, d):
    staged = d.join(live.stage_of(d), live.AT)
    return [r.entity for r in live.gridded(staged).orderBy("grid").collect()]


def test_penalties_move_provisional_and_projected_grids_only(spark):
    drops = {1: 2.0, 3: float("inf")}
    assert grids(spark, field(spark, "official", drops)) == [1, 2, 3, 4, 5]
    assert grids(spark, field(spark, "qualifying", drops)) == [2, 1, 4, 5, 3]
    # Before qualifying the scores order the field (5 best), and the same penalties apply.
    assert grids(spark, live.as_of(field(spark, "official", drops), "pre_quali")) == [5, 4, 2, 1, 3]


def test_an_untouched_grid_keeps_its_gaps_and_a_moved_one_is_completed(spark):
    def short(drops):
        d = field(spark, "qualifying", drops).withColumn("grid", F.when(F.col("entity") != 2, F.col("grid") * 2))
        return live.gridded(d.join(live.stage_of(d), live.AT)).orderBy("entity").collect()

    assert [r.grid for r in short({})] == [2, None, 6, 8, 10]
    assert [r.grid for r in short({3: 1.0})] == [1, 5, 2, 3, 4]


def test_versions_of_one_event_are_forecast_apart(spark, small):
    from rankfield.catalog.live_q import carried
    from rankfield.sources.contest import Tables

    out = live.replay(Tables(spark, small, True), carried(Tables(spark, small, True), 2001, 11)).cache()
    one = out.groupBy("version").agg(F.sum("p_win").alias("win"), F.sum("q_p_win").alias("pole"), F.min("stage").alias("low"), F.max("stage").alias("high"), F.count("*").alias("n"))
    rows = {r.version: r for r in one.collect()}
    assert set(rows) == set(live.STAGES)
    for v, r in rows.items():
        assert abs(r.win - 1) < 1e-6 and abs(r.pole - 1) < 1e-6
        assert r.low == r.high and (v == "post_quali" or r.low == v)
    # A season's strength does not depend on what has landed of the next event.
    assert out.groupBy("entity").agg(F.count_distinct("season_strength").alias("n")).where("n > 1").count() == 0
    assert out.where("version <> 'post_quali' and start_source <> 'projected'").count() == 0


def test_a_short_history_is_refused(spark):
    d = spark.createDataFrame([(0, 1, 1, 2000, "a", 1.0, 2.0)], "series int, race_seq int, round int, season int, entity string, x double, y double")
    with pytest.raises(LookupError):
        ev.fitted(d.withColumn(ev.DATE, F.make_date("season", "round", F.lit(1))), ("x",), "y")
