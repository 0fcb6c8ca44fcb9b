import random

import pandas as pd

from rankfield.operators import windows as op
from rankfield.plans.features import add_outcomes

BY = ["series", "entity"]


def frame(spark, values, entity="a"):
    rows = [(0, entity, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series int, entity string, race_seq int, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("entity", "race_seq").collect()]


def test_current_event_never_feeds_its_own_feature(spark):
    d = op.prior_rolling(frame(spark, [10.0, 10.0, 10.0, 10.0, 1.0]), BY, "race_seq", {"m": ("x", 3, "mean")})
    assert column(d, "m") == [None, 10.0, 10.0, 10.0, 10.0]


def test_entities_do_not_bleed(spark):
    both = frame(spark, [1.0, 1.0, 1.0]).union(frame(spark, [20.0, 20.0, 20.0], "b"))
    d = op.prior_rolling(both, BY, "race_seq", {"m": ("x", 5, "mean")})
    assert column(d, "m") == [None, 1.0, 1.0, None, 20.0, 20.0]


def test_nulls_take_a_place_in_rows_but_not_in_valid(spark):
    d = frame(spark, [4.0, None, None, 8.0, 2.0])
    rows = op.prior_rolling(d, BY, "race_seq", {"m": ("x", 2, "mean")})
    valid = op.prior_valid(d, BY, "race_seq", {"m": ("x", 2, "mean")})
    assert column(rows, "m") == [None, 4.0, 4.0, None, 8.0]
    assert column(valid, "m") == [None, 4.0, 4.0, 4.0, 6.0]


def test_valid_window_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(0, f"e{e}", s, None if rng.random() < 0.3 else float(rng.randint(1, 20))) for e in range(6) for s in range(40)]
    d = spark.createDataFrame(rows, "series int, entity string, race_seq int, x double")
    got = op.prior_valid(d, BY, "race_seq", {"med": ("x", 5, "median"), "avg": ("x", None, "mean")}).toPandas()
    for (_, e), g in got.groupby(["series", "entity"]):
        g = g.sort_values("race_seq")
        seen = []
        for r in g.itertuples():
            want = pd.Series(seen[-5:]).median() if seen else None
            assert (pd.isna(r.med) and want is None) or abs(r.med - want) < 1e-12
            assert (pd.isna(r.avg) and not seen) or abs(r.avg - sum(seen) / len(seen)) < 1e-12
            if not pd.isna(r.x):
                seen.append(r.x)


def team_rows(spark):
    rng = random.Random(5)
    rows = []
    for s in range(25):
        for e in range(2 if s % 6 else 1):
            rows.append((0, "t", f"e{e}", s, None if rng.random() < 0.35 else float(rng.randint(1, 20))))
    return spark.createDataFrame(rows, "series int, team string, entity string, race_seq int, x double")


def test_team_collapses_before_looking_back(spark):
    d = team_rows(spark)
    specs = {"rows": ("x", "sum", 3, "mean"), "valid": ("x", "mean", 3, "median"), "all": ("x", "min", None, "mean")}
    got = op.prior_by_event(d, ["series", "team"], "race_seq", "entity", specs, ("valid",)).toPandas()
    per = got.groupby("race_seq")["x"].agg(["mean", "min", lambda v: v.sum(min_count=1)])
    per.columns = ["mean", "min", "sum"]
    for r in got.itertuples():
        before = per[per.index < r.race_seq]
        for have, want in (
            (r.rows, before["sum"].tail(3).mean()),
            (r.valid, before["mean"].dropna().tail(3).median()),
            (r.all, before["min"].mean()),
        ):
            assert (pd.isna(have) and pd.isna(want)) or abs(have - want) < 1e-12


def test_team_gap_needs_two_times(spark):
    d = spark.createDataFrame([("t", "a", 100), ("t", "b", 102), ("u", "c", 101), ("u", "d", None)], "team string, entity string, x int")
    got = {r.entity: r.g for r in d.withColumn("g", op.teammate_gap("x", ["team"])).collect()}
    assert got["a"] == 0.0 and abs(got["b"] - 2.0) < 1e-9 and got["c"] is None and got["d"] is None


def test_unrun_event_has_null_flags(spark):
    d = spark.createDataFrame([(None, None, None), (3, 15, True), (2, 18, False)], "position int, points int, dnf boolean")
    a, b, c = add_outcomes(d).collect()
    assert (a.finish_or_last, a.scored, a.dnf_flag, a.finish_when_running) == (24, None, None, None)
    assert (b.finish_or_last, b.finish_when_running) == (3, None)
    assert c.finish_when_running == 2


def test_integrity_reports_duplicates_and_disorder(spark):
    rows = [(0, 1, 1, "a", 0), (0, 1, 1, "a", 0), (0, 1, 2, "a", 0)]
    d = spark.createDataFrame(rows, "series int, season int, round int, entity string, race_seq int")
    found = {r.problem for r in op.integrity_problems(d, ["series"], ["season", "round"], "entity", "race_seq").collect()}
    assert found == {"duplicate key", "sequence not increasing"}
