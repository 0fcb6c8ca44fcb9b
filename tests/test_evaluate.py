from pyspark.sql import functions as F

from rankfield.catalog.audit_q import CHECKED, light_build
from rankfield.operators import audit, ranker as rk
from rankfield.plans import evaluate as ev
from rankfield.sources.contest import Tables


def test_refits_only_reach_forward():
    plan = ev.refit_plan(range(60), range(20, 60), 4)
    assert min(plan) == 30 and all(c <= t < c + 4 for t, c in plan.items())


def _field(spark, shift=0, series=0, n=40, entrants=4, flip=None):
    """Events by month; from event ``flip`` on the better input finishes worse."""
    import datetime as dt

    rows = []
    for s in range(n):
        m = s + shift
        day = dt.date(1990 + m // 12, m % 12 + 1, 28)
        for i in range(entrants):
            x = float((i * 7 + s * 3) % 5) + i / 10
            rows.append((series, s, day.year, day, f"e{i}", x, x if flip is None or s < flip else -x))
    return spark.createDataFrame(rows, "series int, race_seq int, season int, race_date date, entity string, x double, label double")


def test_training_never_sees_the_target(spark):
    d = _field(spark, flip=33)
    out = ev.oos_scores(d, d.select("series", "race_seq"), ("x",), "label")
    assert out.select("race_seq").distinct().count() == 10 and out.where("cutoff > race_date").count() == 0
    # Up to the first flipped event every model has seen only the rule that higher inputs finish better.
    assert out.where("race_seq <= 33").select(F.corr("score", "x")).first()[0] > 0.9
    # What later events say changes nothing.
    again = ev.oos_scores(d.where("race_seq <= 35"), d.where("race_seq <= 35").select("series", "race_seq"), ("x",), "label")
    both = out.join(again.select("race_seq", "entity", F.col("score").alias("other")), ["race_seq", "entity"])
    assert both.count() == 24 and both.where("abs(score - other) > 1e-9").count() == 0


def test_series_with_shifted_calendars_lend_no_later_event(spark):
    early, late = _field(spark), _field(spark, shift=24, series=1, flip=12)
    both = early.unionByName(late)
    out = ev.oos_scores(both, both.select("series", "race_seq"), ("x",), "label")
    alone = ev.oos_scores(early, early.select("series", "race_seq"), ("x",), "label")
    # Series 1 contradicts the rule from its event 12 on, month 36: no score of an earlier month may differ.
    pair = out.where("series = 0 and race_seq < 36").join(alone.select("race_seq", "entity", F.col("score").alias("other")), ["race_seq", "entity"])
    assert pair.count() == 24 and pair.where("abs(score - other) > 1e-6").count() == 0
    # The second series starts with a model of the first one's past: its first event has 24 earlier dates, its seventh 30.
    assert out.where("series = 1").agg(F.min("race_seq")).first()[0] == 6


def test_sums_come_one_row_per_date_from_any_number_of_tasks(spark):
    import numpy as np

    d = _field(spark, n=6).withColumn("y", F.col("x") * F.col("race_seq")).unionByName(_field(spark, n=6, series=1).withColumn("y", F.col("x") - 1.0))
    few, many = (ev.event_sums(d.repartition(n, "series", "race_seq"), ("x", "y"), "label") for n in (1, 7))
    assert len(few) == len(many) == 6
    for a, b in zip(sorted(few, key=lambda r: r.race_date), sorted(many, key=lambda r: r.race_date)):
        assert (a.season, a.race_date) == (b.season, b.race_date) and abs(a.w - b.w) < 1e-9
        assert np.allclose(a.xx, b.xx) and np.allclose(a.xy, b.xy) and len(a.xx) == 3 and len(a.xy) == 2
    assert ev.event_sums(d.where("x > 99"), ("x", "y"), "label") == []


def test_normal_equations_match_the_fitted_ranker(spark):
    d = _field(spark, n=32).withColumns({"y": F.hash("entity", "race_seq") % 7 * 1.0, "weight": F.lit(1.0)})
    sums = ev.event_sums(d, ("x", "y"), "label")
    cutoff = d.agg(F.max("race_date")).first()[0]
    fit = ev.solve_cutoffs(sums, [cutoff], 2, None, 0.0)[cutoff]
    plain = rk.train(d.where(F.col("race_date") < F.lit(cutoff)), ("x", "y"), "label").members[0]
    assert all(abs(a - b) < 1e-6 for a, b in zip(fit, plain))


def test_features_ignore_their_own_and_later_events(spark, small):
    base = Tables(spark, small, land=True).contest
    whole = light_build(base)
    for other in (light_build(audit.tamper(base, F.col("race_seq") == 40)), light_build(base.where("race_seq <= 40"))):
        changes = audit.compare_builds(whole, other, CHECKED, 40).collect()
        assert all(r.before == 0 for r in changes)
    moved = audit.compare_builds(whole, light_build(audit.tamper(base, F.col("race_seq") == 40)), CHECKED, 40)
    assert moved.where("after > 0").count() >= 8


def test_shuffling_keeps_the_values_of_an_event(spark):
    d = spark.createDataFrame([(0, s, f"e{i}", float(i)) for s in range(3) for i in range(6)], "series int, race_seq int, entity string, x double")
    out = ev.shuffle_within_events(d, ["x"], "t")
    per = out.groupBy("race_seq").agg(F.sort_array(F.collect_list("x")).alias("v")).collect()
    assert all(r.v == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] for r in per)
    assert out.join(d.withColumnRenamed("x", "old"), ["series", "race_seq", "entity"]).where("x <> old").count() > 0


def test_bias_trend_is_removed(spark):
    rows = [(0, f"e{i}", i + 1, i + 1 + 0.5 * (i - 4) + (2 if i == 3 else 0)) for i in range(9) for _ in range(15)]
    d = spark.createDataFrame(rows, "series int, entity string, predicted_rank int, actual_rank double").withColumn("error", F.col("actual_rank") - F.col("predicted_rank"))
    b = {r.entity: r.entity_bias for r in ev.entity_bias(d, 15).collect()}
    assert max(b, key=lambda e: abs(b[e])) == "e3" and abs(b["e8"]) < 0.5
    assert ev.entity_bias(d, 16).count() == 0


def test_feature_groups_cover_the_race_model():
    from rankfield.constants import EXPLANATION_GROUPS, GROUP_LABELS, PRACTICE_FEATURES, QUALI_FEATURES, RACE_FEATURES

    assert len(RACE_FEATURES) == 27 and len(QUALI_FEATURES) == 28
    assert set(EXPLANATION_GROUPS) == set(RACE_FEATURES) and set(EXPLANATION_GROUPS.values()) == set(GROUP_LABELS)
    assert not set(PRACTICE_FEATURES) & set(RACE_FEATURES)


def test_stages_before_the_grid_never_read_it(spark, small):
    from rankfield.catalog import evaluate_q as q

    t = Tables(spark, small, land=True)
    d = q._stage_frame(t)
    last = d.agg(F.max("race_date")).first()[0]
    hidden = d.withColumn("grid", F.when(F.col("race_date") == F.lit(last), 30 - F.col("grid")).otherwise(F.col("grid")))
    rows = []
    for frame in (d, hidden):
        quali = q._quali_model(frame).where(F.col("race_date") == F.lit(last))
        early = q._before_grid(t, frame, quali).where("method like '%:model'")
        rows.append(sorted((r["method"], r["entity"], round(r["score"], 9)) for r in early.collect()))
    assert rows[0] == rows[1] and len(rows[0]) > 10
    stages = {m: [r for r in rows[0] if r[0].startswith(m)] for m in ("pre_quali", "pre_practice")}
    assert [r[2] for r in stages["pre_quali"]] != [r[2] for r in stages["pre_practice"]]


def test_a_planted_leak_turns_the_audit_red(spark, small):
    from rankfield.plans import worlds

    t = Tables(spark, small)
    found = worlds.leakage(t, ("drv_avg_finish_3", "season_progress", "leak"), lambda d: d.withColumn("leak", F.col("position") * 2.0)).cache()
    one = {(r.audit, r.cutoff, r.feature): r for r in found.collect()}
    assert all(r.before == 0 for k, r in one.items() if k[2] != "leak")
    leaks = [r for k, r in one.items() if k[0] == "tamper" and k[2] == "leak"]
    assert leaks[0].before > 0 and [r.after > 0 for k, r in one.items() if k[0] == "tamper" and k[2] == "drv_avg_finish_3"] == [True]
    assert {r.audit: r.status for r in audit.leakage_status(found, ("audit",)).collect()} == {"tamper": "FAIL", "truncate": "PASS"}
    assert len({k[1] for k in one if k[0] == "truncate"}) == 3


def test_correlations_rank_each_pair_among_the_rows_that_have_both(spark):
    import random

    import numpy as np

    draw = random.Random(5)
    rows = [(float(i % 9), None if i % 4 == 0 else draw.gauss(0, 1) + i % 9, None if i % 4 == 0 else -float(i % 3), None if i % 5 == 1 else draw.gauss(0, 0.1) + i % 9) for i in range(200)]
    names = ("p", "q", "r", "s")
    d = spark.createDataFrame(rows, "p double, q double, r double, s double").repartition(3)
    assert set(ev.null_classes(d, names).values()) == {"p", "q", "s"}

    def ranks(v):
        return np.array([sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v])

    want = {}
    for i, a in enumerate(names):
        for j, b in list(enumerate(names))[i + 1 :]:
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            want[a, b] = (np.corrcoef(*(ranks(v) for v in zip(*both)))[0, 1], len(both))
    got = {(r.a, r.b): (r.rho, r.n) for r in ev.feature_correlation(d, names, 0.0).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    large = ev.feature_correlation(d, names, 0.8)
    assert {(r.a, r.b) for r in large.collect()} == {k for k, v in want.items() if abs(v[0]) >= 0.8}
