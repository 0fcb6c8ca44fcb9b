from pyspark.sql import functions as F

from rankfield.operators import projection as op

KEY = "series int, season int"


def clinch(spark, gap, maxima):
    lead = spark.createDataFrame([(0, 1, float(gap))], f"{KEY}, gap double")
    m = spark.createDataFrame([(0, 1, i, float(v)) for i, v in enumerate(maxima)], f"{KEY}, round int, most double")
    return op.clinch_round(lead, m).first().clinch_in


def test_clinch_cases(spark):
    assert clinch(spark, 80, [25, 25, 25]) == 0
    assert clinch(spark, 30, [25, 25, 25]) == 1
    assert clinch(spark, 0, [25, 25]) == 2
    assert clinch(spark, 10, []) is None


def odds(spark, probs, clinched=None):
    rows = [(0, 1, i, p, bool(clinched and clinched[i]), -float(i)) for i, p in enumerate(probs)]
    d = spark.createDataFrame(rows, f"{KEY}, entity int, p double, clinched boolean, projected double")
    return [r.odds for r in op.allocate_odds(d, "p", "clinched", "projected").orderBy("entity").collect()]


def test_odds_sum_to_one_and_leave_room(spark):
    assert abs(sum(odds(spark, [1 / 3, 1 / 3, 1 / 3])) - 1) < 1e-12
    assert odds(spark, [1.0, 0.0, 0.0]) == [0.999, 0.001, 0.0]
    assert odds(spark, [1.0, 0.0, 0.0], [True, False, False]) == [1.0, 0.0, 0.0]
    assert odds(spark, [0.0, 0.0]) == [0.0, 0.0]


def test_absentees_keep_their_points(spark):
    totals = spark.createDataFrame([(0, 1, s, 1, 1, 50.0) for s in (1, 2)], f"{KEY}, sample int, entity int, team int, total double")
    st = spark.createDataFrame([(0, 1, 1, 1, 40), (0, 1, 2, 1, 70)], f"{KEY}, entity int, team int, points int")
    got = op.absentees(totals, st).where("entity = 2").collect()
    assert [r.total for r in got] == [70.0, 70.0]
    s = {r.entity: r.p_title for r in op.outcome_summary(op.absentees(totals, st)).collect()}
    assert s == {1: 0.0, 2: 1.0}


def test_title_race(spark):
    b = spark.createDataFrame([(0, 1, 1, 100), (0, 1, 2, 76), (0, 1, 3, 74)], f"{KEY}, entity int, points int")
    left = spark.createDataFrame([(0, 1, 25.0)], f"{KEY}, points_left double")
    assert {r.entity: (r.alive, r.clinched) for r in op.title_race(b, left).collect()} == {1: (True, False), 2: (True, False), 3: (False, False)}
    less = left.withColumn("points_left", F.lit(20.0))
    assert {r.entity: r.clinched for r in op.title_race(b, less).collect()}[1]


def test_teammates_share_their_draws(spark):
    res = spark.createDataFrame([(0, 1, r, e, r * 10) for r in (1, 2, 3) for e in (1, 2)], f"{KEY}, round int, entity int, points int")
    base = spark.createDataFrame([(0, 1, 1, 7, 0), (0, 1, 2, 7, 0)], f"{KEY}, entity int, team int, points int")
    left = spark.createDataFrame([(0, 1, 4), (0, 1, 5)], f"{KEY}, round int")
    band = op.teammate_band(op.final_totals(op.resample_seasons(res, base, left, 40))).first()
    assert (band.low, band.high) == (0.0, 0.0)


def test_checkpoints_round_half_to_even(spark):
    d = spark.createDataFrame([(0, 1, r, 40 + r) for r in range(1, 11)], f"{KEY}, round int, race_seq int")
    assert sorted(r.after for r in op.checkpoints(d).collect()) == [4, 6, 8, 9]


def test_sweep_takes_the_first_of_equals(spark):
    d = spark.createDataFrame([("x", 0.0, 10.0, 5.0), ("x", 0.0, 10.0, 12.5)], "kind string, low double, high double, final double")
    assert op.coverage_sweep(d, [0, 1, 2, 3], by=("kind",)).first().spread == 3.0
