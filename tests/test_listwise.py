import math

from pyspark.sql import functions as F

from rankfield.operators import listwise as op, penalties as pen

E = ["series", "race_seq"]


def field(spark, scores, events=1):
    rows = [(0, e, chr(97 + i), float(s), i + 1) for e in range(events) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "series int, race_seq int, entity string, score double, place int")


def test_softmax_does_not_overflow(spark):
    p = [r.p_win for r in op.plackett_luce(field(spark, [1e4, 1e4 - 1, -1e4]), "score", 1.0).orderBy("entity").collect()]
    assert abs(sum(p) - 1) < 1e-12 and abs(p[0] / p[1] - math.e) < 1e-9


def test_sampled_orders_follow_plackett_luce(spark):
    d = field(spark, [1.0, 0.0, -1.0])
    n = 20000
    m = {(r.entity, r.pos): r.share for r in op.position_matrix(d, "score", 1.0, n).collect()}
    p = {r.entity: r.p_win for r in op.plackett_luce(d, "score", 1.0).collect()}
    assert all(abs(m[(e, 1)] - p[e]) < 0.012 for e in "abc")
    second = p["a"] * p["b"] / (1 - p["a"]) + p["c"] * p["b"] / (1 - p["c"])
    assert abs(m[("b", 2)] - second) < 0.012
    assert op.check_distribution(op.position_matrix(d, "score", 1.0, 50)).first().problems == []


def test_certain_retirement_goes_to_the_back(spark):
    d = field(spark, [9.0, 0.0, -1.0, -2.0]).withColumn("q", F.when(F.col("entity") == "a", 1.0).otherwise(0.0))
    m = {(r.entity, r.pos): r.share for r in op.position_matrix(d, "score", 0.5, 200, "q").collect()}
    assert m[("a", 4)] == 1.0 and m[("a", 1)] == 0.0


def test_temperature_prefers_sharp_when_favourites_win(spark):
    d = field(spark, [1.0, 0.5, 0.0, -0.5], 12)
    upset = d.withColumn("place", 5 - F.col("place"))
    sharp = op.fit_temperature(op.temperature_losses(d, "score", "place"), ["series"]).first().temperature
    flat = op.fit_temperature(op.temperature_losses(upset, "score", "place"), ["series"]).first().temperature
    assert sharp == 0.05 and abs(flat - 8.0) < 1e-9
    rolling = {r.race_seq: r.temperature for r in op.rolling_temperature(op.temperature_losses(d, "score", "place"), ["series"], "race_seq", 0.7).collect()}
    assert rolling[9] == 0.7 and rolling[10] == 0.05


def test_trailing_temperatures_are_those_of_the_losses_event_by_event(spark):
    rows = [(s, e, m, f"e{i}", ((i * 7 + e * 3 + s) % 5) / 3.0, None if e == 4 else float((i * (2 + e % 3) + s) % 6)) for s in (0, 1) for e in range(30) for m in ("a", "b") for i in range(6)]
    d = spark.createDataFrame(rows, "series int, race_seq int, method string, entity string, score double, place double")
    by, event = ["series", "method"], [*E, "method"]
    for depth in (1, 3):
        want = op.rolling_temperature(op.temperature_losses(d, "score", "place", depth, event=event), by, "race_seq", 0.7)
        got = op.trailing_temperature(d, "score", "place", by, "race_seq", 0.7, depth, event)
        assert sorted(map(tuple, got.select(*by, "race_seq", "temperature", "n").collect())) == sorted(map(tuple, want.select(*by, "race_seq", "temperature", "n").collect()))


def test_depth_uses_the_field_still_running(spark):
    d = field(spark, [2.0, 1.0, 0.0])
    got = op.temperature_losses(d, "score", "place", 2, [1.0]).first().loss
    z = [math.exp(s) for s in (2, 1, 0)]
    assert abs(got - (-math.log(z[0] / sum(z)) - math.log(z[1] / (z[1] + z[2]))) / 2) < 1e-12


def test_mixture_keeps_its_sums_and_bands_nest(spark):
    d = field(spark, [2.0, 1.0, 0.5, 0.0, -1.0]).withColumn("dnf_prob", F.lit(0.3))
    m = op.forecast(d, "score", 0.6, 0.7)
    assert op.check_distribution(m).first().problems == []
    for r in op.summarise(m).collect():
        assert 0 < r.p_win <= r.p_podium <= r.p_top5 + 1e-9 <= r.p_top10 + 2e-9


def test_dnf_probability_keeps_bounds_and_defaults(spark):
    d = spark.createDataFrame([(None, None), (0.0, 0.0), (1.0, 1.0)], "drv_dnf_rate_10 double, team_dnf_rate_10 double")
    assert [round(r[0], 6) for r in d.select(op.dnf_probability()).collect()] == [0.12, 0.02, 0.35]


def test_penalties_rerank(spark):
    d = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 0.0), ("c", 3, float("inf")), ("d", 4, 0.0), ("e", 5, float("inf"))], "entity string, grid int, drop double").withColumn("g", F.lit(1))
    got = {r.entity: r.grid for r in pen.apply_penalties(d, ["g"]).collect()}
    assert got == {"b": 1, "a": 2, "d": 3, "c": 4, "e": 5}
    clean = pen.apply_penalties(d.withColumn("drop", F.lit(0.0)).withColumn("grid", F.col("grid") * 2), ["g"])
    assert {r.entity: r.grid for r in clean.collect()}["e"] == 10


def test_held_back_lap_is_never_faster(spark):
    rows = [(0, 1, chr(97 + i), float(10 - i), i in (0, 9)) for i in range(10)]
    d = spark.createDataFrame(rows, "series int, race_seq int, entity string, score double, held boolean")
    got = {r.entity: r.s for r in pen.held_back_scores(d, "score", "held", "s", E).collect()}
    assert got["a"] == 3.0 and got["j"] == 1.0 and got["b"] == 9.0
