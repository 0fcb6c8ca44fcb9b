import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from rankfield.operators import listwise as lw, marginals as mg, ranker as rk
from rankfield.plans import evaluate as ev, variants as vr

KEYS = ["series", "race_seq", "entity", "pos"]


def fields(spark, sizes=(2, 5, 9)):
    draw = random.Random(2)
    rows = [(0, e, f"e{i}", draw.gauss(0, 2), draw.uniform(0, 0.4), i + 1.0) for e, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "series int, race_seq int, entity string, score double, dnf double, place double")


def test_exact_positions_are_coherent_and_agree_with_draws(spark):
    d = fields(spark)
    exact = mg.exact_positions(d, "score", 0.7, {"plain": False, "drawn": True}, "dnf").cache()
    for half in ("plain", "drawn"):
        m = exact.select(*KEYS, F.col(half).alias("share"))
        assert all(r.problems == [] for r in lw.check_distribution(m, atol=1e-7).collect())
    n = 4000
    drawn = lw.paired_matrix(d, "score", 0.7, n, "dnf").select(*KEYS, F.col("plain").alias("a"), F.col("drawn").alias("b"))
    for r in exact.join(drawn, KEYS).collect():
        for p, q in ((r.plain, r.a), (r.drawn, r.b)):
            assert abs(p - q) < 5 * math.sqrt(max(p * (1 - p), 1e-3) / n)


def test_exact_positions_in_closed_form(spark):
    d = fields(spark, (3,))
    got = {(r.entity, r.pos): r.plain for r in mg.exact_positions(d, "score", 0.7, {"plain": False}).collect()}
    e = {r.entity: math.exp(r.score / 0.7) for r in d.collect()}
    for i in e:
        total = sum(e.values())
        assert abs(got[i, 1] - e[i] / total) < 1e-8
        second = sum(e[j] / total * e[i] / (total - e[j]) for j in e if j != i)
        assert abs(got[i, 2] - second) < 1e-8


def test_exact_positions_with_extreme_scores_gaps_and_certain_retirement(spark):
    rows = [(0, 0, "a", 1e6, 1.0), (0, 0, "b", -1e6, 0.0), (0, 0, "c", None, 0.0), (0, 0, "d", float("nan"), None), (0, 1, "a", 3.0, 0.5)]
    d = spark.createDataFrame(rows, "series int, race_seq int, entity string, score double, dnf double")
    got = {(r.race_seq, r.entity, r.pos): (r.plain, r.drawn) for r in mg.exact_positions(d, "score", 0.5, {"plain": False, "drawn": True}, "dnf").collect()}
    assert got[0, "a", 1][0] > 1 - 1e-8 and got[0, "a", 4][1] > 1 - 1e-8
    assert abs(got[0, "c", 3][0] + got[0, "c", 4][0] - 1) < 1e-6
    assert abs(got[1, "a", 1][0] - 1) < 1e-9 and abs(got[1, "a", 1][1] - 1) < 1e-9
    assert mg.exact_positions(d.where("race_seq > 5"), "score", 0.5, {"plain": False}).count() == 0


def test_entrants_that_are_alike_share_every_position(spark):
    # The first points of the rule leave positions of a close field of 20 off by 2e-5, more than a forecast may be.
    rows = [(0, n, f"e{i:02}", 0.0 if n % 2 else i / 50, 0.1, None) for n in (19, 20, 40) for i in range(n)]
    d = spark.createDataFrame(rows, "series int, race_seq int, entity string, score double, dnf double, place double")
    m = mg.exact_positions(d, "score", 1.0, {"plain": False, "drawn": True}, "dnf").cache()
    for half in ("plain", "drawn"):
        assert all(r.problems == [] for r in lw.check_distribution(m.withColumn("share", F.col(half)), atol=2e-7).collect())
    assert m.where("race_seq = 19 and abs(plain - 1 / 19) > 1e-7").count() == 0
    assert m.where("race_seq = 40 and pos > 35").groupBy("pos").agg(F.sum("plain").alias("t")).where("abs(t - 1) > 2e-7").count() == 0


def _history(spark, n=40, entrants=5):
    draw, rows = random.Random(4), []
    for s in range(n):
        day = dt.date(1990 + s // 12, s % 12 + 1, 28)
        field = [(draw.gauss(0, 1), draw.gauss(0, 1), draw.gauss(0, 1)) for _ in range(entrants)]
        order = sorted(range(entrants), key=lambda i: -(field[i][0] + 0.5 * field[i][1] + draw.gauss(0, 0.5)))
        for place, i in enumerate(order):
            x, y, z = field[i]
            rows.append((0, s, day.year, day, f"e{i}", x, None if draw.random() < 0.1 else y, z, float(entrants - place)))
    return spark.createDataFrame(rows, "series int, race_seq int, season int, race_date date, entity string, x double, y double, z double, label double")


def test_gain_rows_equal_explicit_pairs(spark):
    d = _history(spark, 3).withColumn("one", F.lit(2.0))
    for gain in ("exponential", "linear"):
        got = np.zeros((3, 3))
        for r in rk.gain_rows(d, ("x", "z"), "label", "one", gain=gain).collect():
            v = np.array([r.x, r.z, r.label])
            got += r._w * np.outer(v, v)
        want = np.zeros((3, 3))
        for s in range(3):
            f = sorted((r for r in d.collect() if r.race_seq == s), key=lambda r: (-r.label, r.entity))
            g = [2.0**r.label - 1 if gain == "exponential" else r.label for r in f]
            k = [1 / math.log2(2 + i) for i in range(len(f))]
            pairs = [(i, j) for i in range(len(f)) for j in range(i + 1, len(f))]
            w = {p: (g[p[0]] - g[p[1]]) * (k[p[0]] - k[p[1]]) for p in pairs}
            for i, j in pairs:
                v = np.array([f[i].x - f[j].x, f[i].z - f[j].z, f[i].label - f[j].label])
                want += 2.0 * w[i, j] / sum(w.values()) * np.outer(v, v)
        assert np.allclose(got, want)


def test_variants_equal_models_fitted_one_by_one(spark):
    d = _history(spark)
    sets = {"x": vr.Variant(("x",), 0.0), "zx": vr.Variant(("z", "x"), 0.1, None), "all": vr.Variant(("x", "y", "z"), 0.01, 3.0)}
    got = vr.variant_scores(d, d.select("series", "race_seq"), sets, "label")
    assert got.count() == 3 * 10 * 5
    for name, v in sets.items():
        alone = ev.oos_scores(d, d.select("series", "race_seq"), v.features, "label", v.recency, ridge=v.ridge)
        both = got.where(F.col("method") == name).join(alone.select("race_seq", "entity", F.col("score").alias("other")), ["race_seq", "entity"])
        assert both.count() == 50 and both.where("abs(score - other) > 1e-8").count() == 0


def test_a_candidate_is_picked_on_one_window_and_kept_on_the_other(spark):
    rows = [("tuning", "a", "ndcg5", 0.1, 0.0, 0.2), ("tuning", "b", "ndcg5", 0.3, 0.1, 0.4), ("later", "b", "ndcg5", 0.2, 0.1, 0.3), ("later", "b", "position_error", 0.2, 0.1, 0.3), ("later", "a", "ndcg5", 0.5, 0.4, 0.6)]
    d = spark.createDataFrame(rows, "window string, method string, metric string, difference double, ci_low double, ci_high double")
    one = {r.method: r for r in vr.picked(d, "ndcg5", ("ndcg5",), ("ndcg5",)).collect()}
    assert one["b"].picked and one["b"].adopt and not one["a"].picked and not one["a"].adopt
    strict = {r.method: r.adopt for r in vr.picked(d, "ndcg5", ("ndcg5",), ("position_error",)).collect()}
    assert strict == {"a": False, "b": False}
