import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfield.functions.hashrand import dense_index
from rankfield.operators import metrics as op


def tau_b(x, y):
    s = n1 = n2 = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, n1, n2 = s + a * b, n1 + (a != 0), n2 + (b != 0)
    return s / math.sqrt(n1 * n2) if n1 and n2 else None


@pytest.mark.parametrize("n, values", [(1, 5), (2, 5), (17, 4), (60, 1000), (33, 1)])
def test_kendall_counts_pairs_without_forming_them(spark, n, values):
    rng = random.Random(n)
    x, y = [rng.randint(1, values) for _ in range(n)], [rng.randint(1, values) for _ in range(n)]
    d = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(x, y))], "g int, entity int, x int, y int")
    got, want = op.kendall(d, ["g"], "x", "y").first().kendall, tau_b(x, y)
    assert (got is None and want is None) or abs(got - want) < 1e-12


def test_ndcg_and_overlaps(spark):
    order = [(1, 1), (2, 3), (3, 2), (4, 4), (5, 6), (6, 5)]
    d = spark.createDataFrame([(1, i, p, a) for i, (p, a) in enumerate(order)], "g int, entity int, pred int, actual int")
    r = op.ranking(d, ["g"]).first()
    gain = lambda true, i: 1 / math.log2(true + 1) / math.log2(i + 1)
    want = (gain(1, 1) + gain(3, 2) + gain(2, 3)) / sum(gain(i, i) for i in (1, 2, 3))
    assert abs(r.ndcg3 - want) < 1e-12 and (r.winner_hit, r.podium_overlap, r.top5_overlap) == (1, 3, 4)
    assert op.ranking(d.where("entity < 2"), ["g"]).count() == 0


def test_spearman_is_null_for_a_constant_side(spark):
    d = spark.createDataFrame([(1, i, 5, i) for i in range(4)], "g int, entity int, x int, y int")
    assert op.spearman(d, ["g"], "x", "y").first().spearman is None


@pytest.mark.parametrize("n", [7, 10, 103])
def test_calibration_error_cuts_equal_buckets(spark, n):
    rng = random.Random(n)
    rows = sorted((round(rng.random(), 2), rng.randint(0, 1)) for _ in range(n))
    d = spark.createDataFrame(rows, "p double, y int")
    parts = np.array_split(np.array(rows), min(10, n))
    want = sum(len(q) * abs(q[:, 0].mean() - q[:, 1].mean()) for q in parts) / n
    assert abs(op.calibration_error(d, "p", "y").first().ece - want) < 1e-9


def test_reliability_keeps_every_row(spark):
    d = spark.createDataFrame([(0.0, 0), (0.02, 0), (0.5, 1), (1.0, 1)], "p double, y int")
    got = {r.bucket: r.n for r in op.reliability(d, "p", "y").collect()}
    assert got == {0: 2, 5: 1, 8: 1}


def test_dense_index_has_no_holes(spark):
    d = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"))
    got = dense_index(d, ["k"], ["g"], "i", 64).groupBy("g").agg(F.min("i"), F.max("i"), F.count_distinct("i"), F.max("i_count")).collect()
    assert all(tuple(r)[1:] == (0, 2499, 2500, 2500) for r in got)


def test_bootstrap_does_not_depend_on_partitioning(spark):
    d = spark.range(60).select(F.lit("a").alias("m"), F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    one = op.bootstrap_intervals(d.coalesce(1), ["k"], ["m"], ["v"], 100).first()
    two = op.bootstrap_intervals(d.repartition(5), ["k"], ["m"], ["v"], 100).first()
    assert (one.ci_low, one.ci_high) == (two.ci_low, two.ci_high) and one.ci_low < one.mean < one.ci_high


def test_paired_verdict_follows_the_direction(spark):
    rows = [(m, i, 1.0 + (m == "b") + 0.01 * i, 1.0 + (m == "b") + 0.01 * i) for m in "ab" for i in range(20)]
    d = spark.createDataFrame(rows, "method string, k int, ndcg5 double, win_logloss double")
    got = {r.metric: r.better for r in op.paired_comparison(d, ["k"], ["ndcg5", "win_logloss"], "a", replicates=50).collect()}
    assert got == {"ndcg5": "b", "win_logloss": "a"}


def test_wilson_of_nothing(spark):
    from rankfield.functions.scalars import wilson_high, wilson_low

    r = spark.createDataFrame([(0, 0)], "h int, n int").select(wilson_low("h", "n").alias("a"), wilson_high("h", "n").alias("b")).first()
    assert (r.a, r.b) == (0.0, 1.0)
