import itertools
import random

import numpy as np
import pytest

from rankfield.operators import ranker as op


def history(spark, events=30, n=8):
    rng = random.Random(1)
    rows = []
    for s in range(events):
        noise = [rng.gauss(0, 1) for _ in range(n)]
        skill = [rng.gauss(0, 1) for _ in range(n)]
        true = sorted(range(n), key=lambda i: -(2 * skill[i] + 0.5 * noise[i]))
        rel = {e: n - p for p, e in enumerate(true)}
        rows += [(0, s, f"e{i}", skill[i], noise[i], float(rel[i]), 0.5 + s % 3) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "series int, race_seq int, entity string, skill double, noise double, label double, weight double")


@pytest.mark.parametrize("top", [None, 3])
def test_fit_equals_explicit_pairs(spark, top):
    rows, d = history(spark)
    X, y, w = [], [], []
    for s in {r[1] for r in rows}:
        g = sorted((r for r in rows if r[1] == s), key=lambda r: (-r[5], r[2]))
        pairs = [(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(g), 2) if top is None or i < top]
        for a, b in pairs:
            X.append([a[3] - b[3], a[4] - b[4]])
            y.append(a[5] - b[5])
            w.append(a[6] / len(pairs))
    X, y, w = np.array(X), np.array(y), np.array(w)
    want = np.linalg.solve((X * w[:, None]).T @ X, (X * w[:, None]).T @ y)
    got = op.train(d, ["skill", "noise"], "label", top=top).members[0]
    assert np.allclose(got, want, atol=1e-8)


def test_contributions_sum_to_the_score(spark):
    _, d = history(spark)
    r = op.ensemble([op.train(d, ["skill", "noise"], "label"), op.train(d, ["skill", "noise"], "label", top=2)])
    s = {(x.race_seq, x.entity): x.score for x in r.score(d).collect()}
    total = {}
    for x in r.contributions(d).collect():
        total[(x.race_seq, x.entity)] = total.get((x.race_seq, x.entity), 0) + x.contribution
    assert all(abs(s[k] - total[k]) < 1e-9 for k in s)


def test_missing_columns_are_refused(spark):
    _, d = history(spark)
    with pytest.raises(KeyError, match="noise"):
        op.Ranker(("skill", "noise"), ((1.0, 1.0),)).score(d.drop("noise"))


def test_renaming_entities_only_permutes(spark):
    from pyspark.sql import functions as F

    _, d = history(spark)
    other = d.withColumn("entity", F.concat(F.lit("z"), F.reverse("entity")))
    a, b = (op.train(x, ["skill", "noise"], "label").members[0] for x in (d, other))
    assert np.allclose(a, b)


def test_recency_floor(spark):
    d = spark.createDataFrame([(s,) for s in (2001, 1999, 1980)], "season int")
    assert [round(r.weight, 4) for r in op.recency_weights(d, 2.0, 2001).collect()] == [1.0, 0.5, 0.15]
