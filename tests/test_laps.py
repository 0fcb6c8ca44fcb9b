import random

from rankfield.operators import laps as op

S = ["session"]
M = 1_000_000


def messages(spark, rows):
    return spark.createDataFrame([(1, t * M, i, k, key) for i, (t, k, key) in enumerate(rows)], "session int, t long, ord int, kind string, key string")


def spans(spark, rows):
    got = op.not_clear_periods(messages(spark, rows), S).orderBy("lo").collect()
    return [(r.lo / M, None if r.hi == op.NEVER else r.hi / M) for r in got]


def test_sector_clears_only_itself(spark):
    rows = [(10, "raise", "s1"), (20, "raise", "s2"), (30, "clear", "s1"), (50, "clear", "s2"), (60, "raise", "s1")]
    assert spans(spark, rows) == [(10, 50), (60, None)]


def test_green_clears_everything(spark):
    rows = [(10, "raise", "s1"), (20, "raise", "safety car"), (900, "clear_all", "-"), (1000, "raise", "red"), (2000, "clear_all", "-")]
    assert spans(spark, rows) == [(10, 900), (1000, 2000)]


def replay(rows):
    active, out, opened = set(), [], None
    for t, kind, key in rows:
        was = bool(active)
        if kind == "raise":
            active.add(key)
        elif kind == "clear":
            active.discard(key)
        else:
            active.clear()
        if active and not was:
            opened = t
        if was and not active:
            out.append((opened, t))
    return out + [(opened, None)] if active else out


def test_spans_equal_replay_across_buckets(spark):
    rng = random.Random(11)
    times = sorted(rng.sample(range(1, 9000), 160))
    kinds = ["raise"] * 5 + ["clear"] * 5 + ["clear_all"]
    rows = [(t, rng.choice(kinds), rng.choice(["s1", "s2", "s3", "red"])) for t in times]
    want = replay(rows)
    assert spans(spark, rows) == want
    laps = [(1, e, i, s * M, (s + d) * M) for i, (e, s, d) in enumerate((rng.choice("ab"), rng.randint(0, 9000), rng.randint(1, 300)) for _ in range(200))]
    df = spark.createDataFrame(laps, "session int, entity string, lap int, start long, end long")
    got = {r.lap: r.green for r in op.green_laps(df, op.not_clear_periods(messages(spark, rows), S), S).collect()}
    for _, _, i, s, e in laps:
        assert got[i] == (not any(lo * M < e and (hi is None or s < hi * M) for lo, hi in want))


def test_pace_of_one_driver(spark):
    times = [130.0, 90.0, 89.5, 90.4, 91.0, 89.0, 120.0, 99.5]
    rows = [(1, "a", i + 1, i * 200 * M, d, i == 0) for i, d in enumerate(times)]
    laps = spark.createDataFrame(rows, "session int, entity string, lap int, start long, duration double, is_out_lap boolean")
    stints = spark.createDataFrame([(1, "a", 1, 1, 8, "SOFT", 1)], "session int, entity string, stint int, lap_start int, lap_end int, compound string, ord int")
    pits = spark.createDataFrame([(1, "a", 7)], "session int, entity string, lap int")
    flags = spark.createDataFrame([(1, 1450 * M, 1470 * M)], "session int, lo long, hi long")
    r = op.driver_pace(laps, stints, pits, flags, S).first()
    # Out-lap, in-lap and the lap under a flag are not clean; the best counts any timed lap.
    assert (r.best_lap_ms, r.n_laps, r.n_clean_laps, r.median_lap_ms, r.long_run_ms, r.compound_mode) == (89000, 8, 5, 90000, 90000, "SOFT")
    short = op.driver_pace(laps, stints, pits, flags, S, 6).first()
    assert short.long_run_ms is None


def test_later_stint_overwrites(spark):
    stints = spark.createDataFrame(
        [(1, "a", 1, 1, 5, "SOFT", 1), (1, "a", 2, 4, 8, "HARD", 2), (1, "a", 3, 7, None, "MEDIUM", 3)],
        "session int, entity string, stint int, lap_start int, lap_end int, compound string, ord int",
    )
    got = {r.lap: r.stint for r in op.stint_of_lap(stints, S).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2, 8: 2}
