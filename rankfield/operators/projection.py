"""Season totals: points carried, resampled seasons, titles still open, calibrated ranges.

Replicates are rows. A season's field and its rounds are bounded, so rows grow with
the number of (series, season) pairs times replicates, and every window is inside
one replicate of one season.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import (
    CHECKPOINT_FRACTIONS, COVERAGE_TARGET, FASTEST_LAP_SEASONS, MIN_OWN_EVENTS, MIN_TRAIN_EVENTS, POINTS,
    SPRINT_FIRST_SEASON, SPRINT_POINTS, SPRINT_POINTS_FIRST, TITLE_EDGES, TYPICAL_WINDOW,
)
from ..functions.hashrand import below
from ..functions.scalars import wilson_high, wilson_low

SEASON = ["series", "season"]


def standings_after(standings: DataFrame, rounds: DataFrame) -> DataFrame:
    """Standings as they stand after a round of each season. rounds: (series, season, after)."""
    return standings.join(rounds, SEASON).where(F.col("round") == F.col("after")).drop("round")


def points_history(standings: DataFrame) -> DataFrame:
    return standings.where("entity is not null").select(*SEASON, "round", "entity", "points")


def remaining_schedule(calendar: DataFrame, sprint: DataFrame, rounds: DataFrame) -> DataFrame:
    """Rounds still to run, each with whether it has a sprint (dated, or already run)."""
    ran = sprint.select(*SEASON, "round").distinct().withColumn("_ran", F.lit(True))
    d = calendar.join(rounds, SEASON).where(F.col("round") > F.col("after")).join(ran, [*SEASON, "round"], "left")
    return d.select(*SEASON, "after", "round", (F.col("sprint_start").isNotNull() | F.col("_ran").isNotNull()).alias("sprint"))


def team_points(results: DataFrame, sprint: DataFrame, rounds: DataFrame) -> DataFrame:
    """Team points as awarded up to a round: each result counts for the team entered."""
    cols = [*SEASON, "round", "team", "points"]
    d = results.select(*cols).unionByName(sprint.select(*cols)).join(rounds, SEASON)
    return d.where((F.col("round") <= F.col("after")) & F.col("team").isNotNull()).groupBy(*SEASON, "after", "team").agg(
        F.sum("points").alias("points")
    )


def round_maximum(season: Column, sprint: Column, cars: int = 1, sprint_era: int = 0) -> Column:
    """Most points one entrant (cars 1) or one team (cars 2) can take from a round.

    sprint_era shifts the sprint tables' seasons, for championships that ran them earlier."""
    first = SPRINT_FIRST_SEASON - sprint_era
    win = F.lit(float(sum(POINTS[:cars])))
    fastest = F.when(season.between(*FASTEST_LAP_SEASONS), 1.0).otherwise(0.0)
    short = (
        F.when(season < first, 0.0).when(season == first, float(sum(SPRINT_POINTS_FIRST[:cars])))
        .otherwise(float(sum(SPRINT_POINTS[:cars])))
    )
    return win + fastest + F.when(sprint, short).otherwise(0.0)


def season_strength(
    scores: DataFrame, field: DataFrame, fallback: str, window: int = TYPICAL_WINDOW, least: int = MIN_OWN_EVENTS
) -> DataFrame:
    """Median standardised score over the field's last events; too few own events fall back.

    scores: (series, race_seq, entity, score) of run events; field: (series, entity, fallback)."""
    mine = scores.join(field.select("series", "entity"), ["series", "entity"], "left_semi")
    turn = F.dense_rank().over(W.partitionBy("series").orderBy(F.desc("race_seq")))
    recent = mine.withColumn("_t", turn).where(F.col("_t") <= window)
    own = recent.groupBy("series", "entity").agg(
        F.percentile("score", F.lit(0.5)).alias("_m"), F.count(F.lit(1)).alias("n_own")
    )
    d = field.join(own, ["series", "entity"], "left")
    value = F.coalesce(F.when(F.col("n_own") >= least, F.col("_m")), F.col(fallback))
    return d.withColumn("strength", value).drop("_m")


def typical_weekend(
    race: DataFrame, history: DataFrame, method: str = "mean5", scope: Sequence[str] = ("series",)
) -> DataFrame:
    """The field on an ordinary weekend at an ordinary venue.

    mean5: prior five-event means, gaps from own last five, venue record from recent form;
    neutral: venue record and team-mate gap at the history's medians;
    median8: as neutral, with own medians over the last eight. race and history share columns;
    medians are one small row per scope."""
    n, stat = (8, "median") if method == "median8" else (5, "mean")
    gaps = ["quali_gap_to_pole_pct", "quali_gap_to_teammate_pct"]
    circuit = ["circuit_overtaking_score", "circuit_dnf_rate", "circuit_pole_win_rate", "drv_circuit_starts"]
    record = {"drv_circuit_avg_finish": "drv_avg_finish_5", "team_circuit_avg_finish": "team_avg_finish_5"}
    cols = ["grid", "quali_position", *gaps, *circuit, *record]
    med = history.groupBy(*scope).agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in cols])
    turn = F.row_number().over(W.partitionBy(*scope, "entity").orderBy(F.desc("race_seq")))
    recent = history.withColumn("_t", turn).where(F.col("_t") <= n)
    agg = (lambda c: F.percentile(c, F.lit(0.5))) if stat == "median" else F.avg
    own = recent.groupBy(*scope, "entity").agg(*[agg(c).alias(f"_o_{c}") for c in ("grid", "quali_position", *gaps)])
    d = race.join(own, [*scope, "entity"], "left").join(med, list(scope), "left")

    def c(name: str) -> Column:
        return F.col(name)

    if method == "median8":
        quali = F.coalesce("_o_quali_position", "_m_quali_position")
        grid = F.coalesce(c("_o_grid"), quali)
    else:
        quali = F.coalesce("drv_avg_quali_5", "drv_avg_grid_5", "_m_quali_position")
        grid = F.coalesce(c("drv_avg_grid_5"), quali)
    mate = c(f"_m_{gaps[1]}") if method != "mean5" else F.coalesce(f"_o_{gaps[1]}", f"_m_{gaps[1]}")
    out = {
        "quali_position": quali,
        "grid": grid,
        gaps[0]: F.coalesce(f"_o_{gaps[0]}", f"_m_{gaps[0]}"),
        gaps[1]: mate,
        **{k: (F.coalesce(c(form), c(f"_m_{k}")) if method == "mean5" else c(f"_m_{k}")) for k, form in record.items()},
        **{k: c(f"_m_{k}") for k in circuit},
    }
    return d.withColumns(out).select(*race.columns)


# -- resampled seasons ---------------------------------------------------------------
def resample_seasons(
    results: DataFrame, base: DataFrame, schedule: DataFrame, replicates: int, tag: str = "season"
) -> DataFrame:
    """Fill each remaining round of each replicate with a past round of this season.

    One draw per (team, replicate, round), so team-mates see the same weekend and stay
    correlated. results: rounds run (series, season, round, entity, points); base: the
    field (series, season, entity, team, points). Returns (…, sample, round, entity, team,
    total): the running total after each remaining round."""
    run = results.select(*SEASON, "round").distinct()
    numbered = run.withColumn("_i", (F.row_number().over(W.partitionBy(*SEASON).orderBy("round")) - 1).cast("long"))
    n = numbered.groupBy(*SEASON).agg(F.count(F.lit(1)).alias("_n"))
    left = schedule.groupBy(*SEASON).agg(F.sort_array(F.collect_set("round")).alias("_left")).join(n, SEASON)
    draws = (
        base.select(*SEASON, "entity", "team", F.col("points").cast("double").alias("_base")).join(left, SEASON)
        .withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("round", F.explode("_left"))
        .withColumn("_i", below("_n", tag, *SEASON, "team", "sample", "round"))
    )
    past = results.join(numbered, [*SEASON, "round"]).select(*SEASON, "_i", "entity", F.col("points").alias("_gain"))
    got = draws.join(past, [*SEASON, "_i", "entity"], "left").withColumn("_gain", F.coalesce("_gain", F.lit(0)))
    run_total = F.sum("_gain").over(W.partitionBy(*SEASON, "sample", "entity").orderBy("round"))
    return got.withColumn("total", F.col("_base") + run_total).select(*SEASON, "sample", "round", "entity", "team", "total")


def final_totals(path: DataFrame, by: Sequence[str] = (*SEASON, "sample", "entity", "team")) -> DataFrame:
    return path.groupBy(*by).agg(F.max_by("total", "round").alias("total"))


def absentees(totals: DataFrame, standings: DataFrame) -> DataFrame:
    """Add everyone with points who is not in the field: their totals stay what they have."""
    field = totals.select(*SEASON, "entity").distinct()
    samples = totals.groupBy(*SEASON).agg(F.max("sample").alias("_s"))
    away = standings.select(*SEASON, "entity", "team", F.col("points").cast("double").alias("total")).join(
        field, [*SEASON, "entity"], "left_anti"
    )
    each = away.join(samples, SEASON).withColumn("sample", F.explode(F.sequence(F.lit(1), F.col("_s"))))
    return totals.unionByName(each.select(*totals.columns))


def outcome_summary(totals: DataFrame, who: Sequence[str] = ("entity",), top: int = 3) -> DataFrame:
    """Mean, p10, p90, title share and share of top places per entrant (or team)."""
    rank = F.row_number().over(W.partitionBy(*SEASON, "sample").orderBy(F.desc("total"), *who))
    d = totals.withColumn("_r", rank)
    return d.groupBy(*SEASON, *who).agg(
        F.avg("total").alias("projected"),
        F.percentile("total", F.lit(0.1)).alias("low"),
        F.percentile("total", F.lit(0.9)).alias("high"),
        F.avg((F.col("_r") == 1).cast("int")).alias("p_title"),
        F.avg((F.col("_r") <= top).cast("int")).alias("p_top"),
    )


def team_totals(totals: DataFrame, base: DataFrame, awarded: DataFrame) -> DataFrame:
    """Per sample: the team's points as awarded plus what its members add."""
    gain = totals.join(base.select(*SEASON, "entity", F.col("points").cast("double").alias("_b")), [*SEASON, "entity"])
    per = gain.groupBy(*SEASON, "sample", "team").agg(F.sum(F.col("total") - F.col("_b")).alias("_g"), F.sum("_b").alias("_own"))
    have = awarded.select(*SEASON, "team", F.col("points").cast("double").alias("_a"))
    return per.join(have, [*SEASON, "team"], "left").select(
        *SEASON, "sample", "team", (F.coalesce("_a", "_own") + F.col("_g")).alias("total")
    )


def teammate_band(totals: DataFrame) -> DataFrame:
    """p10-p90 of the points between team-mates, for teams of exactly two."""
    w = W.partitionBy(*SEASON, "sample", "team")
    d = totals.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy("entity"))}).where("_n = 2")
    pair = d.groupBy(*SEASON, "sample", "team").agg(
        F.min("entity").alias("first"), F.max("entity").alias("second"),
        F.sum(F.when(F.col("_i") == 1, F.col("total")).otherwise(-F.col("total"))).alias("gap"),
    )
    return pair.groupBy(*SEASON, "team", "first", "second").agg(
        F.percentile("gap", F.lit(0.1)).alias("low"), F.percentile("gap", F.lit(0.9)).alias("high")
    )


def round_tracks(path: DataFrame) -> DataFrame:
    """Mean and band of the running total after each remaining round."""
    return path.groupBy(*SEASON, "entity", "round").agg(
        F.avg("total").alias("mean"), F.percentile("total", F.lit(0.1)).alias("low"), F.percentile("total", F.lit(0.9)).alias("high")
    )


# -- titles ---------------------------------------------------------------------------
def title_race(base: DataFrame, available: DataFrame) -> DataFrame:
    """Who can still reach the leader by taking everything left; clinched if only one can.

    base: (series, season, entity, points); available: (series, season, points_left)."""
    w = W.partitionBy(*SEASON)
    d = base.join(available, SEASON)
    alive = F.col("points") + F.col("points_left") >= F.max("points").over(w)
    d = d.withColumn("alive", alive)
    return d.withColumn("clinched", F.col("alive") & (F.sum(F.col("alive").cast("int")).over(w) == 1))


def clinch_round(lead: DataFrame, maxima: DataFrame) -> DataFrame:
    """Rounds from now until the leader could settle the title.

    After k rounds gap + M[:k] must pass M[k:]. 0 if settled, null if none are left or it
    takes longer. lead: (series, season, gap); maxima: (series, season, round, most)."""
    w = W.partitionBy(*SEASON).orderBy("round")
    whole = W.partitionBy(*SEASON)
    m = maxima.select(
        *SEASON, F.row_number().over(w).alias("k"), F.sum("most").over(w).alias("_taken"), F.sum("most").over(whole).alias("_all")
    )
    d = lead.join(m, SEASON, "left")
    settled = F.max(F.col("gap") > F.col("_all") + 1e-9)
    first = F.min(F.when(F.col("gap") + F.col("_taken") > F.col("_all") - F.col("_taken") + 1e-9, F.col("k")))
    return d.groupBy(*SEASON, "gap").agg(F.when(settled, 0).otherwise(first).alias("clinch_in"))


def allocate_odds(df: DataFrame, prob: str, clinched: str, rank_by: str, out: str = "odds", by: Sequence[str] = SEASON) -> DataFrame:
    """Title odds in tenths of a percent that sum to 100; an unclinched leader stays below 100.

    Largest remainder; the tenth taken from a certain-looking leader goes to the runner-up
    by ``rank_by``."""
    w = W.partitionBy(*by)
    total = F.sum(prob).over(w)
    d = df.withColumn("_x", F.when(total > 0, F.round(F.col(prob) / total * 1000.0, 9)).otherwise(0.0))
    d = d.withColumn("_t", F.floor("_x").cast("long"))
    turn = F.row_number().over(w.orderBy(F.desc(F.col("_x") - F.col("_t")), "entity"))
    short = F.when(total > 0, 1000 - F.sum("_t").over(w)).otherwise(0)
    d = d.withColumns({"_turn": turn, "_short": short})
    d = d.withColumn("_t", F.col("_t") + F.when(F.col("_turn") <= F.col("_short"), 1).otherwise(0))
    lead = F.row_number().over(w.orderBy(F.desc("_t"), "entity"))
    rival = F.row_number().over(w.orderBy(F.desc(rank_by), "entity"))
    d = d.withColumns({"_lead": lead, "_order": rival})
    capped = F.max(((F.col("_lead") == 1) & (F.col("_t") >= 1000) & ~F.col(clinched)).cast("int")).over(w) == 1
    second = F.max(((F.col("_order") == 2) & (F.col("_lead") > 1)).cast("int")).over(w) == 1
    d = d.withColumn("_fix", capped & second)
    step = F.when(F.col("_fix") & (F.col("_lead") == 1), -1).when(F.col("_fix") & (F.col("_order") == 2), 1).otherwise(0)
    return d.withColumn(out, (F.col("_t") + step) / 1000.0).drop("_x", "_t", "_turn", "_short", "_lead", "_order", "_fix")


# -- truth and calibration -----------------------------------------------------------------
def final_points(standings: DataFrame) -> DataFrame:
    """Standings of each season's last round."""
    last = standings.groupBy(*SEASON).agg(F.max("round").alias("round"))
    return standings.join(last, [*SEASON, "round"]).select(*SEASON, "entity", F.col("points").alias("final"))


def actual_champion(standings: DataFrame) -> DataFrame:
    f = final_points(standings)
    return f.groupBy(*SEASON).agg(F.max_by("entity", F.struct(F.col("final"), -F.col("entity"))).alias("champion"))


def checkpoints(events: DataFrame, fractions: Sequence[float] = CHECKPOINT_FRACTIONS, least_train: int = MIN_TRAIN_EVENTS) -> DataFrame:
    """Rounds at fixed shares of the season (half to even), at least the third, before the last,
    with enough earlier events to train on. events: (series, season, round, race_seq)."""
    n = events.groupBy(*SEASON).agg(F.max("round").alias("_last"), F.min("race_seq").alias("_first"))
    at = F.explode(F.array_distinct(F.array(*[F.bround(F.col("_last") * F.lit(f)).cast("int") for f in fractions]))).alias("after")
    d = n.select(*SEASON, "_last", "_first", at).where((F.col("after") >= 3) & (F.col("after") < F.col("_last")))
    return d.where(F.col("_first") + F.col("after") >= least_train).select(*SEASON, "after")


def band_coverage(bands: DataFrame, truth: str = "final", by: Sequence[str] = ("kind",)) -> DataFrame:
    """Share of truths inside [low, high], the bands' width, and how many."""
    inside = F.col(truth).between(F.col("low"), F.col("high")).cast("int")
    return bands.groupBy(*by).agg(
        F.avg(inside).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"), F.count(F.lit(1)).alias("n")
    )


def coverage_sweep(bands: DataFrame, candidates: Sequence[float], truth: str = "final", by: Sequence[str] = ()) -> DataFrame:
    """Widen bands by each candidate and keep the one whose coverage is closest to the target, first on a tie."""
    wide = bands.withColumn("spread", F.explode(F.array(*[F.lit(float(c)) for c in candidates]))).withColumns(
        {"low": F.col("low") - F.col("spread"), "high": F.col("high") + F.col("spread")}
    )
    cov = band_coverage(wide, truth, [*by, "spread"])
    gap = F.struct(F.round(F.abs(F.col("coverage") - COVERAGE_TARGET), 9), F.col("spread"))
    return cov.groupBy(*by).agg(
        F.min_by("spread", gap).alias("spread"), F.min_by("coverage", gap).alias("coverage"), F.min_by("width", gap).alias("width")
    )


def title_calibration(calls: DataFrame, edges: Sequence[float] = TITLE_EDGES) -> DataFrame:
    """Favourites' stated odds against how often they won, per bucket (left-closed)."""
    bucket = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        bucket = F.when((F.col("p") >= edges[i]) & (F.col("p") < edges[i + 1]), i).otherwise(bucket)
    g = calls.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(
        F.avg("p").alias("stated"), F.avg("won").alias("observed"), F.sum("won").alias("hits"), F.count(F.lit(1)).alias("n"),
        F.avg((F.col("p") - F.col("won")) * (F.col("p") - F.col("won"))).alias("brier"),
    )
    return g.withColumns({"ci_low": wilson_low("hits", "n"), "ci_high": wilson_high("hits", "n")})


def outlook(history: DataFrame, tracks: DataFrame, after: DataFrame, top: int = 5) -> DataFrame:
    """Points so far by round, then the projected mean and band; the band is pinched at the last
    actual round. The leading entrants by points so far."""
    past = history.join(after, SEASON).where(F.col("round") <= F.col("after"))
    now = past.where(F.col("round") == F.col("after"))
    lead = F.row_number().over(W.partitionBy(*SEASON).orderBy(F.desc("points"), "entity"))
    shown = now.withColumn("_l", lead).where(F.col("_l") <= top).select(*SEASON, "entity")
    p = F.col("points").cast("double")
    done = past.select(
        *SEASON, "entity", "round", p.alias("mean"),
        F.when(F.col("round") == F.col("after"), p).alias("low"), F.when(F.col("round") == F.col("after"), p).alias("high"),
        F.lit(True).alias("actual"),
    )
    ahead = tracks.select(*SEASON, "entity", "round", "mean", "low", "high", F.lit(False).alias("actual"))
    return done.unionByName(ahead).join(shown, [*SEASON, "entity"], "left_semi")


def projection_errors(projected: DataFrame, truth: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean absolute error of projected totals per method."""
    d = projected.join(truth, [*SEASON, "entity"])
    return d.groupBy(*by).agg(F.avg(F.abs(F.col("projected") - F.col("final"))).alias("points_mae"), F.count(F.lit(1)).alias("n"))
