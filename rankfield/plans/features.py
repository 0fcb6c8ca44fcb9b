"""The feature table: one row per (event, entrant), every window blind to its own event.

All windows are partitioned by keys that start with the series, so after one
hash partitioning by series the build needs no further shuffle for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import (
    CLASS_FEATURES, MAX_FIELD, PRACTICE_MAX_GAP_PCT, QUALI_FEATURES, RACE_FEATURES, TEAMMATE_GAP_CLIP,
    VENUE_CLASS_WINDOW,
)
from ..functions.scalars import clip
from ..operators import ladders
from ..operators.windows import (
    event_sequence, gap_to_best, prior_by_event, prior_count, prior_rolling, prior_valid, teammate_gap,
)
from ..session import cut, kept
from ..sources.contest import EVENT, KEY, Tables, add_outcomes

SEQ = "race_seq"
ENTITY = ["series", "entity"]
TEAM = ["series", "team"]
VENUE = ["series", "venue"]
THIS_EVENT = ["series", SEQ]


def relevance(position: str) -> Column:
    """Higher is better; null where there is no position."""
    return F.when(F.col(position).isNotNull(), F.greatest(F.lit(MAX_FIELD) - F.col(position), F.lit(0)))


def previous_standing(df: DataFrame, standings: DataFrame) -> DataFrame:
    """Standing after the round before; everyone starts round 1 on no points."""
    before = standings.select(
        "series",
        "season",
        (F.col("round") + 1).alias("round"),
        "entity",
        F.col("position").alias("champ_position_before"),
        F.col("points").alias("champ_points_before"),
    )
    out = df.join(before, KEY, "left")
    start = F.when(F.col("round") == 1, F.coalesce("champ_points_before", F.lit(0)))
    return out.withColumn("champ_points_before", start.otherwise(F.col("champ_points_before")))


# What each window group reads: out -> (column, n, statistic), or for groups of
# several entrants (column, collapse, n, statistic).
GAP = "quali_gap_to_pole_pct"
FORM_VALID = {
    "drv_avg_finish_3": ("finish_when_running", 3, "median"),
    "drv_avg_finish_5": ("finish_when_running", 5, "median"),
}
FORM_ROWS = {
    "drv_avg_grid_5": ("grid", 5, "mean"),
    "drv_points_rate_5": ("points", 5, "mean"),
    "drv_dnf_rate_10": ("dnf_flag", 10, "mean"),
}
TEAM_FORM_VALID = {
    "team_avg_finish_3": ("finish_when_running", "mean", 3, "median"),
    "team_avg_finish_5": ("finish_when_running", "mean", 5, "median"),
}
TEAM_FORM_ROWS = {
    "team_points_rate_5": ("points", "sum", 5, "mean"),
    "team_dnf_rate_10": ("dnf_flag", "mean", 10, "mean"),
}
QUALI_ROWS = {
    "drv_avg_quali_3": ("quali_position", 3, "mean"),
    "drv_avg_quali_5": ("quali_position", 5, "mean"),
    "drv_pole_rate_10": ("pole_flag", 10, "mean"),
    "drv_quali_top3_rate_10": ("quali_top3_flag", 10, "mean"),
}
TEAM_QUALI_ROWS = {"team_avg_quali_5": ("quali_position", "min", 5, "mean")}
EDGE_VALID = {"drv_teammate_quali_edge": ("_edge", 5, "mean")}
PACE_ROWS = {"drv_pace_gap_pct": (GAP, 5, "mean")}
TEAM_PACE_ROWS = {
    "team_pace_gap_pct": (GAP, "min", 5, "mean"),
    "_recent": (GAP, "min", 3, "mean"),
    "_longer": (GAP, "min", 8, "mean"),
}
CRAFT_VALID = {"drv_positions_gained_5": ("positions_gained", 5, "mean")}
CRAFT_ROWS = {"drv_podium_rate_10": ("podium_flag", 10, "mean"), "drv_top10_rate_10": ("top10_flag", 10, "mean")}


def with_stat(specs: dict, stat: str) -> dict:
    """The form windows with another statistic than the median."""
    return {o: (*s[:-1], stat) for o, s in specs.items()}


def add_form(df: DataFrame, stat: str = "median") -> DataFrame:
    df = prior_valid(df, ENTITY, SEQ, with_stat(FORM_VALID, stat))
    df = prior_rolling(df, ENTITY, SEQ, FORM_ROWS).withColumn("drv_experience", prior_count(ENTITY, SEQ))
    team = {**with_stat(TEAM_FORM_VALID, stat), **TEAM_FORM_ROWS}
    return prior_by_event(df, TEAM, SEQ, "entity", team, tuple(TEAM_FORM_VALID))


def add_venue_history(df: DataFrame) -> DataFrame:
    df = prior_valid(
        df, [*ENTITY, "venue"], SEQ, {"drv_circuit_avg_finish": ("finish_when_running", None, "mean")}
    ).withColumn("drv_circuit_starts", prior_count([*ENTITY, "venue"], SEQ))
    past = {"team_circuit_avg_finish": ("finish_when_running", "mean", None, "mean")}
    return prior_by_event(df, [*TEAM, "venue"], SEQ, "entity", past, True)


def add_venue_profile(df: DataFrame) -> DataFrame:
    ran = F.col("position").isNotNull()
    pole_win = F.coalesce((F.col("grid") == 1) & (F.col("position") == 1), F.lit(False)).cast("int")
    df = df.withColumns(
        {
            "_moved": F.when(ran, F.abs(F.col("grid") - F.col("finish_or_last"))),
            "_pole_win": F.when(ran, pole_win),
        }
    )
    past = {
        "circuit_overtaking_score": ("_moved", "mean", None, "mean"),
        "circuit_dnf_rate": ("dnf_flag", "mean", None, "mean"),
        "circuit_pole_win_rate": ("_pole_win", "max", None, "mean"),
    }
    return prior_by_event(df, VENUE, SEQ, "entity", past).drop("_moved", "_pole_win")


def weekend_inputs(df: DataFrame) -> DataFrame:
    """This event's gaps, flags and places gained: what the windows look back on."""
    return df.withColumns(
        {
            GAP: gap_to_best("best_ms", THIS_EVENT),
            "quali_gap_to_teammate_pct": teammate_gap("best_ms", [*THIS_EVENT, "team"]),
            "pole_flag": (F.col("quali_position") == 1).cast("int"),
            "quali_top3_flag": (F.col("quali_position") <= 3).cast("int"),
            "positions_gained": F.col("grid") - F.col("finish_when_running"),
        }
    ).withColumn("_edge", clip("quali_gap_to_teammate_pct", -TEAMMATE_GAP_CLIP, TEAMMATE_GAP_CLIP))


def add_quali(df: DataFrame) -> DataFrame:
    df = prior_rolling(weekend_inputs(df), ENTITY, SEQ, QUALI_ROWS)
    df = prior_by_event(df, TEAM, SEQ, "entity", TEAM_QUALI_ROWS)
    return prior_valid(df, ENTITY, SEQ, EDGE_VALID).drop("_edge")


def add_edge(df: DataFrame) -> DataFrame:
    """Clipped head-to-head against the team-mate over the last five comparisons."""
    return prior_valid(weekend_inputs(df), ENTITY, SEQ, EDGE_VALID).drop("_edge")


def add_pace(df: DataFrame) -> DataFrame:
    df = prior_by_event(weekend_inputs(df), TEAM, SEQ, "entity", TEAM_PACE_ROWS)
    return prior_rolling(_trend(df), ENTITY, SEQ, PACE_ROWS).drop("_edge")


def _trend(df: DataFrame) -> DataFrame:
    return df.withColumn("team_pace_trend", F.col("_recent") - F.col("_longer")).drop("_recent", "_longer")


def add_racecraft(df: DataFrame) -> DataFrame:
    df = prior_valid(weekend_inputs(df), ENTITY, SEQ, CRAFT_VALID)
    return prior_rolling(df, ENTITY, SEQ, CRAFT_ROWS).drop("_edge")


def practice_pivot(pace: DataFrame, calendar: DataFrame) -> DataFrame:
    """Best times per entrant from the sessions that ran before qualifying (or are undated)."""
    p = pace.where(F.col("session").isin("FP1", "FP2", "FP3")).join(
        calendar.select(*EVENT, "quali_start"), EVENT, "left"
    )
    early = F.coalesce(F.col("session_start") < F.col("quali_start"), F.lit(True))
    best = {f"fp{k}_best_ms": F.min(F.when(F.col("session") == f"FP{k}", F.col("best_lap_ms"))) for k in (1, 2, 3)}
    return p.where(early).groupBy(*KEY).agg(
        F.min("long_run_ms").alias("fp_long_run_ms"),
        F.min("best_lap_ms").alias("fp_best_ms"),
        *[c.alias(n) for n, c in best.items()],
    )


def eligible_sprint_quali(sprint_quali: DataFrame, calendar: DataFrame, first_season: int = 2024) -> DataFrame:
    """Sprint qualifying positions known before qualifying."""
    d = sprint_quali.join(calendar.select(*EVENT, "quali_start"), EVENT)
    known = F.col("quali_start").isNull() | (F.col("session_start") < F.col("quali_start"))
    return d.where((F.col("season") >= first_season) & known).select(*KEY, "sq_position")


def practice_inputs(pace, calendar, sprint_quali, first_season: int = 2024) -> DataFrame:
    """Practice times and sprint qualifying, either of which may be missing."""
    sq = eligible_sprint_quali(sprint_quali, calendar, first_season)
    return practice_pivot(pace, calendar).join(sq, KEY, "full_outer")


def add_practice(df: DataFrame) -> DataFrame:
    """Compact and detailed practice features of the event itself."""
    event = W.partitionBy(*THIS_EVENT)
    df = df.withColumns(
        {
            "fp_long_run_gap_pct": gap_to_best("fp_long_run_ms", THIS_EVENT),
            "fp_best_gap_pct": gap_to_best("fp_best_ms", THIS_EVENT),
            "practice_available": F.col("fp_best_ms").isNotNull().cast("int"),
            **{f"_g{k}": gap_to_best(f"fp{k}_best_ms", THIS_EVENT) for k in (1, 2, 3)},
        }
    )
    df = df.withColumns(
        {f"fp{k}_gap_pct": F.when(F.col(f"_g{k}") <= PRACTICE_MAX_GAP_PCT, F.col(f"_g{k}")) for k in (1, 2, 3)}
    ).withColumn("fp_latest_gap_pct", F.coalesce("fp3_gap_pct", "fp2_gap_pct", "fp1_gap_pct"))
    latest = F.col("fp_latest_gap_pct")
    team = W.partitionBy(*THIS_EVENT, "team")
    three = F.array_compact(F.array("fp1_gap_pct", "fp2_gap_pct", "fp3_gap_pct"))
    size = F.size(three)
    total = F.aggregate(three, F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(three, F.lit(0.0), lambda a, x: a + (x - total / size) * (x - total / size))
    return df.withColumns(
        {
            "fp_latest_rank": F.when(latest.isNotNull(), F.rank().over(event.orderBy(latest.asc_nulls_last()))),
            "fp_team_gap_pct": F.min(latest).over(team),
            "fp_teammate_gap_pct": F.when(F.count(latest).over(team) >= 2, latest - F.min(latest).over(team)),
            "fp_trend_12": F.col("fp2_gap_pct") - F.col("fp1_gap_pct"),
            "fp_trend_23": F.col("fp3_gap_pct") - F.col("fp2_gap_pct"),
            "fp_consistency": F.when(size >= 2, F.sqrt(spread / size)),
        }
    ).drop("_g1", "_g2", "_g3")


def add_venue_class(df: DataFrame, is_class: Column) -> DataFrame:
    """Form at venues of the same class."""
    df = df.withColumn("street_circuit", is_class.cast("int"))
    df = prior_valid(
        df,
        [*ENTITY, "street_circuit"],
        SEQ,
        {"drv_type_avg_finish": ("finish_when_running", VENUE_CLASS_WINDOW, "mean")},
    )
    return prior_by_event(
        df,
        [*TEAM, "street_circuit"],
        SEQ,
        "entity",
        {"team_type_avg_finish": ("finish_when_running", "mean", VENUE_CLASS_WINDOW, "mean")},
        skip_nulls=True,
    )


def add_progress(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Round over calendar length: known before the season starts."""
    length = calendar.groupBy("series", "season").agg(F.max("round").alias("_last"))
    return (
        df.join(length, ["series", "season"], "left")
        .withColumn("season_progress", F.col("round") / F.coalesce("_last", "round"))
        .drop("_last")
    )


def add_all(df: DataFrame, stat: str = "median") -> DataFrame:
    """Every window feature and the labels, on a frame with inputs joined.

    The groups above share their windows here: one pass per partition key."""
    df = weekend_inputs(df)
    df = prior_valid(df, ENTITY, SEQ, {**with_stat(FORM_VALID, stat), **EDGE_VALID, **CRAFT_VALID})
    df = prior_rolling(df, ENTITY, SEQ, {**FORM_ROWS, **QUALI_ROWS, **PACE_ROWS, **CRAFT_ROWS})
    df = df.withColumn("drv_experience", prior_count(ENTITY, SEQ))
    team = {**with_stat(TEAM_FORM_VALID, stat), **TEAM_FORM_ROWS, **TEAM_QUALI_ROWS, **TEAM_PACE_ROWS}
    df = _trend(prior_by_event(df, TEAM, SEQ, "entity", team, tuple(TEAM_FORM_VALID)))
    df = add_practice(add_venue_profile(add_venue_history(df)))
    return df.withColumns(
        {"race_relevance": relevance("position"), "quali_relevance": relevance("quali_position")}
    ).drop("_edge")


def frame(t: Tables, results: DataFrame | None = None, upcoming: bool = True, today: Column | None = None,
          first_sprint_season: int = 1998) -> DataFrame:
    """Results (and placeholder rows of open events) with grid, qualifying, practice and standings joined."""
    results = t.contest if results is None else results
    run = results.select(*EVENT).distinct()
    base = results.select(*KEY, "team", "venue", "position", "points", "dnf", "laps").withColumn(
        "entry_source", F.lit("results")
    )
    qualifying, sessions = t.qualifying, t.session_entries
    if upcoming:
        today = F.lit("2001-12-01").cast("date") if today is None else today
        base = base.unionByName(
            ladders.upcoming_entries(t.calendar, run.join(results, EVENT), qualifying, sessions, today),
            allowMissingColumns=True,
        )
    base = cut(base)
    # The ladder reads only keys and slots; everything else joins its answer.
    listed = base.select(*KEY).join(t.result_grid.join(run, EVENT, "left_semi"), KEY, "left")
    grid = ladders.resolve_grid(listed, qualifying, t.official_grid).select(*KEY, "grid", "grid_source")
    base = base.join(qualifying.select(*KEY, "quali_position", "best_ms"), KEY, "left")
    base = base.join(practice_inputs(t.session_pace, t.calendar, t.sprint_quali, first_sprint_season), KEY, "left")
    base = base.join(grid, KEY, "left")
    base = previous_standing(base, t.standings)
    base = add_progress(base, t.calendar)
    return add_outcomes(event_sequence(base.repartition("series"), ["series"], ["season", "round"]))


def build(t: Tables, upcoming: bool = True, stat: str = "median", results: DataFrame | None = None, today: Column | None = None) -> DataFrame:
    """The whole feature table, from landed results so that no source is read twice.

    The joined frame is stored before the windows: they then run over one scan, and neither
    half is planned again while the other's stages finish."""
    return add_all(kept(frame(t.landed("calendar", "standings"), results, upcoming, today)), stat)


ALL_FEATURES = list(dict.fromkeys([*RACE_FEATURES, *QUALI_FEATURES, "drv_avg_grid_5", "quali_gap_to_teammate_pct"]))
CANDIDATES = [*CLASS_FEATURES]


def coverage(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of rows with a value, per feature, as rows."""
    by = by or []
    wide = df.groupBy(*by).agg(*[(F.count(n) / F.count(F.lit(1)) * 100).alias(n) for n in names])
    return wide.unpivot(by, names, "feature", "coverage_pct")


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("season").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("season", "round", "series", "entity")
