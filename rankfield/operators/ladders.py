"""Source-resolution ladders: take the first source that passes its checks.

Sources are unioned with a priority, each (event, source) gets its list of
problems from one aggregation, and the winner is the lowest priority among the
clean ones. No loop over events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import ENTRY_SESSIONS, FIELD_SIZE, MAX_PER_TEAM, MAX_SLOT, MIN_GRID_COVERAGE

EVENT = ["series", "season", "round"]


def _flag(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def check_grid(candidates: DataFrame, entrants: DataFrame | None = None, event: list[str] = EVENT) -> DataFrame:
    """Problems per (event, source) of candidate grids (event, source, entity, position).

    With entrants (event, entity), a source must not name strangers and must
    place most of the field."""
    pos = F.col("position")
    df = candidates
    if entrants is not None:
        known = entrants.select(*event, "entity").distinct().withColumn("_in", F.lit(1))
        sizes = known.groupBy(*event).agg(F.count(F.lit(1)).alias("_field"))
        df = df.join(known, [*event, "entity"], "left").join(sizes, event, "left")
    else:
        df = df.withColumns({"_in": F.lit(1), "_field": F.lit(0)})
    stats = df.groupBy(*event, "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("entity").alias("distinct_entities"),
        F.max(((pos < 0) | (pos > MAX_SLOT)).cast("int")).alias("out_of_range"),
        F.count(F.when(pos > 0, pos)).alias("slots"),
        F.count_distinct(F.when(pos > 0, pos)).alias("distinct_slots"),
        F.count(F.when(F.col("_in").isNull(), 1)).alias("strangers"),
        F.count_distinct(F.when(pos.isNotNull() & F.col("_in").isNotNull(), F.col("entity"))).alias("placed"),
        F.coalesce(F.max("_field"), F.lit(0)).alias("field"),
    )
    problems = F.array_compact(
        F.array(
            _flag(F.col("n") > F.col("distinct_entities"), "entity twice"),
            _flag(F.coalesce(F.col("out_of_range"), F.lit(0)) == 1, "position out of range"),
            _flag(F.col("slots") > F.col("distinct_slots"), "slot twice"),
            _flag(F.col("strangers") > 0, "stranger"),
            _flag(F.col("placed") < MIN_GRID_COVERAGE * F.col("field"), "coverage"),
        )
    )
    return stats.select(*event, "source", "n", "placed", "field", problems.alias("problems"))


def check_entries(
    candidates: DataFrame,
    sized: Column | bool = True,
    event: list[str] = EVENT,
    field_size: tuple[int, int] = FIELD_SIZE,
    max_per_team: int = MAX_PER_TEAM,
) -> DataFrame:
    """Problems per (event, source) of candidate entry lists (event, source, entity, team)."""
    sized = F.lit(sized) if isinstance(sized, bool) else sized
    key = [*event, "source"]
    teams = (
        candidates.where("team is not null").groupBy(*key, "team").agg(F.count_distinct("entity").alias("_m"))
        .groupBy(*key).agg(F.max("_m").alias("largest_team"))
    )
    stats = (
        candidates.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("entity").alias("distinct_entities"),
            F.max(F.col("team").isNull().cast("int")).alias("teamless"),
        )
        .join(teams, key, "left")
    )
    problems = F.array_compact(
        F.array(
            _flag(F.col("n") > F.col("distinct_entities"), "entity twice"),
            _flag(F.col("teamless") == 1, "no team"),
            _flag(F.coalesce(F.col("largest_team"), F.lit(0)) > max_per_team, "team too large"),
            _flag(sized & ~F.col("n").between(*field_size), "field size"),
        )
    )
    return stats.select(*key, "n", problems.alias("problems"))


def resolve_grid(
    frame: DataFrame, qualifying: DataFrame, official: DataFrame, event: list[str] = EVENT
) -> DataFrame:
    """Starting grid of every entrant with the source it came from.

    frame: (event, entity, grid) with the grid published with the results;
    qualifying: (event, entity, quali_position), trimmed to the entrants;
    official: (event, entity, position). A pit-lane start (0) or a listed
    entrant without a slot starts from the back."""
    cols = [*event, "entity", "position"]
    entrants = frame.select(*event, "entity")
    candidates = (
        frame.where("grid is not null").select(*event, "entity", F.col("grid").alias("position"), F.lit("results").alias("source"))
        .unionByName(official.select(*cols).withColumn("source", F.lit("official")))
        .unionByName(
            qualifying.withColumnRenamed("quali_position", "position").select(*cols)
            .join(entrants, [*event, "entity"], "left_semi").withColumn("source", F.lit("qualifying"))
        )
    )
    rank = F.when(F.col("source") == "results", 1).when(F.col("source") == "official", 2).otherwise(3)
    chosen = (
        check_grid(candidates, entrants, event).where(F.size("problems") == 0)
        .groupBy(*event).agg(F.min_by("source", rank).alias("source"))
    )
    slots = candidates.join(chosen, [*event, "source"]).select(
        *event, "entity", F.col("position").alias("_slot"), F.col("source").alias("_source")
    )
    size = F.count(F.lit(1)).over(W.partitionBy(*event))
    grid = F.when(F.coalesce(F.col("_slot"), F.lit(0)) == 0, F.col("_n")).otherwise(F.col("_slot"))
    return (
        frame.drop("grid", "grid_source").withColumn("_n", size)
        .join(slots, [*event, "entity"], "left")
        .withColumn("grid", F.when(F.col("_source").isNotNull(), grid))
        .withColumn("grid_source", F.when(F.col("grid").isNotNull(), F.col("_source")))
        .drop("_n", "_slot", "_source")
    )


def race_entries(
    targets: DataFrame, results: DataFrame, qualifying: DataFrame, sessions: DataFrame, event: list[str] = EVENT
) -> DataFrame:
    """Field of events without results: (event, entity, team, entry_source).

    Qualifying, then the session lists, then the previous event's field."""
    *season, rnd = event
    cols = [*event, "entity", "team"]
    want = targets.select(*event)
    before = (
        want.join(results.select(*season, F.col(rnd).alias("_r")).distinct(), season)
        .where(F.col("_r") < F.col(rnd)).groupBy(*event).agg(F.max("_r").alias("_r"))
    )
    previous = before.join(
        results.select(*season, F.col(rnd).alias("_r"), "entity", "team"), [*season, "_r"]
    ).dropDuplicates([*event, "entity"])
    candidates = (
        qualifying.select(*cols).withColumns({"source": F.lit("qualifying"), "_p": F.lit(0)})
        .unionByName(
            sessions.withColumns(
                {
                    "source": F.concat(F.lit("session:"), F.col("session")),
                    "_p": F.array_position(F.array(*[F.lit(s) for s in ENTRY_SESSIONS]), F.col("session")).cast("int"),
                }
            ).where("_p > 0").select(*cols, "source", "_p")
        )
        .join(want, event, "left_semi")
    )
    clean = check_entries(candidates, F.col("source") != "qualifying", event).where(F.size("problems") == 0)
    ranked = candidates.select(*event, "source", "_p").distinct().join(clean.select(*event, "source"), [*event, "source"])
    ranked = ranked.unionByName(before.select(*event, F.lit("previous_race").alias("source"), F.lit(99).alias("_p")))
    chosen = ranked.groupBy(*event).agg(F.min_by("source", "_p").alias("source"))
    return (
        candidates.drop("_p").unionByName(previous.select(*cols, F.lit("previous_race").alias("source")))
        .join(chosen, [*event, "source"]).withColumnRenamed("source", "entry_source")
    )


def upcoming_entries(
    calendar: DataFrame, results: DataFrame, qualifying: DataFrame, sessions: DataFrame, today: Column,
    event: list[str] = EVENT,
) -> DataFrame:
    """Placeholder rows for events not run and dated yesterday or later."""
    open_events = calendar.where(F.col("race_date") >= F.date_sub(today, 1)).join(
        results.select(*event).distinct(), event, "left_anti"
    )
    entries = race_entries(open_events, results, qualifying, sessions, event)
    return entries.join(open_events.select(*event, "venue"), event)


def starting_grid(df: DataFrame, event: list[str], entity: str = "entity", grid: str = "grid") -> DataFrame:
    """Complete a grid: entrants without a slot go to the back in field order."""
    w = W.partitionBy(*event)
    order = F.row_number().over(W.partitionBy(*event, F.col(grid).isNull()).orderBy(entity))
    back = F.coalesce(F.max(grid).over(w), F.lit(0))
    return df.withColumns({"_back": back, "_order": order}).withColumn(
        grid, F.coalesce(F.col(grid), F.col("_back") + F.col("_order"))
    ).drop("_back", "_order")


def next_event(df: DataFrame, now: Column, scope: list[str], require: bool = False) -> DataFrame:
    """Earliest event of each scope without results that has not started by ``now``.

    df: (scope, season, round, race_start, ran). With require, an empty answer is an error."""
    left = df.where(~F.col("ran")).where(F.col("race_start").isNull() | (F.col("race_start") > now))
    nxt = left.groupBy(*scope).agg(F.min(F.struct("season", "round")).alias("_e"))
    out = nxt.select(*scope, "_e.season", "_e.round")
    if require and out.isEmpty():
        raise LookupError("no event left to forecast")
    return out


def grid_known(df: DataFrame, event: list[str]) -> DataFrame:
    """Whether enough of each field has a resolved slot."""
    share = F.count("grid_source") / F.count(F.lit(1))
    return df.groupBy(*event).agg((share >= MIN_GRID_COVERAGE).alias("known"), share.alias("share"))
