"""Entity resolution between two sources: identities, teams and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import fold

# --- fixed values: session names of the second source and their codes -----------
SESSION_CODES = {
    "Practice 1": "FP1",
    "Practice 2": "FP2",
    "Practice 3": "FP3",
    "Qualifying": "Q",
    "Sprint Qualifying": "SQ",
    "Sprint Shootout": "SQ",
    "Sprint": "S",
    "Race": "R",
}
# --- end of fixed values ---------------------------------------------------------


def driver_lookup(drivers: DataFrame, scope: list[str], season: Column) -> DataFrame:
    """Known identities up to a season, each with the latest season it was seen in."""
    return (
        drivers.where(F.col("season") <= season)
        .groupBy(*scope, "driver_id", "code", "permanent_number", "family_name")
        .agg(F.max("season").alias("season"))
    )


def _values(df: DataFrame, code: Column, number: Column, family: Column, keep: list) -> DataFrame:
    """One row per usable identifying value: (kind, value), in ladder order."""
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.nullif(F.upper(code), F.lit("")).alias("value")),
        F.struct(F.lit(1).alias("kind"), F.nullif(number.cast("string"), F.lit("0")).alias("value")),
        F.struct(F.lit(2).alias("kind"), F.nullif(fold(family), F.lit("")).alias("value")),
    )
    return df.select(*keep, F.inline(kinds)).where("value is not null")


def map_drivers(entries: DataFrame, drivers: DataFrame, scope: list[str]) -> DataFrame:
    """Second-source entries to identities: code, number, folded surname, first among
    this season's identities, then among every earlier one. A rung counts only if it
    names exactly one identity.

    Both pools are reduced to the values that name one identity before joining, so a
    common value never multiplies rows. In the wider pool a value names exactly one
    identity from that identity's first season until a second one appears.
    entries: (scope, season, entry_id, name_acronym, driver_number, last_name)."""
    known = _values(
        drivers, F.col("code"), F.col("permanent_number"), F.col("family_name"), [*scope, "season", "driver_id"]
    )
    this_season = (
        known.groupBy(*scope, "season", "kind", "value")
        .agg(F.min("driver_id").alias("driver_id"), F.max("driver_id").alias("_other"))
        .where("driver_id = _other").drop("_other")
    )
    first = known.groupBy(*scope, "kind", "value", "driver_id").agg(F.min("season").alias("since"))
    turn = W.partitionBy(*scope, "kind", "value").orderBy("since", "driver_id")
    ever = (
        first.withColumns({"_n": F.row_number().over(turn), "until": F.lead("since").over(turn)})
        .where("_n = 1").select(*scope, "kind", "value", "driver_id", "since", "until")
    )
    asked = _values(
        entries, F.col("name_acronym"), F.col("driver_number"), F.col("last_name"), [*scope, "season", "entry_id"]
    )
    near = asked.join(this_season, [*scope, "season", "kind", "value"]).select(
        *scope, "season", "entry_id", F.col("kind").alias("rung"), "driver_id"
    )
    wide = (
        asked.join(ever, [*scope, "kind", "value"])
        .where((F.col("since") <= F.col("season")) & (F.col("until").isNull() | (F.col("until") > F.col("season"))))
        .select(*scope, "season", "entry_id", (F.col("kind") + 3).alias("rung"), "driver_id")
    )
    found = near.unionByName(wide).groupBy(*scope, "season", "entry_id").agg(
        F.min_by("driver_id", "rung").alias("driver_id"), F.min("rung").alias("rung")
    )
    return entries.join(found, [*scope, "season", "entry_id"], "left")


def team_lookup(results: DataFrame, qualifying: DataFrame, scope: list[str]) -> DataFrame:
    """The team each entrant was with most recently in the season."""
    cols = [*scope, "season", "round", "entity", "team"]
    both = results.select(*cols).unionByName(qualifying.select(*cols)).where("team is not null")
    return both.groupBy(*scope, "season", "entity").agg(F.max_by("team", F.struct("round", "team")).alias("team"))


def map_teams(entries: DataFrame, current: DataFrame, scope: list[str]) -> DataFrame:
    """Team names to ids: the id most of a name's known members were with.

    entries: (scope, season, entity, team_name). Ties go to the smallest id."""
    known = entries.join(current, [*scope, "season", "entity"]).where("team_name is not null")
    votes = known.groupBy(*scope, "season", "team_name", "team").agg(F.count(F.lit(1)).alias("votes"))
    best = F.max(F.struct(F.col("votes"), (-F.col("team")).alias("_neg"))).alias("_b")
    return votes.groupBy(*scope, "season", "team_name").agg(best).select(
        *scope, "season", "team_name", (-F.col("_b._neg")).alias("team"), F.col("_b.votes").alias("votes")
    )


def normalise_sessions(sessions: DataFrame) -> DataFrame:
    """Names to codes; cancelled, unknown and undated sessions dropped."""
    names = F.create_map(*[F.lit(x) for kv in SESSION_CODES.items() for x in kv])
    return (
        sessions.withColumn("code", F.try_element_at(names, F.col("session_name")))
        .where(~F.coalesce(F.col("is_cancelled"), F.lit(False)))
        .where("code is not null and start is not null")
    )


def weekend_sessions(events: DataFrame, sessions: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Sessions of the meeting whose race starts within six hours of the event's.

    The first such race in source order decides, not the nearest. Both sides are
    keyed by day, so the tolerance join is an equi-join on at most two days.
    events: (scope, season, round, race_start); sessions: (scope, meeting, code, start, order)."""
    tolerance = F.make_interval(hours=F.lit(6))
    races = sessions.where(F.col("code") == "R").select(
        *scope, "meeting", F.col("start").alias("_at"), F.col(order).alias("_o"), F.to_date("start").alias("_day")
    )
    days = F.array_distinct(
        F.array(F.to_date(F.col("race_start") - tolerance), F.to_date(F.col("race_start") + tolerance))
    )
    near = (
        events.where("race_start is not null").withColumn("_day", F.explode(days))
        .join(races, [*scope, "_day"])
        .where((F.col("_at") >= F.col("race_start") - tolerance) & (F.col("_at") <= F.col("race_start") + tolerance))
    )
    chosen = near.groupBy(*scope, "season", "round", "race_start").agg(F.min_by("meeting", "_o").alias("meeting"))
    return chosen.join(sessions, [*scope, "meeting"]).where(
        (F.col("start") >= F.col("race_start") - F.make_interval(days=F.lit(4)))
        & (F.col("start") <= F.col("race_start") + tolerance)
    )


def display_names(drivers: DataFrame, scope: list[str]) -> DataFrame:
    """One display name per identity across seasons."""
    return drivers.groupBy(*scope, "driver_id").agg(F.max("family_name").alias("name"))
