"""Source-resolution ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ladders as op
from ..plans.features import add_outcomes
from ..sources.contest import EVENT, KEY, Tables
from .registry import query
from .sqlbase import cte

EV = "series:i season:i round:i "

cte(
    "grid_candidates",
    """SELECT series, season, round, entity, grid AS position, 'results' AS source, 1 AS pr FROM result_grid WHERE grid IS NOT NULL
      UNION ALL SELECT series, season, round, entity, position, 'official', 2 FROM official_grid
      UNION ALL SELECT series, season, round, entity, quali_position, 'qualifying', 3 FROM qualifying""",
)
cte(
    "grid_checked",
    """SELECT series, season, round, source, pr, count(*) AS n,
      count(*) FILTER (position IS NOT NULL AND c.entity IS NOT NULL) AS placed, any_value(f.field) AS field,
      concat_ws(',', CASE WHEN count(*) > count(DISTINCT g.entity) THEN 'entity twice' END,
       CASE WHEN bool_or(g.position < 0 OR g.position > 30) THEN 'position out of range' END,
       CASE WHEN count(*) FILTER (g.position > 0) > count(DISTINCT g.position) FILTER (g.position > 0) THEN 'slot twice' END,
       CASE WHEN count(*) FILTER (c.entity IS NULL) > 0 THEN 'stranger' END,
       CASE WHEN count(DISTINCT g.entity) FILTER (g.position IS NOT NULL AND c.entity IS NOT NULL) < 0.9 * any_value(f.field) THEN 'coverage' END) AS problems
      FROM grid_candidates g LEFT JOIN (SELECT series, season, round, entity FROM contest) c USING (series, season, round, entity)
      LEFT JOIN (SELECT series, season, round, count(*) AS field FROM contest GROUP BY ALL) f USING (series, season, round)
      GROUP BY ALL""".replace("GROUP BY ALL\"", "GROUP BY ALL\""),
)
cte(
    "resolved_grid",
    """SELECT c.series, c.season, c.round, c.entity,
      CASE WHEN g.source IS NOT NULL THEN CASE WHEN coalesce(g.position, 0) = 0 THEN c.field ELSE g.position END END AS grid,
      g.source AS grid_source FROM contest c
      LEFT JOIN (SELECT series, season, round, arg_min(source, pr) AS source FROM grid_checked WHERE problems = '' GROUP BY ALL) ch
        USING (series, season, round)
      LEFT JOIN grid_candidates g ON g.series = c.series AND g.season = c.season AND g.round = c.round AND g.entity = c.entity AND g.source = ch.source""",
)


def candidates(t: Tables):
    return (
        t.result_grid.where("grid is not null").select(*KEY, F.col("grid").alias("position"), F.lit("results").alias("source"))
        .unionByName(t.official_grid.withColumn("source", F.lit("official")))
        .unionByName(t.qualifying.select(*KEY, F.col("quali_position").alias("position"), F.lit("qualifying").alias("source")))
    )


@query("d1_check_grid", EV + "source:s n:i placed:i field:i problems:s", "SELECT * FROM grid_checked")
def _(t):
    d = op.check_grid(candidates(t), t.contest)
    return d.withColumn("problems", F.array_join("problems", ","))


cte(
    "entries_checked",
    """SELECT series, season, round, session AS source, count(*) AS n,
      concat_ws(',', CASE WHEN count(*) > count(DISTINCT entity) THEN 'entity twice' END,
       CASE WHEN bool_or(team IS NULL) THEN 'no team' END, CASE WHEN max(members) > 2 THEN 'team too large' END,
       CASE WHEN count(*) NOT BETWEEN 16 AND 26 THEN 'field size' END) AS problems
      FROM (SELECT *, count(*) OVER (PARTITION BY series, season, round, session, team) AS members FROM session_entries)
      GROUP BY series, season, round, session""",
)


@query("d2_check_entries", EV + "source:s n:i problems:s", "SELECT * FROM entries_checked")
def _(t):
    d = op.check_entries(t.session_entries.withColumnRenamed("session", "source"))
    return d.withColumn("problems", F.array_join("problems", ","))


@query("d3_resolve_grid", EV + "entity:i grid:i grid_source:s", "SELECT * FROM resolved_grid")
def _(t):
    return op.resolve_grid(t.result_grid, t.qualifying, t.official_grid)


def _half_season(t: Tables):
    """As if only eight rounds of each season had been run."""
    return (
        t.calendar.where("round > 8"),
        t.contest.where("round <= 8"),
        t.qualifying.where("round <= 9"),
        t.session_entries.where("round <= 11"),
    )


cte(
    "open_entries",
    """WITH q AS (SELECT series, season, round, entity, team, 'qualifying' AS entry_source, 0 AS pr FROM qualifying WHERE round = 9
        AND (series, season, round) NOT IN (SELECT (series, season, round) FROM
          (SELECT series, season, round, team FROM qualifying GROUP BY ALL HAVING count(*) > 2))),
      s AS (SELECT e.series, e.season, e.round, e.entity, e.team, 'session:' || e.session AS entry_source,
          list_position(['Q', 'S', 'SQ', 'FP3', 'FP2'], e.session) AS pr FROM session_entries e
          JOIN entries_checked k ON e.series = k.series AND e.season = k.season AND e.round = k.round AND e.session = k.source
          WHERE k.problems = '' AND e.round BETWEEN 9 AND 11),
      p AS (SELECT c.series, c.season, c.round, r.entity, r.team, 'previous_race' AS entry_source, 99 AS pr FROM calendar c
          JOIN contest r ON r.series = c.series AND r.season = c.season AND r.round =
            (SELECT max(x.round) FROM contest x WHERE x.series = c.series AND x.season = c.season AND x.round <= 8)
          WHERE c.round > 8),
      u AS (SELECT * FROM q UNION ALL SELECT * FROM s UNION ALL SELECT * FROM p)
      SELECT series, season, round, entity, team, entry_source FROM
        (SELECT *, min(pr) OVER (PARTITION BY series, season, round) AS best FROM u) WHERE pr = best""",
)


@query("d4_race_entries", EV + "entity:i team:i entry_source:s", "SELECT * FROM open_entries")
def _(t):
    return op.race_entries(*_half_season(t))


@query(
    "d5_upcoming_entries",
    EV + "entity:i team:i venue:i entry_source:s position:i finish_or_last:i",
    """SELECT e.*, c.venue, NULL AS position, 24 AS finish_or_last FROM open_entries e JOIN calendar c USING (series, season, round)
      WHERE c.race_date >= DATE '1999-09-14'
      UNION ALL SELECT series, season, round, entity, team, 'results', venue, position, position FROM contest WHERE round <= 8""".replace(
        "SELECT e.*, c.venue, NULL AS position, 24 AS finish_or_last",
        "SELECT e.series, e.season, e.round, e.entity, e.team, e.entry_source, c.venue, NULL AS position, 24 AS finish_or_last",
    ),
)
def _(t):
    calendar, results, quali, sessions = _half_season(t)
    upcoming = op.upcoming_entries(calendar, results, quali, sessions, F.lit("1999-09-15").cast("date"))
    base = results.select(*KEY, "team", "venue", "position", "points", "dnf").withColumn("entry_source", F.lit("results"))
    return add_outcomes(base.unionByName(upcoming, allowMissingColumns=True))


@query(
    "d6_starting_grid",
    EV + "entity:i grid:i",
    """SELECT series, season, round, entity, coalesce(slot, coalesce(max(slot) OVER (PARTITION BY series, season, round), 0)
      + row_number() OVER (PARTITION BY series, season, round, slot IS NULL ORDER BY entity)) AS grid
      FROM (SELECT *, quali_position AS slot FROM contest)""",
)
def _(t):
    return op.starting_grid(t.contest.drop("grid").withColumnRenamed("quali_position", "grid"), EVENT)


@query(
    "d7_next_event",
    EV,
    """SELECT series, n.season, n.round FROM (SELECT series, min({'season': season, 'round': round}) AS n FROM calendar
      ANTI JOIN contest USING (series, season, round) WHERE race_start IS NULL OR race_start > TIMESTAMP '2001-11-15 00:00:00' GROUP BY series)""",
)
def _(t):
    run = t.contest.select(*EVENT).distinct().withColumn("ran", F.lit(True))
    d = t.calendar.join(run, EVENT, "left").withColumn("ran", F.coalesce("ran", F.lit(False)))
    return op.next_event(d, F.lit("2001-11-15").cast("timestamp_ntz"), ["series"], require=True)


@query(
    "d8_grid_known",
    EV + "known:b share:d",
    """SELECT series, season, round, count(grid_source) / count(*) >= 0.9 AS known, count(grid_source) / count(*) AS share
      FROM (SELECT c.series, c.season, c.round, c.entity, o.entity AS grid_source FROM contest c
       LEFT JOIN official_grid o USING (series, season, round, entity)) GROUP BY ALL""",
)
def _(t):
    listed = t.official_grid.select(*KEY, F.lit("official").alias("grid_source")).dropDuplicates(KEY)
    return op.grid_known(t.contest.select(*KEY).join(listed, KEY, "left"), EVENT)
