"""L1-L22 over tables with defects planted by modulus rules, so every check has work."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import checks as op
from ..sources.contest import EVENT, Tables
from .registry import query
from .sqlbase import cte

SPEC = "series:i season:i round:i detail:s"
TODAY = "2001-11-30"

cte("racesd", """SELECT series, season, round, CASE WHEN round = 6 AND season % 3 = 0 THEN make_date(season, 4, 1) ELSE race_date END AS race_date,
  race_start, quali_start FROM calendar WHERE NOT (round = 5 AND (season + series) % 4 = 0)""")
cte("resultsd", """SELECT c.series, c.season, c.round, c.entity, c.team, dnf, NOT dnf AS classified, laps, status,
  CASE WHEN k % 101 = 0 THEN position + 30 WHEN k % 89 = 0 THEN 1 WHEN k % 83 <> 0 THEN position END AS position,
  CASE WHEN k % 79 = 0 THEN -1 WHEN k % 71 = 0 THEN 5 ELSE points END AS points,
  CASE WHEN k % 67 = 0 THEN 3 ELSE g.grid END AS grid
  FROM (SELECT *, season * 12 + round + entity AS k FROM contest) c JOIN result_grid g USING (series, season, round, entity)
  WHERE (season * 12 + round + series) % 17 <> 0 AND NOT ((season * 12 + round + series) % 23 = 0 AND entity % 3 = 0)""")
cte("driversd", "SELECT DISTINCT series, season, entity FROM contest WHERE NOT (entity % 29 = 3 AND season % 2 = 1)")
cte("standingsd", """SELECT series, season, round, entity, points - CASE WHEN (season * 12 + round + series) % 31 = 0 THEN 1 ELSE 0 END AS points
  FROM standings""")
cte("logd", """SELECT 'results' AS source, concat_ws(':', series, season, round) AS scope,
  CASE (season * 12 + round + series) % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'empty' ELSE 'ok' END AS status,
  CASE WHEN (season * 12 + round + series) % 9 = 0 THEN repeat('timeout while reading the source; ', 4)
   WHEN (season * 12 + round + series) % 9 = 2 THEN 'provisional' ELSE '' END AS detail FROM calendar""")


def log_table(t: Tables):
    m = (F.col("season") * 12 + F.col("round") + F.col("series")) % 9
    return t.calendar.select(
        *EVENT,
        F.lit("results").alias("source"),
        F.concat_ws(":", *[F.col(c).cast("string") for c in EVENT]).alias("scope"),
        F.when(m == 0, "failed").when(m == 1, "empty").otherwise("ok").alias("status"),
        F.when(m == 0, F.repeat(F.lit("timeout while reading the source; "), 4)).when(m == 2, "provisional").otherwise("").alias("detail"),
    )


def damaged(t: Tables) -> op.Landed:
    k = F.col("season") * 12 + F.col("round") + F.col("entity")
    e = F.col("season") * 12 + F.col("round") + F.col("series")
    listed = e % 3 != 0
    results = (
        t.contest.where(e % 17 != 0).where(~((e % 23 == 0) & (F.col("entity") % 3 == 0)))
        .withColumns(
            {
                "classified": ~F.col("dnf"),
                "grid": F.when(k % 67 == 0, 3).otherwise(F.when(listed, F.col("grid_listed"))),
                "points": F.when(k % 79 == 0, -1).when(k % 71 == 0, 5).otherwise(F.col("points")),
                "position": F.when(k % 101 == 0, F.col("position") + 30).when(k % 89 == 0, 1)
                .when(k % 83 != 0, F.col("position")),
            }
        )
    )
    races = t.calendar.where(~((F.col("round") == 5) & ((F.col("season") + F.col("series")) % 4 == 0))).withColumn(
        "race_date",
        F.when((F.col("round") == 6) & (F.col("season") % 3 == 0), F.make_date("season", F.lit(4), F.lit(1))).otherwise(
            F.col("race_date")
        ),
    )
    drivers = t.contest.select("series", "season", "entity").distinct()
    drivers = drivers.where(~((F.col("entity") % 29 == 3) & (F.col("season") % 2 == 1)))
    standings = t.standings.withColumn("points", F.col("points") - F.when(e % 31 == 0, 1).otherwise(0))
    log = log_table(t)
    return op.Landed(
        races, results, drivers, t.qualifying, t.sprint, standings, t.session_pace, t.official_grid, log
    )


EV = "series, season, round"
SQL = {
    "tables_populated": f"SELECT NULL AS series, NULL AS season, NULL AS round, 'results' AS detail WHERE (SELECT count(*) FROM resultsd) = 0",
    "rounds_contiguous": """SELECT series, season, NULL AS round, concat_ws(':', min(round), max(round), count(DISTINCT round)) AS detail
      FROM racesd GROUP BY series, season HAVING min(round) <> 1 OR max(round) <> count(DISTINCT round)""",
    "every_race_has_results": f"""SELECT {EV}, 'no results' AS detail FROM racesd ANTI JOIN resultsd USING ({EV}) WHERE race_date <= DATE '{TODAY}'""",
    "field_size_plausible": f"SELECT {EV}, count(*) AS detail FROM resultsd GROUP BY ALL HAVING count(*) < 16 OR count(*) > 26".replace(
        f"GROUP BY ALL", f"GROUP BY {EV}"),
    "results_reference_a_race": f"SELECT DISTINCT {EV}, 'no race' AS detail FROM resultsd ANTI JOIN racesd USING ({EV})",
    "drivers_are_known": "SELECT DISTINCT series, season, NULL AS round, entity AS detail FROM resultsd ANTI JOIN driversd USING (series, season, entity)",
    "positions_in_range": f"""SELECT {EV}, concat_ws(':', entity, coalesce(CAST(position AS VARCHAR), 'null'), coalesce(CAST(grid AS VARCHAR), 'null')) AS detail FROM resultsd
      WHERE position < 1 OR position > 30 OR grid < 0 OR grid > 30
      UNION ALL SELECT {EV}, concat_ws(':', entity, 'negative points', points) FROM resultsd WHERE points < 0""",
    "one_winner_per_race": f"SELECT {EV}, count(*) FILTER (position = 1) AS detail FROM resultsd GROUP BY {EV} HAVING count(*) FILTER (position = 1) <> 1",
    "finishing_positions_unique": f"SELECT {EV}, concat_ws(':', position, count(*)) AS detail FROM resultsd WHERE position IS NOT NULL GROUP BY {EV}, position HAVING count(*) > 1",
    "quali_positions_contiguous": f"SELECT {EV}, concat_ws(':', count(*), max(quali_position)) AS detail FROM qualifying GROUP BY {EV} HAVING count(*) <> max(quali_position)",
    "classified_implies_finished_ahead": f"""SELECT a.series, a.season, a.round, concat_ws(':', a.entity, a.laps, min(b.laps)) AS detail FROM resultsd a JOIN resultsd b
      ON a.series = b.series AND a.season = b.season AND a.round = b.round AND b.position < a.position AND b.laps < a.laps
      WHERE a.classified AND NOT b.classified GROUP BY a.series, a.season, a.round, a.entity, a.laps""",
    "dnf_rate_plausible": f"SELECT {EV}, concat_ws(':', count(*) FILTER (dnf), count(*)) AS detail FROM resultsd GROUP BY {EV} HAVING count(*) FILTER (dnf) * 100.0 > 30 * count(*)",
    "points_awarded_to_finishers": f"""SELECT {EV}, concat_ws(':', entity, coalesce(CAST(position AS VARCHAR), 'null'), points) AS detail FROM resultsd
      WHERE points > 0 AND (position IS NULL OR position > 11)""",
    "races_chronological": f"""SELECT {EV}, concat_ws(':', race_date, prev) AS detail FROM
      (SELECT *, lag(race_date) OVER (PARTITION BY series, season ORDER BY round) AS prev FROM racesd) WHERE race_date < prev""",
    "practice_predates_race": f"SELECT {EV}, concat_ws(':', entity, session) AS detail FROM session_pace JOIN racesd USING ({EV}) WHERE session_start > race_start",
    "practice_predates_qualifying": f"SELECT {EV}, concat_ws(':', entity, session) AS detail FROM session_pace JOIN racesd USING ({EV}) WHERE session_start > quali_start",
    "grid_slots_unique": f"SELECT {EV}, concat_ws(':', grid, count(*)) AS detail FROM resultsd WHERE grid > 0 GROUP BY {EV}, grid HAVING count(*) > 1",
    "grid_present_for_completed_races": f"""SELECT {EV}, concat_ws(':', n, listed, CASE WHEN (SELECT count(*) FROM official_grid g WHERE g.series = r.series
      AND g.season = r.season AND g.round = r.round) > 0 THEN 'covered' ELSE 'uncovered' END) AS detail
      FROM (SELECT {EV}, count(*) AS n, count(grid) AS listed FROM resultsd GROUP BY {EV}) r WHERE listed < 0.9 * n""",
    "official_grid_matches_the_field": f"""SELECT {EV}, g.entity AS detail FROM official_grid g WHERE EXISTS (SELECT 1 FROM resultsd r WHERE r.series = g.series
      AND r.season = g.season AND r.round = g.round) AND NOT EXISTS (SELECT 1 FROM resultsd r WHERE r.series = g.series
      AND r.season = g.season AND r.round = g.round AND r.entity = g.entity)""",
    "no_failed_ingests": "SELECT NULL AS series, NULL AS season, NULL AS round, concat_ws(':', source, scope, substr(detail, 1, 60)) AS detail FROM logd WHERE status = 'failed'",
    "standings_match_results": f"""SELECT {EV}, concat_ws(':', CAST(st.p AS BIGINT), CAST(cum.p AS BIGINT)) AS detail FROM
      (SELECT {EV}, sum(points) AS p FROM standingsd GROUP BY ALL) st JOIN
      (SELECT {EV}, sum(p) OVER (PARTITION BY series, season ORDER BY round) AS p FROM (SELECT {EV}, sum(points) AS p FROM
       (SELECT {EV}, points FROM resultsd UNION ALL SELECT {EV}, points FROM sprint) GROUP BY ALL)) cum USING ({EV}) WHERE abs(st.p - cum.p) > 0.5""",
}

for _i, (_name, (_sev, _check)) in enumerate(op.CHECKS.items(), start=1):
    if _name == "retirement_flag_matches_laps":
        continue

    def _run(t: Tables, name=_name, check=_check):
        d = damaged(t)
        if name == "every_race_has_results":
            return check(d, F.lit(TODAY).cast("date"))
        if name == "field_size_plausible":
            return check(d, 16, 26)
        if name == "dnf_rate_plausible":
            return check(d, 30.0)
        if name == "no_failed_ingests":
            d.log = d.log.drop(*EVENT)
        return check(d)

    query(f"l{_i}_{_name}", SPEC, SQL[_name])(_run)

RETIRED = """SELECT status || ':' || count(*) AS detail, CASE WHEN count(*) >= 20 THEN 'ERROR' ELSE 'WARN' END AS severity, count(*) AS n FROM
  (SELECT *, max(laps) OVER (PARTITION BY series, season, round) AS distance FROM resultsd) WHERE dnf AND laps >= distance - 2 GROUP BY status"""


@query("l22_retirement_flag_matches_laps", "detail:s severity:s n:i", RETIRED)
def _(t):
    return op.retirement_flag_matches_laps(damaged(t))


@query(
    "l_findings",
    "check:s severity:s n:i first:s last:s",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "check", '{op.CHECKS[n][0]}' AS severity, count(*) AS n, min(CAST(detail AS VARCHAR)) AS first,
        max(CAST(detail AS VARCHAR)) AS last FROM ({q.replace('< 16 OR', '< 10 OR').replace('100.0 > 30 *', '100.0 > 70 *')}) HAVING count(*) > 0"""
        for n, q in SQL.items()
    )
    + f""" UNION ALL SELECT 'retirement_flag_matches_laps', max(CASE severity WHEN 'ERROR' THEN 'ERROR' ELSE 'WARN' END),
      count(*), min(detail), max(detail) FROM ({RETIRED}) HAVING count(*) > 0""",
)
def _(t):
    d = damaged(t)
    d.log = d.log.drop(*EVENT)
    return op.findings(d, F.lit(TODAY).cast("date"))


# Both find nothing in the tables above, so each has its own damage.
@query("l1_planted_empty", SPEC, """SELECT NULL AS series, NULL AS season, NULL AS round, 'qualifying' AS detail WHERE (SELECT count(*) FROM contest WHERE quali_position > 30) = 0
  UNION ALL SELECT NULL, NULL, NULL, 'drivers' WHERE (SELECT count(*) FROM driversd WHERE season < 1990) = 0
  UNION ALL SELECT NULL, NULL, NULL, 'results' WHERE (SELECT count(*) FROM resultsd) = 0""")
def _(t):
    """Two of the tables lose all their rows."""
    d = damaged(t)
    return op.tables_populated(replace(d, qualifying=d.qualifying.where("quali_position > 30"), drivers=d.drivers.where("season < 1990")))


@query("l15_planted_late_practice", SPEC, """SELECT series, season, round, concat_ws(':', entity, session) AS detail FROM session_pace p JOIN (SELECT series, season, round, race_start FROM racesd) r USING (series, season, round)
  WHERE session_start + CASE WHEN (season * 12 + round + entity) % 43 = 0 THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END > race_start""")
def _(t):
    """Some sessions dated twenty days late."""
    d = damaged(t)
    late = (F.col("season") * 12 + F.col("round") + F.col("entity")) % 43 == 0
    moved = F.when(late, F.col("session_start") + F.expr("INTERVAL 20 DAY")).otherwise(F.col("session_start"))
    return op.practice_predates_race(replace(d, pace=d.pace.withColumn("session_start", moved)))
