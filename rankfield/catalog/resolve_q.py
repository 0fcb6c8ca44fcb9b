"""Identities, teams and sessions of a second source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import fold
from ..operators import resolve as op
from ..sources.contest import Tables
from .registry import query
from .sqlbase import cte

SCOPE = ["series"]


@query(
    "b1_fold",
    "p_partkey:i folded:s",
    "SELECT p_partkey, lower(trim(p_name)) AS folded FROM part",
)
def _(t: Tables):
    dressed = F.concat(F.lit("  "), F.translate(F.initcap("p_name"), "aeoiuAEOIU", "áèöíůÁÈÖÍŮ"))
    return t.raw("part").withColumn("folded", fold(dressed))


cte("driver_table", """SELECT DISTINCT series, season, entity AS driver_id, 'c' || (entity % 17) AS code,
  entity % 13 + CASE WHEN season > 1998 THEN 1 ELSE 0 END AS permanent_number, 'Núñez ' || (entity % 20 // 2) AS family_name FROM contest
  WHERE NOT (entity % 7 = 2 AND season < 1998)""")
cte("second_entries", """SELECT DISTINCT series, season, entity AS entry_id,
  CASE WHEN entity % 4 > 0 THEN 'C' || (entity % 17) ELSE '' END AS name_acronym,
  CASE WHEN entity % 3 > 0 THEN entity % 13 + CASE WHEN season > 1998 THEN 1 ELSE 0 END END AS driver_number,
  ' NUNEZ ' || (entity % 20 // 2) AS last_name FROM contest""")


def driver_table(t: Tables):
    d = t.contest.select("series", "season", F.col("entity").alias("driver_id")).distinct()
    e = F.col("driver_id")
    d = d.select(
        "series",
        "season",
        "driver_id",
        F.concat(F.lit("c"), (e % 17).cast("string")).alias("code"),
        (e % 13 + F.when(F.col("season") > 1998, 1).otherwise(0)).alias("permanent_number"),
        F.concat(F.lit("Núñez "), F.expr("(driver_id % 20) div 2").cast("string")).alias("family_name"),
    )
    return d.where(~((e % 7 == 2) & (F.col("season") < 1998)))


def second_entries(t: Tables):
    d = t.contest.select("series", "season", F.col("entity").alias("entry_id")).distinct()
    e = F.col("entry_id")
    number = e % 13 + F.when(F.col("season") > 1998, 1).otherwise(0)
    return d.select(
        "series",
        "season",
        "entry_id",
        F.when(e % 4 > 0, F.concat(F.lit("C"), (e % 17).cast("string"))).otherwise("").alias("name_acronym"),
        F.when(e % 3 > 0, number).alias("driver_number"),
        F.concat(F.lit(" NUNEZ "), F.expr("(entry_id % 20) div 2").cast("string")).alias("last_name"),
    )


@query(
    "b2_driver_lookup",
    "series:i driver_id:i code:s permanent_number:i family_name:s season:i",
    """SELECT series, driver_id, code, permanent_number, family_name, max(season) AS season FROM driver_table
      WHERE season <= 2000 GROUP BY ALL""",
)
def _(t):
    return op.driver_lookup(driver_table(t), SCOPE, F.lit(2000))


def _rung(i: int, cond: str, pool: str) -> str:
    return f"""SELECT e.series, e.season, e.entry_id, {i} AS rung, min(d.driver_id) AS driver_id FROM second_entries e JOIN driver_table d
      ON d.series = e.series AND {pool} AND {cond} GROUP BY e.series, e.season, e.entry_id HAVING count(DISTINCT d.driver_id) = 1"""


_CONDS = (
    "e.name_acronym <> '' AND upper(d.code) = upper(e.name_acronym)",
    "e.driver_number <> 0 AND d.permanent_number = e.driver_number",
    "lower(trim(strip_accents(d.family_name))) = lower(trim(strip_accents(e.last_name)))",
)


@query(
    "b3_map_driver",
    "series:i season:i entry_id:i driver_id:i rung:i",
    "WITH r AS ("
    + " UNION ALL ".join(
        [_rung(i, c, "d.season = e.season") for i, c in enumerate(_CONDS)]
        + [_rung(i + 3, c, "d.season <= e.season") for i, c in enumerate(_CONDS)]
    )
    + """) SELECT e.series, e.season, e.entry_id, arg_min(r.driver_id, r.rung) AS driver_id, min(r.rung) AS rung FROM second_entries e
      LEFT JOIN r USING (series, season, entry_id) GROUP BY e.series, e.season, e.entry_id""",
)
def _(t):
    return op.map_drivers(second_entries(t), driver_table(t), SCOPE)


cte("team_now", """SELECT series, season, entity, arg_max(team, round) AS team FROM
  (SELECT series, season, round, entity, team FROM contest UNION ALL SELECT series, season, round, entity, team FROM qualifying)
  GROUP BY ALL""")


@query("b4_team_lookup", "series:i season:i entity:i team:i", "SELECT * FROM team_now")
def _(t):
    return op.team_lookup(t.contest, t.qualifying, SCOPE)


@query(
    "b5_map_teams",
    "series:i season:i team_name:s team:i votes:i",
    """SELECT series, season, team_name, team, votes FROM (SELECT *, row_number() OVER (PARTITION BY series, season, team_name
      ORDER BY votes DESC, team) AS n FROM (SELECT series, season, 'Team ' || (entity % 20 // 3) AS team_name, team, count(*) AS votes
      FROM team_now GROUP BY ALL)) WHERE n = 1""",
)
def _(t):
    name = F.concat(F.lit("Team "), F.expr("(entity % 20) div 3").cast("string"))
    people = t.contest.select("series", "season", "entity").distinct().withColumn("team_name", name)
    return op.map_teams(people, op.team_lookup(t.contest, t.qualifying, SCOPE), SCOPE)


cte("second_sessions", """SELECT c.series, season * 100 + round AS meeting, s.name AS session_name, s.i AS ord, season, round,
  CASE WHEN (season + round) % 10 = 9 AND s.i = 1 THEN NULL ELSE race_start + CAST(CASE s.i WHEN 1 THEN -48 WHEN 2 THEN -26 WHEN 3 THEN -30 WHEN 5 THEN -4 ELSE 0 END
   + (season * 12 + round + series) % 9 - 1 AS INT) * INTERVAL 1 HOUR END AS start,
  (round % 5 = 0 AND s.i = 2) AS is_cancelled
  FROM calendar c, (VALUES (1, 'Practice 1'), (2, 'Qualifying'), (3, 'Parade'), (4, 'Race'), (5, 'Race')) s(i, name)""")


def second_sessions(t: Tables):
    names = ((1, "Practice 1", -48), (2, "Qualifying", -26), (3, "Parade", -30), (4, "Race", 0), (5, "Race", -4))
    items = F.array(
        *[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("session_name"), F.lit(h).alias("_h")) for i, n, h in names]
    )
    d = t.calendar.select("series", "season", "round", "race_start", F.inline(items))
    shift = F.col("_h") + (F.col("season") * 12 + F.col("round") + F.col("series")) % 9 - 1
    start = F.col("race_start") + F.make_interval(hours=shift.cast("int"))
    gone = ((F.col("season") + F.col("round")) % 10 == 9) & (F.col("ord") == 1)
    return d.select(
        "series",
        (F.col("season") * 100 + F.col("round")).alias("meeting"),
        "session_name",
        "ord",
        F.when(~gone, start).alias("start"),
        ((F.col("round") % 5 == 0) & (F.col("ord") == 2)).alias("is_cancelled"),
    )


cte("coded_sessions", """SELECT *, CASE session_name WHEN 'Practice 1' THEN 'FP1' WHEN 'Qualifying' THEN 'Q' WHEN 'Race' THEN 'R' END AS code
  FROM second_sessions WHERE session_name <> 'Parade' AND start IS NOT NULL AND NOT is_cancelled""")


@query("b7_normalise_sessions", "series:i meeting:i code:s ord:i start:t", "SELECT * FROM coded_sessions")
def _(t):
    return op.normalise_sessions(second_sessions(t))


@query(
    "b6_weekend_sessions",
    "series:i season:i round:i meeting:i code:s start:t",
    """SELECT s.series, e.season, e.round, s.meeting, s.code, s.start FROM (SELECT c.series, c.season, c.round, c.race_start, arg_min(r.meeting, r.ord) AS meeting
      FROM calendar c JOIN coded_sessions r ON r.series = c.series AND r.code = 'R' AND r.start BETWEEN c.race_start - INTERVAL 6 HOUR AND c.race_start + INTERVAL 6 HOUR
      GROUP BY ALL) e JOIN coded_sessions s ON s.series = e.series AND s.meeting = e.meeting
      WHERE s.start BETWEEN e.race_start - INTERVAL 4 DAY AND e.race_start + INTERVAL 6 HOUR""",
)
def _(t):
    return op.weekend_sessions(t.calendar.drop("venue"), op.normalise_sessions(second_sessions(t)), SCOPE, "ord")


@query(
    "b8_display_names",
    "series:i driver_id:i name:s",
    "SELECT series, driver_id, max(family_name || CASE WHEN season > 1999 THEN ' II' ELSE '' END) AS name FROM driver_table GROUP BY ALL",
)
def _(t):
    d = driver_table(t).withColumn(
        "family_name", F.concat("family_name", F.when(F.col("season") > 1999, " II").otherwise(""))
    )
    return op.display_names(d, SCOPE)
