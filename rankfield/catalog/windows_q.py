"""The time-safe windows one by one."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import windows as op
from ..sources.contest import HISTORY, KEY, Tables
from . import registry
from .sqlbase import cte, prior_rows, prior_values

ROW = "series:i season:i round:i entity:i "
# One pass over the results each: nothing to store.
query = partial(registry.query, land=False)
ENTITY = "series, entity"
TEAM = "series, team"


@query("e0_event_sequence", ROW + "race_seq:i", "SELECT * FROM contest")
def _(t: Tables):
    return t.contest


@query(
    "e0_integrity",
    "series:i season:i round:i problem:s",
    """SELECT series, season, round, 'duplicate key' AS problem FROM
      (SELECT series, season, round, entity FROM contest GROUP BY ALL HAVING count(*) > 1)
      UNION ALL SELECT series, season, round, 'sequence not increasing' FROM
      (SELECT *, lag(hi) OVER (PARTITION BY series ORDER BY season, round) p FROM
       (SELECT series, season, round, min(race_seq) lo, max(race_seq) hi FROM contest GROUP BY ALL)) WHERE lo <> hi OR lo <= p""",
)
def _(t):
    return op.integrity_problems(t.contest, ["series"], ["season", "round"], "entity", "race_seq")


cte("e0_broken", """SELECT * REPLACE (race_seq - CASE WHEN (season * 12 + round + series) % 13 = 0 THEN 2 ELSE 0 END AS race_seq) FROM contest
  UNION ALL SELECT * FROM contest WHERE (season * 12 + round + entity) % 97 = 0""")


@query(
    "e0_planted_problems",
    "series:i season:i round:i problem:s",
    """SELECT series, season, round, 'duplicate key' AS problem FROM
      (SELECT series, season, round, entity FROM e0_broken GROUP BY ALL HAVING count(*) > 1)
      UNION ALL SELECT series, season, round, 'sequence not increasing' FROM
      (SELECT *, lag(hi) OVER (PARTITION BY series ORDER BY season, round) p FROM
       (SELECT series, season, round, min(race_seq) lo, max(race_seq) hi FROM e0_broken GROUP BY ALL)) WHERE lo <> hi OR lo <= p""",
)
def _(t):
    """Rows landed twice, and events numbered behind earlier ones."""
    off = F.when((F.col("season") * 12 + F.col("round") + F.col("series")) % 13 == 0, 2).otherwise(0)
    twice = t.contest.where((F.col("season") * 12 + F.col("round") + F.col("entity")) % 97 == 0)
    broken = t.contest.withColumn("race_seq", F.col("race_seq") - off).unionByName(twice)
    return op.integrity_problems(broken, ["series"], ["season", "round"], "entity", "race_seq")


@query(
    "e1_prior_rolling",
    ROW + "drv_avg_grid_5:d drv_points_rate_5:d drv_dnf_rate_10:d",
    f"""SELECT *, {prior_rows('grid', ENTITY, 5)} AS drv_avg_grid_5, {prior_rows('points', ENTITY, 5)} AS drv_points_rate_5,
      {prior_rows('dnf_flag', ENTITY, 10)} AS drv_dnf_rate_10 FROM outcomes""",
)
def _(t):
    return op.prior_rolling(
        t.outcomes,
        HISTORY,
        "race_seq",
        {
            "drv_avg_grid_5": ("grid", 5, "mean"),
            "drv_points_rate_5": ("points", 5, "mean"),
            "drv_dnf_rate_10": ("dnf_flag", 10, "mean"),
        },
    )


@query(
    "e2_roll_over_valid",
    ROW + "median_3:d median_5:d mean_5:d mean_all:d",
    f"""SELECT *, {prior_values('finish_when_running', ENTITY, 3, 'median')} AS median_3,
      {prior_values('finish_when_running', ENTITY, 5, 'median')} AS median_5,
      {prior_values('finish_when_running', ENTITY, 5)} AS mean_5,
      {prior_values('finish_when_running', ENTITY, None)} AS mean_all FROM outcomes""",
)
def _(t):
    c = "finish_when_running"
    return op.prior_valid(
        t.outcomes,
        HISTORY,
        "race_seq",
        {
            "median_3": (c, 3, "median"),
            "median_5": (c, 5, "median"),
            "mean_5": (c, 5, "mean"),
            "mean_all": (c, None, "mean"),
        },
    )


cte(
    "team_event",
    """SELECT series, team, race_seq, avg(dnf_flag) AS dnf_rate, sum(points) AS pts, min(quali_position) AS best_quali,
      avg(finish_when_running) AS pace, count(*) AS members FROM outcomes GROUP BY ALL""",
)


@query(
    "e3_prior_rolling_by_event",
    ROW + "team_dnf_rate_10:d team_points_rate_5:d team_avg_quali_5:d",
    f"""SELECT o.series, season, round, entity, team_dnf_rate_10, team_points_rate_5, team_avg_quali_5 FROM outcomes o JOIN
      (SELECT *, {prior_rows('dnf_rate', TEAM, 10)} AS team_dnf_rate_10, {prior_rows('pts', TEAM, 5)} AS team_points_rate_5,
       {prior_rows('best_quali', TEAM, 5)} AS team_avg_quali_5 FROM team_event) USING (series, team, race_seq)""",
)
def _(t):
    return op.prior_by_event(
        t.outcomes,
        ["series", "team"],
        "race_seq",
        "entity",
        {
            "team_dnf_rate_10": ("dnf_flag", "mean", 10, "mean"),
            "team_points_rate_5": ("points", "sum", 5, "mean"),
            "team_avg_quali_5": ("quali_position", "min", 5, "mean"),
        },
    )


@query(
    "e4_prior_pace_by_event",
    ROW + "team_avg_finish_3:d team_avg_finish_5:d",
    f"""SELECT o.series, season, round, entity, team_avg_finish_3, team_avg_finish_5 FROM outcomes o JOIN
      (SELECT *, {prior_values('pace', TEAM, 3, 'median')} AS team_avg_finish_3,
       {prior_values('pace', TEAM, 5, 'median')} AS team_avg_finish_5 FROM team_event) USING (series, team, race_seq)""",
)
def _(t):
    return op.prior_by_event(
        t.outcomes,
        ["series", "team"],
        "race_seq",
        "entity",
        {
            "team_avg_finish_3": ("finish_when_running", "mean", 3, "median"),
            "team_avg_finish_5": ("finish_when_running", "mean", 5, "median"),
        },
        skip_nulls=True,
    )


cte(
    "team_venue_event",
    """SELECT series, team, venue, race_seq, avg(finish_when_running) AS pace FROM outcomes GROUP BY ALL""",
)


@query(
    "e5_prior_pace_at_venue",
    ROW + "team_circuit_avg_finish:d team_circuit_last_2:d",
    f"""SELECT o.series, season, round, entity, team_circuit_avg_finish, team_circuit_last_2 FROM outcomes o JOIN
      (SELECT *, {prior_values('pace', 'series, team, venue', None)} AS team_circuit_avg_finish,
       {prior_values('pace', 'series, team, venue', 2)} AS team_circuit_last_2
       FROM team_venue_event) USING (series, team, venue, race_seq)""",
)
def _(t):
    return op.prior_by_event(
        t.outcomes,
        ["series", "team", "venue"],
        "race_seq",
        "entity",
        {
            "team_circuit_avg_finish": ("finish_when_running", "mean", None, "mean"),
            "team_circuit_last_2": ("finish_when_running", "mean", 2, "mean"),
        },
        skip_nulls=True,
    )


cte(
    "venue_event",
    """SELECT series, venue, race_seq, avg(abs(grid - finish_or_last)) AS moved, avg(dnf_flag) AS dnf,
      max(CAST(grid = 1 AND position = 1 AS INT)) AS pole_win FROM outcomes GROUP BY ALL""",
)
cte(
    "f_venue",
    f"""SELECT series, venue, race_seq, {prior_values('moved', 'series, venue', None)} AS circuit_overtaking_score,
      {prior_values('dnf', 'series, venue', None)} AS circuit_dnf_rate,
      {prior_values('pole_win', 'series, venue', None)} AS circuit_pole_win_rate FROM venue_event""",
)


@query(
    "e6_venue_profile",
    ROW + "circuit_overtaking_score:d circuit_dnf_rate:d",
    "SELECT * FROM outcomes JOIN f_venue USING (series, venue, race_seq)",
)
def _(t):
    d = t.outcomes.withColumn("moved", F.abs(F.col("grid") - F.col("finish_or_last")))
    return op.prior_by_event(
        d,
        ["series", "venue"],
        "race_seq",
        "entity",
        {
            "circuit_overtaking_score": ("moved", "mean", None, "mean"),
            "circuit_dnf_rate": ("dnf_flag", "mean", None, "mean"),
        },
    )


@query(
    "e7_pole_to_win",
    ROW + "circuit_pole_win_rate:d",
    "SELECT * FROM outcomes JOIN f_venue USING (series, venue, race_seq)",
)
def _(t):
    d = t.outcomes.withColumn("pole_win", ((F.col("grid") == 1) & (F.col("position") == 1)).cast("int"))
    return op.prior_by_event(
        d, ["series", "venue"], "race_seq", "entity", {"circuit_pole_win_rate": ("pole_win", "max", None, "mean")}
    )


@query(
    "e8_prior_count",
    ROW + "drv_experience:i drv_circuit_starts:i",
    """SELECT *, (SELECT count(*) FROM contest p WHERE p.series = c.series AND p.entity = c.entity AND p.race_seq < c.race_seq) AS drv_experience,
      (SELECT count(*) FROM contest p WHERE p.series = c.series AND p.entity = c.entity AND p.venue = c.venue AND p.race_seq < c.race_seq) AS drv_circuit_starts
      FROM contest c""",
)
def _(t):
    return t.contest.withColumns(
        {
            "drv_experience": op.prior_count(HISTORY, "race_seq"),
            "drv_circuit_starts": op.prior_count([*HISTORY, "venue"], "race_seq"),
        }
    )


@query(
    "e10_outcome_flags",
    ROW + "finish_or_last:i scored:i dnf_flag:i finish_when_running:i podium_flag:i top10_flag:i",
    "SELECT * FROM outcomes",
)
def _(t):
    return t.outcomes


cte(
    "gaps",
    """SELECT *, (best_ms / min(best_ms) OVER (PARTITION BY series, race_seq) - 1.0) * 100 AS quali_gap_to_pole_pct,
      CASE WHEN count(best_ms) OVER (PARTITION BY series, race_seq, team) >= 2
        THEN (best_ms / min(best_ms) OVER (PARTITION BY series, race_seq, team) - 1.0) * 100 END AS quali_gap_to_teammate_pct
      FROM outcomes""",
)


@query("e11_gap_to_best", ROW + "quali_gap_to_pole_pct:d", "SELECT * FROM gaps")
def _(t):
    return t.contest.withColumn("quali_gap_to_pole_pct", op.gap_to_best("best_ms", ["series", "race_seq"]))


@query("e12_teammate_gap", ROW + "quali_gap_to_teammate_pct:d", "SELECT * FROM gaps")
def _(t):
    gap = op.teammate_gap("best_ms", ["series", "race_seq", "team"])
    return t.contest.withColumn("quali_gap_to_teammate_pct", gap)


@query(
    "e25_relevance_labels",
    ROW + "race_relevance:i quali_relevance:i",
    """SELECT *, CASE WHEN position IS NOT NULL THEN greatest(24 - position, 0) END AS race_relevance,
      CASE WHEN quali_position IS NOT NULL THEN greatest(24 - quali_position, 0) END AS quali_relevance FROM contest""",
)
def _(t):
    from ..plans.features import relevance

    return t.contest.withColumns(
        {"race_relevance": relevance("position"), "quali_relevance": relevance("quali_position")}
    )
