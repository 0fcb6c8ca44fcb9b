"""Feature sets and the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import features as ft
from ..sources.contest import KEY, Tables
from .registry import query
from .sqlbase import cte, prior_rows, prior_values

ROW = "series:i season:i round:i entity:i "
ENTITY = "series, entity"
TEAM = "series, team"

cte(
    "practice",
    """SELECT series, season, round, entity, min(long_run_ms) AS fp_long_run_ms, min(best_lap_ms) AS fp_best_ms,
      min(CASE WHEN session = 'FP1' THEN best_lap_ms END) AS fp1_best_ms,
      min(CASE WHEN session = 'FP2' THEN best_lap_ms END) AS fp2_best_ms,
      min(CASE WHEN session = 'FP3' THEN best_lap_ms END) AS fp3_best_ms
      FROM session_pace LEFT JOIN calendar USING (series, season, round)
      WHERE session IN ('FP1', 'FP2', 'FP3') AND (session_start IS NULL OR quali_start IS NULL OR session_start < quali_start)
      GROUP BY ALL""",
)
cte(
    "sprint_known",
    """SELECT s.series, s.season, s.round, s.entity, sq_position FROM sprint_quali s JOIN calendar c USING (series, season, round)
      WHERE s.season >= 1998 AND (quali_start IS NULL OR session_start < quali_start)""",
)
cte("practice_all", "SELECT * FROM practice FULL JOIN sprint_known USING (series, season, round, entity)")
cte(
    "previous",
    """SELECT series, season, round + 1 AS round, entity, position AS champ_position_before, points AS champ_points_before
      FROM standings""",
)
cte("season_length", "SELECT series, season, max(round) AS last_round FROM calendar GROUP BY ALL")


def feature_ctes(base: str, p: str) -> None:
    """CTEs p_* computing every feature over a base frame."""
    cte(
        f"{p}_gap",
        f"""SELECT *, (best_ms / min(best_ms) OVER (PARTITION BY series, race_seq) - 1.0) * 100 AS quali_gap_to_pole_pct,
        CASE WHEN count(best_ms) OVER (PARTITION BY series, race_seq, team) >= 2
          THEN (best_ms / min(best_ms) OVER (PARTITION BY series, race_seq, team) - 1.0) * 100 END AS quali_gap_to_teammate_pct,
        CASE WHEN finish_when_running IS NOT NULL THEN grid - finish_when_running END AS positions_gained,
        CAST(quali_position = 1 AS INT) AS pole_flag, CAST(quali_position <= 3 AS INT) AS top3_flag
        FROM {base}""",
    )
    cte(
        f"{p}_entity",
        f"""SELECT *, {prior_values('finish_when_running', ENTITY, 3, 'median')} AS drv_avg_finish_3,
        {prior_values('finish_when_running', ENTITY, 5, 'median')} AS drv_avg_finish_5,
        {prior_rows('grid', ENTITY, 5)} AS drv_avg_grid_5, {prior_rows('points', ENTITY, 5)} AS drv_points_rate_5,
        {prior_rows('dnf_flag', ENTITY, 10)} AS drv_dnf_rate_10,
        row_number() OVER (PARTITION BY series, entity ORDER BY race_seq) - 1 AS drv_experience,
        {prior_values('finish_when_running', 'series, entity, venue', None)} AS drv_circuit_avg_finish,
        row_number() OVER (PARTITION BY series, entity, venue ORDER BY race_seq) - 1 AS drv_circuit_starts,
        {prior_rows('quali_position', ENTITY, 3)} AS drv_avg_quali_3, {prior_rows('quali_position', ENTITY, 5)} AS drv_avg_quali_5,
        {prior_rows('pole_flag', ENTITY, 10)} AS drv_pole_rate_10, {prior_rows('top3_flag', ENTITY, 10)} AS drv_quali_top3_rate_10,
        {prior_values('least(greatest(quali_gap_to_teammate_pct, -3.0), 3.0)', ENTITY, 5).replace('FILTER (least(greatest(quali_gap_to_teammate_pct, -3.0), 3.0) IS NOT NULL)', 'FILTER (quali_gap_to_teammate_pct IS NOT NULL)')} AS drv_teammate_quali_edge,
        {prior_rows('quali_gap_to_pole_pct', ENTITY, 5)} AS drv_pace_gap_pct,
        {prior_values('positions_gained', ENTITY, 5)} AS drv_positions_gained_5,
        {prior_rows('podium_flag', ENTITY, 10)} AS drv_podium_rate_10, {prior_rows('top10_flag', ENTITY, 10)} AS drv_top10_rate_10
        FROM {p}_gap""",
    )
    cte(
        f"{p}_te",
        f"""SELECT series, team, race_seq, avg(finish_when_running) AS pace, sum(points) AS pts, avg(dnf_flag) AS dnf,
        min(quali_position) AS bq, min(quali_gap_to_pole_pct) AS bg FROM {p}_gap GROUP BY ALL""",
    )
    cte(
        f"{p}_team",
        f"""SELECT series, team, race_seq, {prior_values('pace', TEAM, 3, 'median')} AS team_avg_finish_3,
        {prior_values('pace', TEAM, 5, 'median')} AS team_avg_finish_5, {prior_rows('pts', TEAM, 5)} AS team_points_rate_5,
        {prior_rows('dnf', TEAM, 10)} AS team_dnf_rate_10, {prior_rows('bq', TEAM, 5)} AS team_avg_quali_5,
        {prior_rows('bg', TEAM, 5)} AS team_pace_gap_pct,
        {prior_rows('bg', TEAM, 3)} - {prior_rows('bg', TEAM, 8)} AS team_pace_trend FROM {p}_te""",
    )
    cte(
        f"{p}_tv",
        f"""SELECT series, team, venue, race_seq, {prior_values('pace', 'series, team, venue', None)} AS team_circuit_avg_finish
        FROM (SELECT series, team, venue, race_seq, avg(finish_when_running) AS pace FROM {p}_gap GROUP BY ALL)""",
    )
    cte(
        f"{p}_venue",
        f"""SELECT series, venue, race_seq, {prior_values('moved', 'series, venue', None)} AS circuit_overtaking_score,
        {prior_values('dnf', 'series, venue', None)} AS circuit_dnf_rate,
        {prior_values('pole_win', 'series, venue', None)} AS circuit_pole_win_rate FROM
        (SELECT series, venue, race_seq, avg(CASE WHEN position IS NOT NULL THEN abs(grid - finish_or_last) END) AS moved,
          avg(dnf_flag) AS dnf, max(CASE WHEN position IS NOT NULL THEN CAST(coalesce(grid = 1 AND position = 1, false) AS INT) END) AS pole_win
          FROM {p}_gap GROUP BY ALL)""",
    )


cte(
    "joined",
    """SELECT o.*, fp_long_run_ms, fp_best_ms, fp1_best_ms, fp2_best_ms, fp3_best_ms, sq_position, champ_position_before,
      CASE WHEN o.round = 1 THEN coalesce(champ_points_before, 0) ELSE champ_points_before END AS champ_points_before,
      o.round / coalesce(last_round, o.round) AS season_progress
      FROM outcomes o LEFT JOIN practice_all USING (series, season, round, entity)
      LEFT JOIN previous USING (series, season, round, entity) LEFT JOIN season_length USING (series, season)""",
)
feature_ctes("joined", "fa")


@query(
    "e9_previous_standing",
    ROW + "champ_position_before:i champ_points_before:i",
    "SELECT * FROM joined",
)
def _(t: Tables):
    return ft.previous_standing(t.contest, t.standings)


@query(
    "e13_quali_record",
    ROW + "drv_avg_quali_3:d drv_avg_quali_5:d drv_pole_rate_10:d drv_quali_top3_rate_10:d team_avg_quali_5:d",
    "SELECT * FROM fa_entity JOIN fa_team USING (series, team, race_seq)",
)
def _(t):
    return ft.add_quali(t.outcomes)


@query("e14_head_to_head", ROW + "drv_teammate_quali_edge:d", "SELECT * FROM fa_entity")
def _(t):
    return ft.add_edge(t.outcomes)


@query(
    "e15_pace_and_trend",
    ROW + "team_pace_gap_pct:d team_pace_trend:d drv_pace_gap_pct:d",
    "SELECT * FROM fa_entity JOIN fa_team USING (series, team, race_seq)",
)
def _(t):
    return ft.add_pace(t.outcomes)


@query(
    "e16_racecraft",
    ROW + "drv_positions_gained_5:d drv_podium_rate_10:d drv_top10_rate_10:d",
    "SELECT * FROM fa_entity",
)
def _(t):
    return ft.add_racecraft(t.outcomes)


@query(
    "e17_form_set",
    ROW + "drv_avg_finish_3:d drv_avg_finish_5:d drv_points_rate_5:d drv_dnf_rate_10:d drv_avg_grid_5:d drv_experience:i "
    "team_avg_finish_3:d team_avg_finish_5:d team_points_rate_5:d team_dnf_rate_10:d",
    "SELECT * FROM fa_entity JOIN fa_team USING (series, team, race_seq)",
)
def _(t):
    return ft.add_form(t.outcomes)


@query(
    "e18_venue_history",
    ROW + "drv_circuit_avg_finish:d team_circuit_avg_finish:d drv_circuit_starts:i",
    "SELECT * FROM fa_entity JOIN fa_tv USING (series, team, venue, race_seq)",
)
def _(t):
    return ft.add_venue_history(t.outcomes)


@query("e19_season_progress", ROW + "season_progress:d", "SELECT * FROM joined")
def _(t):
    return ft.add_progress(t.contest, t.calendar)


@query(
    "e20_practice_pivot",
    ROW + "fp_long_run_ms:i fp_best_ms:i fp1_best_ms:i fp2_best_ms:i fp3_best_ms:i",
    "SELECT * FROM practice",
)
def _(t):
    return ft.practice_pivot(t.session_pace, t.calendar)


@query("e21_sprint_quali", ROW + "fp_best_ms:i sq_position:i", "SELECT * FROM practice_all")
def _(t):
    return ft.practice_inputs(t.session_pace, t.calendar, t.sprint_quali, 1998)


cte(
    "fp_gaps",
    """SELECT series, season, round, race_seq, entity, team, CAST(fp_best_ms IS NOT NULL AS INT) AS practice_available,
      (fp_long_run_ms / min(fp_long_run_ms) OVER ev - 1.0) * 100 AS fp_long_run_gap_pct,
      (fp_best_ms / min(fp_best_ms) OVER ev - 1.0) * 100 AS fp_best_gap_pct,
      (fp1_best_ms / min(fp1_best_ms) OVER ev - 1.0) * 100 AS g1, (fp2_best_ms / min(fp2_best_ms) OVER ev - 1.0) * 100 AS g2,
      (fp3_best_ms / min(fp3_best_ms) OVER ev - 1.0) * 100 AS g3
      FROM joined WINDOW ev AS (PARTITION BY series, race_seq)""",
)


def practice_ctes(src: str, p: str) -> None:
    cte(
        f"{p}_fp1",
        f"""SELECT *, coalesce(fp3_gap_pct, fp2_gap_pct, fp1_gap_pct) AS fp_latest_gap_pct FROM
        (SELECT *, CASE WHEN g1 <= 7 THEN g1 END AS fp1_gap_pct, CASE WHEN g2 <= 7 THEN g2 END AS fp2_gap_pct,
         CASE WHEN g3 <= 7 THEN g3 END AS fp3_gap_pct FROM {src})""",
    )
    cte(
        f"{p}_fp",
        f"""SELECT *, CASE WHEN fp_latest_gap_pct IS NOT NULL THEN
          rank() OVER (PARTITION BY series, race_seq ORDER BY fp_latest_gap_pct NULLS LAST) END AS fp_latest_rank,
        min(fp_latest_gap_pct) OVER (PARTITION BY series, race_seq, team) AS fp_team_gap_pct,
        CASE WHEN count(fp_latest_gap_pct) OVER (PARTITION BY series, race_seq, team) >= 2
          THEN fp_latest_gap_pct - min(fp_latest_gap_pct) OVER (PARTITION BY series, race_seq, team) END AS fp_teammate_gap_pct,
        fp2_gap_pct - fp1_gap_pct AS fp_trend_12, fp3_gap_pct - fp2_gap_pct AS fp_trend_23,
        CASE WHEN list_aggregate([fp1_gap_pct, fp2_gap_pct, fp3_gap_pct], 'count') >= 2
          THEN list_aggregate([fp1_gap_pct, fp2_gap_pct, fp3_gap_pct], 'stddev_pop') END AS fp_consistency
        FROM {p}_fp1""",
    )


practice_ctes("fp_gaps", "fa")


def _with_practice(t):
    p = ft.practice_inputs(t.session_pace, t.calendar, t.sprint_quali, 1998)
    return ft.add_practice(t.contest.join(p, KEY, "left"))


@query(
    "e22_practice_compact",
    ROW + "fp_long_run_gap_pct:d fp_best_gap_pct:d practice_available:i",
    "SELECT * FROM fa_fp",
)
def _(t):
    return _with_practice(t)


@query(
    "e23_practice_detailed",
    ROW + "fp1_gap_pct:d fp2_gap_pct:d fp3_gap_pct:d fp_latest_gap_pct:d fp_latest_rank:i fp_team_gap_pct:d "
    "fp_teammate_gap_pct:d fp_trend_12:d fp_trend_23:d fp_consistency:d",
    "SELECT * FROM fa_fp",
)
def _(t):
    return _with_practice(t)


cte("classed", "SELECT *, CAST(venue % 100 IN (2, 5, 7, 11) AS INT) AS street_circuit FROM outcomes")


@query(
    "e24_venue_class",
    ROW + "street_circuit:i drv_type_avg_finish:d team_type_avg_finish:d",
    f"""SELECT * FROM (SELECT *, {prior_values('finish_when_running', 'series, entity, street_circuit', 10)} AS drv_type_avg_finish FROM classed)
      JOIN (SELECT series, team, street_circuit, race_seq, {prior_values('pace', 'series, team, street_circuit', 10)} AS team_type_avg_finish
       FROM (SELECT series, team, street_circuit, race_seq, avg(finish_when_running) AS pace FROM classed GROUP BY ALL))
      USING (series, team, street_circuit, race_seq)""",
)
def _(t):
    return ft.add_venue_class(t.outcomes, (F.col("venue") % 100).isin(2, 5, 7, 11))


# -- the whole table -------------------------------------------------------------
cte(
    "upcoming_rows",
    """SELECT c.series, c.season, c.round, r.entity, r.team, c.venue FROM
      (SELECT cal.series, cal.season, cal.round, cal.venue,
        (SELECT max(x.round) FROM contest x WHERE x.series = cal.series AND x.season = cal.season AND x.round < cal.round) AS prev
       FROM calendar cal ANTI JOIN contest USING (series, season, round) WHERE race_date >= DATE '2001-11-30') c
      JOIN contest r ON r.series = c.series AND r.season = c.season AND r.round = c.prev""",
)
cte(
    "all_rows",
    """SELECT series, season, round, entity, team, venue, position, points, dnf FROM contest
      UNION ALL SELECT series, season, round, entity, team, venue, NULL, NULL, NULL FROM upcoming_rows""",
)
cte(
    "whole",
    """SELECT a.*, dense_rank() OVER (PARTITION BY a.series ORDER BY a.season, a.round) - 1 AS race_seq, quali_position, best_ms,
      fp_long_run_ms, fp_best_ms, fp1_best_ms, fp2_best_ms, fp3_best_ms, champ_position_before,
      CASE WHEN a.round = 1 THEN coalesce(champ_points_before, 0) ELSE champ_points_before END AS champ_points_before,
      a.round / coalesce(last_round, a.round) AS season_progress, g.grid, g.grid_source,
      coalesce(position, 24) AS finish_or_last, CAST(dnf AS INT) AS dnf_flag,
      CASE WHEN position IS NOT NULL AND NOT coalesce(dnf, true) THEN position END AS finish_when_running,
      CASE WHEN position IS NOT NULL THEN CAST(position <= 3 AS INT) END AS podium_flag,
      CASE WHEN position IS NOT NULL THEN CAST(position <= 10 AS INT) END AS top10_flag
      FROM all_rows a LEFT JOIN (SELECT series, season, round, entity, quali_position, best_ms FROM qualifying) q USING (series, season, round, entity)
      LEFT JOIN practice_all USING (series, season, round, entity)
      LEFT JOIN previous USING (series, season, round, entity) LEFT JOIN season_length USING (series, season)
      LEFT JOIN resolved_grid g USING (series, season, round, entity)""",
)
feature_ctes("whole", "fw")
cte(
    "fw_gaps",
    """SELECT series, race_seq, entity, team, CAST(fp_best_ms IS NOT NULL AS INT) AS practice_available,
      (fp_long_run_ms / min(fp_long_run_ms) OVER ev - 1.0) * 100 AS fp_long_run_gap_pct,
      (fp_best_ms / min(fp_best_ms) OVER ev - 1.0) * 100 AS fp_best_gap_pct,
      (fp1_best_ms / min(fp1_best_ms) OVER ev - 1.0) * 100 AS g1, (fp2_best_ms / min(fp2_best_ms) OVER ev - 1.0) * 100 AS g2,
      (fp3_best_ms / min(fp3_best_ms) OVER ev - 1.0) * 100 AS g3
      FROM whole WINDOW ev AS (PARTITION BY series, race_seq)""",
)
practice_ctes("fw_gaps", "fw")
cte(
    "features_all",
    """SELECT * FROM fw_entity JOIN fw_team USING (series, team, race_seq) JOIN fw_tv USING (series, team, venue, race_seq)
      JOIN fw_venue USING (series, venue, race_seq) JOIN fw_fp USING (series, race_seq, entity)""",
)

_INT = {
    "drv_experience", "drv_circuit_starts", "champ_position_before", "champ_points_before", "practice_available",
    "fp_latest_rank", "grid", "quali_position",
}
_SPEC = " ".join(f"{n}:{'i' if n in _INT else 'd'}" for n in ft.ALL_FEATURES)


@query(
    "e26_build",
    ROW + "race_seq:i grid_source:s race_relevance:i quali_relevance:i " + _SPEC,
    """SELECT *, CASE WHEN position IS NOT NULL THEN greatest(24 - position, 0) END AS race_relevance,
      CASE WHEN quali_position IS NOT NULL THEN greatest(24 - quali_position, 0) END AS quali_relevance FROM features_all""",
)
def _(t):
    return ft.build(t)


@query(
    "e27_feature_lists",
    "feature:s race:b qualifying:b",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{f}', {f in ft.RACE_FEATURES}, {f in ft.QUALI_FEATURES})" for f in dict.fromkeys([*ft.RACE_FEATURES, *ft.QUALI_FEATURES]))
    + ") v(feature, race, qualifying) WHERE (SELECT count(*) FROM contest) > 0",
)
def _(t):
    have = ft.build(t).columns
    race, quali = set(ft.RACE_FEATURES), set(ft.QUALI_FEATURES)
    rows = F.explode(F.array(*[F.lit(c) for c in have])).alias("feature")
    d = t.calendar.groupBy().agg(F.count(F.lit(1)).alias("_n")).select(rows)
    d = d.select("feature", F.col("feature").isin(*race).alias("race"), F.col("feature").isin(*quali).alias("qualifying"))
    return d.where("race or qualifying")


@query(
    "e28_feature_coverage",
    "feature:s coverage_pct:d",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, count({n}) * 100.0 / count(*) AS coverage_pct FROM features_all" for n in ft.ALL_FEATURES
    ),
)
def _(t):
    return ft.coverage(ft.build(t), ft.ALL_FEATURES)
