"""Season totals and projection arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..constants import SPREAD_CANDIDATES
from ..operators import projection as op
from ..plans import evaluate as ev, features as ft
from ..session import cut
from ..sources.contest import EVENT, Tables
from .evaluate_q import oos
from .metrics_q import wilson_sql
from .registry import query
from .sqlbase import cte, uniform_sql

S2 = "series:i season:i "
AFTER = 8
N = 25
S = "series, season"


def after(t: Tables, rnd: int = AFTER):
    return t.contest.select("series", "season").distinct().withColumn("after", F.lit(rnd))


cte("now_standings", f"SELECT series, season, entity, team, points, position FROM standings WHERE round = {AFTER}")


@query("k1_standings_after", S2 + "entity:i team:i points:i position:i", "SELECT * FROM now_standings")
def _(t):
    return op.standings_after(t.standings, after(t))


@query("k1_points_history", S2 + "round:i entity:i points:i", "SELECT * FROM standings")
def _(t):
    return op.points_history(t.standings)


cte("left_rounds", f"SELECT series, season, round, round IN (3, 7) AS sprint FROM calendar WHERE round > {AFTER}")


@query("k2_remaining_schedule", S2 + "round:i sprint:b", "SELECT series, season, round, round IN (3, 7) AS sprint FROM calendar WHERE round > 5")
def _(t):
    return op.remaining_schedule(t.calendar.withColumn("sprint_start", F.when(F.col("round") < 7, F.col("sprint_start"))), t.sprint, after(t, 5))


cte("team_now_points", f"""SELECT series, season, team, sum(points) AS points FROM (SELECT series, season, round, team, points FROM contest
  UNION ALL SELECT series, season, round, team, points FROM sprint) WHERE round <= {AFTER} GROUP BY ALL""")


@query("k3_team_points", S2 + "team:i points:i", "SELECT * FROM team_now_points")
def _(t):
    return op.team_points(t.contest, t.sprint, after(t))


@query(
    "k4_round_maximum",
    S2 + "round:i one:d two:d",
    """SELECT series, season, round, 25.0 + CASE WHEN s THEN CASE WHEN season < 1997 THEN 0 WHEN season = 1997 THEN 3 ELSE 8 END ELSE 0 END AS one,
      43.0 + CASE WHEN s THEN CASE WHEN season < 1997 THEN 0 WHEN season = 1997 THEN 5 ELSE 15 END ELSE 0 END AS two FROM (SELECT *, round IN (3, 7) AS s FROM calendar)""",
)
def _(t):
    # This championship's sprints began 24 seasons before the published tables' first.
    s = F.col("sprint_start").isNotNull()
    return t.calendar.withColumns(
        {"one": op.round_maximum(F.col("season"), s, 1, 24), "two": op.round_maximum(F.col("season"), s, 2, 24)}
    )


cte("last_field", "SELECT c.series, c.entity FROM contest c JOIN (SELECT series, max(race_seq) AS m FROM contest GROUP BY ALL) l ON l.series = c.series AND c.race_seq = l.m WHERE c.entity % 9 < 8")


@query(
    "k5_season_strength",
    "series:i entity:i strength:d n_own:i",
    """SELECT f.series, f.entity, CASE WHEN n_own >= 3 THEN m ELSE -1.0 END AS strength, n_own FROM last_field f LEFT JOIN
      (SELECT series, entity, median(score) AS m, count(*) AS n_own FROM (SELECT s.*, dense_rank() OVER (PARTITION BY s.series ORDER BY race_seq DESC) AS t
        FROM oos_scores s SEMI JOIN last_field USING (series, entity)) WHERE t <= 8 GROUP BY ALL) USING (series, entity)""",
)
def _(t):
    d = t.contest.select("series", "entity", "race_seq")
    last = d.groupBy("series").agg(F.max("race_seq").alias("race_seq"))
    field = d.join(last, ["series", "race_seq"]).where("entity % 9 < 8").select("series", "entity", F.lit(-1.0).alias("typical"))
    return op.season_strength(oos(t), field, "typical")


WEEKEND = ("grid", "quali_position", "quali_gap_to_pole_pct", "quali_gap_to_teammate_pct", "drv_circuit_avg_finish", "team_circuit_avg_finish",
           "circuit_overtaking_score", "circuit_dnf_rate", "circuit_pole_win_rate", "drv_circuit_starts")
cte("typical_base", """SELECT * FROM fa_entity JOIN fa_team USING (series, team, race_seq) JOIN fa_tv USING (series, team, venue, race_seq) JOIN fa_venue USING (series, venue, race_seq)""")
cte("typical_race", "SELECT * FROM typical_base WHERE season = 2001 AND round = 10")
cte("typical_past", "SELECT * FROM typical_base WHERE NOT (season = 2001 AND round >= 10)")


def _typical_sql(method: str) -> str:
    n, stat = (8, "median") if method == "median8" else (5, "avg")
    own = f"""SELECT series, entity, {', '.join(f'{stat}({c}) AS o_{c}' for c in WEEKEND[:4])} FROM
      (SELECT *, row_number() OVER (PARTITION BY series, entity ORDER BY race_seq DESC) AS t FROM typical_past) WHERE t <= {n} GROUP BY ALL"""
    med = f"SELECT series, {', '.join(f'median({c}) AS m_{c}' for c in WEEKEND)} FROM typical_past GROUP BY series"
    if method == "median8":
        q = "coalesce(o_quali_position, m_quali_position)"
        g = f"coalesce(o_grid, {q})"
    else:
        q = "coalesce(drv_avg_quali_5, drv_avg_grid_5, m_quali_position)"
        g = f"coalesce(drv_avg_grid_5, {q})"
    mate = "m_quali_gap_to_teammate_pct" if method != "mean5" else "coalesce(o_quali_gap_to_teammate_pct, m_quali_gap_to_teammate_pct)"
    rec = {k: (f"coalesce({f}, m_{k})" if method == "mean5" else f"m_{k}") for k, f in (("drv_circuit_avg_finish", "drv_avg_finish_5"), ("team_circuit_avg_finish", "team_avg_finish_5"))}
    out = {"grid": g, "quali_position": q, "quali_gap_to_pole_pct": "coalesce(o_quali_gap_to_pole_pct, m_quali_gap_to_pole_pct)", "quali_gap_to_teammate_pct": mate, **rec,
           **{k: f"m_{k}" for k in WEEKEND[6:]}}
    return f"SELECT '{method}' AS method, r.series, r.entity, {', '.join(f'{e} AS {k}' for k, e in out.items())} FROM typical_race r LEFT JOIN ({own}) USING (series, entity) LEFT JOIN ({med}) USING (series)"


@query(
    "k6_typical_weekend",
    "method:s series:i entity:i " + " ".join(f"{c}:d" for c in WEEKEND),
    " UNION ALL ".join(_typical_sql(m) for m in ("mean5", "neutral", "median8")),
)
def _(t):
    d = ft.add_venue_profile(ft.add_venue_history(ft.add_form(ft.add_quali(t.outcomes))))
    d = cut(d.select("series", "season", "round", "race_seq", "entity", *WEEKEND, "drv_avg_quali_5", "drv_avg_grid_5", "drv_avg_finish_5", "team_avg_finish_5"))
    race = d.where("season = 2001 and round = 10")
    past = d.where("not (season = 2001 and round >= 10)")
    parts = [op.typical_weekend(race, past, m).withColumn("method", F.lit(m)) for m in ("mean5", "neutral", "median8")]
    return reduce(DataFrame.unionByName, parts)


# -- resampled seasons -------------------------------------------------------------------------
cte("season_field", f"""SELECT n.series, n.season, n.entity, n.team, n.points FROM now_standings n WHERE entity % 10 <> 7""")
cte("past_rounds", f"SELECT series, season, round, row_number() OVER (PARTITION BY series, season ORDER BY round) - 1 AS i, count(*) OVER (PARTITION BY series, season) AS n FROM (SELECT DISTINCT series, season, round FROM contest WHERE round <= {AFTER})")
cte("season_path", f"""SELECT series, season, sample, round, entity, team, points + sum(gain) OVER (PARTITION BY series, season, sample, entity ORDER BY round) AS total FROM
  (SELECT d.*, coalesce(c.points, 0) AS gain FROM
    (SELECT f.*, sample, l.round, CAST(floor({uniform_sql('season', 'f.series', 'f.season', 'team', 'sample', 'l.round')} * k.n) AS BIGINT) AS i
     FROM season_field f JOIN left_rounds l USING (series, season) JOIN (SELECT DISTINCT series, season, n FROM past_rounds) k USING (series, season), range(1, {N} + 1) r(sample)) d
    JOIN past_rounds p ON p.series = d.series AND p.season = d.season AND p.i = d.i
    LEFT JOIN contest c ON c.series = d.series AND c.season = d.season AND c.round = p.round AND c.entity = d.entity)""")
cte("season_totals", "SELECT series, season, sample, entity, team, arg_max(total, round) AS total FROM season_path GROUP BY ALL")
cte("season_all", f"""SELECT * FROM season_totals UNION ALL SELECT n.series, n.season, sample, n.entity, n.team, n.points FROM now_standings n
  ANTI JOIN season_field USING (series, season, entity), range(1, {N} + 1) r(sample)""")


def field(t: Tables):
    now = op.standings_after(t.standings, after(t))
    return now.where("entity % 10 <> 7").select("series", "season", "entity", "team", "points")


def path(t: Tables):
    schedule = op.remaining_schedule(t.calendar, t.sprint, after(t))
    return op.resample_seasons(t.contest.where(F.col("round") <= AFTER), cut(field(t)), schedule, N)


def totals(t: Tables):
    """Final totals of every replicate, absentees included."""
    return op.absentees(cut(op.final_totals(path(t))), op.standings_after(t.standings, after(t)))


@query("k14_resampled_totals", S2 + "sample:i round:i entity:i total:d", "SELECT * FROM season_path")
def _(t):
    return path(t)


@query("k10_absentees", S2 + "sample:i entity:i total:d", "SELECT * FROM season_all")
def _(t):
    return totals(t)


cte("season_summary", """SELECT series, season, entity, avg(total) AS projected, quantile_cont(CAST(total AS DOUBLE), 0.1) AS low, quantile_cont(CAST(total AS DOUBLE), 0.9) AS high,
  avg((r = 1)::INT) AS p_title, avg((r <= 3)::INT) AS p_top FROM (SELECT *, row_number() OVER (PARTITION BY series, season, sample ORDER BY total DESC, entity) AS r FROM season_all) GROUP BY ALL""")


@query("k7_outcome_summary", S2 + "entity:i projected:d low:d high:d p_title:d p_top:d", "SELECT * FROM season_summary")
def _(t):
    return op.outcome_summary(totals(t))


@query(
    "k8_team_summary",
    S2 + "team:i projected:d low:d high:d p_title:d",
    """SELECT series, season, team, avg(total) AS projected, quantile_cont(CAST(total AS DOUBLE), 0.1) AS low, quantile_cont(CAST(total AS DOUBLE), 0.9) AS high, avg((r = 1)::INT) AS p_title FROM
      (SELECT *, row_number() OVER (PARTITION BY series, season, sample ORDER BY total DESC, team) AS r FROM
       (SELECT g.series, g.season, sample, g.team, coalesce(a.points, own) + gain AS total FROM
        (SELECT x.series, x.season, x.sample, x.team, sum(x.total - n.points) AS gain, sum(n.points) AS own FROM season_all x JOIN now_standings n USING (series, season, entity) GROUP BY ALL) g
        LEFT JOIN team_now_points a ON a.series = g.series AND a.season = g.season AND a.team = g.team)) GROUP BY ALL""",
)
def _(t):
    now = cut(op.standings_after(t.standings, after(t)))
    teams = op.team_totals(totals(t), now, op.team_points(t.contest, t.sprint, after(t)))
    return op.outcome_summary(teams, ("team",))


@query(
    "k9_teammate_band",
    S2 + "team:i first:i second:i low:d high:d",
    """SELECT series, season, team, a AS first, b AS second, quantile_cont(CAST(gap AS DOUBLE), 0.1) AS low, quantile_cont(CAST(gap AS DOUBLE), 0.9) AS high FROM
      (SELECT series, season, sample, team, min(entity) AS a, max(entity) AS b, arg_min(total, entity) - arg_max(total, entity) AS gap FROM season_totals GROUP BY ALL HAVING count(*) = 2) GROUP BY ALL""",
)
def _(t):
    return op.teammate_band(op.final_totals(path(t)))


@query(
    "k15_round_tracks",
    S2 + "entity:i round:i mean:d low:d high:d",
    "SELECT series, season, entity, round, avg(total) AS mean, quantile_cont(CAST(total AS DOUBLE), 0.1) AS low, quantile_cont(CAST(total AS DOUBLE), 0.9) AS high FROM season_path GROUP BY ALL",
)
def _(t):
    return op.round_tracks(path(t))


# -- titles ------------------------------------------------------------------------------------------
LATE = 10
cte("late_standings", f"SELECT series, season, entity, points FROM standings WHERE round = {LATE}")
cte("title_now", f"""SELECT s.*, points + 25.0 * k >= max(points) OVER (PARTITION BY series, season) AS alive FROM late_standings s
  JOIN (SELECT series, season, count(*) AS k FROM calendar WHERE round > {LATE} GROUP BY ALL) USING (series, season)""")
cte("title_clinched", "SELECT *, alive AND sum(alive::INT) OVER (PARTITION BY series, season) = 1 AS clinched FROM title_now")


def title(t: Tables):
    m = op.remaining_schedule(t.calendar, t.sprint, after(t, LATE)).withColumn("most", op.round_maximum(F.col("season"), F.col("sprint")))
    left = m.groupBy("series", "season").agg(F.sum("most").alias("points_left"))
    return op.title_race(op.standings_after(t.standings, after(t, LATE)), left)


@query("k11_title_race", S2 + "entity:i alive:b clinched:b", "SELECT * FROM title_clinched")
def _(t):
    return title(t)


@query(
    "k12_clinch_round",
    S2 + "gap:d clinch_in:i",
    """SELECT g.series, g.season, gap, CASE WHEN gap > 25.0 * k + 1e-9 THEN 0 ELSE (SELECT min(i) FROM range(1, 13) r(i) WHERE i <= k AND gap + 25.0 * i > 25.0 * (k - i) + 1e-9) END AS clinch_in FROM
      (SELECT series, season, max(points) FILTER (position = 1) - max(points) FILTER (position = 2) AS gap FROM standings WHERE round = 10 GROUP BY ALL) g
      JOIN (SELECT series, season, count(*) AS k FROM calendar WHERE round > 10 GROUP BY ALL) USING (series, season)""",
)
def _(t):
    now = op.standings_after(t.standings, after(t, LATE))
    lead = now.groupBy("series", "season").agg(
        (F.max(F.when(F.col("position") == 1, F.col("points"))) - F.max(F.when(F.col("position") == 2, F.col("points")))).alias("gap")
    )
    m = op.remaining_schedule(t.calendar, t.sprint, after(t, LATE)).withColumn("most", op.round_maximum(F.col("season"), F.col("sprint")))
    return op.clinch_round(lead, m)


cte("odds_input", "SELECT s.*, c.clinched FROM season_summary s JOIN title_clinched c USING (series, season, entity)")


@query(
    "k13_allocate_odds",
    S2 + "entity:i odds:d",
    """SELECT series, season, entity, (t2 + CASE WHEN fix AND lead = 1 THEN -1 WHEN fix AND ord = 2 THEN 1 ELSE 0 END) / 1000.0 AS odds FROM
      (SELECT *, bool_or(lead = 1 AND t2 >= 1000 AND NOT clinched) OVER (PARTITION BY series, season) AND bool_or(ord = 2 AND lead > 1) OVER (PARTITION BY series, season) AS fix FROM
       (SELECT *, row_number() OVER (PARTITION BY series, season ORDER BY t2 DESC, entity) AS lead, row_number() OVER (PARTITION BY series, season ORDER BY projected DESC, entity) AS ord FROM
        (SELECT *, t1 + CASE WHEN row_number() OVER (PARTITION BY series, season ORDER BY x - t1 DESC, entity) <= 1000 - sum(t1) OVER (PARTITION BY series, season) THEN 1 ELSE 0 END AS t2 FROM
         (SELECT *, CAST(floor(x) AS BIGINT) AS t1 FROM (SELECT *, round(p_title / sum(p_title) OVER (PARTITION BY series, season) * 1000.0, 9) AS x FROM odds_input)))))""",
)
def _(t):
    d = op.outcome_summary(totals(t)).join(title(t).select("series", "season", "entity", "clinched"), ["series", "season", "entity"])
    return op.allocate_odds(cut(d), "p_title", "clinched", "projected")


# -- truth and calibration --------------------------------------------------------------------------------
cte("finals", f"SELECT series, season, entity, points AS final FROM standings s WHERE round = (SELECT max(round) FROM standings x WHERE x.series = s.series AND x.season = s.season)")


@query("k16_final_points", S2 + "entity:i final:i", "SELECT * FROM finals")
def _(t):
    return op.final_points(t.standings)


@query("k16_actual_champion", S2 + "champion:i", "SELECT series, season, arg_max(entity, (final, -entity)) AS champion FROM finals GROUP BY ALL")
def _(t):
    return op.actual_champion(t.standings)


@query(
    "k17_checkpoints",
    S2 + "after:i",
    """SELECT DISTINCT series, season, CAST(round_even(n * f, 0) AS INT) AS after FROM (SELECT series, season, max(round) AS n, min(race_seq) AS s FROM contest GROUP BY ALL),
      unnest([0.35, 0.55, 0.75, 0.9]) u(f) WHERE round_even(n * f, 0) >= 3 AND round_even(n * f, 0) < n AND s + round_even(n * f, 0) >= 30""",
)
def _(t):
    return op.checkpoints(t.contest)


cte("bands", """SELECT s.series, s.season, 'entrant' AS kind, low, high, final FROM season_summary s JOIN finals USING (series, season, entity)
  UNION ALL SELECT b.series, b.season, 'teammates', low, high, x.final - y.final FROM
   (SELECT series, season, team, a, b, quantile_cont(CAST(gap AS DOUBLE), 0.1) AS low, quantile_cont(CAST(gap AS DOUBLE), 0.9) AS high FROM
    (SELECT series, season, sample, team, min(entity) AS a, max(entity) AS b, arg_min(total, entity) - arg_max(total, entity) AS gap FROM season_totals GROUP BY ALL HAVING count(*) = 2) GROUP BY ALL) b
   JOIN finals x ON x.series = b.series AND x.season = b.season AND x.entity = b.a JOIN finals y ON y.series = b.series AND y.season = b.season AND y.entity = b.b""")


def bands(t: Tables):
    final = cut(op.final_points(t.standings))
    p = cut(op.final_totals(path(t)))
    whole = op.absentees(p, op.standings_after(t.standings, after(t)))
    own = op.outcome_summary(whole).join(final, ["series", "season", "entity"]).select("series", "season", F.lit("entrant").alias("kind"), "low", "high", "final")
    a = final.select("series", "season", F.col("entity").alias("first"), F.col("final").alias("_a"))
    b = final.select("series", "season", F.col("entity").alias("second"), F.col("final").alias("_b"))
    mates = op.teammate_band(p).join(a, ["series", "season", "first"]).join(b, ["series", "season", "second"])
    mates = mates.select("series", "season", F.lit("teammates").alias("kind"), "low", "high", (F.col("_a") - F.col("_b")).alias("final"))
    return own.unionByName(mates)


@query(
    "k18_band_coverage",
    "kind:s coverage:d width:d n:i",
    "SELECT kind, avg((final BETWEEN low AND high)::INT) AS coverage, avg(high - low) AS width, count(*) AS n FROM bands GROUP BY kind",
)
def _(t):
    return op.band_coverage(bands(t))


@query(
    "k19_coverage_sweep",
    "kind:s spread:d coverage:d width:d",
    f"""SELECT kind, arg_min(spread, (gap, spread)) AS spread, arg_min(coverage, (gap, spread)) AS coverage, arg_min(width, (gap, spread)) AS width FROM
      (SELECT *, round(abs(coverage - 0.8), 9) AS gap FROM (SELECT kind, CAST(sp AS DOUBLE) AS spread, avg((final BETWEEN low - sp AND high + sp)::INT) AS coverage, avg(high - low + 2 * sp) AS width
       FROM bands, unnest({list(SPREAD_CANDIDATES)}) u(sp) GROUP BY ALL)) GROUP BY kind""",
)
def _(t):
    return op.coverage_sweep(bands(t), SPREAD_CANDIDATES, by=("kind",))


cte("title_calls", """SELECT f.series, f.season, f.p, (f.favourite = c.champion)::INT AS won FROM
  (SELECT series, season, arg_max(entity, (p_title, projected, -entity)) AS favourite, max(p_title) AS p FROM season_summary GROUP BY ALL) f
  JOIN (SELECT series, season, arg_max(entity, (final, -entity)) AS champion FROM finals GROUP BY ALL) c USING (series, season)""")
_LO, _HI = wilson_sql("sum(won)", "count(*)")


@query(
    "k20_title_calibration",
    "bucket:i stated:d observed:d n:i brier:d ci_low:d ci_high:d",
    f"""SELECT CASE WHEN p < 0.5 THEN 0 WHEN p < 0.8 THEN 1 WHEN p < 0.95 THEN 2 ELSE 3 END AS bucket, avg(p) AS stated, avg(won) AS observed, count(*) AS n,
      avg((p - won) ** 2) AS brier, {_LO} AS ci_low, {_HI} AS ci_high FROM title_calls GROUP BY bucket""",
)
def _(t):
    s = cut(op.outcome_summary(totals(t)))
    order = F.struct(F.round("p_title", 9), F.round("projected", 9), -F.col("entity"))
    fav = s.groupBy("series", "season").agg(F.max_by("entity", order).alias("favourite"), F.max("p_title").alias("p"))
    d = fav.join(op.actual_champion(t.standings), ["series", "season"])
    return op.title_calibration(d.withColumn("won", (F.col("favourite") == F.col("champion")).cast("int")))


@query(
    "k21_outlook",
    S2 + "entity:i round:i mean:d low:d high:d actual:b",
    f"""SELECT * FROM (SELECT series, season, entity, round, CAST(points AS DOUBLE) AS mean, CASE WHEN round = {AFTER} THEN points END AS low, CASE WHEN round = {AFTER} THEN points END AS high, true AS actual
      FROM standings WHERE round <= {AFTER} UNION ALL SELECT series, season, entity, round, avg(total), quantile_cont(CAST(total AS DOUBLE), 0.1), quantile_cont(CAST(total AS DOUBLE), 0.9), false FROM season_path GROUP BY ALL)
      SEMI JOIN (SELECT series, season, entity FROM now_standings WHERE position <= 5) USING (series, season, entity)""",
)
def _(t):
    return op.outlook(op.points_history(t.standings), op.round_tracks(path(t)), after(t))


@query(
    "j18_projection_errors",
    "method:s points_mae:d n:i",
    """SELECT 'resampled' AS method, avg(abs(projected - final)) AS points_mae, count(*) AS n FROM season_summary JOIN finals USING (series, season, entity)
      UNION ALL SELECT 'as they stand', avg(abs(points - final)), count(*) FROM now_standings JOIN finals USING (series, season, entity)""",
)
def _(t):
    a = op.outcome_summary(totals(t)).select("series", "season", "entity", "projected", F.lit("resampled").alias("method"))
    b = op.standings_after(t.standings, after(t)).select("series", "season", "entity", F.col("points").cast("double").alias("projected"), F.lit("as they stand").alias("method"))
    return op.projection_errors(a.unionByName(b), op.final_points(t.standings), ("method",))
