"""One event end to end, as it has landed and as it stood at every stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DEFAULTS, EXPLANATION_GROUPS, GROUP_LABELS, PENALTY_GAP, QUALI_FEATURES, RACE_FEATURES
from ..operators import ranker as rk
from ..plans import evaluate as ev, live
from ..plans.variants import Variant
from ..sources.contest import Tables
from .evaluate_q import EV2, losses_sql
from .landing_q import penalty_list
from .projection_q import WEEKEND
from .registry import query
from .sqlbase import cte, exact_sql
from .variants_q import score_ctes, system_ctes, whole

SPEC = """series:i season:i round:i version:s stage:s entity:i start_source:s grid:i held:b temperature:d quali_temperature:d p_win:d p_podium:d p_top5:d
  p_top10:d exp_position:d q_p_win:d q_p_podium:d q_exp_position:d season_strength:d why:s"""
NOW = "2001-12-01"
#: No list exists for the events forecast: each entrant's last penalty of two seasons carries over to them.
CARRIED = 2000


def carried(t: Tables, season: int, rnd: int):
    p = penalty_list(t).where(F.col("season") >= CARRIED).withColumn("places", F.col("penalty").try_cast("int"))
    last = p.groupBy("series", "entity").agg(F.max_by("places", F.struct("season", "round")).alias("places"))
    return last.withColumns({"season": F.lit(season), "round": F.lit(rnd)})


# -- the same in SQL ----------------------------------------------------------------------------------
cte("carried", f"""SELECT series, entity, CASE WHEN penalty = 'back' THEN 'Infinity'::DOUBLE ELSE places END AS "drop" FROM penalties WHERE season >= {CARRIED}
  QUALIFY row_number() OVER (PARTITION BY series, entity ORDER BY season DESC, round DESC) = 1""")
cte("live_dates", "SELECT key, cutoff, latest FROM oos_dates UNION ALL SELECT DATE '2001-12-28', DATE '2001-12-28', max(season) FROM train_field")
cte("live_known", """SELECT f.*, make_date(season, round, 28) AS race_date, k.sq_position, greatest(least(0.35 * coalesce(drv_dnf_rate_10, 0.12) + 0.65 * coalesce(team_dnf_rate_10, 0.12), 0.35), 0.02) AS dnf_prob,
  f.quali_position AS quali_place FROM features_all f LEFT JOIN (SELECT series, season, round, entity, sq_position FROM sprint_known) k USING (series, season, round, entity)""")
system_ctes("lvr", "whole_run", {"race": Variant(tuple(RACE_FEATURES))}, "race_relevance", dates="live_dates")
system_ctes("lvq", "whole_run", {"quali": Variant(tuple(QUALI_FEATURES))}, "quali_relevance", dates="live_dates")
_AT = "PARTITION BY series, race_seq, version"
_GROUPS = ", ".join("('{}', '{}')".format(f, GROUP_LABELS[g].replace("'", "''")) for f, g in EXPLANATION_GROUPS.items())
_NAMES = "[" + ", ".join(f"'{f}'" for f in RACE_FEATURES) + "]"


def versions_sql(src: str) -> str:
    late = ", ".join(f"CASE WHEN v.version = 'post_quali' THEN {c} END AS {c}" for c in live.GRID)
    early = ", ".join(f"CASE WHEN v.version <> 'pre_practice' THEN {c} END AS {c}" for c in live.PRACTICE)
    flag = "CASE WHEN v.version = 'pre_practice' THEN 0 ELSE practice_available END AS practice_available"
    return f"SELECT w.* REPLACE ({late}, {early}, {flag}), v.version FROM {src} w, (VALUES ('post_quali'), ('pre_quali'), ('pre_practice')) v(version)"


def _board(src: str) -> str:
    return f"""SELECT series, race_seq, method AS version, entity, sum(s) FILTER (pos = 1) AS p_win, sum(s) FILTER (pos <= 3) AS p_podium, sum(s) FILTER (pos <= 5) AS p_top5,
      sum(s) FILTER (pos <= 10) AS p_top10, sum(s * pos) AS exp_position FROM (SELECT *, 0.998 * share + 0.002 / count(*) OVER (PARTITION BY series, race_seq, method, entity) AS s FROM ({src})) GROUP BY ALL"""


def forecast_sql(p: str, day: str, race: str) -> str:
    """The forecast of ``race`` (rows with version) of the date ``day``, from strictly earlier dates."""
    cte(f"{p}_hist", f"SELECT * FROM live_known WHERE position IS NOT NULL AND race_date < {day}")
    cte(f"{p}_recent", f"SELECT series, race_seq FROM (SELECT DISTINCT series, race_seq FROM {p}_hist) QUALIFY row_number() OVER (PARTITION BY series ORDER BY race_seq DESC) <= 24")
    cte(f"{p}_trail", f"SELECT * FROM {p}_hist SEMI JOIN {p}_recent USING (series, race_seq)")
    cte(f"{p}_race", race)
    cte(f"{p}_rows", f"SELECT *, false AS target FROM ({versions_sql(f'{p}_trail')}) UNION ALL BY NAME SELECT *, true AS target FROM {p}_race")
    score_ctes("lvq", f"{p}_rows", QUALI_FEATURES, f"{p}", "version")
    cte(f"{p}_q", f"""SELECT * EXCLUDE (score, method, place, n, sq, o), CASE WHEN n >= 2 THEN (o - avg(o) OVER w) / coalesce(nullif(stddev_pop(o) OVER w, 0), 1) * coalesce(nullif(stddev_pop(score) OVER w, 0), 1) ELSE score END AS qs FROM
      (SELECT *, score + 0.5 * -(sq - avg(sq) OVER w) / coalesce(nullif(stddev_samp(sq) OVER w, 0), 1) AS o FROM
        (SELECT *, count(sq_position) OVER w AS n, CAST(coalesce(sq_position, max(sq_position) OVER w + 1) AS DOUBLE) AS sq FROM lvq_{p} WINDOW w AS ({_AT})) WINDOW w AS ({_AT})) WINDOW w AS ({_AT})""")
    cte(f"{p}_source", f"""SELECT series, race_seq, version, arg_min(grid_source, (-n, grid_source)) AS source FROM
      (SELECT series, race_seq, version, grid_source, count(*) AS n FROM {p}_race WHERE grid_source IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
    cte(f"{p}_stage", f"""SELECT series, race_seq, version, stage, CASE WHEN stage = 'post_quali' THEN source ELSE 'projected' END AS start_source FROM
      (SELECT series, race_seq, version, CASE WHEN count(grid_source) / count(*) >= 0.9 THEN 'post_quali' WHEN max(practice_available) > 0 THEN 'pre_quali' ELSE 'pre_practice' END AS stage FROM {p}_race GROUP BY ALL)
      LEFT JOIN {p}_source USING (series, race_seq, version)""")
    cte(f"{p}_staged", f"SELECT q.*, coalesce(g.stage, q.version) AS stage, g.start_source FROM {p}_q q LEFT JOIN {p}_stage g USING (series, race_seq, version)")
    turn = "row_number() OVER (PARTITION BY series, race_seq, version ORDER BY qs DESC, entity)"
    projected = {"grid": turn, "quali_position": turn, "quali_gap_to_pole_pct": "drv_pace_gap_pct", "quali_gap_to_teammate_pct": "drv_teammate_quali_edge"}
    cte(f"{p}_proj", f"""SELECT s.* REPLACE ({', '.join(f"CASE WHEN stage = 'post_quali' THEN {c} ELSE {e} END AS {c}" for c, e in projected.items())}), coalesce(c."drop", 0) AS announced,
      CASE WHEN target AND start_source IN ('projected', 'qualifying') THEN coalesce(c."drop", 0) ELSE 0 END AS moved FROM {p}_staged s LEFT JOIN carried c USING (series, entity)""")
    cte(f"{p}_start", f"""SELECT * EXCLUDE (start_slot, touched) REPLACE (CASE WHEN touched THEN row_number() OVER ({_AT} ORDER BY start_slot + CASE WHEN isinf(moved) THEN 1000 ELSE moved END + CASE WHEN moved > 0 THEN 0.5 ELSE 0 END, start_slot, entity) ELSE grid END AS grid)
      FROM (SELECT *, max(moved) OVER ({_AT}) > 0 AS touched, coalesce(grid, coalesce(max(grid) OVER ({_AT}), 0) + row_number() OVER (PARTITION BY series, race_seq, version, grid IS NULL ORDER BY entity)) AS start_slot FROM {p}_proj)""")
    score_ctes("lvr", f"{p}_start", RACE_FEATURES, f"{p}", "version")
    for kind, score, place in (("rt", "score", "place"), ("qt", "qs", "quali_place")):
        cte(f"{p}_{kind}s", f"SELECT series, race_seq, entity, version AS method, {score} AS score, CAST({place} AS DOUBLE) AS place FROM lvr_{p} WHERE NOT target")
        cte(f"{p}_{kind}l", losses_sql(f"{p}_{kind}s"))
        cte(f"{p}_{kind}", f"""SELECT series, method AS stage, m.t AS temperature FROM (SELECT series, method, min({{'l': round(l, 10), 't': temperature}}) AS m FROM
          (SELECT series, method, temperature, avg(loss) AS l, count(*) AS n FROM {p}_{kind}l GROUP BY ALL) WHERE n >= 10 GROUP BY ALL)""")
    cte(f"{p}_field", f"""SELECT s.* REPLACE (s.version AS method), coalesce(r.temperature, 0.35) AS temperature, coalesce(q.temperature, 0.55) AS quali_temperature,
      coalesce(isinf(announced) AND drv_avg_quali_5 <= 6, false) AS held FROM lvr_{p} s LEFT JOIN {p}_rt r USING (series, stage) LEFT JOIN {p}_qt q USING (series, stage) WHERE target""")
    cte(f"{p}_held", f"""SELECT f.series, f.race_seq, f.method, entity, quali_temperature AS temperature, qs AS score,
      CASE WHEN held THEN least(qs, list_extract(free, CAST(least(len(free), round_even(n * 0.7, 0)) AS INT))) ELSE qs END AS held_score FROM {p}_field f
      JOIN (SELECT series, race_seq, method, list(qs ORDER BY qs DESC) FILTER (NOT held) AS free, count(*) AS n FROM {p}_field GROUP BY ALL) USING (series, race_seq, method)""")
    keys = "series, race_seq, method"
    cte(f"{p}_usual", exact_sql(f"{p}_held", keys, temp="temperature"))
    cte(f"{p}_slow", exact_sql(f"{p}_held", keys, temp="temperature", score="held_score"))
    cte(f"{p}_qboard", _board(f"SELECT {keys}, entity, pos, 0.6 * b.share + 0.4 * a.share AS share FROM {p}_usual a JOIN {p}_slow b USING ({keys}, entity, pos)"))
    cte(f"{p}_plain", exact_sql(f"{p}_field", keys, temp="temperature"))
    cte(f"{p}_drawn", exact_sql(f"{p}_field", keys, True, "temperature"))
    cte(f"{p}_board", _board(f"SELECT {keys}, entity, pos, 0.7 * a.share + 0.3 * b.share AS share FROM {p}_plain a JOIN {p}_drawn b USING ({keys}, entity, pos)"))

    # Why: each feature's share of the score, in groups.
    inputs = "[" + ", ".join(f"coalesce(CAST({f} AS DOUBLE), avg({f}) OVER ev, 0)" for f in RACE_FEATURES) + "]"
    cte(f"{p}_model", f"SELECT c FROM lvr_g WHERE key = {day}")
    cte(f"{p}_parts", f"""SELECT series, race_seq, version, entity, grid, quali_position, sd, {_NAMES}[i] AS f, c[i] * (x[i] - avg(x[i]) OVER (PARTITION BY series, race_seq, version, i)) / sd AS part FROM
      (SELECT *, CASE WHEN stddev_pop(raw) OVER ({_AT}) > 1e-9 THEN stddev_pop(raw) OVER ({_AT}) ELSE 1 END AS sd FROM (SELECT *, list_dot_product(x, c) AS raw FROM
        (SELECT series, race_seq, version, entity, grid, quali_position, {inputs} AS x FROM {p}_start WHERE target WINDOW ev AS ({_AT})) JOIN {p}_model ON true)),
      unnest(range(1, {len(RACE_FEATURES) + 1})) u(i)""")
    cte(f"{p}_groups", f"""SELECT series, race_seq, version, entity, CASE WHEN f = 'quali_position' AND coalesce(abs(grid - quali_position) >= 3, false) THEN 'one-lap pace' ELSE l END AS l, round(sum(part), 9) AS c
      FROM {p}_parts JOIN (VALUES {_GROUPS}) g(f, l) USING (f) GROUP BY ALL""")
    cte(f"{p}_why", f"""SELECT series, race_seq, version, entity, upper(s[1]) || s[2:] AS why FROM (SELECT series, race_seq, version, entity, concat_ws(', ', CASE WHEN max(c) > 0 THEN 'helped by ' || arg_max(l, (c, l)) END,
      CASE WHEN min(c) < 0 THEN 'held back by ' || arg_min(l, (c, l)) END) AS s FROM {p}_groups GROUP BY ALL)""")

    # The rest of the season: own last weekends, or an ordinary one.
    def scored(src: str) -> str:
        return f"""SELECT series, race_seq, entity, (raw - avg(raw) OVER w) / CASE WHEN stddev_pop(raw) OVER w > 1e-9 THEN stddev_pop(raw) OVER w ELSE 1 END AS score FROM
          (SELECT series, race_seq, entity, list_dot_product(x, c) AS raw FROM (SELECT series, race_seq, entity, {inputs} AS x FROM {src} WINDOW ev AS (PARTITION BY series, race_seq)) JOIN {p}_model ON true) WINDOW w AS (PARTITION BY series, race_seq)"""

    cte(f"{p}_one", f"SELECT * FROM {p}_race QUALIFY version = min(version) OVER (PARTITION BY series)")
    cte(f"{p}_whole", f"SELECT * FROM {p}_hist QUALIFY count(*) OVER (PARTITION BY series, race_seq) >= 5")
    cte(f"{p}_past", f"SELECT * FROM ({scored(f'{p}_whole')}) SEMI JOIN {p}_one USING (series, entity)")
    cte(f"{p}_own", f"""SELECT series, entity, median(score) AS m, count(*) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY race_seq DESC) AS t FROM {p}_past) WHERE t <= 8 GROUP BY ALL""")
    cte(f"{p}_last8", f"""SELECT series, entity, {', '.join(f'median({c}) AS o_{c}' for c in WEEKEND[:4])} FROM
      (SELECT *, row_number() OVER (PARTITION BY series, entity ORDER BY race_seq DESC) AS t FROM {p}_hist) WHERE t <= 8 GROUP BY ALL""")
    cte(f"{p}_med", f"SELECT series, {', '.join(f'median({c}) AS m_{c}' for c in WEEKEND)} FROM {p}_hist GROUP BY series")
    q = "coalesce(o_quali_position, m_quali_position)"
    ordinary = {"grid": f"coalesce(o_grid, {q})", "quali_position": q, **{c: f"coalesce(o_{c}, m_{c})" for c in WEEKEND[2:4]}, **{c: f"m_{c}" for c in WEEKEND[4:]}}
    cte(f"{p}_typical", f"SELECT r.* REPLACE ({', '.join(f'{e} AS {c}' for c, e in ordinary.items())}) FROM {p}_one r LEFT JOIN {p}_last8 USING (series, entity) LEFT JOIN {p}_med USING (series)")
    cte(f"{p}_strength", f"""SELECT t.series, t.entity, CASE WHEN n >= 3 THEN m ELSE t.score END AS season_strength FROM ({scored(f'{p}_typical')}) t LEFT JOIN {p}_own USING (series, entity)""")
    return f"""SELECT f.*, b.p_win, b.p_podium, b.p_top5, b.p_top10, b.exp_position, q.p_win AS q_p_win, q.p_podium AS q_p_podium, q.exp_position AS q_exp_position, season_strength, why
      FROM {p}_field f JOIN {p}_board b USING (series, race_seq, version, entity) JOIN {p}_qboard q USING (series, race_seq, version, entity)
      JOIN {p}_why USING (series, race_seq, version, entity) LEFT JOIN {p}_strength USING (series, entity)"""


@query("m15_live_forecast", SPEC, forecast_sql("lf", "DATE '2001-12-28'", "SELECT *, 'landed' AS version FROM live_known WHERE position IS NULL AND season = 2001 AND round = 12"))
def _(t):
    """The next event of every series as it has landed: the whole models, its stage's temperatures, penalties, and the season's strength."""
    return live.run(t, F.lit(NOW).cast("timestamp_ntz"), carried(t, 2001, 12))


cte("live_last", "SELECT * FROM live_known WHERE position IS NOT NULL AND race_date = DATE '2001-11-28'")


@query("m15_replayed_stages", SPEC, forecast_sql("lp", "DATE '2001-11-28'", versions_sql("live_last")))
def _(t):
    """The last events forecast again as they stood with a grid, with practice and with neither, in one plan."""
    return live.replay(t, carried(t, 2001, 11))


# -- F5: the whole model's reasons for every result ------------------------------------------------------
_INPUTS = "[" + ", ".join(f"coalesce(CAST({f} AS DOUBLE), avg({f}) OVER ev, 0)" for f in RACE_FEATURES) + "]"
cte("full_raw", f"""SELECT *, list_dot_product(x, c) AS raw FROM (SELECT series, race_seq, entity, grid, quali_position, {_INPUTS} AS x FROM whole_run WINDOW ev AS (PARTITION BY series, race_seq))
  JOIN (SELECT c FROM lvr_g WHERE key = DATE '2001-12-28') ON true""")
cte("full_parts", f"""SELECT series, race_seq, entity, grid, quali_position, {_NAMES}[i] AS f, c[i] * (x[i] - avg(x[i]) OVER (PARTITION BY series, race_seq, i)) / sd AS part FROM
  (SELECT *, CASE WHEN stddev_pop(raw) OVER w > 1e-9 THEN stddev_pop(raw) OVER w ELSE 1 END AS sd FROM full_raw WINDOW w AS (PARTITION BY series, race_seq)), unnest(range(1, {len(RACE_FEATURES) + 1})) u(i)""")
_IDS = ", ".join(f"('{f}', '{g}')" for f, g in EXPLANATION_GROUPS.items())


@query("f5_full_groups", "series:i race_seq:i entity:i group:s contribution:d", f"""SELECT series, race_seq, entity,
  CASE WHEN f = 'quali_position' AND coalesce(abs(grid - quali_position) >= 3, false) THEN 'one_lap_pace' ELSE g END AS "group", sum(part) AS contribution
  FROM full_parts JOIN (VALUES {_IDS}) v(f, g) USING (f) GROUP BY ALL""")
def _(t):
    """Contributions of all 27 inputs by group; a grid pulled away from qualifying hands the qualifying position to pace."""
    d = whole(t)
    keys = [*EV2, "entity"]
    model = ev.fitted(d, RACE_FEATURES, "race_relevance", DEFAULTS["recency"], None, live.RIDGE)
    long = model.contributions(d).join(d.select(*keys, "grid", "quali_position"), keys)
    apart = F.coalesce(F.abs(F.col("grid") - F.col("quali_position")) >= PENALTY_GAP, F.lit(False))
    return rk.grouped_contributions(long, EXPLANATION_GROUPS, keys, apart)
