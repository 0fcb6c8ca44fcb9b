"""Listwise probabilities and grid penalties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import PRACTICE_DETAIL_FEATURES, PRACTICE_FEATURES, TEMPERATURES
from ..operators import listwise as op, penalties as pen
from ..plans import features as ft
from ..session import cut
from ..sources.contest import EVENT, KEY, Tables
from ..sources.landing import penalties_for  # noqa: F401  (the list these rules read)
from .landing_q import penalty_list
from .registry import query
from .sqlbase import cte, exact_sql, gumbel_sql, uniform_sql

RACE = "series:i race_seq:i "
EV = "series, race_seq"
GRID_SQL = "[" + ", ".join(repr(t) for t in TEMPERATURES) + "]"

cte("scored_field", "SELECT *, (11 - grid) / 4.0 AS score, CAST(position AS DOUBLE) AS place FROM contest")


def scored_field(t: Tables):
    return t.contest.withColumns({"score": (11 - F.col("grid")) / 4.0, "place": F.col("position").cast("double")})


def softmax_sql(src: str, score: str, t: str, ev: str = EV, out: str = "p_win") -> str:
    return f"""SELECT *, e / sum(e) OVER (PARTITION BY {ev}) AS {out} FROM
      (SELECT *, exp(({score} - max({score}) OVER (PARTITION BY {ev})) / {t}) AS e FROM {src})"""


@query("g1_plackett_luce", RACE + "entity:i p_win:d", softmax_sql("scored_field", "score", "0.8"))
def _(t):
    return op.plackett_luce(scored_field(t), "score", 0.8)


def orders_sql(src: str, score: str, temp: str, n: int, tag: str, keep: str = "") -> str:
    return f"""SELECT series, race_seq, entity, sample{keep}, row_number() OVER (PARTITION BY series, race_seq, sample ORDER BY noisy DESC, entity) AS pos FROM
      (SELECT f.*, sample, {score} / {temp} + {gumbel_sql(tag, 'series', 'race_seq', 'entity', 'sample')} AS noisy
       FROM {src} f, range(1, {n} + 1) r(sample))"""


def retire_sql(orders: str, p: str, tag: str) -> str:
    k = ("series", "race_seq", "entity", "sample")
    return f"""SELECT series, race_seq, entity, sample, row_number() OVER (PARTITION BY series, race_seq, sample ORDER BY key, entity) AS pos FROM
      (SELECT *, CASE WHEN {uniform_sql(tag + '-out', *k)} < {p} THEN count(*) OVER (PARTITION BY series, race_seq, sample) + 1 + {uniform_sql(tag + '-order', *k)}
       ELSE pos END AS key FROM ({orders}))"""


def counts_sql(orders: str, n: int) -> str:
    return f"""SELECT series, race_seq, f.entity, f.pos, coalesce(c.n, 0) / {float(n)} AS share FROM
      (SELECT a.series, a.race_seq, a.entity, b.position AS pos FROM contest a JOIN
        (SELECT series, race_seq, row_number() OVER (PARTITION BY series, race_seq ORDER BY entity) AS position FROM contest) b USING (series, race_seq)) f
      LEFT JOIN (SELECT series, race_seq, entity, pos, count(*) AS n FROM ({orders}) GROUP BY ALL) c USING (series, race_seq, entity, pos)"""


@query("g2_sample_orders", RACE + "entity:i sample:i pos:i", orders_sql("scored_field", "score", "0.8", 5, "pl"))
def _(t):
    return op.sample_orders(scored_field(t), "score", 0.8, 5)


cte("g_orders", orders_sql("scored_field", "score", "0.8", 20, "pl"))


@query("g3_position_counts", RACE + "entity:i pos:i share:d", counts_sql("SELECT * FROM g_orders", 20))
def _(t):
    return op.position_counts(op.sample_orders(scored_field(t), "score", 0.8, 20), 20)


cte("dnf_field", """SELECT s.*, greatest(least(0.35 * coalesce(drv_dnf_rate_10, 0.12) + 0.65 * coalesce(team_dnf_rate_10, 0.12), 0.35), 0.02) AS dnf_prob
  FROM scored_field s JOIN (SELECT series, race_seq, entity, drv_dnf_rate_10, team_dnf_rate_10 FROM fa_entity JOIN fa_team USING (series, team, race_seq))
  USING (series, race_seq, entity)""")
cte("g_dnf_orders", retire_sql(orders_sql("dnf_field", "score", "0.8", 20, "pl", ", dnf_prob"), "dnf_prob", "pl-dnf"))


def dnf_field(t: Tables):
    d = ft.add_form(t.outcomes).withColumns(
        {"score": (11 - F.col("grid")) / 4.0, "place": F.col("position").cast("double"), "dnf_prob": op.dnf_probability()}
    )
    return d.select(*KEY, "race_seq", "score", "place", "dnf_prob", "team", "position", "grid")


@query("g4_position_matrix", RACE + "entity:i pos:i share:d", counts_sql("SELECT * FROM g_dnf_orders", 20))
def _(t):
    return op.position_matrix(dnf_field(t), "score", 0.8, 20, "dnf_prob")


cte("t_losses", f"""SELECT series, season, race_seq, temperature, -ln(greatest(max(CASE WHEN place = 1 THEN e END) / sum(e), 1e-12)) AS loss FROM
  (SELECT f.*, temperature, exp((score - max(score) OVER (PARTITION BY series, race_seq, temperature)) / temperature) AS e
   FROM scored_field f, unnest({GRID_SQL}) g(temperature)) GROUP BY ALL""")


@query(
    "g5_fit_temperature",
    "series:i temperature:d loss:d",
    """SELECT series, m.t AS temperature, m.l AS loss FROM (SELECT series, min({'l': round(loss, 10), 't': temperature}) AS m FROM
      (SELECT series, temperature, avg(loss) AS loss FROM t_losses GROUP BY ALL) GROUP BY series)""",
)
def _(t):
    return op.fit_temperature(op.temperature_losses(scored_field(t), "score", "place"), ["series"])


@query(
    "g5_fit_depth_three",
    "series:i temperature:d loss:d",
    f"""SELECT series, m.t AS temperature, m.l AS loss FROM (SELECT series, min({{'l': round(loss, 10), 't': temperature}}) AS m FROM
      (SELECT series, temperature, avg(loss) AS loss FROM (SELECT series, race_seq, temperature, avg(loss) AS loss FROM
       (SELECT a.series, a.race_seq, a.entity, temperature, -ln(greatest(exp(a.score / temperature) / sum(exp(b.score / temperature)), 1e-12)) AS loss
        FROM scored_field a JOIN scored_field b ON a.series = b.series AND a.race_seq = b.race_seq AND b.place >= a.place, unnest([0.1, 0.5, 1.0, 2.0, 4.0, 6.0, 8.0]) g(temperature)
        WHERE a.place <= 3 GROUP BY ALL, a.score) GROUP BY ALL) GROUP BY ALL) GROUP BY series)""".replace("GROUP BY ALL, a.score", "GROUP BY a.series, a.race_seq, a.entity, a.score, temperature"),
)
def _(t):
    grid = [0.1, 0.5, 1.0, 2.0, 4.0, 6.0, 8.0]
    return op.fit_temperature(op.temperature_losses(scored_field(t), "score", "place", 3, grid), ["series"])


cte("rolling_t", """SELECT series, race_seq, CASE WHEN n >= 10 THEN m.t ELSE 1.0 END AS temperature, n FROM
  (SELECT series, race_seq, min({'l': l, 't': temperature}) AS m, max(n) AS n FROM
   (SELECT series, race_seq, temperature, round(avg(loss) OVER w, 10) AS l, count(loss) OVER w AS n FROM t_losses
    WINDOW w AS (PARTITION BY series, temperature ORDER BY race_seq ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) GROUP BY ALL)""")


@query("g6_rolling_temperature", RACE + "temperature:d n:i", "SELECT * FROM rolling_t")
def _(t):
    return op.rolling_temperature(op.temperature_losses(scored_field(t), "score", "place"), ["series"], "race_seq", 1.0)


cte("g_plain", counts_sql("SELECT * FROM g_orders", 20))
cte("g_drawn", counts_sql(retire_sql(orders_sql("dnf_field", "score", "0.8", 20, "sim", ", dnf_prob"), "dnf_prob", "sim-dnf"), 20))
cte("g_mixed", """SELECT series, race_seq, entity, pos, 0.998 * (0.7 * p.share + 0.3 * q.share) + 0.002 / count(*) OVER (PARTITION BY series, race_seq, entity) AS share
  FROM g_plain p JOIN g_drawn q USING (series, race_seq, entity, pos)""")


def summary_sql(src: str, keep: str = "") -> str:
    return f"""SELECT series, race_seq, entity{keep}, sum(share) FILTER (pos = 1) AS p_win, sum(share) FILTER (pos <= 3) AS p_podium,
      sum(share) FILTER (pos <= 5) AS p_top5, sum(share) FILTER (pos <= 10) AS p_top10, sum(share * pos) AS exp_position FROM {src} GROUP BY ALL"""


def mixed(t: Tables):
    return op.forecast(dnf_field(t), "score", 0.8, 0.7)


@query("g7_mix", RACE + "entity:i pos:i share:d", "SELECT * FROM g_mixed")
def _(t):
    d = dnf_field(t)
    p, q = op.position_matrix(d, "score", 0.8, 20), op.position_matrix(d, "score", 0.8, 20, "dnf_prob", "sim")
    return op.mix(p, q, 0.7)


@query(
    "g8_smooth",
    RACE + "entity:i p_win:d",
    f"SELECT *, 0.998 * p + 0.002 / count(*) OVER (PARTITION BY {EV}) AS p_win FROM ({softmax_sql('scored_field', 'score', '0.3', out='p')})",
)
def _(t):
    return op.smooth(op.plackett_luce(scored_field(t), "score", 0.3), "p_win", ["series", "race_seq"])


SUMMARY = RACE + "entity:i p_win:d p_podium:d p_top5:d p_top10:d exp_position:d"


@query("g9_summarise", SUMMARY, summary_sql("g_plain"))
def _(t):
    return op.summarise(op.position_matrix(scored_field(t), "score", 0.8, 20))


@query(
    "g10_check_distribution",
    RACE + "problems:s",
    """SELECT series, race_seq, CASE race_seq % 4 WHEN 0 THEN '' WHEN 1 THEN 'positions of an entrant,entrants of a position'
      WHEN 2 THEN 'outside [0, 1],positions of an entrant,entrants of a position' ELSE 'positions of an entrant' END AS problems
      FROM (SELECT DISTINCT series, race_seq FROM contest)""",
)
def _(t):
    # One cell of each event is raised (r = 1), pushed outside (r = 2), or moved between entrants (r = 3).
    m = t.contest.select("series", "race_seq", "entity", F.col("position").alias("at"), "field")
    m = m.withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), F.col("field"))))
    share = F.when(F.col("pos") == F.col("at"), 1.0).otherwise(0.0)
    r, cell = F.col("race_seq") % 4, (F.col("pos") == 1)
    share = share + F.when((r == 1) & cell & (F.col("at") == 1), -0.5).otherwise(0.0)
    share = share + F.when((r == 2) & cell & (F.col("at") == 1), 0.5).otherwise(0.0)
    share = share + F.when((r == 3) & cell & (F.col("at") == 1), -0.5).when((r == 3) & cell & (F.col("at") == 2), 0.5).otherwise(0.0)
    d = op.check_distribution(m.withColumn("share", share))
    return d.withColumn("problems", F.array_join("problems", ","))


# -- penalties -------------------------------------------------------------------------
def penalised(t: Tables):
    """Every event's field with drops and recent qualifying form."""
    p = penalty_list(t).withColumn("places", F.col("penalty").try_cast("int"))
    return pen.places_for(ft.add_quali(t.outcomes), p, KEY)


cte("penalised", """SELECT e.*, CASE WHEN p.penalty = 'back' THEN 'Infinity'::DOUBLE ELSE coalesce(p.places, 0) END AS "drop"
  FROM fa_entity e LEFT JOIN (SELECT series, season, round, entity, penalty, places FROM penalties) p USING (series, season, round, entity)""")


@query(
    "h1_places_for",
    RACE + "entity:i back:b places:d",
    """SELECT series, race_seq, entity, isinf("drop") AS back, CASE WHEN isinf("drop") THEN NULL ELSE "drop" END AS places FROM penalised""",
)
def _(t):
    d = penalised(t)
    back = F.col("drop") == float("inf")
    return d.withColumns({"back": back, "places": F.when(~back, F.col("drop"))})


cte("regridded", """SELECT *, CASE WHEN max("drop") OVER (PARTITION BY series, race_seq) > 0 THEN
  row_number() OVER (PARTITION BY series, race_seq ORDER BY grid + CASE WHEN isinf("drop") THEN 1000 ELSE "drop" END + CASE WHEN "drop" > 0 THEN 0.5 ELSE 0 END, grid, entity)
  ELSE grid END AS new_grid FROM penalised""")


@query("h2_apply", RACE + "entity:i grid:i", "SELECT series, race_seq, entity, new_grid AS grid FROM regridded")
def _(t):
    return pen.apply_penalties(penalised(t), ["series", "race_seq"])


@query(
    "h2_apply_sampled",
    RACE + "entity:i sample:i pos:i",
    """SELECT series, race_seq, entity, sample, CASE WHEN max("drop") OVER (PARTITION BY series, race_seq, sample) > 0 THEN
      row_number() OVER (PARTITION BY series, race_seq, sample ORDER BY pos + CASE WHEN isinf("drop") THEN 1000 ELSE "drop" END + CASE WHEN "drop" > 0 THEN 0.5 ELSE 0 END, pos, entity)
      ELSE pos END AS pos FROM (SELECT o.*, p."drop" FROM g_orders o JOIN penalised p USING (series, race_seq, entity) WHERE sample <= 3)""",
)
def _(t):
    orders = op.sample_orders(penalised(t).withColumn("score", (11 - F.col("grid")) / 4.0), "score", 0.8, 3)
    return pen.apply_penalties(orders, ["series", "race_seq", "sample"], "pos")


cte("held_field", """SELECT *, coalesce(isinf("drop") AND drv_avg_quali_5 <= 6, false) AS held, (11 - grid) / 4.0 AS score FROM penalised""")


def held(t: Tables):
    d = penalised(t).withColumn("score", (11 - F.col("grid")) / 4.0)
    return d.withColumn("held", pen.held_back())


@query("h3_held_back", RACE + "entity:i held:b", "SELECT * FROM held_field WHERE held")
def _(t):
    return held(t).where("held")


cte("held_scores", """SELECT h.*, CASE WHEN held THEN least(score, list_extract(free, CAST(least(len(free), round_even(n * 0.7, 0)) AS INT))) ELSE score END AS held_score
  FROM held_field h JOIN (SELECT series, race_seq, list(score ORDER BY score DESC) FILTER (NOT held) AS free, count(*) AS n FROM held_field GROUP BY ALL) USING (series, race_seq)""")


@query("h4_held_back_scores", RACE + "entity:i held_score:d", "SELECT * FROM held_scores")
def _(t):
    return pen.held_back_scores(held(t), "score", "held", "held_score", ["series", "race_seq"])


@query(
    "g11_ranking_forecast",
    SUMMARY,
    summary_sql(f"""(SELECT series, race_seq, entity, pos, 0.998 * (0.6 * a.share + 0.4 * p.share) + 0.002 / count(*) OVER (PARTITION BY series, race_seq, entity) AS share
      FROM ({exact_sql('held_scores', EV)}) p JOIN ({exact_sql('held_scores', EV, score='held_score')}) a USING (series, race_seq, entity, pos))"""),
)
def _(t):
    d = pen.held_back_scores(held(t), "score", "held", "held_score", ["series", "race_seq"])
    d = cut(d.select("series", "race_seq", "entity", "score", "held_score"))
    return op.ranking_forecast(d, "score", 0.8, "held_score")


@query("g12_dnf_probability", RACE + "entity:i dnf_prob:d", "SELECT * FROM dnf_field")
def _(t):
    return dnf_field(t)


cte("g_exact", f"""SELECT series, race_seq, entity, pos, 0.998 * (0.7 * p.share + 0.3 * q.share) + 0.002 / count(*) OVER (PARTITION BY series, race_seq, entity) AS share
  FROM ({exact_sql('dnf_field', EV)}) p JOIN ({exact_sql('dnf_field', EV, True)}) q USING (series, race_seq, entity, pos)""")


@query("g13_forecast", SUMMARY, summary_sql("g_exact"))
def _(t):
    return op.summarise(mixed(t))


# -- baselines -----------------------------------------------------------------------------
METHODS = {
    "grid": "grid",
    "championship": "champ_position_before",
    "recent_form": "drv_avg_finish_3",
    "team_form": "team_avg_finish_3",
}


def baselines(t: Tables, methods=tuple(METHODS)):
    """Long table of baseline ranks and strengths: (event, entity, position, method, rank, score)."""
    d = ft.add_form(t.outcomes)
    if "championship" in methods:
        d = ft.previous_standing(d, t.standings)
    base = d.select(*EVENT, "race_seq", "entity", "position", *[METHODS[m] for m in methods])
    ranked = base.withColumns({f"_{m}": op.baseline_rank(METHODS[m]) for m in methods})
    long = F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_{m}").alias("rank")) for m in methods]))
    d = ranked.select(*EVENT, "race_seq", "entity", "position", long)
    first = F.row_number().over(
        op.W.partitionBy("series", "race_seq", "method").orderBy("rank", "entity")
    )
    return d.withColumns({"score": op.baseline_score("rank"), "pred": first, "place": F.col("position").cast("double")})


cte("baseline_values", """SELECT o.series, o.season, o.round, o.race_seq, o.entity, o.position, m.method,
  CAST(CASE m.method WHEN 'grid' THEN o.grid WHEN 'championship' THEN champ_position_before WHEN 'recent_form' THEN drv_avg_finish_3 ELSE team_avg_finish_3 END AS DOUBLE) AS v
  FROM joined o JOIN (SELECT series, race_seq, entity, drv_avg_finish_3, team_avg_finish_3 FROM fa_entity JOIN fa_team USING (series, team, race_seq)) USING (series, race_seq, entity),
  (VALUES ('grid'), ('championship'), ('recent_form'), ('team_form')) m(method)""")
cte("baselines", """SELECT *, -ln(rank) AS score, row_number() OVER (PARTITION BY series, race_seq, method ORDER BY rank, entity) AS pred, CAST(position AS DOUBLE) AS place FROM
  (SELECT * EXCLUDE (v), rank() OVER (PARTITION BY series, race_seq, method ORDER BY f) + (count(*) OVER (PARTITION BY series, race_seq, method, f) - 1) / 2.0 AS rank FROM
   (SELECT *, coalesce(v, max(v) OVER (PARTITION BY series, race_seq, method) + 1, 1.0) AS f FROM baseline_values))""")


@query("g14_baselines", RACE + "entity:i method:s rank:d score:d", "SELECT * FROM baselines")
def _(t):
    return baselines(t)


@query(
    "g15_sprint_blend",
    RACE + "entity:i blended:d",
    """SELECT series, race_seq, entity, CASE WHEN n >= 2 THEN (o - avg(o) OVER w) / coalesce(nullif(stddev_pop(o) OVER w, 0), 1) * coalesce(nullif(stddev_pop(score) OVER w, 0), 1) ELSE score END AS blended FROM
      (SELECT *, score + 0.5 * -(sq - avg(sq) OVER w) / coalesce(nullif(stddev_samp(sq) OVER w, 0), 1) AS o FROM
       (SELECT s.*, count(sq_position) OVER w AS n, CAST(coalesce(sq_position, max(sq_position) OVER w + 1) AS DOUBLE) AS sq FROM scored_field s
        LEFT JOIN (SELECT series, season, round, entity, sq_position FROM sprint_quali WHERE entity % 6 > 0) USING (series, season, round, entity)
        WINDOW w AS (PARTITION BY series, race_seq)) WINDOW w AS (PARTITION BY series, race_seq)) WINDOW w AS (PARTITION BY series, race_seq)""",
)
def _(t):
    sq = t.sprint_quali.where("entity % 6 > 0").select(*KEY, "sq_position")
    return op.sprint_blend(scored_field(t).join(sq, KEY, "left"), "score", "sq_position", 0.5, "blended")


@query(
    "g16_projected_weekend",
    RACE + "entity:i grid:i quali_position:i quali_gap_to_pole_pct:d quali_gap_to_teammate_pct:d",
    """SELECT series, race_seq, entity, row_number() OVER (PARTITION BY series, race_seq ORDER BY coalesce(drv_avg_quali_5, 99), entity) AS grid,
      row_number() OVER (PARTITION BY series, race_seq ORDER BY coalesce(drv_avg_quali_5, 99), entity) AS quali_position,
      drv_pace_gap_pct AS quali_gap_to_pole_pct, drv_teammate_quali_edge AS quali_gap_to_teammate_pct FROM fa_entity""",
)
def _(t):
    d = ft.add_pace(ft.add_quali(t.outcomes)).withColumn("q", -F.coalesce("drv_avg_quali_5", F.lit(99.0)))
    return op.projected_weekend(d, "q")


@query(
    "g17_without_practice",
    RACE + "entity:i practice_available:i fp_best_gap_pct:d fp_latest_rank:i points:i",
    "SELECT series, race_seq, entity, 0 AS practice_available, NULL AS fp_best_gap_pct, NULL AS fp_latest_rank, points FROM contest",
)
def _(t):
    p = ft.practice_inputs(t.session_pace, t.calendar, t.sprint_quali, 1998)
    d = ft.add_practice(t.contest.join(p, KEY, "left"))
    return op.without_columns(d, [*PRACTICE_FEATURES, *PRACTICE_DETAIL_FEATURES, "sq_position"])


@query(
    "g18_top_order",
    RACE + "turn:i entity:i",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, race_seq ORDER BY quali_position, entity) AS turn FROM contest WHERE quali_position IS NOT NULL) WHERE turn <= 3",
)
def _(t):
    return op.top_order(t.contest, "quali_position", 3)
