"""Walk-forward evaluation, tuning, decisions and diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..constants import BLEND_CANDIDATES, MIN_BIAS_EVENTS, MIN_TRAIN_EVENTS, RECENCY_CANDIDATES
from ..operators import listwise as lw, metrics as mt, ranker as rk
from ..plans import evaluate as ev, features as ft
from ..session import cut
from ..sources.contest import EVENT, KEY, Tables
from .listwise_q import GRID_SQL, baselines, dnf_field
from .metrics_q import BETTER_SQL, BUCKET_SQL, LOW, boot_sql, wilson_sql
from .ranker_q import TWO, dated, fit_sql, train_field
from .registry import query
from .sqlbase import CTES, cte, exact_sql, prior_values, uniform_sql

R = 5000
EV2 = ["series", "race_seq"]
SM = "series:i race_seq:i method:s "


@query(
    "j1_completed_events",
    "series:i race_seq:i season:i round:i",
    "SELECT DISTINCT series, race_seq, season, round FROM contest WHERE season BETWEEN 1998 AND 2000",
)
def _(t: Tables):
    return ev.completed_events(t.contest, 1998, 2000)


# -- out-of-sample model scores --------------------------------------------------------
# A target needs 30 earlier dates; each date's model is refitted, its seasons weighed from the last one trained on.
cte("oos_dates", f"""SELECT race_date AS key, race_date AS cutoff, max(last) OVER (ORDER BY race_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
  FROM (SELECT race_date, max(season) AS last FROM train_field GROUP BY race_date) QUALIFY row_number() OVER (ORDER BY race_date) > {MIN_TRAIN_EVENTS}""")


def oos_sql(pair: str = "true", recency: float | None = 2.0, field: str = "train_filled") -> str:
    """Out-of-sample scores in SQL: one fit per date from earlier dates, standardised within the event."""
    weight = f"greatest(pow({recency}, -(k.latest - a.season) / 2.0), 0.15)"
    fit = fit_sql("SELECT * FROM oos_dates", pair, weight, "a.race_date < k.cutoff").replace("train_filled", field)
    return f"""SELECT series, season, round, race_seq, entity, position, CAST(position AS DOUBLE) AS place, CAST(race_date AS VARCHAR) AS cutoff,
      (raw - avg(raw) OVER w) / CASE WHEN stddev_pop(raw) OVER w > 1e-9 THEN stddev_pop(raw) OVER w ELSE 1 END AS score FROM
      (SELECT f.*, c1 * g + c2 * f5 AS raw FROM {field} f JOIN ({fit}) c ON c.key = f.race_date)
      WINDOW w AS (PARTITION BY series, race_seq)"""


cte("oos_scores", oos_sql())
cte("oos_events", "SELECT DISTINCT series, race_seq FROM train_field WHERE race_date IN (SELECT key FROM oos_dates)")


def oos(t: Tables, features=TWO, label="label", top=None, ridge=0.0, recency: float | None = 2.0, d: DataFrame | None = None):
    d = cut(train_field(t)) if d is None else d
    out = ev.oos_scores(d, d.select(*EV2), features, label, recency, top, ridge)
    return out.withColumns({"place": F.col("position").cast("double"), "method": F.lit("model"), "cutoff": F.col("cutoff").cast("string")})


@query(
    "j2_oos_scores",
    "series:i race_seq:i entity:i cutoff:s score:d",
    "SELECT * FROM oos_scores",
)
def _(t):
    return oos(t)


def _all_scores(t: Tables, methods=("grid", "recent_form"), model: DataFrame | None = None):
    """Model and baselines in one table, with retirement rates."""
    d = cut(train_field(t))
    cols = ["series", "season", "round", "race_seq", "entity", "position", "place", "method", "score"]
    both = (oos(t, d=d) if model is None else model).select(*cols)
    if methods:
        both = both.unionByName(baselines(t, methods).join(ev.eligible(d), EV2, "left_semi").select(*cols))
    return cut(both)


#: Results are reported for the last two seasons of the data: one to tune on, one to check.
LAST = "(SELECT max(season) FROM contest)"


def last_season(df: DataFrame) -> int:
    return df.agg(F.max("season")).first()[0] or 0


cte("wf_scores", """SELECT series, season, race_seq, entity, position, place, 'model' AS method, score FROM oos_scores
  UNION ALL SELECT series, season, race_seq, entity, position, place, method, score FROM baselines SEMI JOIN oos_events USING (series, race_seq) WHERE method IN ('grid', 'recent_form')""")


def losses_sql(src: str, place: str = "place") -> str:
    return f"""SELECT series, method, race_seq, temperature, -ln(greatest(max(CASE WHEN turn = 1 THEN e END) / sum(e), 1e-12)) AS loss FROM
      (SELECT f.*, temperature, exp((score - max(score) OVER (PARTITION BY series, race_seq, method, temperature)) / temperature) AS e FROM
       (SELECT *, CASE WHEN {place} IS NOT NULL THEN row_number() OVER (PARTITION BY series, race_seq, method ORDER BY {place} NULLS LAST, entity) END AS turn FROM {src}) f,
       unnest({GRID_SQL}) g(temperature)) GROUP BY ALL HAVING max(CASE WHEN turn = 1 THEN e END) IS NOT NULL"""


def rolling_sql(losses: str, fallback: float = 1.0) -> str:
    return f"""SELECT series, method, race_seq, CASE WHEN n >= 10 THEN m.t ELSE {fallback} END AS temperature FROM
      (SELECT series, method, race_seq, min({{'l': l, 't': temperature}}) AS m, max(n) AS n FROM
       (SELECT series, method, race_seq, temperature, round(avg(loss) OVER w, 10) AS l, count(loss) OVER w AS n FROM {losses}
        WINDOW w AS (PARTITION BY series, method, temperature ORDER BY race_seq ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) GROUP BY ALL)"""


def matrix_sql(src: str, dnf: bool = False, temp: str = "temperature") -> str:
    """Exact position shares per method."""
    return exact_sql(src, "series, race_seq, method", dnf, temp)


def table_sql(matrix: str) -> str:
    """Smoothed matrix to published probabilities."""
    return f"""SELECT series, race_seq, method, entity, sum(s) FILTER (pos = 1) AS p_win, sum(s) FILTER (pos <= 3) AS p_podium, sum(s) FILTER (pos <= 10) AS p_top10 FROM
      (SELECT *, 0.998 * share + 0.002 / count(*) OVER (PARTITION BY series, race_seq, method, entity) AS s FROM ({matrix})) GROUP BY ALL"""


def podium_sql(src: str) -> str:
    """Win and podium probabilities in closed form, smoothed: over who comes first, and who comes first and second."""
    m = "series, race_seq, method"
    return f"""SELECT {m}, entity, 0.998 * w + 0.002 / n AS p_win, 0.998 * (w + second + third) + 0.006 / n AS p_podium FROM
      (SELECT {m}, x.entity, any_value(x.n) AS n, any_value(x.w) AS w, sum(CASE WHEN k.entity = j.entity THEN j.w * x.w / (1 - j.w) ELSE 0 END) AS second,
        sum(CASE WHEN k.entity <> j.entity THEN j.w * k.w / (1 - j.w) * x.w / greatest(1 - j.w - k.w, 1e-300) ELSE 0 END) AS third
       FROM p_src x JOIN p_src j USING ({m}) JOIN p_src k USING ({m}) WHERE x.entity <> j.entity AND x.entity <> k.entity GROUP BY {m}, x.entity)""".replace("p_src", f"""(SELECT *, count(*) OVER v AS n, exp(z) / sum(exp(z)) OVER v AS w FROM
       (SELECT *, (score - max(score) OVER (PARTITION BY {m})) / temperature AS z FROM {src}) WINDOW v AS (PARTITION BY {m}))""")


def grade_sql(table: str, scores: str) -> str:
    m = "series, race_seq, method"
    return f"""SELECT * FROM (SELECT {m}, sum(CASE WHEN pr <= 5 THEN 1 / log2(tr + 1) / log2(pr + 1) END) / sum(CASE WHEN tr <= 5 THEN 1 / log2(tr + 1) / log2(tr + 1) END) AS ndcg5,
        count(*) FILTER (pr = 1 AND tr = 1) AS winner_hit, avg(abs(pr - tr)) AS position_error FROM
        (SELECT *, row_number() OVER (PARTITION BY {m} ORDER BY score DESC, entity) AS pr, row_number() OVER (PARTITION BY {m} ORDER BY place, entity) AS tr FROM {scores}) GROUP BY ALL)
      JOIN (SELECT {m}, -ln(greatest(max(p) FILTER (won = 1), 1e-12)) AS win_logloss, avg((p_podium - (place <= 3)::INT) ** 2) AS podium_brier FROM
        (SELECT t.*, s.place, CAST(s.place = min(s.place) OVER w AS INT) AS won, p_win / sum(p_win) OVER w AS p FROM {table} t JOIN {scores} s USING ({m}, entity)
         WINDOW w AS (PARTITION BY {m})) GROUP BY ALL) USING ({m})"""


cte("wf_losses", losses_sql("wf_scores"))
cte("wf_t", rolling_sql("wf_losses"))
cte("wf_window", f"SELECT s.*, temperature FROM wf_scores s JOIN wf_t USING (series, method, race_seq) WHERE season >= {LAST} - 1")
cte("wf_table", table_sql(matrix_sql("wf_window")))
cte("wf_rows", f"SELECT * FROM ({grade_sql('wf_table', 'wf_window')}) JOIN (SELECT DISTINCT series, race_seq, method, season, temperature FROM wf_window) USING (series, race_seq, method)")


def targets_of(scores: DataFrame) -> DataFrame:
    return ev.window_targets(ev.completed_events(scores, 0), last_season(scores) - 1)


def forward(t: Tables, scores: DataFrame | None = None, **kw):
    scores = _all_scores(t) if scores is None else scores
    return ev.walk_forward(scores.drop("season", "round"), targets_of(scores), **kw)


WF = "season:i temperature:d ndcg5:d winner_hit:i position_error:d win_logloss:d podium_brier:d"


@query("j3_walk_forward", SM + WF, "SELECT * FROM wf_rows")
def _(t):
    return forward(t)[0]


cte("wq_scores", """SELECT b.series, b.season, b.race_seq, b.entity, b.method, b.score, CAST(c.quali_position AS DOUBLE) AS place
  FROM baselines b JOIN (SELECT series, race_seq, entity, quali_position FROM contest) c USING (series, race_seq, entity)
  SEMI JOIN oos_events e ON b.series = e.series AND b.race_seq = e.race_seq WHERE method IN ('recent_form', 'team_form')""")
cte("wq_losses", losses_sql("wq_scores"))
cte("wq_t", rolling_sql("wq_losses"))
cte("wq_rows", f"""SELECT series, race_seq, method, any_value(season) AS season, any_value(temperature) AS temperature, avg(abs(pr - place)) AS position_error,
  -ln(greatest(arg_min(p, (place, entity)) FILTER (place IS NOT NULL), 1e-12)) AS pole_logloss FROM
  (SELECT s.*, temperature, row_number() OVER w AS pr, exp(score / temperature) / sum(exp(score / temperature)) OVER (PARTITION BY series, race_seq, method) AS p
   FROM wq_scores s JOIN wq_t USING (series, method, race_seq) WHERE season >= {LAST} - 1 WINDOW w AS (PARTITION BY series, race_seq, method ORDER BY score DESC, entity)) GROUP BY ALL""")


@query("j4_walk_forward_quali", SM + "season:i temperature:d position_error:d pole_logloss:d", "SELECT * FROM wq_rows")
def _(t):
    q = t.contest.select(*EV2, "entity", F.col("quali_position").cast("double").alias("quali_place"))
    b = baselines(t, ("recent_form", "team_form")).join(ev.eligible(cut(train_field(t))), EV2, "left_semi").drop("place")
    scores = cut(b.join(q, [*EV2, "entity"]))
    return ev.walk_forward_quali(scores.drop("season", "round"), targets_of(scores), "quali_place")


MEANS = ("ndcg5", "winner_hit", "position_error", "win_logloss", "podium_brier")
MEAN_SQL = ", ".join(f"avg({m}) AS {m}" for m in MEANS) + ", count(*) AS n_events"
MEAN_SPEC = " ".join(f"{m}:d" for m in MEANS) + " n_events:i"


@query("j5_summary", "method:s " + MEAN_SPEC, f"SELECT method, {MEAN_SQL} FROM wf_rows GROUP BY method")
def _(t):
    return ev.summary(forward(t)[0], MEANS)


@query("j5_by_season", "season:i method:s " + MEAN_SPEC, f"SELECT season, method, {MEAN_SQL} FROM wf_rows GROUP BY ALL")
def _(t):
    return ev.summary(forward(t)[0], MEANS, ("season", "method"))


cte("wf_types", """SELECT series, race_seq, method, entity, u.event_type, round(u.p, 12) AS p, u.y FROM (SELECT t.*, s.place, CAST(s.place = min(s.place) OVER (PARTITION BY series, race_seq, method) AS INT) AS won
  FROM wf_table t JOIN wf_window s USING (series, race_seq, method, entity)), LATERAL (VALUES ('win', p_win, won), ('podium', p_podium, (place <= 3)::INT), ('top10', p_top10, (place <= 10)::INT)) u(event_type, p, y)""")
_LO, _HI = wilson_sql("sum(y)", "count(*)")


@query(
    "j6_reliability",
    "method:s event_type:s bucket:i stated:d observed:d n:i ci_low:d ci_high:d",
    f"""SELECT method, event_type, bucket, avg(p) AS stated, avg(y) AS observed, count(*) AS n, {_LO} AS ci_low, {_HI} AS ci_high
      FROM (SELECT *, {BUCKET_SQL} AS bucket FROM wf_types) GROUP BY method, event_type, bucket""",
)
def _(t):
    return mt.reliability(ev.event_types(forward(t)[1]), "p", "y", ("method", "event_type"))


@query(
    "j6_calibration_error",
    "method:s event_type:s ece:d n:i",
    """SELECT method, event_type, sum(m * abs(s - o)) / sum(m) AS ece, CAST(sum(m) AS BIGINT) AS n FROM (SELECT method, event_type, b, count(*) AS m, avg(p) AS s, avg(y) AS o FROM
      (SELECT method, event_type, p, y, ntile(10) OVER (PARTITION BY method, event_type ORDER BY p, y) AS b FROM (SELECT method, event_type, round(p, 9) AS p, y FROM wf_types)) GROUP BY ALL) GROUP BY ALL""",
)
def _(t):
    types = ev.event_types(forward(t)[1]).withColumn("p", F.round("p", 9))  # below the error of the quadrature
    return mt.calibration_error(types, "p", "y", ("method", "event_type"))


COMPARE = ("ndcg5", "win_logloss", "podium_brier")


def diffs_sql(rows: str, ref: str, metrics) -> str:
    return f"SELECT a.series, a.race_seq, a.method, {', '.join(f'a.{m} - b.{m} AS {m}' for m in metrics)} FROM {rows} a JOIN {rows} b USING (series, race_seq) WHERE a.method <> '{ref}' AND b.method = '{ref}'"


cte("wf_diffs", diffs_sql("wf_rows", "grid", COMPARE))
PAIR = "method:s metric:s difference:d ci_low:d ci_high:d better:s"


def paired_sql(diffs: str, metrics, ref: str) -> str:
    return f"""SELECT method, metric, mean AS difference, ci_low, ci_high, {BETTER_SQL.format(low=LOW, a='method', b=f"'{ref}'")} AS better
      FROM ({boot_sql(diffs, 'series, race_seq', ['method'], list(metrics), R)})"""


@query("j6_compare", PAIR, paired_sql("wf_diffs", COMPARE, "grid"))
def _(t):
    return mt.paired_comparison(cut(forward(t)[0]), EV2, COMPARE, "grid", replicates=R)


# -- tuning ------------------------------------------------------------------------------
def _pooled_fit(scores: DataFrame, place: str = "place"):
    losses = lw.temperature_losses(scores, "score", place, event=ev.METHOD_EVENT)
    return lw.fit_temperature(losses, ["method"])


cte("pooled_t", """SELECT method, m.t AS temperature, m.l AS win_logloss FROM (SELECT method, min({'l': round(loss, 10), 't': temperature}) AS m FROM
  (SELECT method, temperature, avg(loss) AS loss FROM wf_losses GROUP BY ALL) GROUP BY method)""")


@query("j9_pooled_fit", "method:s temperature:d win_logloss:d", "SELECT * FROM pooled_t")
def _(t):
    return _pooled_fit(_all_scores(t)).withColumnRenamed("loss", "win_logloss")


@query("j9_winner_loss", "method:s win_logloss:d", """SELECT method, avg(-ln(greatest(p, 1e-12))) AS win_logloss FROM (SELECT method, place,
  exp(score / 0.7) / sum(exp(score / 0.7)) OVER (PARTITION BY series, race_seq, method) AS p FROM wf_scores) WHERE place = 1 GROUP BY method""")
def _(t):
    return ev.winner_loss(_all_scores(t), 0.7)


cte("tune_field", "SELECT w.*, dnf_prob FROM wf_scores w JOIN (SELECT series, race_seq, entity, dnf_prob FROM dnf_field) USING (series, race_seq, entity) WHERE method = 'model'")
cte("tune_plain", matrix_sql("tune_field", temp="0.7"))


@query(
    "j7_tune_blend",
    "method:s blend:d win_logloss:d",
    f"""SELECT method, blend, avg(-ln(greatest(0.998 * (blend * p.share + (1 - blend) * q.share) + 0.002 / n, 1e-12))) AS win_logloss FROM tune_plain p
      JOIN ({matrix_sql('tune_field', True, '0.7')}) q USING (series, race_seq, method, entity, pos)
      JOIN tune_field f USING (series, race_seq, method, entity) JOIN (SELECT series, race_seq, count(*) AS n FROM tune_field GROUP BY ALL) USING (series, race_seq),
      unnest({list(BLEND_CANDIDATES)}) b(blend) WHERE p.pos = 1 AND f.place = 1 GROUP BY ALL""",
)
def _(t):
    rates = dnf_field(t).select(*EV2, "entity", "dnf_prob")
    scores = cut(_all_scores(t, ()).join(rates, [*EV2, "entity"]))
    return ev.tune_blend(scores, 0.7, BLEND_CANDIDATES)


RECENCIES = RECENCY_CANDIDATES
cte("recency_scores", " UNION ALL ".join(
    f"SELECT *, '{w}' AS method FROM ({oos_sql(recency=w)})" for w in RECENCIES))
cte("recency_losses", losses_sql("recency_scores"))


@query(
    "j7_tune",
    "recency:d temperature:d win_logloss:d chosen:b",
    """SELECT CAST(method AS DOUBLE) AS recency, m.t AS temperature, m.l AS win_logloss, row_number() OVER (ORDER BY m.l, CAST(method AS DOUBLE)) = 1 AS chosen FROM
      (SELECT method, min({'l': round(loss, 10), 't': temperature}) AS m FROM (SELECT method, temperature, avg(loss) AS loss FROM recency_losses GROUP BY ALL) GROUP BY method)""",
)
def _(t):
    """Each recency candidate refits the models; the lowest loss at its own best temperature wins."""
    d = cut(train_field(t))
    parts = []
    for w in RECENCIES:
        scores = cut(oos(t, recency=w, d=d))
        parts.append(_pooled_fit(scores).withColumn("recency", F.lit(w)))
    both = cut(reduce(DataFrame.unionByName, parts))
    best = F.first("recency").over(lw.W.partitionBy("method").orderBy("loss", "recency"))
    return both.select("recency", "temperature", F.col("loss").alias("win_logloss"), (F.col("recency") == best).alias("chosen"))


@query(
    "j8_trailing_temperatures",
    "series:i method:s temperature:d",
    """SELECT series, method, m.t AS temperature FROM (SELECT series, method, min({'l': l, 't': temperature}) AS m FROM
      (SELECT series, method, temperature, round(avg(loss), 10) AS l FROM (SELECT *, dense_rank() OVER (PARTITION BY series, method ORDER BY race_seq DESC) AS age FROM wf_losses)
       WHERE age <= 24 GROUP BY ALL) GROUP BY ALL)""",
)
def _(t):
    losses = lw.temperature_losses(_all_scores(t), "score", "place", event=ev.METHOD_EVENT)
    age = F.dense_rank().over(lw.W.partitionBy("series", "method").orderBy(F.desc("race_seq")))
    return lw.fit_temperature(losses.withColumn("_age", age).where("_age <= 24"), ["series", "method"])


STAGES = ("pre_quali", "pre_practice")
QUALI_TWO = ("drv_avg_quali_5", "fp_best_gap_pct")
BEFORE_GRID = ("championship", "recent_form", "team_form")


def _stage_frame(t: Tables) -> DataFrame:
    """Race and qualifying inputs and labels of every entry."""
    p = ft.practice_inputs(t.session_pace, t.calendar, t.sprint_quali, 1998)
    d = ft.add_form(ft.add_pace(ft.add_quali(ft.add_practice(t.outcomes.join(p, KEY, "left")))))
    d = dated(d.withColumns({"label": ft.relevance("position"), "quali_label": ft.relevance("quali_position")}))
    cols = ["position", "quali_position", "grid", "drv_avg_finish_5", *QUALI_TWO, "drv_pace_gap_pct", "drv_teammate_quali_edge", "label", "quali_label"]
    return cut(d.select(*EVENT, "race_date", "race_seq", "entity", *cols))


def _quali_model(d: DataFrame) -> DataFrame:
    """Out-of-sample qualifying scores at each stage (column ``method``): before practice its inputs are hidden."""
    known = d.withColumn("method", F.lit("pre_quali"))
    hidden = lw.without_columns(d, ["fp_best_gap_pct"]).withColumn("method", F.lit("pre_practice"))
    return ev.oos_scores(d, d.select(*EV2), QUALI_TWO, "quali_label", 2.0, varied=known.unionByName(hidden))


def _before_grid(t: Tables, d: DataFrame, quali: DataFrame) -> DataFrame:
    """Race scores at the stages before a grid exists: the field that qualifying scores project, and three baselines."""
    cols = ["series", "season", "round", "race_seq", "entity", "position", "method", "score"]
    field = lw.projected_weekend(quali.withColumn("_q", F.col("score")).drop("score", "cutoff").withColumns({c: F.col(c).cast("double") for c in ("quali_position", "grid")}), "_q", ev.METHOD_EVENT)
    model = ev.oos_scores(d, d.select(*EV2), TWO, "label", 2.0, varied=field)
    model = model.withColumn("method", F.concat("method", F.lit(":model"))).select(*cols)
    base = baselines(t, BEFORE_GRID).join(ev.eligible(d), EV2, "left_semi").withColumn("stage", F.explode(F.array(*map(F.lit, STAGES))))
    base = base.withColumn("method", F.concat_ws(":", "stage", "method")).select(*cols)
    return cut(model.unionByName(base).withColumn("place", F.col("position").cast("double")))


def _stage_rows(t: Tables):
    """The four walk-forwards of a report as one table: race stages and the qualifying target, each from what it can know."""
    after = forward(t)[0].select("series", "race_seq", "method", F.col("win_logloss").alias("loss"), "position_error").withColumn("stage", F.lit("post_quali"))
    d = _stage_frame(t)
    quali = cut(_quali_model(d))
    early = forward(t, _before_grid(t, d, quali))[0]
    parts = F.split("method", ":")
    early = early.select("series", "race_seq", parts[1].alias("method"), F.col("win_logloss").alias("loss"), "position_error", parts[0].alias("stage"))
    graded = _quali_target(t, d, quali).select("series", "race_seq", "method", F.col("pole_logloss").alias("loss"), "position_error")
    return after.unionByName(early).unionByName(graded.withColumn("stage", F.lit("qualifying")))


def _quali_target(t: Tables, d: DataFrame, quali: DataFrame) -> DataFrame:
    """The qualifying model, practice known, and two baselines on the qualifying order."""
    cols = ["series", "season", "race_seq", "entity", "position", "method", "score"]
    model = quali.where("method = 'pre_quali'").withColumn("method", F.lit("model")).select(*cols)
    base = baselines(t, ("recent_form", "team_form")).join(ev.eligible(d), EV2, "left_semi").select(*cols)
    q = t.contest.select(*EV2, "entity", F.col("quali_position").cast("double").alias("quali_place"))
    scores = cut(model.unionByName(base).join(q, [*EV2, "entity"]))
    targets = ev.window_targets(ev.completed_events(scores.withColumn("round", F.col("race_seq")), 0), last_season(scores) - 1)
    return ev.walk_forward_quali(scores.drop("season"), targets, "quali_place")


OOS_WEIGHT = "greatest(pow(2.0, -(k.latest - a.season) / 2.0), 0.15)"
cte("oos_race_fit", fit_sql("SELECT * FROM oos_dates", weight=OOS_WEIGHT, before="a.race_date < k.cutoff"))
cte("stage_field", """SELECT f.series, f.season, f.round, make_date(f.season, f.round, 28) AS race_date, f.race_seq, f.entity, f.position, f.quali_position, f.drv_avg_finish_5, f.drv_avg_quali_5,
  p.fp_best_gap_pct FROM fa_entity f LEFT JOIN (SELECT series, race_seq, entity, fp_best_gap_pct FROM fp_gaps) p USING (series, race_seq, entity)""")
cte("quali_fit_rows", """SELECT *, row_number() OVER (PARTITION BY series, race_seq ORDER BY label DESC, entity) AS turn FROM
  (SELECT *, coalesce(drv_avg_quali_5, avg(drv_avg_quali_5) OVER ev, 0) AS g, coalesce(fp_best_gap_pct, avg(fp_best_gap_pct) OVER ev, 0) AS f5, greatest(24 - quali_position, 0) AS label
   FROM stage_field WHERE quali_position IS NOT NULL WINDOW ev AS (PARTITION BY series, race_seq))""")
cte("quali_fit", fit_sql("SELECT * FROM oos_dates", weight=OOS_WEIGHT, before="a.race_date < k.cutoff").replace("train_filled", "quali_fit_rows"))
cte("quali_scores", """SELECT *, (raw - avg(raw) OVER w) / CASE WHEN stddev_pop(raw) OVER w > 1e-9 THEN stddev_pop(raw) OVER w ELSE 1 END AS score FROM
  (SELECT s.*, c1 * coalesce(drv_avg_quali_5, avg(drv_avg_quali_5) OVER v, 0) + c2 * coalesce(fp, avg(fp) OVER v, 0) AS raw FROM
   (SELECT f.*, stage, CASE WHEN stage = 'pre_quali' THEN fp_best_gap_pct END AS fp FROM stage_field f, (VALUES ('pre_quali'), ('pre_practice')) x(stage)) s
   JOIN quali_fit c ON c.key = s.race_date WINDOW v AS (PARTITION BY series, race_seq, stage)) WINDOW w AS (PARTITION BY series, race_seq, stage)""")
cte("early_scores", """SELECT series, season, race_seq, entity, position, CAST(position AS DOUBLE) AS place, stage || ':model' AS method,
   (raw - avg(raw) OVER w) / CASE WHEN stddev_pop(raw) OVER w > 1e-9 THEN stddev_pop(raw) OVER w ELSE 1 END AS score FROM
   (SELECT s.* EXCLUDE (raw, score), c1 * row_number() OVER (PARTITION BY series, race_seq, stage ORDER BY s.score DESC, entity) + c2 * coalesce(drv_avg_finish_5, avg(drv_avg_finish_5) OVER (PARTITION BY series, race_seq, stage), 0) AS raw
    FROM quali_scores s JOIN oos_race_fit c ON c.key = s.race_date) WINDOW w AS (PARTITION BY series, race_seq, stage)
  UNION ALL SELECT series, season, race_seq, entity, position, place, stage || ':' || method, score FROM baselines SEMI JOIN oos_events USING (series, race_seq), (VALUES ('pre_quali'), ('pre_practice')) x(stage)
  WHERE method IN ('championship', 'recent_form', 'team_form')""")
cte("early_losses", losses_sql("early_scores"))
cte("early_t", rolling_sql("early_losses"))
cte("early_window", f"SELECT s.*, temperature FROM early_scores s JOIN early_t USING (series, method, race_seq) WHERE season >= {LAST} - 1")
cte("early_table", podium_sql("early_window"))
cte("early_rows", grade_sql("early_table", "early_window"))
cte("wp_scores", """SELECT s.series, s.season, s.race_seq, s.entity, s.method, s.score, CAST(c.quali_position AS DOUBLE) AS place FROM
  (SELECT series, season, race_seq, entity, 'model' AS method, score FROM quali_scores WHERE stage = 'pre_quali'
   UNION ALL SELECT series, season, race_seq, entity, method, score FROM baselines SEMI JOIN oos_events USING (series, race_seq) WHERE method IN ('recent_form', 'team_form')) s
  JOIN (SELECT series, race_seq, entity, quali_position FROM contest) c USING (series, race_seq, entity)""")
cte("wp_losses", losses_sql("wp_scores"))
cte("wp_t", rolling_sql("wp_losses"))
cte("wp_rows", f"""SELECT series, race_seq, method, any_value(season) AS season, any_value(temperature) AS temperature, avg(abs(pr - place)) AS position_error, -ln(greatest(arg_min(p, (place, entity)) FILTER (place IS NOT NULL), 1e-12)) AS loss FROM
  (SELECT s.*, temperature, row_number() OVER w AS pr, exp(score / temperature) / sum(exp(score / temperature)) OVER (PARTITION BY series, race_seq, method) AS p
   FROM wp_scores s JOIN wp_t USING (series, method, race_seq) WHERE season >= {LAST} - 1 WINDOW w AS (PARTITION BY series, race_seq, method ORDER BY score DESC, entity)) GROUP BY ALL""")
cte("stage_rows", """SELECT 'post_quali' AS stage, method, win_logloss AS loss, position_error FROM wf_rows UNION ALL SELECT 'qualifying', method, loss, position_error FROM wp_rows
  UNION ALL SELECT split_part(method, ':', 1), split_part(method, ':', 2), win_logloss, position_error FROM early_rows""")


@query("j4_quali_model", SM + "season:i temperature:d position_error:d pole_logloss:d", "SELECT *, loss AS pole_logloss FROM wp_rows")
def _(t):
    """The qualifying model against its baselines, each event scored from earlier dates."""
    d = _stage_frame(t)
    return _quali_target(t, d, _quali_model(d))


@query(
    "j3_before_grid", SM + "ndcg5:d winner_hit:i position_error:d win_logloss:d podium_brier:d", "SELECT * FROM early_rows"
)
def _(t):
    """The race walk-forward at the stages before a grid exists."""
    d = _stage_frame(t)
    return forward(t, _before_grid(t, d, cut(_quali_model(d))))[0]


@query(
    "j10_backtest_report",
    "stage:s method:s loss:d position_error:d n_events:i",
    "SELECT stage, method, avg(loss) AS loss, avg(position_error) AS position_error, count(*) AS n_events FROM stage_rows GROUP BY ALL",
)
def _(t):
    return ev.summary(_stage_rows(t), ("loss", "position_error"), ("stage", "method"))


# -- experiments: variants of one table against a reference ---------------------------------
def _variants(t: Tables, sets: dict[str, dict], place: str = "position") -> DataFrame:
    """Out-of-sample scores of model variants, one method each; the frame is built once."""
    d = cut(train_field(t))
    parts = [
        oos(t, d=d, **kw).withColumn("method", F.lit(name)).select(
            "series", "season", "round", "race_seq", "entity", "position", "place", "method", "score")
        for name, kw in sets.items()
    ]
    return cut(reduce(DataFrame.unionByName, parts))


def _compare(t: Tables, scores: DataFrame, reference: str, metrics=COMPARE) -> DataFrame:
    return mt.paired_comparison(cut(forward(t, scores)[0]), EV2, metrics, reference, replicates=R)


cte("cal_scores", """SELECT s.series, s.season, s.race_seq, s.entity, s.place, v.method, s.score,
  CASE v.method WHEN 'raw' THEN 1.0 WHEN 'fixed' THEN 0.35 ELSE t.temperature END AS temperature
  FROM wf_scores s JOIN wf_t t USING (series, method, race_seq), (VALUES ('raw'), ('fixed'), ('rolling')) v(method)
  WHERE s.method = 'model' AND s.season >= LAST - 1""".replace("LAST", LAST).replace("s.score,", "s.score, s.position,"))
cte("cal_table", table_sql(matrix_sql("cal_scores")))


@query(
    "j12_calibration_variants",
    "method:s win_logloss:d podium_brier:d n_events:i",
    f"SELECT method, avg(win_logloss) AS win_logloss, avg(podium_brier) AS podium_brier, count(*) AS n_events FROM ({grade_sql('cal_table', 'cal_scores')}) GROUP BY method",
)
def _(t):
    """Probability steps on one set of scores: the temperature rule is the variant."""
    scores = _all_scores(t, ())
    d = ev.with_temperatures(scores).where(F.col("season") >= last_season(scores) - 1)
    steps = F.inline(
        F.array(
            F.struct(F.lit("raw").alias("method"), F.lit(1.0).alias("temperature")),
            F.struct(F.lit("fixed").alias("method"), F.lit(0.35).alias("temperature")),
            F.struct(F.lit("rolling").alias("method"), F.col("_t").alias("temperature")),
        )
    )
    d = cut(d.withColumnRenamed("temperature", "_t").drop("method").select("series", "race_seq", "entity", "place", "score", steps))
    rows = ev.grade(d, ev.forecast_table(d))
    return ev.summary(rows, ("win_logloss", "podium_brier"))


cte("train_field_mean", f"""SELECT series, season, round, race_seq, entity, position, grid, {prior_values('finish_when_running', 'series, entity', 5)} AS drv_avg_finish_5,
  make_date(season, round, 28) AS race_date, greatest(24 - position, 0) AS label FROM outcomes""")
cte("train_filled_mean", CTES["train_filled"].replace("train_field", "train_field_mean"))
cte("definition_scores", f"SELECT *, 'median' AS method FROM ({oos_sql()}) UNION ALL SELECT *, 'mean' AS method FROM ({oos_sql(field='train_filled_mean')})")
cte("definition_losses", losses_sql("definition_scores"))
cte("definition_t", rolling_sql("definition_losses"))
cte("definition_window", f"SELECT s.*, temperature FROM definition_scores s JOIN definition_t USING (series, method, race_seq) WHERE season >= {LAST} - 1")
cte("definition_table", podium_sql("definition_window"))
cte("definition_rows", grade_sql("definition_table", "definition_window"))
cte("definition_diffs", diffs_sql("definition_rows", "median", COMPARE))


@query("j13_definition_experiment", PAIR, paired_sql("definition_diffs", COMPARE, "median"))
def _(t):
    """The same model on recent form defined as a median and as a mean."""
    parts = []
    for stat in ("median", "mean"):
        d = ft.add_form(t.outcomes, stat).withColumn("label", ft.relevance("position"))
        d = cut(dated(d).select(*EVENT, "race_date", "race_seq", "entity", "position", "grid", "drv_avg_finish_5", "label"))
        parts.append(oos(t, d=d).withColumn("method", F.lit(stat)).select(
            "series", "season", "round", "race_seq", "entity", "position", "place", "method", "score"))
    return _compare(t, cut(reduce(DataFrame.unionByName, parts)), "median")


@query(
    "j14a_decision",
    "method:s adopt:b",
    f"""SELECT method, bool_or(metric IN ('ndcg5') AND verdict = 'better') AND NOT bool_or(metric IN ('win_logloss', 'podium_brier') AND verdict = 'worse') AS adopt FROM
      (SELECT *, CASE WHEN ci_low > 0 THEN CASE WHEN metric IN ({LOW}) THEN 'worse' ELSE 'better' END WHEN ci_high < 0 THEN CASE WHEN metric IN ({LOW}) THEN 'better' ELSE 'worse' END
       ELSE 'unclear' END AS verdict FROM ({boot_sql('wf_diffs', 'series, race_seq', ['method'], list(COMPARE), R)})) GROUP BY method""",
)
def _(t):
    c = mt.paired_comparison(cut(forward(t)[0]), EV2, COMPARE, "grid", replicates=R)
    return ev.decide(c, ("ndcg5",), ("win_logloss", "podium_brier"))


cte("ret_scores", f"""SELECT w.series, w.season, w.race_seq, w.entity, w.position, w.place, v.method, w.score, w.temperature, dnf_prob
  FROM wf_window w JOIN (SELECT series, race_seq, entity, dnf_prob FROM dnf_field) USING (series, race_seq, entity), (VALUES ('one half'), ('both halves')) v(method) WHERE w.method = 'model'""")
cte("ret_one", "SELECT * FROM ret_scores WHERE method = 'one half'")
cte("ret_both", "SELECT * FROM ret_scores WHERE method = 'both halves'")
cte("ret_plain", f"{matrix_sql('ret_one')} UNION ALL {matrix_sql('ret_both', True)}")
cte("ret_drawn", matrix_sql("ret_scores", True))
cte("ret_table", table_sql("SELECT series, race_seq, method, entity, pos, 0.7 * p.share + 0.3 * q.share AS share FROM ret_plain p JOIN ret_drawn q USING (series, race_seq, method, entity, pos)"))
cte("ret_rows", grade_sql("ret_table", "ret_scores"))
cte("ret_diffs", diffs_sql("ret_rows", "one half", COMPARE))


@query("j14d_retirement_experiment", "method:s metric:s difference:d ci_low:d ci_high:d", paired_sql("ret_diffs", COMPARE, "one half"))
def _(t):
    """The retirement draw in both halves against one, on shared scores."""
    rates = dnf_field(t).select(*EV2, "entity", "dnf_prob")
    scores = _all_scores(t, ()).join(rates, [*EV2, "entity"])
    d = cut(ev.with_temperatures(scores).where(F.col("season") >= last_season(scores) - 1))
    parts = []
    for name, both in (("one half", False), ("both halves", True)):
        x = d.withColumn("method", F.lit(name))
        parts.append(ev.grade(x, ev.forecast_table(x, "dnf_prob", 0.7, both)))
    return mt.paired_comparison(cut(parts[0].unionByName(parts[1])), EV2, COMPARE, "one half", replicates=R)


cte("pairing_scores", f"SELECT *, 'whole field' AS method FROM ({oos_sql()}) UNION ALL SELECT *, 'top eight' AS method FROM ({oos_sql('a.turn <= 8')})")
cte("pairing_losses", losses_sql("pairing_scores"))
cte("pairing_t", rolling_sql("pairing_losses"))
cte("pairing_window", f"SELECT s.*, temperature FROM pairing_scores s JOIN pairing_t USING (series, method, race_seq) WHERE season >= {LAST} - 1")
cte("pairing_table", podium_sql("pairing_window"))
cte("pairing_rows", grade_sql("pairing_table", "pairing_window"))
cte("pairing_diffs", diffs_sql("pairing_rows", "whole field", COMPARE))


@query("j14f_pairing_experiment", PAIR, paired_sql("pairing_diffs", COMPARE, "whole field"))
def _(t):
    return _compare(t, _variants(t, {"whole field": {}, "top eight": {"top": 8}}), "whole field")


# -- redundancy and stability -----------------------------------------------------------------
cte("perm_fit", fit_sql("SELECT * FROM oos_dates", weight="greatest(pow(2.0, -(k.latest - a.season) / 2.0), 0.15)", before="a.race_date < k.cutoff"))
cte("perm_base", "SELECT *, row_number() OVER (PARTITION BY series, race_seq ORDER BY entity) AS i FROM train_field WHERE race_date IN (SELECT key FROM oos_dates)")


def _permuted(name: str) -> str:
    """The late field with one column moved by hashed order (or as it is)."""
    if name == "intact":
        return "SELECT series, race_seq, race_date, entity, position, CAST(grid AS DOUBLE) AS g, drv_avg_finish_5 AS f FROM perm_base"
    moved = f"""SELECT series, race_seq, {name} AS v, row_number() OVER (PARTITION BY series, race_seq ORDER BY {uniform_sql('perm-' + name, 'series', 'race_seq', 'entity')}, entity) AS i FROM perm_base"""
    cols = "CAST(m.v AS DOUBLE) AS g, b.drv_avg_finish_5 AS f" if name == "grid" else "CAST(b.grid AS DOUBLE) AS g, m.v AS f"
    return f"SELECT b.series, b.race_seq, b.race_date, b.entity, b.position, {cols} FROM perm_base b JOIN ({moved}) m USING (series, race_seq, i)"


cte("perm_ranks", " UNION ALL ".join(
    f"""SELECT '{n}' AS method, series, race_seq, entity, row_number() OVER (PARTITION BY series, race_seq ORDER BY raw DESC, entity) AS pr,
      row_number() OVER (PARTITION BY series, race_seq ORDER BY position, entity) AS tr FROM
      (SELECT x.*, round(c1 * g + c2 * coalesce(f, avg(f) OVER (PARTITION BY series, race_seq), 0), 12) AS raw FROM ({_permuted(n)}) x JOIN perm_fit p ON p.key = x.race_date)"""
    for n in ("intact", *TWO)))
cte("perm_rows", """SELECT method, series, race_seq, avg(abs(pr - tr)) AS position_error,
  sum(CASE WHEN pr <= 5 THEN 1 / log2(tr + 1) / log2(pr + 1) END) / sum(CASE WHEN tr <= 5 THEN 1 / log2(tr + 1) / log2(tr + 1) END) AS ndcg5 FROM perm_ranks GROUP BY ALL""")
cte("perm_diffs", diffs_sql("perm_rows", "intact", ("ndcg5", "position_error")))


@query(
    "j16_permutation_importance",
    "method:s metric:s difference:d ci_low:d ci_high:d",
    paired_sql("perm_diffs", ("ndcg5", "position_error"), "intact"),
)
def _(t):
    """Score with one feature group shuffled inside each event, against the model as it is."""
    d = cut(train_field(t))
    parts = [d.withColumn("method", F.lit("intact"))]
    parts += [ev.shuffle_within_events(d, [f], f"perm-{f}").withColumn("method", F.lit(f)) for f in TWO]
    varied = reduce(DataFrame.unionByName, parts)
    scores = cut(ev.oos_scores(d, d.select(*EV2), TWO, "label", 2.0, varied=varied)).withColumns({"place": F.col("position").cast("double"), "score": F.round("score", 10)})
    order = F.row_number().over(lw.W.partitionBy(*ev.METHOD_EVENT).orderBy(F.desc("score"), "entity"))
    rows = mt.ranking(scores.withColumns({"pred": order, "actual": F.col("place")}), ev.METHOD_EVENT)
    return mt.paired_comparison(cut(rows), EV2, ("ndcg5", "position_error"), "intact", replicates=R)


cte("entries", """SELECT *, actual_rank - predicted_rank AS error FROM (SELECT series, race_seq, entity,
  row_number() OVER (PARTITION BY series, race_seq ORDER BY score DESC, entity) AS predicted_rank,
  row_number() OVER (PARTITION BY series, race_seq ORDER BY place, entity) AS actual_rank FROM oos_scores)""")


@query("j19_entry_errors", "series:i race_seq:i entity:i predicted_rank:i actual_rank:i error:i", "SELECT * FROM entries")
def _(t):
    return ev.entry_errors(oos(t))


cte("bias_base", f"""SELECT series, entity, count(*) AS events, avg(error) AS raw_bias, avg(abs(error)) AS mean_abs_error, avg(predicted_rank) AS avg_predicted FROM entries GROUP BY ALL HAVING count(*) >= {MIN_BIAS_EVENTS}""")


@query(
    "j20_entity_bias",
    "series:i entity:i events:i raw_bias:d mean_abs_error:d expected_from_rank:d entity_bias:d",
    """SELECT b.*, i + s * avg_predicted AS expected_from_rank, raw_bias - (i + s * avg_predicted) AS entity_bias FROM bias_base b
      JOIN (SELECT series, regr_slope(raw_bias, avg_predicted) AS s, regr_intercept(raw_bias, avg_predicted) AS i FROM bias_base GROUP BY series) USING (series)""",
)
def _(t):
    return ev.entity_bias(ev.entry_errors(oos(t)), MIN_BIAS_EVENTS)


@query(
    "j21_trend_strength",
    "series:i r:d r2:d n:i",
    "SELECT series, corr(avg_predicted, raw_bias) AS r, corr(avg_predicted, raw_bias) ** 2 AS r2, count(*) AS n FROM bias_base GROUP BY series",
)
def _(t):
    return ev.bias_trend(ev.entity_bias(ev.entry_errors(oos(t)), MIN_BIAS_EVENTS))
