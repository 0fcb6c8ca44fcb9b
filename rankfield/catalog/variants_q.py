"""J11, J14b, J14c, J14e, J14g, J17: variants of the whole models, from one set of normal equations each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..constants import BLEND_CANDIDATES, CLASS_FEATURES, PRACTICE_DETAIL_FEATURES, PRACTICE_FEATURES, QUALI_FEATURES, RACE_FEATURES, RECENCY_CANDIDATES
from ..operators import listwise as lw, metrics as mt
from ..plans import evaluate as ev, features as ft, variants as vr
from ..plans.variants import Variant
from ..session import cut, kept
from ..sources.contest import EVENT, Tables
from .evaluate_q import BEFORE_GRID, COMPARE, EV2, LAST, R, diffs_sql, grade_sql, last_season, losses_sql, podium_sql, rolling_sql
from .metrics_q import BETTER_SQL, LOW, boot_sql
from .ranker_q import dated
from .registry import query
from .listwise_q import GRID_SQL, METHODS, baselines
from .sqlbase import cte, exact_sql

CIRCUIT = ("drv_circuit_avg_finish", "team_circuit_avg_finish", "circuit_overtaking_score", "circuit_dnf_rate", "drv_circuit_starts", "circuit_pole_win_rate", "season_progress")
GROUPS = {
    "qualifying": ("quali_position", "quali_gap_to_pole_pct"),
    "team form": tuple(f for f in RACE_FEATURES if f.startswith("team_") and f not in CIRCUIT),
    "circuit": CIRCUIT,
}
GROUPS["entrant form"] = tuple(f for f in RACE_FEATURES if f != "grid" and not any(f in cols for cols in GROUPS.values()))
CANDIDATES = {
    "qualifying form": ("drv_avg_grid_5", "drv_avg_quali_5", "drv_pole_rate_10", "drv_pace_gap_pct"),
    "teammate": ("quali_gap_to_teammate_pct", "drv_teammate_quali_edge"),
}


def whole(t: Tables) -> DataFrame:
    """Every feature and label of the events that have run."""
    return kept(dated(ft.build(t, upcoming=False)))


# -- the same in SQL: one system of equations per (date, variant), solved by elimination -------------
def system_ctes(p: str, src: str, variants: Mapping[str, Variant], label: str, gain: str | None = None, scored: str | None = None, dates: str = "oos_dates") -> None:
    """``{p}_scores``: out-of-sample scores (method) of the variants on ``scored`` (default ``src``); a model for each of ``dates``."""
    features = list(dict.fromkeys(f for v in variants.values() for f in v.features))
    n = len(features)
    inputs = ", ".join(f"coalesce(CAST({f} AS DOUBLE), avg({f}) OVER ev, 0)" for f in features)
    cte(f"{p}_t", f"SELECT series, season, race_seq, race_date, entity, CAST({label} AS DOUBLE) AS y, [{inputs}, CAST({label} AS DOUBLE)] AS x FROM {src} WHERE {label} IS NOT NULL WINDOW ev AS (PARTITION BY series, race_seq)")
    cte(f"{p}_l", f"SELECT * EXCLUDE (x), x[i] - avg(x[i]) OVER (PARTITION BY series, race_seq, i) AS v, count(*) OVER (PARTITION BY series, race_seq, i) AS n FROM {p}_t, unnest(range(1, {n + 2})) u(i)")
    if gain is None:
        cte(f"{p}_w", f"SELECT a.season, a.race_date, a.i, b.i AS j, sum(2.0 / (a.n - 1) * a.v * b.v) AS v FROM {p}_l a JOIN {p}_l b USING (series, race_seq, entity) WHERE a.n > 1 AND a.i <= {n} GROUP BY ALL")
        cte(f"{p}_n", f"SELECT season, race_date, sum(2.0 / (n - 1)) AS v FROM {p}_l WHERE i = 1 AND n > 1 GROUP BY ALL")
    else:  # explicit pairs
        worth = "y" if gain == "linear" else "pow(2, y) - 1"
        cte(f"{p}_r", f"SELECT *, {worth} AS g, row_number() OVER (PARTITION BY series, race_seq ORDER BY y DESC, entity) AS turn FROM {p}_t")
        cte(f"{p}_p", f"""SELECT *, w / sum(w) OVER (PARTITION BY series, race_seq) AS share FROM (SELECT a.series, a.season, a.race_seq, a.race_date, list_transform(range(1, {n + 2}), lambda k: a.x[k] - b.x[k]) AS z,
          (a.g - b.g) * (1 / log2(1 + a.turn) - 1 / log2(1 + b.turn)) AS w FROM {p}_r a JOIN {p}_r b ON a.series = b.series AND a.race_seq = b.race_seq AND a.turn < b.turn) WHERE w > 0""")
        cte(f"{p}_w", f"SELECT season, race_date, i, j, sum(share * z[i] * z[j]) AS v FROM {p}_p, unnest(range(1, {n + 1})) u(i), unnest(range(1, {n + 2})) o(j) GROUP BY ALL")
        cte(f"{p}_n", f"SELECT season, race_date, 2.0 * sum(share) AS v FROM {p}_p GROUP BY ALL")
    share = "CASE WHEN recency IS NULL THEN 1 ELSE greatest(pow(recency, -(k.latest - a.season) / 2.0), 0.15) END"
    rows = ", ".join(f"('{m}', {v.ridge}, {'NULL' if v.recency is None else v.recency}, [{', '.join(str(features.index(f) + 1) for f in v.features)}])" for m, v in variants.items())
    cte(f"{p}_v", f"SELECT method, ridge, CAST(recency AS DOUBLE) AS recency, has FROM (VALUES {rows}) v(method, ridge, recency, has)")
    cte(f"{p}_k", f"SELECT key, cutoff, latest, recency FROM {dates}, (SELECT DISTINCT recency FROM {p}_v)")
    cte(f"{p}_s", f"SELECT key, recency, i, j, sum({share} * v) AS v FROM {p}_k k JOIN {p}_w a ON a.race_date < k.cutoff GROUP BY ALL")
    cte(f"{p}_all", f"SELECT key, recency, sum({share} * v) AS total FROM {p}_k k JOIN {p}_n a ON a.race_date < k.cutoff GROUP BY ALL")
    cte(f"{p}_m", f"""SELECT key, method, i, j, CASE WHEN NOT list_contains(has, i) THEN CAST(i = j AS INT)::DOUBLE WHEN j <= {n} AND NOT list_contains(has, j) THEN 0.0
      WHEN i = j THEN v + ridge * total ELSE v END AS v FROM {p}_s s JOIN {p}_all a USING (key, recency) JOIN {p}_v w ON s.recency IS NOT DISTINCT FROM w.recency""".replace("USING (key, recency)", "ON s.key = a.key AND s.recency IS NOT DISTINCT FROM a.recency").replace("SELECT key,", "SELECT s.key,"))
    cte(f"{p}_g", f"""WITH RECURSIVE g AS (SELECT key, method, i, j, v, 0 AS k FROM {p}_m UNION ALL SELECT key, method, i, j, CASE WHEN i = k + 1 THEN v / piv ELSE v - col * row / piv END, k + 1 FROM
      (SELECT *, max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER (PARTITION BY key, method) AS piv, max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY key, method, i) AS col,
        max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY key, method, j) AS row FROM g WHERE k < {n}))
      SELECT key, method, list(v ORDER BY i) AS c FROM g WHERE k = {n} AND j = {n + 1} GROUP BY ALL""")
    score_ctes(p, scored or src, features)


def score_ctes(p: str, src: str, features: Sequence[str], out: str = "scores", view: str | None = None) -> None:
    by = "series, race_seq" + (f", {view}" if view else "")
    inputs = ", ".join(f"coalesce(CAST({f} AS DOUBLE), avg({f}) OVER ev, 0)" for f in features)
    cte(f"{p}_x_{out}", f"SELECT *, [{inputs}] AS x FROM {src} WINDOW ev AS (PARTITION BY {by})")
    method = f"x.{view} || ':' || c.method" if view else "c.method"
    cte(f"{p}_{out}", f"""SELECT * EXCLUDE (raw), CAST(position AS DOUBLE) AS place, (raw - avg(raw) OVER w) / CASE WHEN stddev_pop(raw) OVER w > 1e-9 THEN stddev_pop(raw) OVER w ELSE 1 END AS score FROM
      (SELECT x.* EXCLUDE (x), {method} AS method, list_dot_product(x.x, c.c) AS raw FROM {p}_x_{out} x JOIN {p}_g c ON c.key = x.race_date) WINDOW w AS (PARTITION BY series, race_seq, method)""")


def graded_ctes(p: str, scores: str) -> None:
    """``{p}_rows``: the graded events of both windows."""
    cte(f"{p}_losses", losses_sql(scores))
    cte(f"{p}_temps", rolling_sql(f"{p}_losses"))
    cte(f"{p}_window", f"SELECT s.*, temperature FROM {scores} s JOIN {p}_temps USING (series, method, race_seq) WHERE season >= {LAST} - 1")
    cte(f"{p}_table", podium_sql(f"{p}_window"))
    cte(f"{p}_rows", f"""SELECT *, CASE WHEN season < {LAST} THEN 'tuning' ELSE 'later' END AS "window" FROM ({grade_sql(f'{p}_table', f'{p}_window')})
      JOIN (SELECT DISTINCT series, race_seq, method, season FROM {p}_window) USING (series, race_seq, method)""")


def paired_windows(rows: str, metrics: Sequence[str], ref: str) -> str:
    diffs = f"""(SELECT a.series, a.race_seq, a.method, a."window", {', '.join(f'a.{m} - b.{m} AS {m}' for m in metrics)} FROM {rows} a JOIN {rows} b USING (series, race_seq) WHERE a.method <> '{ref}' AND b.method = '{ref}')"""
    return f"""SELECT "window", method, metric, mean AS difference, ci_low, ci_high, {BETTER_SQL.format(low=LOW, a='method', b=f"'{ref}'")} AS better
      FROM ({boot_sql(diffs, 'series, race_seq', ['"window"', 'method'], list(metrics), R)})"""


WPAIR = "window:s method:s metric:s difference:d ci_low:d ci_high:d better:s"
RACE_COLUMNS = ["series", "season", "race_seq", "entity", "position", "place", "method", "score"]


def race_scores(d: DataFrame, variants: Mapping[str, Variant], label: str = "race_relevance", **kw) -> DataFrame:
    out = vr.variant_scores(d, d.select(*EV2), variants, label, **kw)
    return cut(out.withColumn("place", F.col("position").cast("double")).select(*RACE_COLUMNS))


def graded(scores: DataFrame) -> DataFrame:
    """The race walk-forward of the last two seasons, by window."""
    last = last_season(scores)
    targets = ev.window_targets(ev.completed_events(scores.withColumn("round", F.col("race_seq")), 0), last - 1)
    return cut(vr.windowed(ev.walk_forward(scores.drop("season"), targets)[0], last))


def compared(rows: DataFrame, reference: str, metrics: Sequence[str] = COMPARE) -> DataFrame:
    return mt.paired_comparison(rows, EV2, metrics, reference, replicates=R, by=["window"])


# -- J11: which inputs carry the forecast -----------------------------------------------------------
ABLATION = vr.ablation_sets(RACE_FEATURES, GROUPS, CANDIDATES)
ABLATION["grid + entrant form + team form"] = Variant(("grid", *GROUPS["entrant form"], *GROUPS["team form"]))
cte("whole_run", """SELECT *, make_date(season, round, 28) AS race_date, greatest(24 - position, 0) AS race_relevance,
  CASE WHEN quali_position IS NOT NULL THEN greatest(24 - quali_position, 0) END AS quali_relevance FROM features_all WHERE position IS NOT NULL""")
system_ctes("abl", "whole_run", ABLATION, "race_relevance")
graded_ctes("abl", "abl_scores")


@query("j11_ablation", WPAIR, paired_windows("abl_rows", COMPARE, "full"))
def _(t):
    """The grid alone, with each group, the full model of 27 inputs, without each group and with each candidate, on both windows."""
    return compared(graded(race_scores(whole(t), ABLATION)), "full")


# -- J17: is the choice of penalty stable --------------------------------------------------------------
RIDGES = {f"ridge {r}": Variant(tuple(RACE_FEATURES), r) for r in (0.001, 0.01, 0.1, 1.0)}
RIDGES |= {"ridge 0.01, all seasons alike": Variant(tuple(RACE_FEATURES), 0.01, None), "ridge 0.01, steeper recency": Variant(tuple(RACE_FEATURES), 0.01, 4.0)}
system_ctes("rdg", "whole_run", RIDGES, "race_relevance")
cte("rdg_seen", f"""SELECT *, CASE WHEN season < {LAST} THEN 'tuning' ELSE 'later' END AS "window" FROM rdg_scores WHERE season >= {LAST} - 1""")
cte("rdg_losses", losses_sql("rdg_seen"))
cte("rdg_best", """SELECT "window", method, m.l AS win_logloss, m.t AS temperature FROM (SELECT "window", method, min({'l': round(loss, 10), 't': temperature}) AS m FROM
  (SELECT "window", method, temperature, avg(loss) AS loss FROM rdg_losses JOIN (SELECT DISTINCT series, race_seq, "window" FROM rdg_seen) USING (series, race_seq) GROUP BY ALL) GROUP BY ALL)""")
cte("rdg_order", """SELECT "window", method, avg(n) AS ndcg5, count(*) AS n_events FROM (SELECT "window", method, series, race_seq,
  sum(CASE WHEN pr <= 5 THEN 1 / log2(tr + 1) / log2(pr + 1) END) / sum(CASE WHEN tr <= 5 THEN 1 / log2(tr + 1) / log2(tr + 1) END) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY series, race_seq, method ORDER BY score DESC, entity) AS pr, row_number() OVER (PARTITION BY series, race_seq, method ORDER BY place, entity) AS tr FROM rdg_seen)
  GROUP BY ALL) GROUP BY ALL""")


@query("j17_parameter_stability", "window:s method:s temperature:d win_logloss:d ndcg5:d n_events:i",
       """SELECT * FROM rdg_best JOIN rdg_order USING ("window", method)""")
def _(t):
    """Candidates on two windows: order quality, and the winner's loss at the temperature that fits the window best."""
    scores = race_scores(whole(t), RIDGES)
    last = last_season(scores)
    seen = cut(vr.windowed(scores.where(F.col("season") >= last - 1), last))
    losses = lw.temperature_losses(seen, "score", "place", event=ev.METHOD_EVENT, keep=("window",))
    best = lw.fit_temperature(losses, ["window", "method"]).withColumnRenamed("loss", "win_logloss")
    order = F.row_number().over(lw.W.partitionBy(*ev.METHOD_EVENT).orderBy(F.desc("score"), "entity"))
    ranks = mt.ranking(seen.withColumns({"pred": order, "actual": F.col("place")}), [*ev.METHOD_EVENT, "window"])
    return ev.summary(ranks, ("ndcg5",), ("window", "method")).join(best, ["window", "method"])


# -- J14c: how the qualifying model weighs pairs -----------------------------------------------------------
HISTORY = tuple(f for f in QUALI_FEATURES if f not in {*PRACTICE_FEATURES, *PRACTICE_DETAIL_FEATURES})
QUALI_KEEP = ("pole_logloss", "ndcg5", "position_error")
QUALI_METRICS = ("pole_logloss", "ndcg5", "position_error")
ORDER_FORMS = {"mean": tuple(QUALI_FEATURES), "median": tuple({"drv_avg_quali_3": "median_quali_3", "drv_avg_quali_5": "median_quali_5"}.get(f, f) for f in QUALI_FEATURES)}
GAINS = ("exponential", "linear")


def _median(k: int) -> str:
    return f"median(quali_position) OVER (PARTITION BY series, entity ORDER BY race_seq ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


cte("median_run", f"SELECT *, {_median(3)} AS median_quali_3, {_median(5)} AS median_quali_5 FROM whole_run")
for _gain in GAINS:
    system_ctes(f"qo_{_gain[:3]}", "median_run", {f"{_gain} {form}": Variant(cols) for form, cols in ORDER_FORMS.items()}, "quali_relevance", _gain)
cte("qo_scores", " UNION ALL ".join(f"SELECT series, season, race_seq, entity, method, score, CAST(quali_position AS DOUBLE) AS place FROM qo_{g[:3]}_scores" for g in GAINS))


def quali_rows_ctes(p: str, scores: str) -> None:
    """``{p}_rows``: graded qualifying events of both windows (pole loss, order, error)."""
    m = "series, race_seq, method"
    cte(f"{p}_losses", losses_sql(scores))
    cte(f"{p}_temps", rolling_sql(f"{p}_losses"))
    cte(f"{p}_rows", f"""SELECT {m}, any_value(season) AS season, CASE WHEN any_value(season) < {LAST} THEN 'tuning' ELSE 'later' END AS "window", avg(abs(pr - place)) AS position_error,
      -ln(greatest(arg_min(p, (place, entity)) FILTER (place IS NOT NULL), 1e-12)) AS pole_logloss,
      sum(CASE WHEN pt <= 5 AND tr IS NOT NULL THEN 1 / log2(tr + 1) / log2(pt + 1) END) / sum(CASE WHEN tr <= 5 THEN 1 / log2(tr + 1) / log2(tr + 1) END) AS ndcg5 FROM
      (SELECT *, CASE WHEN place IS NOT NULL THEN row_number() OVER (PARTITION BY {m}, place IS NULL ORDER BY place, entity) END AS tr,
        CASE WHEN place IS NOT NULL THEN row_number() OVER (PARTITION BY {m}, place IS NULL ORDER BY pr, entity) END AS pt FROM
       (SELECT s.*, temperature, row_number() OVER w AS pr, exp(score / temperature) / sum(exp(score / temperature)) OVER (PARTITION BY {m}) AS p
        FROM {scores} s JOIN {p}_temps USING (series, method, race_seq) WHERE season >= {LAST} - 1 WINDOW w AS (PARTITION BY {m} ORDER BY score DESC, entity))) GROUP BY {m}""")


quali_rows_ctes("qo", "qo_scores")


def quali_scores(d: DataFrame, variants: Mapping[str, Variant], **kw) -> DataFrame:
    out = vr.variant_scores(d, d.select(*EV2), variants, "quali_relevance", **kw)
    return out.withColumn("place", F.col("quali_position").cast("double")).select(*[c for c in RACE_COLUMNS if c != "position"])


def quali_graded(scores: DataFrame) -> DataFrame:
    last = last_season(scores)
    targets = ev.window_targets(ev.completed_events(scores.withColumn("round", F.col("race_seq")), 0, place="place"), last - 1)
    return cut(vr.windowed(ev.walk_forward_quali(scores.drop("season"), targets, "place"), last))


def verdicts(table: DataFrame, keep: Sequence[str], guard: Sequence[str]) -> DataFrame:
    """Whether a variant passes on the tuning window, holds on the later one, and both."""
    d = table.withColumn("verdict", mt.clear_verdict())
    early, good, bad = F.col("window") == "tuning", F.col("metric").isin(*keep) & (F.col("verdict") == "better"), F.col("metric").isin(*guard) & (F.col("verdict") == "worse")
    passes = F.bool_or(early & good) & ~F.bool_or(early & bad)
    holds = ~F.bool_or(~early & bad)
    return d.groupBy("method").agg(passes.alias("passes_tuning"), holds.alias("holds_later"), (passes & holds).alias("adopt"))


def verdicts_sql(paired: str, keep: Sequence[str], guard: Sequence[str]) -> str:
    named = lambda ms: ", ".join(f"'{m}'" for m in ms)
    return f"""SELECT method, pass AND NOT fail AS passes_tuning, NOT late AS holds_later, pass AND NOT fail AND NOT late AS adopt FROM (SELECT method,
      bool_or("window" = 'tuning' AND metric IN ({named(keep)}) AND v = 'better') AS pass, bool_or("window" = 'tuning' AND metric IN ({named(guard)}) AND v = 'worse') AS fail,
      bool_or("window" = 'later' AND metric IN ({named(guard)}) AND v = 'worse') AS late FROM (SELECT *, CASE WHEN better = 'unclear' THEN 'unclear' WHEN better = method THEN 'better' ELSE 'worse' END AS v
       FROM ({paired})) GROUP BY method)"""


def _orders(t: Tables) -> DataFrame:
    d = whole(t)
    d = cut(ft.prior_rolling(d, ["series", "entity"], "race_seq", {f"median_quali_{k}": ("quali_position", k, "median") for k in (3, 5)}))
    parts = [quali_scores(d, {f"{g} {form}": Variant(cols) for form, cols in ORDER_FORMS.items()}, gain=g) for g in GAINS]
    return quali_graded(cut(parts[0].unionByName(parts[1])))


_QO = paired_windows("qo_rows", QUALI_METRICS, "exponential mean")


@query("j14c_quali_ordering", WPAIR, _QO)
def _(t):
    """Pairs weighed by exponential or linear gains, recent qualifying as a mean or a median, on both windows."""
    return compared(_orders(t), "exponential mean", QUALI_METRICS)


@query("j14c_verdict", "method:s passes_tuning:b holds_later:b adopt:b", verdicts_sql(_QO, QUALI_KEEP, QUALI_METRICS))
def _(t):
    return verdicts(compared(_orders(t), "exponential mean", QUALI_METRICS), QUALI_KEEP, QUALI_METRICS)


# -- before qualifying: the full qualifying model projects the grid -----------------------------------------
QUALI_MODEL = {"quali": Variant(tuple(QUALI_FEATURES))}
system_ctes("qm", "whole_run", QUALI_MODEL, "quali_relevance")
PROJECTED = """SELECT w.* REPLACE (row_number() OVER (PARTITION BY w.series, w.race_seq ORDER BY q.score DESC, w.entity) AS grid,
  row_number() OVER (PARTITION BY w.series, w.race_seq ORDER BY q.score DESC, w.entity) AS quali_position, drv_pace_gap_pct AS quali_gap_to_pole_pct,
  drv_teammate_quali_edge AS quali_gap_to_teammate_pct), 'pre_quali' AS stage FROM {0} w JOIN (SELECT series, race_seq, entity, score FROM qm_scores) q USING (series, race_seq, entity)"""
cte("early_run", PROJECTED.format("whole_run"))


def projected(d: DataFrame) -> DataFrame:
    quali = vr.variant_scores(d, d.select(*EV2), QUALI_MODEL, "quali_relevance")
    return vr.before_qualifying(d, quali).withColumn("view", F.lit("pre_quali"))


EARLY = {name: v for name, v in ABLATION.items() if name == "full" or name.startswith("full + ")}
score_ctes("abl", "early_run", list(dict.fromkeys(f for v in ABLATION.values() for f in v.features)), "early", "stage")
cte("abe_scores", f"SELECT * FROM abl_early WHERE method IN ({', '.join(repr('pre_quali:' + n) for n in EARLY)})")
graded_ctes("abe", "abe_scores")


@query("j11_pre_quali_ablation", WPAIR, paired_windows("abe_rows", COMPARE, "pre_quali:full"))
def _(t):
    """The candidates again before qualifying, where the grid columns hold the projected order."""
    d = whole(t)
    return compared(graded(race_scores(d, EARLY, varied=projected(d))), "pre_quali:full")


# -- J14e: the class of the venue, at two stages ------------------------------------------------------------
CLASSED = {"without": Variant(tuple(RACE_FEATURES)), "with": Variant((*RACE_FEATURES, *CLASS_FEATURES))}
cte("classed_run", """SELECT w.*, street_circuit, drv_type_avg_finish, team_type_avg_finish FROM whole_run w JOIN venue_classed USING (series, race_seq, entity)""")
cte("class_run", "SELECT *, CAST(venue % 100 IN (2, 5, 7, 11) AS INT) AS street_circuit FROM whole_run")


def _prior(by: str) -> str:
    from .sqlbase import prior_values

    return prior_values("finish_when_running" if "entity" in by else "pace", by, 10)


cte("venue_classed", f"""SELECT series, race_seq, entity, street_circuit, drv_type_avg_finish, team_type_avg_finish FROM
  (SELECT *, {_prior('series, entity, street_circuit')} AS drv_type_avg_finish FROM class_run) JOIN (SELECT series, team, street_circuit, race_seq, {_prior('series, team, street_circuit')} AS team_type_avg_finish
   FROM (SELECT series, team, street_circuit, race_seq, avg(finish_when_running) AS pace FROM class_run GROUP BY ALL)) USING (series, team, street_circuit, race_seq)""")
system_ctes("cls", "classed_run", CLASSED, "race_relevance")
cte("class_early", PROJECTED.format("classed_run"))
_CLASS_INPUTS = [*RACE_FEATURES, *CLASS_FEATURES]
score_ctes("cls", "class_early", _CLASS_INPUTS, "early", "stage")
cte("cls_both", """SELECT series, season, race_seq, entity, position, place, 'post_quali:' || method AS method, score FROM cls_scores
  UNION ALL SELECT series, season, race_seq, entity, position, place, method, score FROM cls_early""")
graded_ctes("cls2", "cls_both")
cte("cls_rows", "SELECT * REPLACE (split_part(method, ':', 2) AS method), split_part(method, ':', 1) AS stage FROM cls2_rows")
cte("cls_diffs", f"""SELECT a.series, a.race_seq, a.stage, a."window", a.method, {', '.join(f'a.{m} - b.{m} AS {m}' for m in COMPARE)}
  FROM cls_rows a JOIN cls_rows b USING (series, race_seq, stage) WHERE a.method = 'with' AND b.method = 'without'""")


@query("j14e_venue_class_experiment", "stage:s " + WPAIR, f"""SELECT stage, "window", method, metric, mean AS difference, ci_low, ci_high,
  {BETTER_SQL.format(low=LOW, a='method', b="'without'")} AS better FROM ({boot_sql('cls_diffs', 'series, race_seq', ['stage', '"window"', 'method'], list(COMPARE), R)})""")
def _(t):
    """The race model with and without form at venues of the same class, at both stages, on both windows."""
    d = cut(ft.add_venue_class(whole(t), (F.col("venue") % 100).isin(2, 5, 7, 11)))
    views = d.withColumn("view", F.lit("post_quali")).unionByName(projected(d))
    rows = graded(race_scores(d, CLASSED, varied=views))
    parts = F.split("method", ":")
    rows = cut(rows.withColumns({"stage": parts[0], "method": parts[1]}))
    return mt.paired_comparison(rows, EV2, COMPARE, "without", replicates=R, by=["stage", "window"])


# -- J14b: designs picked on one window, checked on the other --------------------------------------------------
DESIGNS = {"history": Variant(HISTORY), "compact": Variant((*HISTORY, *PRACTICE_FEATURES)), "detailed": Variant((*HISTORY, *PRACTICE_FEATURES, *PRACTICE_DETAIL_FEATURES))}
PRACTICE_KEEP, PRACTICE_GUARD = ("ndcg5", "position_error"), ("ndcg5", "position_error", "pole_logloss")
system_ctes("dsg", "whole_run", DESIGNS, "quali_relevance")
cte("practised", "SELECT series, race_seq FROM whole_run GROUP BY ALL HAVING max(practice_available) > 0")
cte("dsg_seen", "SELECT series, season, race_seq, entity, method, score, CAST(quali_position AS DOUBLE) AS place FROM dsg_scores SEMI JOIN practised USING (series, race_seq)")
quali_rows_ctes("dsg", "dsg_seen")


def picked_sql(paired: str, metric: str, keep: Sequence[str], guard: Sequence[str], lower: bool = False) -> str:
    named = lambda ms: ", ".join(f"'{m}'" for m in ms)
    return f"""SELECT method, gain, n = 1 AS picked, n = 1 AND good AND NOT bad AS adopt FROM (SELECT *, row_number() OVER (ORDER BY round(gain, 10) DESC NULLS LAST, method) AS n FROM
      (SELECT method, max({'-' if lower else ''}difference) FILTER ("window" = 'tuning' AND metric = '{metric}') AS gain, bool_or("window" = 'later' AND metric IN ({named(keep)}) AND better = method) AS good,
        bool_or("window" = 'later' AND metric IN ({named(guard)}) AND better <> method AND better <> 'unclear') AS bad FROM ({paired}) GROUP BY method))"""


PICK = "method:s gain:d picked:b adopt:b"


def _practised(d: DataFrame) -> DataFrame:
    return d.where("practice_available > 0").select(*EV2).distinct()


@query("j14b_practice_experiment", PICK, picked_sql(paired_windows("dsg_rows", PRACTICE_GUARD, "history"), "ndcg5", PRACTICE_KEEP, PRACTICE_GUARD))
def _(t):
    """The practice design that gains most on the tuning window, checked on the later one."""
    d = whole(t)
    scores = quali_scores(d, DESIGNS).join(_practised(d), EV2, "left_semi")
    return vr.picked(compared(quali_graded(cut(scores)), "history", PRACTICE_GUARD), "ndcg5", PRACTICE_KEEP, PRACTICE_GUARD)


PRACTISED = {"race model": Variant(tuple(RACE_FEATURES)), "race model + practice": Variant((*RACE_FEATURES, *PRACTICE_FEATURES))}
system_ctes("prc", "whole_run", PRACTISED, "race_relevance")
graded_ctes("prc", "prc_scores")
cte("prc_seen", "SELECT * FROM prc_rows SEMI JOIN practised USING (series, race_seq)")


@query("j14b_race_half", WPAIR, paired_windows("prc_seen", COMPARE, "race model"))
def _(t):
    """What practice adds to the race model once the grid is known, on the events that had it."""
    d = whole(t)
    rows = graded(race_scores(d, PRACTISED)).join(_practised(d), EV2, "left_semi")
    return compared(cut(rows), "race model")


# -- J14g: a weight picked on one window, graded on the other ----------------------------------------------------
WEIGHTS = (0.25, 0.5, 1.0)
_SQ = "OVER (PARTITION BY series, race_seq)"
cte("spr_scores", f"""SELECT s.series, s.season, s.race_seq, s.entity, s.score, CAST(s.quali_position AS DOUBLE) AS place, k.sq_position FROM qm_scores s
  LEFT JOIN (SELECT series, season, round, entity, sq_position FROM sprint_known) k USING (series, season, round, entity)""")
cte("spr_all", f"""SELECT series, season, race_seq, entity, place, CASE WHEN weight = 0 THEN 'model alone' ELSE 'w=' || weight END AS method,
  CASE WHEN n >= 2 AND weight > 0 THEN (o - avg(o) {_SQ[:-1]}, weight)) / coalesce(nullif(stddev_pop(o) {_SQ[:-1]}, weight), 0), 1) * coalesce(nullif(stddev_pop(score) {_SQ[:-1]}, weight), 0), 1) ELSE score END AS score FROM
  (SELECT *, score + weight * -(sq - avg(sq) {_SQ}) / coalesce(nullif(stddev_samp(sq) {_SQ}, 0), 1) AS o FROM
   (SELECT *, count(sq_position) {_SQ} AS n, CAST(coalesce(sq_position, max(sq_position) {_SQ} + 1) AS DOUBLE) AS sq FROM spr_scores) JOIN (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS weight) ON true)""".replace(
    "avg(sq) " + _SQ, "avg(sq) " + _SQ[:-1] + ", weight)").replace("stddev_samp(sq) " + _SQ, "stddev_samp(sq) " + _SQ[:-1] + ", weight)"))
cte("spr_with", "SELECT DISTINCT series, race_seq FROM spr_scores WHERE sq_position IS NOT NULL")
quali_rows_ctes("spr", "spr_all")
cte("spr_seen", "SELECT * FROM spr_rows SEMI JOIN spr_with USING (series, race_seq)")


@query("j14g_sprint_experiment", PICK, picked_sql(paired_windows("spr_seen", QUALI_METRICS, "model alone"), "position_error", QUALI_KEEP, QUALI_METRICS, True))
def _(t):
    """The weight on the sprint order with the least position error on the tuning window's sprint events, graded on the later ones."""
    d = whole(t)
    sq = ft.eligible_sprint_quali(t.sprint_quali, t.calendar, 1998).select(*EVENT, "entity", "sq_position")
    model = vr.variant_scores(d, d.select(*EV2), QUALI_MODEL, "quali_relevance").drop("sq_position").join(sq, [*EVENT, "entity"], "left")
    model = cut(model.select("series", "season", "race_seq", "entity", "score", "sq_position", F.col("quali_position").cast("double").alias("place")))
    parts = [model.withColumn("method", F.lit("model alone"))]
    parts += [lw.sprint_blend(model, "score", "sq_position", w, "_b", EV2).drop("score").withColumnRenamed("_b", "score").withColumn("method", F.lit(f"w={w}")) for w in WEIGHTS]
    every = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    rows = quali_graded(every).join(model.where("sq_position is not null").select(*EV2).distinct(), EV2, "left_semi")
    return vr.picked(compared(cut(rows), "model alone", QUALI_METRICS), "position_error", QUALI_KEEP, QUALI_METRICS, True)


# -- J7: the chain of tuned settings --------------------------------------------------------------------------------
TUNED = {f"{w}": Variant(tuple(RACE_FEATURES), recency=w) for w in RECENCY_CANDIDATES}
QUALI_TUNED = {f"{w}": Variant(tuple(QUALI_FEATURES), recency=w) for w in RECENCY_CANDIDATES}
system_ctes("tnr", "whole_run", TUNED, "race_relevance")
system_ctes("tnq", "whole_run", QUALI_TUNED, "quali_relevance")
cte("tnr_seen", f"SELECT * FROM tnr_scores WHERE season = {LAST} - 1")
cte("tnq_seen", f"SELECT * REPLACE (CAST(quali_position AS DOUBLE) AS place) FROM tnq_scores WHERE season = {LAST} - 1")
cte("tnr_losses", losses_sql("tnr_seen"))
cte("tnq_losses", losses_sql("tnq_seen"))
_FIT = "SELECT method, min({{'l': round(loss, 10), 't': temperature}}) AS m FROM (SELECT method, temperature, avg(loss) AS loss FROM {0} GROUP BY ALL) GROUP BY method"
cte("tnr_best", f"SELECT method, m.t AS temperature, m.l AS win_logloss FROM ({_FIT.format('tnr_losses')}) ORDER BY m.l, CAST(method AS DOUBLE) LIMIT 1")
cte("tn_field", """SELECT s.series, s.race_seq, s.method, s.entity, s.place, s.score, b.temperature, f.dnf_prob FROM tnr_seen s JOIN tnr_best b USING (method)
  JOIN (SELECT series, race_seq, entity, dnf_prob FROM dnf_field) f USING (series, race_seq, entity)""")
cte("tn_plain", exact_sql("tn_field", "series, race_seq, method", temp="temperature"))
cte("tn_drawn", exact_sql("tn_field", "series, race_seq, method", True, "temperature"))
cte("tn_blend", f"""SELECT blend, avg(-ln(greatest(0.998 * (blend * p.share + (1 - blend) * q.share) + 0.002 / n, 1e-12))) AS loss FROM tn_plain p JOIN tn_drawn q USING (series, race_seq, method, entity, pos)
  JOIN tn_field f USING (series, race_seq, method, entity) JOIN (SELECT series, race_seq, count(*) AS n FROM tn_field GROUP BY ALL) USING (series, race_seq), unnest({list(BLEND_CANDIDATES)}) b(blend)
  WHERE p.pos = 1 AND f.place = 1 GROUP BY blend""")


@query("j7_settings", "recency:d temperature:d win_logloss:d blend:d blend_logloss:d quali_temperature:d",
       f"""SELECT CAST(r.method AS DOUBLE) AS recency, r.temperature, r.win_logloss, b.blend, b.loss AS blend_logloss, q.m.t AS quali_temperature FROM tnr_best r
         JOIN ({_FIT.format('tnq_losses')}) q USING (method), (SELECT * FROM tn_blend ORDER BY round(loss, 10), blend LIMIT 1) b""")
def _(t):
    """Recency, temperature, blend and qualifying temperature, each chosen given those before it, on the tuning window."""
    d = whole(t)
    tuning = F.col("season") == last_season(d) - 1
    race = race_scores(d, TUNED).where(tuning)
    fits = lw.fit_temperature(lw.temperature_losses(race, "score", "place", event=ev.METHOD_EVENT), ["method"])
    best = cut(fits.orderBy("loss", F.col("method").cast("double")).limit(1).select("method", "temperature", F.col("loss").alias("win_logloss")))
    rates = d.select(*EV2, "entity", lw.dnf_probability().alias("dnf_prob"))
    field = race.join(best.select("method", "temperature"), "method").join(rates, [*EV2, "entity"])
    blends = ev.tune_blend(cut(field), F.col("temperature"), BLEND_CANDIDATES)
    blend = blends.orderBy(F.round("win_logloss", 10), "blend").limit(1).select("method", "blend", F.col("win_logloss").alias("blend_logloss"))
    quali = quali_scores(d, QUALI_TUNED).where(tuning).join(best.select("method"), "method", "left_semi")
    pole = lw.fit_temperature(lw.temperature_losses(cut(quali), "score", "place", event=ev.METHOD_EVENT), ["method"])
    out = best.join(blend, "method").join(pole.select("method", F.col("temperature").alias("quali_temperature")), "method")
    return out.withColumn("recency", F.col("method").cast("double")).drop("method")


# -- J15: which inputs carry the same information ---------------------------------------------------------------------
_LISTED = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in RACE_FEATURES)
cte("train_run", f"SELECT row_number() OVER () AS id, {_LISTED} FROM whole_run WHERE season < {LAST} - 1")
cte("train_long", f"SELECT id, f, v FROM (UNPIVOT (SELECT * FROM train_run) ON {', '.join(RACE_FEATURES)} INTO NAME f VALUE v)")
cte("feature_pairs", """SELECT a.f AS a, b.f AS b, a.v AS x, b.v AS y FROM train_long a JOIN train_long b USING (id)""")


@query("j15_feature_correlation", "a:s b:s rho:d n:i", f"""SELECT a, b, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM feature_pairs
    JOIN (SELECT unnest({list(RACE_FEATURES)}) AS a, unnest(range({len(RACE_FEATURES)})) AS i) USING (a) JOIN (SELECT unnest({list(RACE_FEATURES)}) AS b, unnest(range({len(RACE_FEATURES)})) AS j) USING (b) WHERE i < j)
  GROUP BY ALL HAVING abs(corr(rx, ry)) >= 0.8""")
def _(t):
    """All pairs of the race model's inputs, on the rows before the reported windows."""
    d = whole(t)
    return ev.feature_correlation(d.where(F.col("season") < last_season(d) - 1), RACE_FEATURES)


# -- J12: what each probability step is worth ---------------------------------------------------------------------------
cte("stp_scores", "SELECT series, season, race_seq, entity, position, place, 'model' AS method, score FROM abl_scores WHERE method = 'full'")
cte("stp_losses", losses_sql("stp_scores"))
cte("stp_deep", f"""SELECT series, method, race_seq, temperature, avg(loss) AS loss FROM (SELECT a.series, a.method, a.race_seq, a.entity, temperature,
  -ln(greatest(exp(a.score / temperature) / sum(exp(b.score / temperature)), 1e-12)) AS loss FROM stp_scores a JOIN stp_scores b ON a.series = b.series AND a.race_seq = b.race_seq AND b.place >= a.place, unnest({GRID_SQL}) g(temperature)
  WHERE a.place <= 3 GROUP BY a.series, a.method, a.race_seq, a.entity, a.score, temperature) GROUP BY ALL""")
cte("stp_t", rolling_sql("stp_losses"))
cte("stp_t3", rolling_sql("stp_deep"))
cte("stp_fixed", f"SELECT m.t AS temperature FROM (SELECT min({{'l': round(loss, 10), 't': temperature}}) AS m FROM (SELECT temperature, avg(loss) AS loss FROM stp_losses SEMI JOIN (SELECT DISTINCT series, race_seq FROM stp_scores WHERE season < {LAST} - 1) USING (series, race_seq) GROUP BY temperature))")
STEPS = {"raw": ("raw", 1.0), "fixed": ("fixed", 0.7), "rolling": ("rolling", 0.7), "rolling, ranking only": ("rolling", 1.0), "rolling, retirements only": ("rolling", 0.0), "rolling, top three": ("deep", 0.7)}
cte("stp_temps", """SELECT t.series, t.race_seq, v.step, CASE v.step WHEN 'raw' THEN 1.0 WHEN 'fixed' THEN f.temperature WHEN 'rolling' THEN t.temperature ELSE d.temperature END AS temperature
  FROM stp_t t JOIN stp_t3 d USING (series, race_seq), stp_fixed f, (VALUES ('raw'), ('fixed'), ('rolling'), ('deep')) v(step)""")
cte("stp_rows", f"""SELECT s.series, s.race_seq, s.season, s.entity, s.place, s.score, t.step AS method, t.temperature, d.dnf_prob FROM stp_scores s JOIN stp_temps t USING (series, race_seq)
  JOIN (SELECT series, race_seq, entity, greatest(least(0.35 * coalesce(drv_dnf_rate_10, 0.12) + 0.65 * coalesce(team_dnf_rate_10, 0.12), 0.35), 0.02) AS dnf_prob FROM whole_run) d USING (series, race_seq, entity) WHERE s.season >= {LAST} - 1""")
cte("stp_plain", exact_sql("stp_rows", "series, race_seq, method", temp="temperature"))
cte("stp_drawn", exact_sql("stp_rows", "series, race_seq, method", True, "temperature"))
cte("stp_table", f"""SELECT series, race_seq, v.name AS method, entity, sum(s) FILTER (pos = 1) AS p_win, sum(s) FILTER (pos <= 3) AS p_podium, sum(s) FILTER (pos <= 10) AS p_top10 FROM
  (SELECT *, 0.998 * (w * p.share + (1 - w) * q.share) + 0.002 / count(*) OVER (PARTITION BY series, race_seq, v.name, entity) AS s FROM stp_plain p JOIN stp_drawn q USING (series, race_seq, method, entity, pos)
   JOIN (VALUES {', '.join(f"('{n}', '{step}', {w})" for n, (step, w) in STEPS.items())}) v(name, step, w) ON v.step = method) GROUP BY ALL""".replace("SELECT *, 0.998", "SELECT series, race_seq, entity, pos, v.name, 0.998").replace("v.name AS method, entity, sum", "name AS method, entity, sum").replace("GROUP BY ALL", "GROUP BY series, race_seq, name, entity"))
cte("stp_seen", "SELECT DISTINCT t.series, t.race_seq, t.method, t.entity, s.place, s.score FROM stp_table t JOIN stp_scores s USING (series, race_seq, entity)")
cte("stp_types", """SELECT series, race_seq, method, entity, u.event_type, round(u.p, 9) AS p, u.y FROM (SELECT t.*, s.place, CAST(s.place = min(s.place) OVER (PARTITION BY series, race_seq, method) AS INT) AS won
  FROM stp_table t JOIN stp_seen s USING (series, race_seq, method, entity)), LATERAL (VALUES ('win', p_win, won), ('podium', p_podium, (place <= 3)::INT), ('top10', p_top10, (place <= 10)::INT)) u(event_type, p, y)""")
cte("stp_ece", """SELECT method, event_type, sum(m * abs(s - o)) / sum(m) AS ece FROM (SELECT method, event_type, b, count(*) AS m, avg(p) AS s, avg(y) AS o FROM
  (SELECT method, event_type, p, y, ntile(10) OVER (PARTITION BY method, event_type ORDER BY p, y) AS b FROM stp_types) GROUP BY ALL) GROUP BY ALL""")


@query("j12_probability_steps", "method:s win_logloss:d podium_brier:d ece_win:d ece_podium:d ece_top10:d n_events:i",
       f"""SELECT method, avg(win_logloss) AS win_logloss, avg(podium_brier) AS podium_brier, count(*) AS n_events, any_value(w.ece) AS ece_win, any_value(p.ece) AS ece_podium, any_value(x.ece) AS ece_top10
         FROM ({grade_sql('stp_table', 'stp_seen')}) JOIN (SELECT method, ece FROM stp_ece WHERE event_type = 'win') w USING (method) JOIN (SELECT method, ece FROM stp_ece WHERE event_type = 'podium') p USING (method)
         JOIN (SELECT method, ece FROM stp_ece WHERE event_type = 'top10') x USING (method) GROUP BY method""")
def _(t):
    """One set of scores of the whole model, six ways to turn them into probabilities."""
    d = whole(t)
    scores = race_scores(d, {"model": ABLATION["full"]})
    start = last_season(d) - 1
    losses = cut(lw.temperature_losses(scores, "score", "place", event=ev.METHOD_EVENT, keep=("season",)))
    deep = lw.temperature_losses(scores, "score", "place", 3, event=ev.METHOD_EVENT)
    rolling, top = (lw.rolling_temperature(x, ["series", "method"], "race_seq", 1.0).select("series", "race_seq", F.col("temperature").alias(n)) for x, n in ((losses, "rolling"), (deep, "deep")))
    fixed = lw.fit_temperature(losses.where(F.col("season") < start), ["method"]).first()
    rates = d.select(*EV2, "entity", lw.dnf_probability().alias("dnf_prob"))
    seen = scores.where(F.col("season") >= start).join(rolling, EV2).join(top, EV2).join(rates, [*EV2, "entity"])
    steps = {"raw": F.lit(1.0), "fixed": F.lit(fixed["temperature"] if fixed else 1.0), "rolling": F.col("rolling"), "deep": F.col("deep")}
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("method"), c.alias("temperature")) for n, c in steps.items()]))
    rows = cut(seen.select(*EV2, "entity", "place", "score", "dnf_prob", each))
    halves = cut(lw.exact_positions(rows, "score", F.col("temperature"), {"plain": False, "drawn": True}, "dnf_prob", ev.METHOD_EVENT))
    named = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("step"), F.lit(w).alias("w")) for n, (s, w) in STEPS.items()]))
    mixed = halves.select("*", named).where("step = method")
    share = F.col("w") * F.col("plain") + (1 - F.col("w")) * F.col("drawn")
    m = mixed.select(*EV2, F.col("name").alias("method"), "entity", "field", "pos", share.alias("share"))
    table = cut(lw.summarise(lw.smooth(m), ev.METHOD_EVENT))
    graded_rows = scores.drop("method").join(table.select(*ev.METHOD_EVENT, "entity"), [*EV2, "entity"])
    means = ev.summary(ev.grade(graded_rows, table), ("win_logloss", "podium_brier"))
    types = ev.event_types(table.join(scores.select(*EV2, "entity", F.col("place").alias("actual")), [*EV2, "entity"])).withColumn("p", F.round("p", 9))
    ece = mt.calibration_error(types, "p", "y", ("method", "event_type")).groupBy("method").agg(
        *[F.max(F.when(F.col("event_type") == k, F.col("ece"))).alias(f"ece_{k}") for k in ("win", "podium", "top10")]
    )
    return means.join(ece, "method")


# -- J3, J4, J10: the whole models against every baseline, at each stage ---------------------------------------------------
FULL = {"model": ABLATION["full"]}
_BASE = "SELECT series, season, race_seq, entity, position, place, {0} AS method, score FROM baselines SEMI JOIN oos_events USING (series, race_seq)"
cte("ful_scores", f"SELECT series, season, race_seq, entity, position, place, 'model' AS method, score FROM abl_scores WHERE method = 'full' UNION ALL {_BASE.format('method')}")
graded_ctes("ful", "ful_scores")
cte("fue_scores", f"""SELECT series, season, race_seq, entity, position, place, 'model' AS method, score FROM abl_early WHERE method = 'pre_quali:full'
  UNION ALL {_BASE.format('method')} WHERE method IN ({', '.join(repr(m) for m in BEFORE_GRID)})""")
graded_ctes("fue", "fue_scores")
QUALI_BASE = ("recent_form", "team_form")
cte("fuq_scores", f"""SELECT series, season, race_seq, entity, 'model' AS method, score, CAST(quali_position AS DOUBLE) AS place FROM qm_scores
  UNION ALL SELECT b.series, b.season, b.race_seq, b.entity, b.method, b.score, CAST(c.quali_position AS DOUBLE) AS place FROM baselines b SEMI JOIN oos_events o ON o.series = b.series AND o.race_seq = b.race_seq
  JOIN (SELECT series, race_seq, entity, quali_position FROM contest) c USING (series, race_seq, entity) WHERE b.method IN ('recent_form', 'team_form')""")
quali_rows_ctes("fuq", "fuq_scores")
RACE_SPEC = "series:i race_seq:i method:s window:s ndcg5:d winner_hit:i position_error:d win_logloss:d podium_brier:d"


def _based(t: Tables, d: DataFrame, methods: Sequence[str]) -> DataFrame:
    return baselines(t, tuple(methods)).join(ev.eligible(d), EV2, "left_semi").select(*RACE_COLUMNS)


def full_rows(t: Tables, d: DataFrame) -> DataFrame:
    return graded(cut(race_scores(d, FULL).unionByName(_based(t, d, tuple(METHODS)))))


def early_rows(t: Tables, d: DataFrame) -> DataFrame:
    model = race_scores(d, FULL, varied=projected(d)).withColumn("method", F.lit("model"))
    return graded(cut(model.unionByName(_based(t, d, BEFORE_GRID))))


def pole_rows(t: Tables, d: DataFrame) -> DataFrame:
    model = quali_scores(d, QUALI_MODEL).withColumn("method", F.lit("model"))
    places = t.contest.select(*EV2, "entity", F.col("quali_position").cast("double").alias("place"))
    base = _based(t, d, QUALI_BASE).drop("place", "position").join(places, [*EV2, "entity"])
    return quali_graded(cut(model.unionByName(base)))


@query("j3_full_walk_forward", RACE_SPEC, "SELECT * FROM ful_rows")
def _(t):
    """The model of 27 inputs and four baselines once the grid is known."""
    return full_rows(t, whole(t))


@query("j3_full_before_grid", RACE_SPEC, "SELECT * FROM fue_rows")
def _(t):
    """The same model on the projected grid, and the baselines that need none."""
    return early_rows(t, whole(t))


@query("j4_full_quali", "series:i race_seq:i method:s window:s ndcg5:d position_error:d pole_logloss:d", "SELECT * FROM fuq_rows")
def _(t):
    """The qualifying model of 28 inputs and two baselines."""
    return pole_rows(t, whole(t))


_MEANS = ", ".join(f"avg({c}) AS {c}" for c in ("loss", "ndcg5", "position_error"))


@query("j10_full_report", "stage:s window:s method:s loss:d ndcg5:d position_error:d n_events:i", f"""SELECT stage, "window", method, {_MEANS}, count(*) AS n_events FROM
  (SELECT 'post_quali' AS stage, "window", method, win_logloss AS loss, ndcg5, position_error FROM ful_rows UNION ALL SELECT 'pre_quali', "window", method, win_logloss, ndcg5, position_error FROM fue_rows
   UNION ALL SELECT 'qualifying', "window", method, pole_logloss, ndcg5, position_error FROM fuq_rows) GROUP BY ALL""")
def _(t):
    """What each stage's model and baselines come to, by window."""
    d = whole(t)
    parts = (("post_quali", full_rows(t, d), "win_logloss"), ("pre_quali", early_rows(t, d), "win_logloss"), ("qualifying", pole_rows(t, d), "pole_logloss"))
    every = None
    for stage, rows, loss in parts:
        one = rows.select(F.lit(stage).alias("stage"), "window", "method", F.col(loss).alias("loss"), "ndcg5", "position_error")
        every = one if every is None else every.unionByName(one)
    return ev.summary(every, ("loss", "ndcg5", "position_error"), ("stage", "window", "method"))
