"""Audits of features and model, and the track record of logged forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as op, listwise as lw, ranker as rk
from ..plans import evaluate as ev, features as ft, worlds
from ..constants import MIN_BIAS_EVENTS
from ..session import cut
from ..sources.contest import EVENT, KEY, Tables, add_outcomes
from .evaluate_q import COMPARE, R, forward, oos, paired_sql
from .features_q import feature_ctes, practice_ctes
from .landing_q import penalty_list
from .listwise_q import dnf_field, mixed
from .metrics_q import BUCKET_SQL, outcomes, wilson_sql
from .ranker_q import TWO, train_field
from .registry import query
from .sqlbase import CTES, cte

#: Features that the light build has, for a quick look without the raw tables.
CHECKED = (
    "drv_avg_finish_3", "drv_avg_finish_5", "drv_points_rate_5", "drv_dnf_rate_10", "drv_experience", "drv_positions_gained_5", "drv_podium_rate_10",
    "drv_avg_quali_5", "drv_teammate_quali_edge", "team_avg_finish_3", "team_avg_finish_5", "team_points_rate_5", "team_dnf_rate_10", "team_avg_quali_5", "team_pace_gap_pct",
)


def light_build(results):
    """The window features on results alone."""
    return ft.add_racecraft(ft.add_pace(ft.add_quali(ft.add_form(add_outcomes(results)))))


# The same cuts in SQL, and the whole build once more from the changed rows of each.
_SEQS = "(SELECT list_sort(list(DISTINCT race_seq)) FROM contest)"
MIDDLE = f"{_SEQS}[len({_SEQS}) // 2 + 1]"
_LO, _HI = f"CAST(floor(0.4 * len({_SEQS})) AS BIGINT)", f"(len({_SEQS}) - 2)"
TRUNCATED = {k: f"{_SEQS}[{_LO} + ({_HI} - {_LO}) * {k} // 2 + 1]" for k in range(3)}


def _build_sql(p: str, rows: str) -> None:
    cte(f"{p}_rows", f"SELECT series, season, round, entity, team, venue, position, points, dnf FROM {rows}")
    cte(f"{p}_whole", CTES["whole"].replace("FROM all_rows a", f"FROM {p}_rows a"))
    feature_ctes(f"{p}_whole", p)
    cte(f"{p}_gaps", CTES["fw_gaps"].replace("FROM whole ", f"FROM {p}_whole "))
    practice_ctes(f"{p}_gaps", p)
    cte(f"{p}_all", CTES["features_all"].replace("fw_", f"{p}_"))


cte("mirrored", f"""SELECT c.* EXCLUDE (position, points, dnf), CASE WHEN hit THEN m.position ELSE c.position END AS position, CASE WHEN hit THEN m.points ELSE c.points END AS points,
  CASE WHEN hit THEN m.dnf ELSE c.dnf END AS dnf FROM (SELECT *, race_seq = {MIDDLE} AS hit FROM contest) c JOIN (SELECT series, race_seq, field + 1 - position AS mirror, position, points, dnf FROM contest) m
  ON m.series = c.series AND m.race_seq = c.race_seq AND m.mirror = c.position""")
_build_sql("ftam", "mirrored")
for _k, _at in TRUNCATED.items():
    cte(f"kept_{_k}", f"SELECT * FROM contest WHERE race_seq <= {_at}")
    _build_sql(f"fcut{_k}", f"kept_{_k}")

AUDITED = tuple(ft.ALL_FEATURES)


def _moved_sql(name: str, p: str, cutoff: str) -> str:
    moved = lambda f: f"(a.{f} IS NULL) <> (b.{f} IS NULL) OR coalesce(abs(a.{f} - b.{f}) > 1e-9, false)"
    counts = ", ".join(f"count(*) FILTER (({moved(f)}) AND a.race_seq <= k) AS e_{f}, count(*) FILTER (({moved(f)}) AND a.race_seq > k) AS l_{f}" for f in AUDITED)
    rows = ", ".join(f"('{f}', e_{f}, l_{f})" for f in AUDITED)
    return f"""SELECT '{name}' AS audit, k AS cutoff, u.feature, u.before, u.after FROM (SELECT any_value(k) AS k, {counts} FROM (SELECT * FROM features_all WHERE position IS NOT NULL) a
      JOIN {p}_all b USING (series, race_seq, entity), (SELECT {cutoff} AS k) x), LATERAL (VALUES {rows}) u(feature, before, after)"""


cte("leakage_rows", " UNION ALL ".join([_moved_sql("tamper", "ftam", MIDDLE), *(_moved_sql("truncate", f"fcut{k}", at) for k, at in TRUNCATED.items())]))


@query("m1_tamper", "cutoff:i feature:s before:i after:i", "SELECT * FROM leakage_rows WHERE audit = 'tamper'")
def _(t: Tables):
    """Every feature of the whole build after the middle event's outcome is mirrored."""
    return cut(worlds.leakage(t, AUDITED)).where("audit = 'tamper'")


@query("m2_truncation", "cutoff:i feature:s before:i after:i", "SELECT * FROM leakage_rows WHERE audit = 'truncate'")
def _(t):
    """Every feature of the whole build from raw tables that stop at an event, for three events."""
    return cut(worlds.leakage(t, AUDITED)).where("audit = 'truncate'")


@query("m1_status", "audit:s status:s features:i",
       "SELECT audit, CASE WHEN max(before) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(DISTINCT feature) AS features FROM leakage_rows GROUP BY audit")
def _(t):
    return op.leakage_status(cut(worlds.leakage(t, AUDITED)), ("audit",))


CLASSES = {
    "Past results": ("drv_avg_finish_3", "drv_points_rate_5", "team_avg_finish_3"),
    "Qualifying": ("quali_position", "drv_avg_quali_3"),
    "Practice": ("sq_position",),
}


@query(
    "m3_input_coverage",
    "input:s features:i coverage_pct:d status:s",
    " UNION ALL ".join(
        f"""SELECT '{k}' AS input, {len(fs)} AS features, {' + '.join(f'count({f}) * 100.0 / count(*)' for f in fs)} AS s, s / {len(fs)} AS coverage_pct,
        CASE WHEN s / {len(fs)} < 1 THEN {"'WARN'" if k == 'Practice' else "'FAIL'"} ELSE 'PASS' END AS status
        FROM (SELECT e.*, team_avg_finish_3 FROM fa_entity e JOIN fa_team USING (series, team, race_seq)) WHERE season >= 2000"""
        for k, fs in CLASSES.items()
    ),
)
def _(t):
    sq = ft.eligible_sprint_quali(t.sprint_quali, t.calendar, 1998)
    d = ft.add_form(ft.add_quali(t.outcomes.join(sq, KEY, "left")))
    return op.input_coverage(d.where("season >= 2000"), CLASSES)


@query(
    "m4_contribution_share",
    "input:s share_pct:d",
    """SELECT input, avg(s) * 100 AS share_pct FROM (SELECT series, race_seq, input, sum(a) / any_value(t) AS s FROM
      (SELECT *, CASE feature WHEN 'grid' THEN 'Qualifying' ELSE 'Past results' END AS input, abs(contribution) AS a, sum(abs(contribution)) OVER (PARTITION BY series, race_seq) AS t
       FROM model_contributions WHERE race_seq > 70) GROUP BY ALL) GROUP BY input""",
)
def _(t):
    d = cut(train_field(t))
    long = rk.train(d, TWO, "label").contributions(d).where("race_seq > 70")
    return op.contribution_share(long, {"grid": "Qualifying", "drv_avg_finish_5": "Past results"})


@query(
    "m5_bias_audit",
    "series:i worst:d regulars:d status:s",
    """SELECT *, CASE WHEN regulars > 1.5 THEN 'FAIL' WHEN worst > 3 THEN 'WARN' ELSE 'PASS' END AS status FROM
      (SELECT series, max(abs(b)) AS worst, max(abs(b)) FILTER (n <= 4) AS regulars FROM
       (SELECT series, entity, raw_bias - (i + s * avg_predicted) AS b, row_number() OVER (PARTITION BY series ORDER BY events DESC, entity) AS n FROM bias_base
        JOIN (SELECT series, regr_slope(raw_bias, avg_predicted) AS s, regr_intercept(raw_bias, avg_predicted) AS i FROM bias_base GROUP BY series) USING (series)) GROUP BY series)""",
)
def _(t):
    return op.bias_audit(ev.entity_bias(ev.entry_errors(oos(t)), MIN_BIAS_EVENTS))


@query(
    "m6_accuracy_audit",
    "method:s better:i worse:i status:s",
    f"""SELECT method, count(*) FILTER (better = method) AS better, count(*) FILTER (better = 'grid') AS worse,
      CASE WHEN bool_or(better = 'grid' AND metric = 'win_logloss') THEN 'FAIL' WHEN bool_or(better = 'grid') THEN 'WARN' ELSE 'PASS' END AS status
      FROM ({paired_sql('wf_diffs', COMPARE, 'grid')}) AS q(method, metric, difference, ci_low, ci_high, better) GROUP BY method""",
)
def _(t):
    from ..operators import metrics as mt

    return op.accuracy_audit(mt.paired_comparison(cut(forward(t)[0]), ["series", "race_seq"], COMPARE, "grid", replicates=R), "grid")


_LO, _HI = wilson_sql("sum(y)", "count(*)")


@query(
    "m7_calibration_audit",
    "off:i buckets:i status:s",
    f"""SELECT count(*) FILTER (NOT stated BETWEEN lo AND hi) AS off, count(*) AS buckets,
      CASE WHEN count(*) FILTER (NOT stated BETWEEN lo AND hi) > greatest(2, count(*) // 4) THEN 'WARN' ELSE 'PASS' END AS status FROM
      (SELECT avg(p) AS stated, {_LO} AS lo, {_HI} AS hi FROM (SELECT {BUCKET_SQL} AS bucket, p, y FROM (SELECT round(p_podium, 12) AS p, podium AS y FROM outcome_table)) GROUP BY bucket)""",
)
def _(t):
    from ..operators import metrics as mt

    return op.calibration_audit(mt.reliability(outcomes(t), "p_podium", "podium"))


@query(
    "m8_plausibility",
    "series:i race_seq:i failed:s status:s",
    """SELECT series, race_seq, failed, CASE WHEN failed <> '' THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT series, race_seq, concat_ws(',',
        CASE WHEN abs(sum(w) - 1) >= 1e-6 THEN 'win sum' END, CASE WHEN abs(sum(p) - 3) >= 1e-6 THEN 'podium sum' END, CASE WHEN min(w) <= 0 THEN 'zero chance' END,
        CASE WHEN max(w) >= 0.9 THEN 'false certainty' END, CASE WHEN max(w) <= 0.08 THEN 'coin toss' END, CASE WHEN max(x) - min(x) <= 5 THEN 'narrow span' END) AS failed FROM
      (SELECT series, race_seq, entity, sum(share) FILTER (pos = 1) AS w, sum(share) FILTER (pos <= 3) AS p, sum(share * pos) AS x FROM g_mixed GROUP BY ALL) GROUP BY ALL)""",
)
def _(t):
    m = cut(mixed(t))
    d = op.plausibility(lw.summarise(m), lw.check_distribution(m))
    return d.withColumn("failed", F.array_join("failed", ","))


# -- logged forecasts -------------------------------------------------------------------------
# Five forecasts per event: before practice, before qualifying, on the provisional grid, on the
# official grid, and one made after the start.
TIMES = ((1, -96), (2, -40), (3, -22), (4, -6), (5, 5))


def forecast_rows(t: Tables):
    """One row per (event, forecast, entrant) with a stated win chance."""
    runs = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(h).alias("_h")) for k, h in TIMES]))
    d = t.contest.select(*KEY, "grid", "position", runs)
    d = d.join(t.calendar.select(*EVENT, "race_start", "quali_start"), EVENT)
    order = F.when(F.col("k") <= 2, (F.col("entity") * 7 + F.col("season") + F.col("round")) % 20).otherwise(F.col("grid"))
    order = order + F.when((F.col("k") == 4) & (F.col("entity") % 4 == 0), 3).otherwise(0)
    return d.withColumns(
        {
            "p_win": F.round(1.0 / (order + F.col("k") + 1), 9),
            "exp_position": (order + 1).cast("double"),
            "generated_at": F.col("race_start") + F.make_interval(hours=F.col("_h")),
        }
    ).drop("_h")


def forecast_log(t: Tables):
    """One row per logged forecast with its leading pick."""
    k = F.col("k")
    d = forecast_rows(t).groupBy(*EVENT, "k", "race_start", "quali_start", "generated_at").agg(
        F.max(F.struct(F.col("p_win"), (-F.col("entity")).alias("_e"))).alias("_top")
    )
    return d.select(
        *EVENT,
        "k",
        "race_start",
        "quali_start",
        "generated_at",
        (k >= 3).alias("grid_known"),
        F.when(k >= 3, "post_quali").when(F.col("round") % 2 == 0, "pre_quali").alias("stage"),
        (k == 2).alias("practice_data"),
        F.when(k == 3, "qualifying").when(k >= 4, "official").alias("grid_source"),
        F.when((k >= 3) & (F.col("round") % 3 == 0), F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("penalties"),
        (F.col("round") % 5 > 0).alias("practice_complete"),
        (-F.col("_top._e")).alias("pick"),
        F.col("_top.p_win").alias("p_pick"),
    )


cte("fc_rows", """SELECT *, round(1.0 / (o + k + 1), 9) AS p_win, o + 1 AS exp_position FROM (SELECT c.series, c.season, c.round, c.entity, c.position, k, race_start, quali_start,
  race_start + h * INTERVAL 1 HOUR AS generated_at, CASE WHEN k <= 2 THEN (c.entity * 7 + c.season + c.round) % 20 ELSE grid END + CASE WHEN k = 4 AND c.entity % 4 = 0 THEN 3 ELSE 0 END AS o
  FROM contest c JOIN calendar USING (series, season, round), (VALUES (1, -96), (2, -40), (3, -22), (4, -6), (5, 5)) v(k, h))""")
cte("fc_log", """SELECT series, season, round, k, race_start, quali_start, generated_at, k >= 3 AS grid_known, CASE WHEN k >= 3 THEN 'post_quali' WHEN round % 2 = 0 THEN 'pre_quali' END AS stage,
  k = 2 AS practice_data, CASE WHEN k = 3 THEN 'qualifying' WHEN k >= 4 THEN 'official' END AS grid_source, round % 5 > 0 AS practice_complete,
  arg_max(entity, (p_win, -entity)) AS pick, max(p_win) AS p_pick FROM fc_rows GROUP BY ALL""")
cte("fc_staged", """SELECT *, CASE WHEN k >= 3 THEN 'post_quali' WHEN k = 2 THEN 'pre_quali' ELSE 'pre_practice' END AS weekend_stage, CASE WHEN k >= 3 THEN 'post_quali' ELSE 'pre_quali' END AS step,
  CASE k WHEN 1 THEN 'before practice data' WHEN 2 THEN 'with this weekend''s practice' WHEN 3 THEN 'qualifying order, penalties pending' ELSE 'official grid' END AS note FROM fc_log""")
EVS = "series:i season:i round:i "


@query("m13_stage_labels", EVS + "k:i weekend_stage:s step:s note:s", "SELECT * FROM fc_staged")
def _(t):
    return op.stage_columns(forecast_log(t))


@query(
    "m9_first_write_wins",
    EVS + "k:i stage:s",
    """SELECT series, season, round, k, coalesce(stage, 'pre_quali') AS stage FROM fc_log WHERE (k = 2 AND round % 2 = 1 AND NOT (round % 5 = 0 AND date_diff('second', generated_at, quali_start) > 3600))
      OR k = 4""",
)
def _(t):
    # Logged so far: the first forecast of even rounds and the one on the provisional grid.
    d = forecast_log(t).withColumn("stage", F.coalesce("stage", F.lit("pre_quali")))
    log = d.where("(k = 1 and round % 2 = 0) or k = 3")
    return op.append_forecasts(log, d.where("k = 2")).unionByName(op.append_forecasts(log, d.where("k = 4")))


@query(
    "m10_final_forecasts",
    EVS + "k:i pick:i p_pick:d",
    "SELECT series, season, round, k, pick, p_pick FROM fc_log WHERE k = 4",
)
def _(t):
    return op.final_forecasts(forecast_log(t), ["k", "pick", "p_pick"])


@query(
    "m11_forecast_history",
    EVS + "turn:i step:s note:s pick:i runs:i p_low:d p_high:d p_pick:d made:t hit:b",
    """SELECT series, season, round, g AS turn, step, note, pick, count(*) AS runs, min(p_pick) AS p_low, max(p_pick) AS p_high, arg_max(p_pick, generated_at) AS p_pick, max(generated_at) AS made,
      bool_or(pick = w) AS hit FROM (SELECT *, sum(fresh) OVER (PARTITION BY series, season, round ORDER BY generated_at) AS g FROM
      (SELECT f.*, c.entity AS w, CASE WHEN lag(f.step || f.note || f.pick) OVER (PARTITION BY f.series, f.season, f.round ORDER BY generated_at) = f.step || f.note || f.pick THEN 0 ELSE 1 END AS fresh
       FROM (SELECT * EXCLUDE (note), CASE WHEN round % 2 = 0 AND k >= 3 THEN 'grid' ELSE note END AS note FROM fc_staged) f
       JOIN contest c ON (c.series, c.season, c.round) = (f.series, f.season, f.round) AND c.position = 1 WHERE generated_at <= race_start)) GROUP BY ALL""",
)
def _(t):
    d = op.stage_columns(forecast_log(t))
    # Even rounds log both grids under one note, so that equal picks merge.
    d = d.withColumn("note", F.when((F.col("round") % 2 == 0) & (F.col("k") >= 3), "grid").otherwise(F.col("note")))
    winners = t.contest.where("position = 1").select(*EVENT, F.col("entity").alias("winner"))
    return op.forecast_history(d, winners)


@query(
    "m12_coherent",
    EVS + "k:i coherent:b",
    "SELECT DISTINCT series, season, round, k, NOT (k = 3 AND round % 4 = 1) AS coherent FROM fc_rows",
)
def _(t):
    off = F.when((F.col("k") == 3) & (F.col("round") % 4 == 1), 0.05).otherwise(0.0)
    d = forecast_rows(t).withColumn("_row", F.array(F.col("p_win") + off, 1 - F.col("p_win")))
    docs = d.groupBy(*EVENT, "k").agg(
        F.collect_list(F.struct("entity", "_row")).alias("_m"), F.collect_list(F.struct("entity", "p_win")).alias("field")
    )
    docs = docs.withColumns({"matrix_ids": F.col("_m.entity"), "matrix": F.col("_m._row")})
    return op.coherent(cut(docs.drop("_m")), [*EVENT, "k"])


@query(
    "m14_board",
    EVS + "k:i row:i entity:i p_win:d",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, season, round, k ORDER BY p_win DESC, entity) AS row FROM fc_rows) WHERE row <= 10",
)
def _(t):
    return op.board(forecast_rows(t), [*EVENT, "k"])


@query(
    "m14_board_by_finish",
    EVS + "k:i row:i entity:i exp_position:d",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, season, round, k ORDER BY exp_position, entity) AS row FROM fc_rows) WHERE row <= 10",
)
def _(t):
    return op.board(forecast_rows(t), [*EVENT, "k"], "exp_position")
