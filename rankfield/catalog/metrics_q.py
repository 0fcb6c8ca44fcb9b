"""Metrics, calibration and paired uncertainty on the baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LOWER_IS_BETTER, RELIABILITY_EDGES
from ..functions.scalars import wilson_high, wilson_low
from ..functions.hashrand import DRAWS, POISSON_CUTS
from ..operators import listwise as lw, metrics as op
from ..session import cut
from ..sources.contest import Tables
from .listwise_q import GRID_SQL, baselines, counts_sql, orders_sql, summary_sql
from .registry import query
from .sqlbase import cte, uniform_sql

BY = ["series", "race_seq", "method"]
RM = "series:i race_seq:i method:s "
RMS = "series, race_seq, method"

cte("rank_pairs", """SELECT * FROM (SELECT series, race_seq, method, entity, rank, position, count(*) OVER w AS n,
  row_number() OVER (PARTITION BY series, race_seq, method ORDER BY pred, entity) AS pred_rank,
  row_number() OVER (PARTITION BY series, race_seq, method ORDER BY position, entity) AS true_rank FROM baselines
  WHERE method IN ('grid', 'recent_form') WINDOW w AS (PARTITION BY series, race_seq, method)) WHERE n >= 3""")
cte("rank_metrics", f"""SELECT {RMS},
  sum(CASE WHEN pred_rank <= 3 THEN 1 / log2(true_rank + 1) / log2(pred_rank + 1) END) / sum(CASE WHEN true_rank <= 3 THEN 1 / log2(true_rank + 1) / log2(true_rank + 1) END) AS ndcg3,
  sum(CASE WHEN pred_rank <= 5 THEN 1 / log2(true_rank + 1) / log2(pred_rank + 1) END) / sum(CASE WHEN true_rank <= 5 THEN 1 / log2(true_rank + 1) / log2(true_rank + 1) END) AS ndcg5,
  count(*) FILTER (pred_rank = 1 AND true_rank = 1) AS winner_hit, count(*) FILTER (pred_rank <= 3 AND true_rank <= 3) AS podium_overlap,
  count(*) FILTER (pred_rank <= 5 AND true_rank <= 5) AS top5_overlap, count(*) FILTER (pred_rank <= 10 AND true_rank <= 10) AS top10_overlap,
  avg(abs(pred_rank - true_rank)) AS position_error FROM rank_pairs GROUP BY ALL""")


def preds(t: Tables):
    return baselines(t, ("grid", "recent_form")).withColumn("actual", F.col("position"))


@query("i1_ndcg", RM + "ndcg3:d ndcg5:d", "SELECT * FROM rank_metrics")
def _(t):
    return op.ranking(preds(t), BY)


@query(
    "i2_overlaps",
    RM + "winner_hit:i podium_overlap:i top5_overlap:i top10_overlap:i",
    "SELECT * FROM rank_metrics",
)
def _(t):
    return op.ranking(preds(t), BY)


@query("i3_spearman", RM + "spearman:d", f"""SELECT {RMS}, CASE WHEN min(rank) <> max(rank) AND count(*) > 1 THEN corr(rank, rp) END AS spearman FROM
  (SELECT *, rank() OVER (PARTITION BY {RMS} ORDER BY position) + (count(*) OVER (PARTITION BY {RMS}, position) - 1) / 2.0 AS rp FROM rank_pairs) GROUP BY ALL""")
def _(t):
    return op.spearman(preds(t), BY, "rank", "position")


KENDALL_SQL = """SELECT {by}, CASE WHEN any_value(nx) > 0 AND any_value(ny) > 0 THEN any_value(s) / sqrt(any_value(nx) * any_value(ny)) END AS kendall FROM
  (SELECT {a}, sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) AS s, count(*) FILTER (a.{x} <> b.{x}) AS nx, count(*) FILTER (a.{y} <> b.{y}) AS ny
   FROM {src} a JOIN {src} b ON {on} AND a.entity < b.entity GROUP BY ALL) GROUP BY ALL"""


@query(
    "i4_kendall",
    RM + "kendall:d",
    KENDALL_SQL.format(by=RMS, a="a.series, a.race_seq, a.method", x="rank", y="position", src="rank_pairs",
                       on="a.series = b.series AND a.race_seq = b.race_seq AND a.method = b.method"),
)
def _(t):
    return op.kendall(preds(t), BY, "rank", "position")


@query(
    "i4_kendall_ties_both_sides",
    "series:i race_seq:i kendall:d",
    KENDALL_SQL.format(by="series, race_seq", a="a.series, a.race_seq", x="laps", y="points", src="contest",
                       on="a.series = b.series AND a.race_seq = b.race_seq"),
)
def _(t):
    return op.kendall(t.contest, ["series", "race_seq"], "laps", "points")


@query(
    "i5_ranking_guards",
    RM + "n:i",
    f"""SELECT {RMS}, count(*) AS n FROM (SELECT * FROM baselines WHERE method = 'grid' AND (position + race_seq) % 7 = 0) GROUP BY ALL HAVING count(*) >= 3""",
)
def _(t):
    d = baselines(t, ("grid",)).withColumn(
        "actual", F.when((F.col("position") + F.col("race_seq")) % 7 == 0, F.col("position"))
    )
    return op.true_ranks(d, BY).groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))


cte("dist_field", "SELECT series, race_seq, entity, position, score FROM baselines WHERE method = 'grid'")
cte("dist", f"""SELECT d.*, c.position AS actual FROM ({summary_sql('(' + counts_sql(orders_sql('dist_field', 'score', '0.6', 37, 'dist'), 37) + ')')}) d
  JOIN contest c USING (series, race_seq, entity)""")


def dist(t: Tables):
    """Stated probabilities of the grid baseline beside the actual positions."""
    d = cut(baselines(t, ("grid",)).select("series", "race_seq", "entity", "position", "score"))
    table = lw.summarise(lw.position_matrix(d, "score", 0.6, 37, tag="dist"))
    return table.join(d.select("series", "race_seq", "entity", F.col("position").alias("actual")), ["series", "race_seq", "entity"])


R2 = ["series", "race_seq"]


@query(
    "i6_probability",
    "series:i race_seq:i win_logloss:d win_brier:d podium_brier:d top10_brier:d p_winner:d",
    """SELECT series, race_seq, -ln(greatest(max(p) FILTER (won = 1), 1e-12)) AS win_logloss, sum((p - won) * (p - won)) AS win_brier,
      avg((p_podium - (actual <= 3)::INT) ** 2) AS podium_brier, avg((p_top10 - (actual <= 10)::INT) ** 2) AS top10_brier, max(p) FILTER (won = 1) AS p_winner
      FROM (SELECT *, CAST(actual = min(actual) OVER w AS INT) AS won, p_win / sum(p_win) OVER w AS p FROM dist WINDOW w AS (PARTITION BY series, race_seq)) GROUP BY ALL""",
)
def _(t):
    return op.probability(dist(t), R2)


@query("i7_position_error", RM + "position_error:d", "SELECT * FROM rank_metrics")
def _(t):
    return op.ranking(preds(t), BY)


@query(
    "i8_pole_logloss",
    "series:i race_seq:i pole_logloss:d",
    """SELECT series, race_seq, -ln(greatest(arg_min(p, (quali_position, entity)), 1e-12)) AS pole_logloss FROM
      (SELECT q.*, exp(score / 0.7) / sum(exp(score / 0.7)) OVER (PARTITION BY series, race_seq) AS p FROM
       (SELECT b.*, c.quali_position FROM baselines b JOIN contest c USING (series, race_seq, entity) WHERE method = 'recent_form') q)
      WHERE quali_position IS NOT NULL GROUP BY ALL""",
)
def _(t):
    q = t.contest.select("series", "race_seq", "entity", "quali_position")
    d = baselines(t, ("recent_form",)).join(q, ["series", "race_seq", "entity"])
    return op.target_logloss(lw.plackett_luce(d, "score", 0.7, "p"), R2, "p", "quali_position", "pole_logloss")


cte("outcome_table", """SELECT series, race_seq, entity, p_win, CAST(actual = min(actual) OVER (PARTITION BY series, race_seq) AS INT) AS won,
  p_podium, CAST(actual <= 3 AS INT) AS podium, p_top10, CAST(actual <= 10 AS INT) AS top10 FROM dist""")


def outcomes(t):
    return op.outcome_rows(dist(t), R2)


@query(
    "i9_outcome_rows",
    "series:i race_seq:i entity:i p_win:d won:i p_podium:d podium:i p_top10:d top10:i",
    "SELECT * FROM outcome_table",
)
def _(t):
    return outcomes(t)


BUCKET_SQL = "CASE " + " ".join(f"WHEN p <= {e} THEN {i}" for i, e in enumerate(RELIABILITY_EDGES[1:])) + " END"


def wilson_sql(h: str, n: str) -> tuple[str, str]:
    c = f"(({h}) / {n}::DOUBLE + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n})"
    w = f"1.96 * sqrt(({h}) / {n}::DOUBLE * (1 - ({h}) / {n}::DOUBLE) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})"
    return f"greatest(0.0, {c} - {w})", f"least(1.0, {c} + {w})"


_LO, _HI = wilson_sql("sum(y)", "count(*)")


@query(
    "i10_reliability",
    "bucket:i stated:d observed:d hits:i n:i ci_low:d ci_high:d",
    f"""SELECT bucket, avg(p) AS stated, avg(y) AS observed, sum(y) AS hits, count(*) AS n, {_LO} AS ci_low, {_HI} AS ci_high
      FROM (SELECT {BUCKET_SQL} AS bucket, p, y FROM (SELECT round(p_podium, 12) AS p, podium AS y FROM outcome_table)) GROUP BY bucket""",
)
def _(t):
    return op.reliability(outcomes(t), "p_podium", "podium")


@query(
    "i11_calibration_error",
    "ece:d n:i",
    """SELECT sum(m * abs(s - o)) / sum(m) AS ece, CAST(sum(m) AS BIGINT) AS n FROM (SELECT b, count(*) AS m, avg(p) AS s, avg(y) AS o FROM
      (SELECT p, y, ntile(10) OVER (ORDER BY p, y) AS b FROM (SELECT round(p_podium, 12) AS p, podium AS y FROM outcome_table)) GROUP BY b)""",
)
def _(t):
    # Sums of shares differ by rounding error between engines, which must not order equal values.
    return op.calibration_error(outcomes(t).withColumn("p_podium", F.round("p_podium", 12)), "p_podium", "podium")


@query(
    "i12_wilson",
    "quality:i hits:i n:i ci_low:d ci_high:d",
    "SELECT quality, hits, n, {0} AS ci_low, {1} AS ci_high FROM (SELECT quality, sum(toxic) AS hits, count(*) AS n FROM labels GROUP BY quality)".format(
        *wilson_sql("hits", "n")),
)
def _(t):
    d = t.raw("labels").groupBy("quality").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n"))
    return d.withColumns({"ci_low": wilson_low("hits", "n"), "ci_high": wilson_high("hits", "n")})


R = 5000


def boot_sql(src: str, key: str, by: list[str], values: list[str], r: int, tag: str = "boot") -> str:
    """(by, metric, mean, ci_low, ci_high, n): the same hashed Poisson weights, written out in SQL."""
    b = ", ".join(by)
    bc = f"{b}, " if by else ""
    keys = [k.strip() for k in key.split(",")]
    parts = ", ".join([f"'{tag}'", *[f"CAST({k} AS VARCHAR)" for k in (*by, *keys, "g")]])
    weight = " + ".join(f"(u >= '{c}')::INT" for c in POISSON_CUTS)
    means = ", ".join(f"sum(w * {v}) / nullif(sum(CASE WHEN {v} IS NOT NULL THEN w END), 0) AS {v}" for v in values)
    return f"""WITH h AS (SELECT s.*, g, md5(concat_ws('|', {parts})) AS h FROM {src} s, range(0, {(r + DRAWS - 1) // DRAWS}) x(g)),
      d AS (SELECT *, {weight} AS w FROM (SELECT h.*, g * {DRAWS} + i + 1 AS replicate, substr(h, CAST(4 * i + 1 AS BIGINT), 4) AS u FROM h, range(0, {DRAWS}) y(i))),
      m AS (SELECT {bc}replicate, {means} FROM d WHERE replicate <= {r} GROUP BY ALL),
      l AS ({' UNION ALL '.join(f"SELECT {bc}'{v}' AS metric, quantile_cont({v}, 0.025) AS ci_low, quantile_cont({v}, 0.975) AS ci_high FROM m {'GROUP BY ' + b if by else ''}" for v in values)}),
      a AS ({' UNION ALL '.join(f"SELECT {bc}'{v}' AS metric, avg({v}) AS mean, count({v}) AS n FROM {src} {'GROUP BY ' + b if by else ''}" for v in values)})
      SELECT * FROM a JOIN l USING ({bc}metric)"""


@query(
    "i13_bootstrap_mean",
    "method:s metric:s mean:d ci_low:d ci_high:d n:i",
    boot_sql("rank_metrics", "series, race_seq", ["method"], ["ndcg5", "position_error"], R),
)
def _(t):
    m = cut(op.ranking(preds(t), BY))
    return op.bootstrap_intervals(m, R2, ["method"], ["ndcg5", "position_error"], R)


cte("paired_diffs", """SELECT a.series, a.race_seq, 'recent_form' AS method, a.ndcg5 - b.ndcg5 AS ndcg5, a.winner_hit - b.winner_hit AS winner_hit,
  a.position_error - b.position_error AS position_error FROM rank_metrics a JOIN rank_metrics b USING (series, race_seq)
  WHERE a.method = 'recent_form' AND b.method = 'grid'""")
PAIRED = ("ndcg5", "winner_hit", "position_error")
BETTER_SQL = """CASE WHEN ci_low > 0 THEN CASE WHEN metric IN ({low}) THEN {b} ELSE {a} END WHEN ci_high < 0 THEN CASE WHEN metric IN ({low}) THEN {a} ELSE {b} END ELSE 'unclear' END"""
LOW = ", ".join(f"'{m}'" for m in sorted(LOWER_IS_BETTER))
cte("paired_table", f"""SELECT q.method, q.metric, s.value, s.reference_value, q.mean AS difference, ci_low, ci_high, q.n AS n_events,
  {BETTER_SQL.format(low=LOW, a="q.method", b="'grid'").replace('metric IN', 'q.metric IN')} AS better FROM ({boot_sql('paired_diffs', 'series, race_seq', ['method'], list(PAIRED), R)}) q JOIN
  ({' UNION ALL '.join(f"SELECT '{m}' AS metric, avg({m}) FILTER (method = 'recent_form') AS value, avg({m}) FILTER (method = 'grid') AS reference_value FROM rank_metrics" for m in PAIRED)}) s
  ON s.metric = q.metric""")


def paired(t: Tables):
    m = cut(op.ranking(preds(t), BY))
    return op.paired_comparison(m, R2, PAIRED, "grid", replicates=R)


@query(
    "i14_paired_comparison",
    "method:s metric:s value:d reference_value:d difference:d ci_low:d ci_high:d better:s n_events:i",
    "SELECT * FROM paired_table",
)
def _(t):
    return paired(t)


@query(
    "i15_clear_verdict",
    "method:s metric:s verdict:s",
    f"""SELECT method, metric, CASE WHEN ci_low > 0 THEN CASE WHEN metric IN ({LOW}) THEN 'worse' ELSE 'better' END
      WHEN ci_high < 0 THEN CASE WHEN metric IN ({LOW}) THEN 'better' ELSE 'worse' END ELSE 'unclear' END AS verdict FROM paired_table""",
)
def _(t):
    return paired(t).withColumn("verdict", op.clear_verdict())


cte("all_errors", """SELECT series, race_seq, method, avg(abs(pred - tr)) AS position_error FROM (SELECT series, race_seq, method, pred,
  row_number() OVER (PARTITION BY series, race_seq, method ORDER BY position, entity) AS tr FROM baselines) GROUP BY ALL""")
cte("variant_diffs", """SELECT a.series, a.race_seq, a.method, a.position_error - b.position_error AS position_error FROM all_errors a
  JOIN all_errors b USING (series, race_seq) WHERE a.method <> 'grid' AND b.method = 'grid'""")


@query(
    "i16_paired_table",
    "method:s metric:s difference:d ci_low:d ci_high:d",
    "SELECT method, metric, mean AS difference, ci_low, ci_high FROM (" + boot_sql("variant_diffs", "series, race_seq", ["method"], ["position_error"], R) + ")",
)
def _(t):
    m = cut(op.ranking(baselines(t).withColumn("actual", F.col("position")), BY))
    return op.paired_comparison(m, R2, ("position_error",), "grid", replicates=R)
