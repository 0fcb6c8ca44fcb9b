"""The linear pairwise ranker on grouped rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import EXPLANATION_GROUPS, GROUP_LABELS, PENALTY_GAP
from ..operators import ranker as op
from ..plans import evaluate as ev, features as ft
from ..session import cut
from ..sources.contest import EVENT, Tables
from .registry import query
from .sqlbase import cte

FEATS = ("grid", "drv_avg_finish_5", "quali_position")
TWO = ("grid", "drv_avg_finish_5")

cte("train_field", """SELECT series, season, round, make_date(season, round, 28) AS race_date, race_seq, entity, team, position, quali_position, grid, drv_avg_finish_5, drv_dnf_rate_10, greatest(24 - position, 0) AS label,
  greatest(pow(2.0, -((SELECT max(season) FROM fa_entity) - season) / 2.0), 0.15) AS weight FROM fa_entity""")


def latest_season(d) -> int:
    """The last season that a frame trains on."""
    return d.agg(F.max("season")).first()[0] or 0


def dated(d):
    """Event dates of the contest view: its rounds are months."""
    return d.withColumn("race_date", F.make_date("season", "round", F.lit(28)))


def train_field(t: Tables):
    """The label, two or three plain inputs and the recency weight."""
    d = ft.add_form(t.outcomes).withColumn("label", ft.relevance("position"))
    d = dated(op.recency_weights(d, 2.0, latest_season(t.outcomes)))
    return d.select(*EVENT, "race_date", "race_seq", "entity", "team", "position", "quali_position", "grid", "drv_avg_finish_5", "drv_dnf_rate_10", "label", "weight")


@query(
    "f0_prepare",
    "series:i race_seq:i entity:i group:s label:i",
    """SELECT series, race_seq, entity, series || ':' || race_seq AS "group", 24 - quali_position AS label FROM contest WHERE quali_position IS NOT NULL""",
)
def _(t):
    d = t.contest.withColumn("label", ft.relevance("quali_position"))
    return op.prepare(d, "label")


@query("f1_recency_weights", "series:i season:i round:i weight:d", "SELECT DISTINCT series, season, round, weight FROM train_field")
def _(t):
    return train_field(t).select(*EVENT, "weight").distinct()


# Filled inputs and the sums over all within-event pairs, solved for two inputs.
cte("train_filled", """SELECT * EXCLUDE (drv_avg_finish_5), coalesce(drv_avg_finish_5, avg(drv_avg_finish_5) OVER (PARTITION BY series, race_seq), 0) AS f5,
  CAST(grid AS DOUBLE) AS g, row_number() OVER (PARTITION BY series, race_seq ORDER BY label DESC, entity) AS turn FROM train_field""")


def fit_sql(where: str, pair: str = "true", weight: str = "a.weight", before: str = "a.race_seq < k.cutoff") -> str:
    """Normal equations over explicit pairs, each event's pairs weighing the same."""
    return f"""SELECT key, (sxy1 * s22 - sxy2 * s12) / (s11 * s22 - s12 * s12) AS c1, (sxy2 * s11 - sxy1 * s12) / (s11 * s22 - s12 * s12) AS c2 FROM
      (SELECT key, sum(w * x1 * x1) AS s11, sum(w * x1 * x2) AS s12, sum(w * x2 * x2) AS s22, sum(w * x1 * y) AS sxy1, sum(w * x2 * y) AS sxy2 FROM
       (SELECT *, weight / count(*) OVER (PARTITION BY key, series, race_seq) AS w FROM
        (SELECT k.key, a.series, a.race_seq, {weight} AS weight, a.g - b.g AS x1, a.f5 - b.f5 AS x2, a.label - b.label AS y
         FROM train_filled a JOIN train_filled b ON a.series = b.series AND a.race_seq = b.race_seq AND a.turn < b.turn AND {pair}
         JOIN ({where}) k ON {before})) GROUP BY key)"""


def _coefficients(t, ranker):
    rows = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.lit(c).alias("coefficient")) for f, c in zip(ranker.features, ranker.members[0])]
    )
    return t.contest.agg(F.count(F.lit(1)).alias("_n")).select(F.inline(rows))


COEF = "SELECT 'grid' AS feature, c1 AS coefficient FROM ({0}) UNION ALL SELECT 'drv_avg_finish_5', c2 FROM ({0})"
ALL_EVENTS = "SELECT 0 AS key, 1000 AS cutoff"


@query("f2_train", "feature:s coefficient:d", COEF.format(fit_sql(ALL_EVENTS)))
def _(t):
    return _coefficients(t, op.train(cut(train_field(t)), TWO, "label"))


@query("f2_train_top8", "feature:s coefficient:d", COEF.format(fit_sql(ALL_EVENTS, "a.turn <= 8")))
def _(t):
    return _coefficients(t, op.train(cut(train_field(t)), TWO, "label", top=8))


cte("fitted", fit_sql(ALL_EVENTS))
cte("model_scores", """SELECT *, (raw - avg(raw) OVER w) / CASE WHEN stddev_pop(raw) OVER w > 1e-9 THEN stddev_pop(raw) OVER w ELSE 1 END AS score FROM
  (SELECT t.*, c1, c2, c1 * g + c2 * f5 AS raw FROM train_filled t, (SELECT c1, c2 FROM fitted) f) WINDOW w AS (PARTITION BY series, race_seq)""")


@query("f3_score", "series:i race_seq:i entity:i score:d", "SELECT * FROM model_scores")
def _(t):
    d = cut(train_field(t))
    return op.train(d, TWO, "label").score(d)


cte("model_contributions", """SELECT series, race_seq, entity, grid, quali_position, u.feature, u.c AS contribution FROM
  (SELECT *, CASE WHEN stddev_pop(raw) OVER w > 1e-9 THEN stddev_pop(raw) OVER w ELSE 1 END AS sd, g - avg(g) OVER w AS dg, f5 - avg(f5) OVER w AS df
   FROM model_scores WINDOW w AS (PARTITION BY series, race_seq)), LATERAL (VALUES ('grid', c1 * dg / sd), ('drv_avg_finish_5', c2 * df / sd)) u(feature, c)""")


@query("f4_contributions", "series:i race_seq:i entity:i feature:s contribution:d", "SELECT * FROM model_contributions")
def _(t):
    d = cut(train_field(t))
    return op.train(d, TWO, "label").contributions(d)


def _grouped(t):
    d = cut(train_field(t))
    three = op.ensemble([op.train(d, FEATS, "label", ridge=0.01), op.train(d.where("season >= 1998"), FEATS, "label", ridge=0.01)])
    keep = ["grid", "quali_position"]
    long = three.contributions(d.withColumnsRenamed({}), keep=()).join(d.select("series", "race_seq", "entity", *keep), ["series", "race_seq", "entity"])
    apart = F.coalesce(F.abs(F.col("grid") - F.col("quali_position")) >= PENALTY_GAP, F.lit(False))
    return op.grouped_contributions(long, EXPLANATION_GROUPS, ["series", "race_seq", "entity"], apart)


@query("f5_grouped_contributions", "series:i race_seq:i entity:i group:s contribution:d", None)
def _(t):
    return _grouped(t)


@query("f5_groups_of_two", "series:i race_seq:i entity:i group:s contribution:d",
       """SELECT series, race_seq, entity, CASE feature WHEN 'grid' THEN 'grid' ELSE 'race_form' END AS "group", contribution FROM model_contributions""")
def _(t):
    d = cut(train_field(t))
    long = op.train(d, TWO, "label").contributions(d)
    return op.grouped_contributions(long, EXPLANATION_GROUPS, ["series", "race_seq", "entity"])


@query(
    "f6_explain",
    "series:i race_seq:i entity:i why:s",
    """SELECT series, race_seq, entity, upper(s[1]) || s[2:] AS why FROM (SELECT series, race_seq, entity, concat_ws(', ',
      CASE WHEN max(c) > 0 THEN 'helped by ' || arg_max(l, (c, l)) END, CASE WHEN min(c) < 0 THEN 'held back by ' || arg_min(l, (c, l)) END) AS s FROM
      (SELECT *, round(contribution, 9) AS c, CASE feature WHEN 'grid' THEN 'starting position' ELSE 'recent race results' END AS l FROM model_contributions) GROUP BY ALL)""",
)
def _(t):
    d = cut(train_field(t))
    long = op.train(d, TWO, "label").contributions(d)
    keys = ["series", "race_seq", "entity"]
    return op.explain(op.grouped_contributions(long, EXPLANATION_GROUPS, keys), GROUP_LABELS, keys)


@query("f_full_model", "series:i race_seq:i entity:i score:d", None)
def _(t):
    d = cut(dated(ft.build(t, upcoming=False)))
    return ev.fitted(d, ft.RACE_FEATURES, "race_relevance", 2.0, 8, 0.01).score(d)
