"""Many models of one frame from one pass: variants differ in their inputs and penalty, not in what is summed.

The normal equations of all inputs hold those of every subset, so one set of sums per event date serves all variants:
each takes its own rows and columns of it. Scoring reads the frame once, with a row per variant.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import MIN_TRAIN_EVENTS
from ..operators import listwise as lw, metrics as mt, ranker as rk
from . import evaluate as ev
from .evaluate import DATE, EVENT

RIDGE = 0.01


@dataclass(frozen=True)
class Variant:
    features: tuple[str, ...]
    ridge: float = RIDGE
    recency: float | None = 2.0


def variant_scores(
    df: DataFrame, targets: DataFrame, variants: Mapping[str, Variant], label: str, top: int | None = None, every: int = 1,
    least: int = MIN_TRAIN_EVENTS, date: str = DATE, gain: str | None = None, varied: DataFrame | None = None,
) -> DataFrame:
    """Out-of-sample scores of every variant on the target events, column ``method``; as ``evaluate.oos_scores`` gives one.

    ``gain``: weigh pairs by what swapping them costs in discounted gain (``ranker.gain_rows``). ``varied``: rows to score
    instead of ``df``'s, with a column ``view``; a method is then ``view:variant``."""
    every_feature = tuple(dict.fromkeys(f for v in variants.values() for f in v.features))
    rk.require(df, [label, date, *every_feature])
    dates = [r[0] for r in df.select(date).distinct().collect()]
    wanted = [r[0] for r in df.join(targets.select(*EVENT).distinct(), EVENT, "left_semi").select(date).distinct().collect()]
    plan = ev.refit_plan(dates, wanted, every, least)
    sums = ev.event_sums(df, every_feature, label, date, top, gain)
    models: dict = {}
    for name, v in variants.items():
        at = [every_feature.index(f) for f in v.features]
        fits = ev.solve_cutoffs(ev.sub_sums(sums, len(every_feature), at), list(plan.values()), len(at), v.recency, v.ridge, date)
        for target, cutoff in plan.items():
            if cutoff in fits:
                own: list = [None] * len(every_feature)
                for i, c in zip(at, fits[cutoff]):
                    own[i] = float(c)
                models.setdefault((target, cutoff), []).append((name, own))
    kind = df.schema[date].dataType.simpleString()
    rows = [(*key, fits) for key, fits in models.items()]
    models = df.sparkSession.createDataFrame(rows, f"{date} {kind}, cutoff {kind}, _m array<struct<method:string,c:array<double>>>")
    source = df if varied is None else varied
    scope = EVENT if varied is None else [*EVENT, "view"]
    w = W.partitionBy(*scope)
    x = {f"_x{i}": F.coalesce(F.col(f).cast("double"), F.avg(F.col(f).cast("double")).over(w), F.lit(0.0)) for i, f in enumerate(every_feature)}
    # A row per date, and every variant's score is worked out and standardised before the rows multiply.
    d = source.join(targets.select(*EVENT).distinct(), EVENT, "left_semi").join(F.broadcast(models), date).withColumns(x)
    names = [f"_raw{k}" for k in range(len(variants))]
    for k, name in enumerate(names):
        own = F.get("_m", F.lit(k))["c"]
        raw = F.lit(0.0)
        for i, n in enumerate(x):
            raw = raw + F.coalesce(F.get(own, F.lit(i)) * F.col(n), F.lit(0.0))
        d = d.withColumn(name, raw)
    d = d.withColumns({f"_score{k}": standardised(n, w) for k, n in enumerate(names)})
    each = F.array(*[F.struct(F.get("_m", F.lit(k))["method"].alias("method"), F.col(f"_score{k}").alias("score")) for k in range(len(names))])
    d = d.drop(*x, *names).withColumn("_each", F.explode(each)).where("_each.method is not null")
    method = F.col("_each.method")
    if varied is not None:
        method = F.concat_ws(":", "view", method)
    return d.withColumns({"method": method, "score": F.col("_each.score")}).drop("_m", "_each", *(f"_score{k}" for k in range(len(names))))


def standardised(raw: str, w) -> Column:  # noqa: ANN001
    """A column over its window's mean and spread; a constant field is only centred."""
    sd = F.stddev_pop(raw).over(w)
    return (F.col(raw) - F.avg(raw).over(w)) / F.when(sd > 1e-9, sd).otherwise(1.0)


def ablation_sets(full: Sequence[str], groups: Mapping[str, Sequence[str]], candidates: Mapping[str, Sequence[str]], anchor: str = "grid") -> dict[str, Variant]:
    """The anchor alone, the anchor and each group, the full model, without each group, and with each candidate."""
    sets = {f"{anchor} only": (anchor,)}
    sets |= {f"{anchor} + {g}": tuple(dict.fromkeys((anchor, *cols))) for g, cols in groups.items()}
    sets["full"] = tuple(full)
    sets |= {f"full - {g}": tuple(f for f in full if f not in set(cols)) for g, cols in groups.items()}
    sets |= {f"full + {c}": (*full, *cols) for c, cols in candidates.items()}
    return {name: Variant(cols) for name, cols in sets.items()}


def windowed(rows: DataFrame, split: int | Column) -> DataFrame:
    """Graded events with the window they belong to: ``tuning`` before the season ``split``, ``later`` from it on."""
    return rows.withColumn("window", F.when(F.col("season") < split, "tuning").otherwise("later"))


def before_qualifying(df: DataFrame, quali_scores: DataFrame) -> DataFrame:
    """The events' rows as they stand before qualifying: the order that ``score`` of ``quali_scores`` projects, and prior averages."""
    q = quali_scores.select(*EVENT, "entity", F.col("score").alias("_q"))
    types = dict(df.dtypes)
    seen = lw.projected_weekend(df.join(q, [*EVENT, "entity"]), "_q", EVENT).drop("_q")
    return seen.withColumns({c: F.col(c).cast(types[c]) for c in ("grid", "quali_position")})


def picked(table: DataFrame, metric: str, keep: Sequence[str], guard: Sequence[str], lower: bool = False) -> DataFrame:
    """One row per variant of a comparison by window: its gain on the tuning window, whether it is the one picked for the largest
    gain, and whether it is then kept: on the later window clearly better on a keep metric and clearly worse on no guard metric."""
    d = table.withColumn("verdict", mt.clear_verdict())
    late, tuned = F.col("window") == "later", (F.col("window") == "tuning") & (F.col("metric") == metric)
    good = F.col("metric").isin(*keep) & (F.col("verdict") == "better")
    bad = F.col("metric").isin(*guard) & (F.col("verdict") == "worse")
    sign = -1.0 if lower else 1.0
    g = d.groupBy("method").agg(F.max(F.when(tuned, sign * F.col("difference"))).alias("gain"), (F.bool_or(late & good) & ~F.bool_or(late & bad)).alias("_kept"))
    first = F.row_number().over(W.partitionBy().orderBy(F.desc_nulls_last(F.round("gain", 10)), "method")) == 1  # one row per variant
    return g.withColumn("picked", first).withColumn("adopt", F.col("picked") & F.coalesce("_kept", F.lit(False))).drop("_kept")
