"""Walk-forward evaluation: train on earlier events only, grade every event at once.

Scores live in one long table (event, entity, method, score, place). Everything after
scoring is one plan over all events and methods. Only sums per event date,
bounded by the calendar, and the coefficients solved from them reach the driver.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from ..constants import CALIBRATION_WARMUP, MIN_TRAIN_EVENTS, RECENCY_FLOOR
from ..operators import listwise as lw, metrics as mt, ranker as rk
from ..operators.marginals import exact_positions
from ..operators.ranker import EVENT
from ..session import cut

DATE = "race_date"
METHOD_EVENT = [*EVENT, "method"]


def completed_events(df: DataFrame, start: int, end: int | None = None, place: str = "position") -> DataFrame:
    d = df.where(F.col(place).isNotNull() & (F.col("season") >= start))
    if end is not None:
        d = d.where(F.col("season") <= end)
    return d.select("series", "race_seq", "season", "round").distinct()


def refit_plan(dates: Sequence, targets: Sequence, every: int, least: int = MIN_TRAIN_EVENTS) -> dict:
    """Target date -> training cut-off. A fit is reused only for later targets, ``every`` at a time."""
    known = sorted(set(dates))
    eligible = [t for t in sorted(set(targets)) if bisect_left(known, t) >= least]
    return {t: eligible[i // every * every] for i, t in enumerate(eligible)}


def event_sums(df: DataFrame, features: Sequence[str], label: str, date: str = DATE, top: int | None = None, gain: str | None = None) -> list[Row]:
    """Sums of weight, x x' and x y over the regression rows of each (season, date): as many rows as the calendar has dates."""
    d = df.withColumn("_one", F.lit(1.0))
    event = [*EVENT, "season", date]
    rows = rk.regression_rows(d, features, label, "_one", event, top) if gain is None else rk.gain_rows(d, features, label, "_one", event, gain)
    parts = rows.select("season", date, F.col("_w").cast("double").alias("_w"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([label, *features])])
    n = len(features)
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields[:2])
    sums = parts.mapInArrow(_products(n, date), f"{named}, w double, xx array<double>, xy array<double>")
    return sums.repartition("season", date).mapInArrow(_added(), sums.schema).collect()


def _products(n: int, date: str):  # noqa: ANN202
    """A function on Arrow batches of (season, date, weight, label, inputs): the sums of each (season, date) of a task."""

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        upper = np.triu_indices(n)
        sums: dict = {}
        kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).dictionary_encode(null_encoding="encode") for i in range(2)]
            kinds = [k.dictionary.type for k in keys]
            code = [k.indices.to_numpy(zero_copy_only=False).astype(np.int64) for k in keys]
            code = code[0] * len(keys[1].dictionary) + code[1]
            value = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]], axis=1)
            order = np.argsort(code, kind="stable")
            found, begin = np.unique(code[order], return_index=True)
            value = value[order]
            for c, low, high in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
                key = tuple(k.dictionary[i].as_py() for k, i in zip(keys, divmod(c, len(keys[1].dictionary))))
                w, x = value[low:high, :1], value[low:high, 1:]
                square = (x * w).T @ x
                one = sums.setdefault(key, [0.0, np.zeros(len(upper[0])), np.zeros(n)])
                one[0] += w.sum()
                one[1] += square[1:, 1:][upper]
                one[2] += square[1:, 0]
        if sums:
            rows = [pa.array(list(k), t) for k, t in zip(zip(*sums), kinds)]
            lists = [pa.array([one[i].tolist() for one in sums.values()], pa.list_(pa.float64())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([float(one[0]) for one in sums.values()]), *lists], names=["season", date, "w", "xx", "xy"])

    return run


def _added():  # noqa: ANN202
    """A function on Arrow batches of such sums, which adds those of each (season, date) up."""

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for *key, w, xx, xy in zip(*(c.to_pylist() for c in batch.columns)):
                one = sums.setdefault(tuple(key), [0.0, 0.0, 0.0])
                for i, v in enumerate((w, xx, xy)):
                    one[i] = one[i] + np.array(v)
        if sums:
            columns = [*zip(*sums), *([v[i].tolist() for v in sums.values()] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def sub_sums(sums: Sequence[Row], n: int, at: Sequence[int]) -> list[Row]:
    """The sums of some of ``n`` features, numbered in ``at``, from those of all."""
    pairs = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i, n))}
    cells = [pairs[min(i, j), max(i, j)] for k, i in enumerate(at) for j in at[k:]]
    fields = [f for f in (sums[0].__fields__ if sums else ()) if f not in ("xx", "xy")]
    return [Row(**{f: r[f] for f in fields}, xx=[r["xx"][c] for c in cells], xy=[r["xy"][i] for i in at]) for r in sums]


def solve_cutoffs(sums: Sequence[Row], cutoffs: Sequence, n: int, recency: float | None, ridge: float, date: str = DATE) -> dict:
    """Coefficients of each cut-off from the sums of earlier dates, their seasons weighed from the last one trained on."""
    upper = np.triu_indices(n)
    by_season: dict = {}
    out, at = {}, 0
    ordered = sorted(sums, key=lambda r: r[date])
    for cutoff in sorted(set(cutoffs)):
        while at < len(ordered) and ordered[at][date] < cutoff:
            r, at = ordered[at], at + 1
            old = by_season.get(r["season"], (0.0, np.zeros(len(upper[0])), np.zeros(n)))
            by_season[r["season"]] = (old[0] + r["w"], old[1] + np.array(r["xx"]), old[2] + np.array(r["xy"]))
        if not by_season:
            continue
        latest = max(by_season)
        total, square, cross = 0.0, np.zeros((n, n)), np.zeros(n)
        for season, (w, xx, xy) in by_season.items():
            share = 1.0 if recency is None else max(recency ** (-(latest - season) / 2.0), RECENCY_FLOOR)
            total += share * w
            square[upper] += share * xx
            cross += share * xy
        square = square + np.triu(square, 1).T + ridge * total * np.eye(n)
        out[cutoff] = np.linalg.lstsq(square, cross, rcond=None)[0]
    return out


def oos_scores(
    df: DataFrame, targets: DataFrame, features: Sequence[str], label: str, recency: float | None = None, top: int | None = None,
    ridge: float = 0.0, every: int = 1, least: int = MIN_TRAIN_EVENTS, date: str = DATE, varied: DataFrame | None = None,
    sums: list[Row] | None = None,
) -> DataFrame:
    """Out-of-sample scores of the target events: each is scored by a model of strictly earlier dates, whatever the series.

    Training pools all series by event date, so series with other calendars never lend a later event. A target needs
    ``least`` earlier dates. The normal equations are sums over events: one pass gathers them per date, running sums
    give every cut-off's, and one pass scores all events. ``varied``: rows to score instead of ``df``'s (as many
    versions of an event as its column ``method`` names). ``sums``: ``df``'s ``event_sums`` where they are known."""
    rk.require(df, [label, date, *features])
    dates = [r[0] for r in df.select(date).distinct().collect()]
    wanted = [r[0] for r in df.join(targets.select(*EVENT).distinct(), EVENT, "left_semi").select(date).distinct().collect()]
    plan = refit_plan(dates, wanted, every, least)
    sums = event_sums(df, features, label, date, top) if sums is None else sums
    fits = solve_cutoffs(sums, list(plan.values()), len(features), recency, ridge, date)
    spark = df.sparkSession
    kind = df.schema[date].dataType.simpleString()
    rows = [(t, c, [float(x) for x in fits[c]]) for t, c in plan.items() if c in fits]
    models = spark.createDataFrame(rows, f"{date} {kind}, cutoff {kind}, _c array<double>")
    source = df if varied is None else varied
    event = EVENT if varied is None else METHOD_EVENT
    d = source.join(targets.select(*EVENT).distinct(), EVENT, "left_semi").join(F.broadcast(models), date)  # a row per date
    w = W.partitionBy(*event)
    raw = F.lit(0.0)
    for i, f in enumerate(features):
        x = F.coalesce(F.col(f).cast("double"), F.avg(F.col(f).cast("double")).over(w), F.lit(0.0))
        raw = raw + F.col("_c")[i] * x
    d = d.withColumn("_raw", raw)
    sd = F.stddev_pop("_raw").over(w)
    return d.withColumn("score", (F.col("_raw") - F.avg("_raw").over(w)) / F.when(sd > 1e-9, sd).otherwise(1.0)).drop("_c", "_raw")


def fitted(
    df: DataFrame, features: Sequence[str], label: str, recency: float | None = None, top: int | None = None, ridge: float = 0.0,
    least: int = MIN_TRAIN_EVENTS, date: str = DATE, sums: list[Row] | None = None,
) -> rk.Ranker:
    """The model of all of the frame's events: that of a cut-off after its last date. Fewer than ``least`` dates are refused.
    ``sums``: the frame's ``event_sums`` where they are known."""
    rk.require(df, [label, date, *features])
    sums = event_sums(df, features, label, date, top) if sums is None else sums
    dates = {r[date] for r in sums}
    if len(dates) < least:
        raise LookupError(f"{len(dates)} dates to train on, {least} needed")
    cutoff = max(dates) + timedelta(days=1)
    return rk.Ranker(tuple(features), (tuple(float(c) for c in solve_cutoffs(sums, [cutoff], len(features), recency, ridge, date)[cutoff]),))


def eligible(df: DataFrame, least: int = MIN_TRAIN_EVENTS, date: str = DATE) -> DataFrame:
    """Events with at least ``least`` earlier dates in the frame."""
    dates = sorted(r[0] for r in df.select(date).distinct().collect())
    first = dates[least] if len(dates) > least else None
    return df.where(F.col(date) >= F.lit(first)).select(*EVENT).distinct()


def window_targets(events: DataFrame, start: int, end: int | None = None, warmup: int = CALIBRATION_WARMUP) -> DataFrame:
    """Reported events of a season window and the warm-up events before it: (event, reported)."""
    inside = F.col("season") >= start
    if end is not None:
        inside = inside & (F.col("season") <= end)
    before = events.where(F.col("season") < start)
    age = F.row_number().over(W.partitionBy("series").orderBy(F.desc("race_seq")))
    warm = before.withColumn("_a", age).where(F.col("_a") <= warmup).drop("_a")
    return events.where(inside).withColumn("reported", F.lit(True)).unionByName(warm.withColumn("reported", F.lit(False)))


def with_temperatures(
    scores: DataFrame, place: str = "place", fallback: float | Column = 1.0, depth: int = 1, fixed: float | None = None
) -> DataFrame:
    """Attach each method's trailing temperature (or a fixed one) to its rows."""
    if fixed is not None:
        return scores.withColumn("temperature", F.lit(float(fixed)))
    default = 1.0 if isinstance(fallback, Column) else fallback
    t = lw.trailing_temperature(scores, "score", place, ["series", "method"], "race_seq", default, depth, METHOD_EVENT)
    out = scores.join(t.select("series", "method", "race_seq", "temperature"), METHOD_EVENT, "left")
    return out.withColumn("temperature", F.coalesce("temperature", F.lit(float(default))))


def forecast_table(scores: DataFrame, dnf_prob: str | None = None, weight: float = 1.0, retire_both: bool = False) -> DataFrame:
    """Published probabilities per (event, method, entity) at each row's temperature, exact.

    weight 1 is the plain ranking, smoothed; below 1 the rest comes with retirements."""
    t = F.col("temperature")
    if dnf_prob is None or weight >= 1:
        m = exact_positions(scores, "score", t, {"share": retire_both and dnf_prob is not None}, dnf_prob, METHOD_EVENT)
    else:
        both = exact_positions(scores, "score", t, {"plain": retire_both, "drawn": True}, dnf_prob, METHOD_EVENT)
        m = both.withColumn("share", weight * F.col("plain") + (1.0 - weight) * F.col("drawn"))
    return lw.summarise(lw.smooth(m, by=[*METHOD_EVENT, "entity"]), METHOD_EVENT)


def grade(scores: DataFrame, table: DataFrame, place: str = "place") -> DataFrame:
    """One row of ranking and probability metrics per (event, method)."""
    order = F.row_number().over(W.partitionBy(*METHOD_EVENT).orderBy(F.desc("score"), "entity"))
    d = scores.withColumns({"pred": order, "actual": F.col(place)})
    ranks = mt.ranking(d, METHOD_EVENT)
    probs = mt.probability(
        table.join(scores.select(*METHOD_EVENT, "entity", F.col(place).alias("actual")), [*METHOD_EVENT, "entity"]),
        METHOD_EVENT,
    )
    return ranks.join(probs, METHOD_EVENT)


def walk_forward(
    scores: DataFrame, targets: DataFrame, place: str = "place", fallback: float = 1.0,
    dnf_prob: str | None = None, weight: float = 1.0, depth: int = 1, fixed: float | None = None, min_field: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Grade methods on the reported targets, temperatures trailing over all targets.

    Returns (metric rows per event and method, published tables with outcomes)."""
    n = F.count(place).over(W.partitionBy(*METHOD_EVENT))
    d = scores.join(targets.select(*EVENT, "season", "reported"), EVENT).withColumn("_n", n).where(F.col("_n") >= min_field)
    d = with_temperatures(d.drop("_n"), place, fallback, depth, fixed).where("reported")
    table = forecast_table(d, dnf_prob, weight)
    rows = grade(d, table, place)
    facts = d.select(*METHOD_EVENT, "season", "temperature").distinct()
    told = table.join(d.select(*METHOD_EVENT, "entity", F.col(place).alias("actual"), "season"), [*METHOD_EVENT, "entity"])
    return rows.join(facts, METHOD_EVENT), told


def walk_forward_quali(scores: DataFrame, targets: DataFrame, place: str, fallback: float = 1.0) -> DataFrame:
    """Grade the qualifying target: closed-form pole probability, order metrics, position error."""
    d = scores.join(targets.select(*EVENT, "season", "reported"), EVENT)
    d = with_temperatures(d, place, fallback).where("reported")
    order = F.row_number().over(W.partitionBy(*METHOD_EVENT).orderBy(F.desc("score"), "entity"))
    d = lw.plackett_luce(d, "score", F.col("temperature"), "p", METHOD_EVENT).withColumn("pred", order)
    ranks = mt.ranking(d, METHOD_EVENT, "pred", place).drop("position_error", "podium_overlap", "top5_overlap")
    pole = mt.target_logloss(d, METHOD_EVENT, "p", place, "pole_logloss")
    error = d.groupBy(*METHOD_EVENT, "season", "temperature").agg(
        F.avg(F.abs(F.col("pred") - F.col(place))).alias("position_error")
    )
    return ranks.withColumnRenamed("winner_hit", "pole_hit").join(pole, METHOD_EVENT).join(error, METHOD_EVENT)


def summary(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("method",)) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_events"))


def event_types(told: DataFrame) -> DataFrame:
    """Stated and observed per (method, event type), long form."""
    o = mt.outcome_rows(told, METHOD_EVENT)
    types = F.array(
        *[F.struct(F.lit(n).alias("event_type"), F.col(p).alias("p"), F.col(y).alias("y"))
          for n, p, y in (("win", "p_win", "won"), ("podium", "p_podium", "podium"), ("top10", "p_top10", "top10"))]
    )
    return o.select(*METHOD_EVENT, "entity", F.inline(types))


def winner_loss(scores: DataFrame, temperature: float, place: str = "place", by: Sequence[str] = ("method",)) -> DataFrame:
    losses = lw.temperature_losses(scores, "score", place, 1, [temperature], METHOD_EVENT)
    return losses.groupBy(*by).agg(F.avg("loss").alias("win_logloss"))


def tune_blend(scores: DataFrame, temperature, weights: Sequence[float], dnf_prob: str = "dnf_prob") -> DataFrame:
    """Mean winner loss per blend weight: both halves are worked out once, the weights vary on their winners."""
    key = [*METHOD_EVENT, "entity"]
    m = exact_positions(scores, "score", temperature, {"plain": False, "drawn": True}, dnf_prob, METHOD_EVENT)
    first = lw.top_order(scores, "place", 1, METHOD_EVENT).select(*key, F.lit(1).alias("pos"))
    both = m.join(first, [*key, "pos"]).withColumn("blend", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    p = F.col("blend") * F.col("plain") + (1 - F.col("blend")) * F.col("drawn")
    p = (1 - lw.SMOOTHING) * p + lw.SMOOTHING / F.col("field")
    loss = -F.log(F.greatest(p, F.lit(lw.LOG_FLOOR)))
    return both.groupBy("method", "blend").agg(F.avg(loss).alias("win_logloss"))


# -- decisions -------------------------------------------------------------------------
def decide(comparison: DataFrame, keep: Sequence[str], guard: Sequence[str], by: Sequence[str] = ("method",)) -> DataFrame:
    """Adopt a variant that is clearly better on one keep metric and clearly worse on no guard metric."""
    d = comparison.withColumn("verdict", mt.clear_verdict())
    good = F.col("metric").isin(*keep) & (F.col("verdict") == "better")
    bad = F.col("metric").isin(*guard) & (F.col("verdict") == "worse")
    return d.groupBy(*by).agg((F.bool_or(good) & ~F.bool_or(bad)).alias("adopt"))


def biggest_gain(comparison: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """The variant that gains most on a metric over the reference."""
    d = comparison.where(F.col("metric") == metric)
    best = F.max_by("method", F.struct(F.col("difference"), F.col("method"))).alias("picked")
    return (d.groupBy(*by) if by else d.groupBy()).agg(best)


# -- redundancy ------------------------------------------------------------------------
def null_classes(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Each column's representative: the first column that is null in the same rows."""
    duo = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    differ = df.agg(*[F.max(F.col(a).isNull() != F.col(b).isNull()).alias(f"_{k}") for k, (a, b) in enumerate(duo)]).first() if duo else ()
    out = {n: n for n in names}
    for k, (a, b) in enumerate(duo):
        if not differ[k] and out[b] == b:
            out[b] = out[a]
    return out


def feature_correlation(df: DataFrame, features: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Spearman correlation of every pair of features over the rows with both, where large.

    A feature's ranks among the rows that have another one depend only on where that one is null. Rows are counted per
    (feature, value, classes of nulls they have); running totals of those counts give a value's rank in each class. A value is
    joined to its ranks once, and tasks add up the products of all pairs over Arrow batches."""
    from ..functions.places import running_total
    from ..functions.scalars import safe_corr

    names = list(features)
    rows = cut(df.select(F.monotonically_increasing_id().alias("_id"), *[F.col(n).cast("double").alias(n) for n in names]))
    same = null_classes(rows, names)
    classes = sorted(set(same.values()))
    has = sum((F.when(F.col(c).isNotNull(), F.lit(1 << k)).otherwise(0) for k, c in enumerate(classes)), F.lit(0)).cast("long")

    def having(k: int) -> Column:
        return F.col("_has").bitwiseAND(F.lit(1 << k)) != 0

    cells = F.array(*[F.struct(F.lit(i).alias("a"), F.col(n).alias("v")) for i, n in enumerate(names)])
    long = rows.select("_id", has.alias("_has"), F.inline(cells)).where("v is not null")
    counts = long.groupBy("a", "v", "_has").agg(F.count(F.lit(1)).alias("_n"))
    split = F.inline(F.array(*[F.struct(F.lit(k).alias("c"), F.when(having(k), F.col("_n")).alias("_n")) for k in range(len(classes))]))
    counts = counts.select("a", "v", split).where("_n is not null").groupBy("a", "c", "v").agg(F.sum("_n").alias("_n"))
    ranks = running_total(counts, ["a", "c"], ["v"], "_n", "_below", "_all").select("a", "c", "v", (F.col("_below") + (F.col("_n") + 1) / 2.0).alias("r"))
    ranks = ranks.groupBy("a", "v").agg(F.array(*[F.max(F.when(F.col("c") == k, F.col("r"))) for k in range(len(classes))]).alias("_r"))
    held = long.join(ranks, ["a", "v"]).groupBy("_id").agg(F.collect_list(F.struct("a", "_r")).alias("_m"), F.first("_has").alias("_has"))
    at = [classes.index(same[n]) for n in names]
    sums = held.select("_m", "_has").mapInArrow(_rank_products(at, len(classes)), "a int, b int, n double, x double, y double, xx double, yy double, xy double")
    x = {c: F.sum(c) for c in ("n", "x", "y", "xx", "yy", "xy")}
    out = sums.groupBy("a", "b").agg(safe_corr(*(x[c] for c in x)).alias("rho"), x["n"].cast("long").alias("n"))
    called = F.array(*map(F.lit, names))
    return out.select(F.get(called, "a").alias("a"), F.get(called, "b").alias("b"), "rho", "n").where(F.abs(F.col("rho")) >= threshold)


def _rank_products(at: list[int], classes: int):  # noqa: ANN202
    """A function on Arrow batches of rows (a list of features with their ranks in every class; the classes a row has):
    counts and sums of products of all pairs of features.

    ``at``: each feature's class. A pair is ranked among the rows that have both: each feature in the other one's class."""

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        n = len(at)
        sums = np.zeros((6, n, n))
        for batch in batches:
            rows, held = batch.column(0), batch.column(1).to_numpy()
            feature, ranks = rows.flatten().flatten()
            row = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
            r = np.full((len(rows), n, classes), np.nan)
            r[row, feature.to_numpy()] = ranks.flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
            r[np.broadcast_to((held[:, None] >> np.arange(classes) & 1 == 0)[:, None], r.shape)] = np.nan
            known = ~np.isnan(r)
            r = np.where(known, r, 0.0)
            for c in range(classes):
                for e in range(classes):
                    own, other = [i for i in range(n) if at[i] == c], [i for i in range(n) if at[i] == e]
                    x, kx, y, ky = r[:, own, e], known[:, own, e] * 1.0, r[:, other, c], known[:, other, c] * 1.0
                    for k, (p, q) in enumerate(((kx, ky), (x, ky), (kx, y), (x * x, ky), (kx, y * y), (x, y))):
                        sums[k][np.ix_(own, other)] += p.T @ q
        a, b = np.triu_indices(n, 1)
        found = sums[0][a, b] > 0
        a, b = a[found], b[found]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), *(pa.array(t[a, b]) for t in sums)], names=["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    return run


def shuffle_within_events(df: DataFrame, columns: Sequence[str], tag: str, event: list[str] = EVENT) -> DataFrame:
    """Permute a group of columns together among the entrants of each event, by hashed order."""
    from ..functions.hashrand import uniform

    keys = [*event, "entity"]
    w = W.partitionBy(*event)
    base = df.withColumn("_i", F.row_number().over(w.orderBy("entity")))
    moved = df.withColumn("_i", F.row_number().over(w.orderBy(uniform(tag, *keys), "entity"))).select(*event, "_i", *columns)
    return base.drop(*columns).join(moved, [*event, "_i"]).drop("_i")


# -- diagnostics -----------------------------------------------------------------------
def entry_errors(scores: DataFrame, place: str = "place", event: list[str] = EVENT) -> DataFrame:
    """Predicted rank, actual rank and error per entry."""
    w = W.partitionBy(*event)
    d = scores.where(F.col(place).isNotNull())
    return d.withColumns(
        {
            "predicted_rank": F.row_number().over(w.orderBy(F.desc("score"), "entity")),
            "actual_rank": F.row_number().over(w.orderBy(place, "entity")),
        }
    ).withColumn("error", F.col("actual_rank") - F.col("predicted_rank"))


def entity_bias(entries: DataFrame, min_events: int, keys: Sequence[str] = ("series", "entity"), scope: Sequence[str] = ("series",)) -> DataFrame:
    """Bias per entrant, and what is left of it once the linear trend with predicted rank is removed."""
    g = (
        entries.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("events"), F.avg("error").alias("raw_bias"), F.avg(F.abs("error")).alias("mean_abs_error"),
            F.avg("predicted_rank").alias("avg_predicted"), F.avg("actual_rank").alias("avg_actual"),
        ).where(F.col("events") >= min_events)
    )
    fit = bias_trend(g, scope)
    expected = F.coalesce(F.col("slope"), F.lit(0.0)) * F.col("avg_predicted") + F.col("intercept")
    out = g.join(fit, list(scope)).withColumn("expected_from_rank", F.when(F.col("n") >= 3, expected))
    return out.withColumn("entity_bias", F.col("raw_bias") - F.col("expected_from_rank")).drop("slope", "intercept", "n", "r", "r2")


def bias_trend(per_entity: DataFrame, scope: Sequence[str] = ("series",)) -> DataFrame:
    """Line through bias against predicted rank per scope, with r and r2; flat where ranks are constant."""
    x, y, n = F.col("avg_predicted"), F.col("raw_bias"), F.count(F.lit(1))
    sx, sy, sxx, sxy, syy = F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y), F.sum(y * y)
    den = n * sxx - sx * sx
    slope = F.when(den > 1e-9, (n * sxy - sx * sy) / den).otherwise(0.0)
    from ..functions.scalars import safe_corr

    g = per_entity.groupBy(*scope).agg(
        n.alias("n"), slope.alias("slope"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        safe_corr(n, sx, sy, sxx, syy, sxy).alias("r"),
    )
    return g.select(*scope, "n", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), "r", (F.col("r") * F.col("r")).alias("r2"))
