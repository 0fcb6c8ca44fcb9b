"""Time-safe windows: no function here lets a row see its own or a later event.

Keys are lists of column names. Where they start with a column the frame is
already partitioned by (the series), Spark plans no further shuffle. Grouped
forms need no self-join: one row per (group, event) carries the collapsed value
and a RANGE frame over an event counter reads the earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_AGG = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def prior_rolling(df: DataFrame, by: list[str], seq: str, specs: dict[str, tuple[str, int, str]]) -> DataFrame:
    """Statistic over the previous n rows, current one excluded; null rows take a place.

    Only for keys with one row per event. specs: out -> (column, n, how)."""
    w = W.partitionBy(*by).orderBy(seq)
    return df.withColumns({o: _AGG[how](c).over(w.rowsBetween(-n, -1)) for o, (c, n, how) in specs.items()})


def prior_valid(df: DataFrame, by: list[str], seq: str, specs: dict[str, tuple[str, int | None, str]]) -> DataFrame:
    """Statistic over the last n non-null values strictly before the row (None = all).

    The last n values are read by lags that skip nulls, all in one window, so the rows of a key are sorted once
    however many columns there are."""
    w = W.partitionBy(*by).orderBy(seq)
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    over = f"OVER (PARTITION BY {', '.join(f'`{b}`' for b in by)} ORDER BY `{seq}`)"
    deepest: dict[str, int] = {}
    for c, n, _ in specs.values():
        if n:
            deepest[c] = max(n, deepest.get(c, 0))
    lags = {(c, k): f"_lag_{i}_{k}" for i, c in enumerate(sorted(deepest)) for k in range(1, deepest[c] + 1)}
    df = df.withColumns({
        **{name: F.expr(f"lag(`{c}`, {k}) IGNORE NULLS {over}") for (c, k), name in lags.items()},
        **{name: _AGG[how](c).over(earlier) for name, (c, n, how) in specs.items() if n is None},
    })
    out = {name: _of_last([F.col(lags[c, k]) for k in range(1, n + 1)], how) for name, (c, n, how) in specs.items() if n}
    return df.withColumns(out).drop(*lags.values())


def _of_last(values: list[Column], how: str) -> Column:
    """A statistic of the values that are there, as the aggregate of that name gives it."""
    known = F.filter(F.array(*values), lambda x: x.isNotNull())
    size = F.size(known)
    if how == "count":
        return size.cast("long")
    if how in ("min", "max"):
        return (F.array_min if how == "min" else F.array_max)(known)
    if how == "median":
        order = F.array_sort(F.transform(known, lambda x: x.cast("double")))
        low, high = F.get(order, F.floor((size - 1) / 2).cast("int")), F.get(order, F.floor(size / 2).cast("int"))
        return F.when(size > 0, low + (high - low) * 0.5)
    total = F.aggregate(F.transform(known, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.when(size > 0, total / size if how == "mean" else total)


def prior_by_event(
    df: DataFrame,
    group: list[str],
    seq: str,
    member: str,
    specs: dict[str, tuple[str, str, int | None, str]],
    skip_nulls: bool | tuple[str, ...] = False,
) -> DataFrame:
    """Collapse a group to one value per event, then look back over earlier events.

    specs: out -> (column, collapse, n, statistic); n counts events, or only
    events with a value for the outputs in skip_nulls (True = all of them);
    None looks back to the start."""
    skipping = set(specs) if skip_nulls is True else set(skip_nulls or ())
    keys = sorted({(c, how) for c, how, _, _ in specs.values()})
    value = {k: f"_v{i}" for i, k in enumerate(keys)}
    event = W.partitionBy(*group, seq)
    history = W.partitionBy(*group).orderBy(seq)
    before = history.rangeBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_first", F.row_number().over(event.orderBy(member)) == 1).withColumns(
        {v: F.when(F.col("_first"), _AGG[how](c).over(event)) for (c, how), v in value.items()}
    )
    counted = sorted({value[s[:2]] for o, s in specs.items() if o in skipping and s[2] is not None})
    helpers = {f"{v}n": F.count(v).over(before) for v in counted}
    if any(s[2] is not None for o, s in specs.items() if o not in skipping):
        helpers["_turn"] = F.dense_rank().over(history)
    if helpers:
        df = df.withColumns(helpers)
    out = {}
    for name, (c, how, n, stat) in specs.items():
        v = value[(c, how)]
        if n is None:
            frame = before
        else:
            frame = W.partitionBy(*group).orderBy(f"{v}n" if name in skipping else "_turn").rangeBetween(-n, -1)
        out[name] = _AGG[stat](v).over(frame)
    return df.withColumns(out).drop("_first", *helpers, *value.values())


def prior_count(by: list[str], seq: str) -> Column:
    """How many earlier rows the key has."""
    return F.row_number().over(W.partitionBy(*by).orderBy(seq)) - 1


def event_sequence(df: DataFrame, scope: list[str], order: list[str], out: str = "race_seq") -> DataFrame:
    """Number the events of each scope in order, from 0."""
    w = W.partitionBy(*scope).orderBy(*order)
    return df.withColumn(out, (F.dense_rank().over(w) - 1).cast("int"))


def integrity_problems(df: DataFrame, scope: list[str], order: list[str], entity: str, seq: str) -> DataFrame:
    """Duplicate (event, entity) keys, and sequences that do not follow the order columns."""
    key = [*scope, *order, entity]
    duplicates = (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(*scope, *order, F.lit("duplicate key").alias("problem"))
    )
    events = df.groupBy(*scope, *order).agg(F.min(seq).alias("_lo"), F.max(seq).alias("_hi"))
    previous = F.lag("_hi").over(W.partitionBy(*scope).orderBy(*order))
    disorder = (
        events.withColumn("_p", previous).where("_lo <> _hi or _lo <= _p")
        .select(*scope, *order, F.lit("sequence not increasing").alias("problem"))
    )
    return duplicates.unionByName(disorder)


def gap_to_best(value: str, by: list[str]) -> Column:
    """Percentage above the best of the group."""
    best = F.min(value).over(W.partitionBy(*by))
    return (F.col(value) / best - 1.0) * 100


def teammate_gap(value: str, by: list[str]) -> Column:
    """Percentage above the team's best, only where the team has two values."""
    w = W.partitionBy(*by)
    gap = (F.col(value) / F.min(value).over(w) - 1.0) * 100
    return F.when(F.count(value).over(w) >= 2, gap)


def average_rank(order: Column, by: list[str], ties: list[str | Column]) -> Column:
    """Rank with ties averaged (all rows of the group must fit one task: use on bounded fields)."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(W.partitionBy(*by, *ties)) - 1) / 2.0
