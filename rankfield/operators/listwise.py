"""Listwise probabilities: scores of one event's field to a coherent position distribution.

A matrix is a long table (event, entity, pos, share); rows and columns of each
event sum to 1. Sampled orders derive every draw from hashed keys, so a matrix
does not depend on partitioning. Every step is keyed by the event: a frame
partitioned by series needs no shuffle for the sampling windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import (
    DNF_CAP, DNF_ENTITY_SHARE, DNF_FLOOR, DNF_TEAM_SHARE, DNF_UNKNOWN, FIELD_LIMIT, HOLD_BACK_SHARE, LOG_FLOOR,
    MIN_CALIBRATION_EVENTS, SMOOTHING, TEMPERATURES, TRAILING_EVENTS,
)
from ..functions.hashrand import gumbel, uniform
from ..functions.scalars import clip
from .marginals import exact_positions

EVENT = ["series", "race_seq"]


def _t(temperature) -> Column:
    c = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return F.greatest(c, F.lit(1e-6))


def plackett_luce(df: DataFrame, score: str, temperature, out: str = "p_win", event: list[str] = EVENT) -> DataFrame:
    """Probability of finishing first: a stable softmax of score / T within the event."""
    w = W.partitionBy(*event)
    z = (F.col(score) - F.max(score).over(w)) / _t(temperature)
    return df.withColumn("_e", F.exp(z)).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def _sampled(df: DataFrame, score: str, temperature, samples: Column, tag: str | Column, draw: Column, event: list[str]) -> DataFrame:
    """Rows times samples, ranked within (event, sample) by score / T plus Gumbel noise."""
    s = df.withColumn("_field", F.count(F.lit(1)).over(W.partitionBy(*event))).withColumn("sample", F.explode(samples))
    noisy = F.col(score) / _t(temperature) + gumbel(tag, *event, "entity", draw)
    order = W.partitionBy(*event, "sample").orderBy(F.desc("_noisy"), "entity")
    return s.withColumn("_noisy", noisy).withColumn("pos", F.row_number().over(order)).drop("_noisy")


def sample_orders(
    df: DataFrame, score: str, temperature, n_samples: int, tag: str = "pl", event: list[str] = EVENT
) -> DataFrame:
    """Exact Plackett-Luce orders: Gumbel noise on score / T, ranked within (event, sample).

    Yields a row per (event, sample, entity) with pos from 1."""
    return _sampled(df, score, temperature, F.sequence(F.lit(1), F.lit(n_samples)), tag, F.col("sample"), event)


def retire(
    orders: DataFrame, dnf_prob: str, tag: str = "dnf", event: list[str] = EVENT, only: Column | None = None,
    draw: Column | None = None,
) -> DataFrame:
    """Lose each sampled order's retirements to the back, in random order among themselves.

    With ``only``, other samples keep their order; ``draw`` numbers the draws."""
    keys = [*event, "entity", F.col("sample") if draw is None else draw]
    out = uniform(f"{tag}-out", *keys) < F.col(dnf_prob)
    out = out if only is None else only & out
    key = F.when(out, F.col("_field") + 1 + uniform(f"{tag}-order", *keys)).otherwise(F.col("pos").cast("double"))
    order = W.partitionBy(*event, "sample").orderBy("_key", "entity")
    return orders.withColumn("_key", key).withColumn("pos", F.row_number().over(order)).drop("_key")


def _laid_out(counts: DataFrame, names: list[str], event: list[str]) -> DataFrame:
    """Counts per (event, entity, pos) to a row for every position of the field, zeros included.

    Each entrant's counts are gathered in a map no larger than the field and laid out again."""
    one = counts.groupBy(*event, "entity").agg(
        F.max("_field").alias("field"), F.map_from_entries(F.collect_list(F.struct("pos", F.struct(*names)))).alias("_m")
    )
    wide = one.withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("field").cast("int"))))
    hit = F.try_element_at("_m", F.col("pos"))
    return wide.select(*event, "entity", "field", "pos", *[F.coalesce(hit[n], F.lit(0)).alias(n) for n in names])


def position_counts(orders: DataFrame, n_samples: int, event: list[str] = EVENT) -> DataFrame:
    """Share of samples per (entity, position), with zeros for positions never taken."""
    counts = orders.groupBy(*event, "entity", "pos").agg(F.count(F.lit(1)).alias("_n"), F.max("_field").alias("_field"))
    m = _laid_out(counts, ["_n"], event)
    return m.select(*event, "entity", "field", "pos", (F.col("_n") / F.lit(float(n_samples))).alias("share"))


def _fields(df: DataFrame, score: str, temperature, dnf_prob: str | None, event: list[str]) -> DataFrame:
    """One row per event with its field as an array; a field of more than FIELD_LIMIT entrants is refused."""
    item = F.struct("entity", (F.col(score) / _t(temperature)).alias("z"), (F.col(dnf_prob) if dnf_prob else F.lit(None).cast("double")).alias("d"))
    rows = df.groupBy(*event).agg(F.array_sort(F.collect_list(item)).alias("_f")).withColumn("_field", F.size("_f").cast("long"))
    return rows.withColumn("_f", F.when(F.col("_field") > FIELD_LIMIT, F.raise_error(F.lit("field too large"))).otherwise(F.col("_f")))


def _order(tag: str, dnf_tag: str | None, event: list[str]) -> Column:
    """The entrants of ``_f`` in the order that draw ``sample`` gives: Gumbel noise, then retirements to the back."""
    def first(e: Column) -> Column:
        noisy = e["z"] + gumbel(tag, *event, e["entity"], "sample")
        return F.struct(F.coalesce(-noisy, F.lit(float("inf"))).alias("k"), e["entity"].alias("entity"), e["d"].alias("d"))

    order = F.array_sort(F.transform("_f", first))
    if dnf_tag is not None:
        def again(e: Column, i: Column) -> Column:
            keys = [*event, e["entity"], "sample"]
            out = uniform(f"{dnf_tag}-out", *keys) < e["d"]
            back = F.col("_field") + 1 + uniform(f"{dnf_tag}-order", *keys)
            return F.struct(F.when(out, back).otherwise(i + 1.0).alias("k"), e["entity"].alias("entity"))

        order = F.array_sort(F.transform(order, again))
    return F.transform(order, lambda e: e["entity"])


def position_matrix(
    df: DataFrame, score: str, temperature, n_samples: int, dnf_prob: str | None = None, tag: str = "pl",
    event: list[str] = EVENT,
) -> DataFrame:
    """Shares of each finishing position, optionally with a retirement draw.

    A field is one array; each draw sorts it in place and only counts per (entity, position) are shuffled."""
    draws = _fields(df, score, temperature, dnf_prob, event).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n_samples))))
    order = _order(tag, None if dnf_prob is None else f"{tag}-dnf", event)
    orders = draws.select(*event, "_field", F.posexplode(order).alias("pos", "entity")).withColumn("pos", F.col("pos") + 1)
    return position_counts(orders, n_samples, event)


def paired_matrix(
    df: DataFrame, score: str, temperature, n_samples: int, dnf_prob: str, tags: tuple[str, str] = ("pl", "sim"),
    event: list[str] = EVENT, retire_both: bool = False,
) -> DataFrame:
    """Both halves of a mixture in one pass: ``plain`` shares and ``drawn`` shares with the retirement draw.

    Each half keys its draws as it would alone."""
    draws = _fields(df, score, temperature, dnf_prob, event).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n_samples))))
    plain = _order(tags[0], f"{tags[0]}-dnf" if retire_both else None, event)
    drawn = _order(tags[1], f"{tags[1]}-dnf", event)
    halves = F.array(F.struct(F.lit(False).alias("second"), plain.alias("o")), F.struct(F.lit(True).alias("second"), drawn.alias("o")))
    orders = draws.select(*event, "_field", F.inline(halves)).select(*event, "_field", "second", F.posexplode("o").alias("pos", "entity"))
    counts = orders.withColumn("pos", F.col("pos") + 1).groupBy(*event, "entity", "pos").agg(
        F.count(F.when(~F.col("second"), 1)).alias("_a"), F.count(F.when(F.col("second"), 1)).alias("_b"), F.max("_field").alias("_field")
    )
    m, n = _laid_out(counts, ["_a", "_b"], event), F.lit(float(n_samples))
    return m.select(*event, "entity", "field", "pos", (F.col("_a") / n).alias("plain"), (F.col("_b") / n).alias("drawn"))


# -- temperature ----------------------------------------------------------------
def _wide_losses(
    df: DataFrame, score: str, place: str, depth: int, grid: list[float], event: list[str], keep: tuple[str, ...],
) -> DataFrame:
    """The losses of ``temperature_losses`` as a row per event, with a column ``_l0``, ``_l1`` ... for each temperature.

    Maxima of the field still running do not depend on T, so they are taken once per
    event; then one aggregation covers all temperatures, each a column of it."""
    w = W.partitionBy(*event)
    turn = F.when(F.col(place).isNotNull(), F.row_number().over(w.orderBy(F.col(place).asc_nulls_last(), "entity")))
    df = df.select(*event, *keep, "entity", F.col(score).alias("_s"), turn.alias("_turn"))
    left = {i: F.col("_turn").isNull() | (F.col("_turn") >= i) for i in range(1, depth + 1)}
    df = df.withColumns({f"_m{i}": F.max(F.when(c, F.col("_s"))).over(w) for i, c in left.items()})
    sums, out = [], []
    for k, t in enumerate(grid):
        for i, c in left.items():
            e = F.exp((F.col("_s") - F.col(f"_m{i}")) / F.lit(t))
            sums += [F.sum(F.when(c, e)).alias(f"_z{i}_{k}"), F.max(F.when(F.col("_turn") == i, e)).alias(f"_p{i}_{k}")]
        losses = [-F.log(F.greatest(F.col(f"_p{i}_{k}") / F.col(f"_z{i}_{k}"), F.lit(LOG_FLOOR))) for i in left]
        total = sum((F.coalesce(x, F.lit(0.0)) for x in losses[1:]), F.coalesce(losses[0], F.lit(0.0)))
        places = sum((F.col(f"_p{i}_{k}").isNotNull().cast("int") for i in list(left)[1:]), F.col(f"_p1_{k}").isNotNull().cast("int"))
        out.append((total / places).alias(f"_l{k}"))
    return df.groupBy(*event, *keep).agg(*sums).where("_p1_0 is not null").select(*event, *keep, *out)


def temperature_losses(
    df: DataFrame, score: str, place: str, depth: int = 1, grid: list[float] | None = None,
    event: list[str] = EVENT, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Loss per (event, temperature): mean negative log likelihood of the first ``depth``
    finishers, one place at a time. Events without a finisher are left out."""
    grid = TEMPERATURES if grid is None else grid
    each = F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"_l{k}").alias("loss")) for k, t in enumerate(grid)])
    return _wide_losses(df, score, place, depth, grid, event, keep).select(*event, *keep, F.inline(each))


def fit_temperature(losses: DataFrame, by: list[str]) -> DataFrame:
    """Temperature with the lowest mean loss; the first of equals."""
    mean = losses.groupBy(*by, "temperature").agg(F.avg("loss").alias("loss"))
    best = F.min(F.struct(F.round("loss", 10).alias("loss"), "temperature")).alias("_b")
    return mean.groupBy(*by).agg(best).select(*by, "_b.temperature", "_b.loss")


def rolling_temperature(
    losses: DataFrame, by: list[str], seq: str, fallback: float, window: int = TRAILING_EVENTS,
    minimum: int = MIN_CALIBRATION_EVENTS,
) -> DataFrame:
    """Temperature per event fitted on the trailing events before it; the fallback until there are enough."""
    w = W.partitionBy(*by, "temperature").orderBy(seq).rowsBetween(-window, -1)
    past = losses.withColumns({"_l": F.round(F.avg("loss").over(w), 10), "_n": F.count("loss").over(w)})
    best = past.groupBy(*by, seq).agg(F.min(F.struct("_l", "temperature")).alias("_b"), F.max("_n").alias("n"))
    t = F.when(F.col("n") >= minimum, F.col("_b.temperature")).otherwise(F.lit(fallback))
    return best.select(*by, seq, t.alias("temperature"), "n")


def trailing_temperature(
    df: DataFrame, score: str, place: str, by: list[str], seq: str, fallback: float, depth: int = 1, event: list[str] = EVENT,
    window: int = TRAILING_EVENTS, minimum: int = MIN_CALIBRATION_EVENTS,
) -> DataFrame:
    """``rolling_temperature`` of the ``temperature_losses`` of scores, with a row per event all the way: temperatures stay columns."""
    losses = _wide_losses(df, score, place, depth, TEMPERATURES, event, ())
    w = W.partitionBy(*by).orderBy(seq).rowsBetween(-window, -1)
    past = losses.select(*by, seq, F.count("_l0").over(w).alias("n"), *[F.round(F.avg(f"_l{k}").over(w), 10).alias(f"_a{k}") for k in range(len(TEMPERATURES))])
    best = F.array_min(F.array(*[F.struct(F.col(f"_a{k}").alias("l"), F.lit(t).alias("temperature")) for k, t in enumerate(TEMPERATURES)]))
    return past.select(*by, seq, F.when(F.col("n") >= minimum, best["temperature"]).otherwise(F.lit(fallback)).alias("temperature"), "n")


# -- mixing and reading a distribution --------------------------------------------
def smooth(matrix: DataFrame, column: str = "share", by: list[str] | None = None, amount: float = SMOOTHING) -> DataFrame:
    """Mix in a small uniform share. by: the columns whose rows sum to one.

    A matrix that carries its field size needs no window for it."""
    n = F.col("field") if "field" in matrix.columns else F.count(F.lit(1)).over(W.partitionBy(*(by or [*EVENT, "entity"])))
    return matrix.withColumn(column, (1.0 - amount) * F.col(column) + amount / n)


def blend(p: DataFrame, q: DataFrame, weight: float | Column, keys: list[str], column: str = "share") -> DataFrame:
    """weight * p + (1 - weight) * q on matching keys."""
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    other = q.select(*keys, F.col(column).alias("_q"))
    return p.join(other, keys).withColumn(column, w * F.col(column) + (1.0 - w) * F.col("_q")).drop("_q")


def mix(p: DataFrame, q: DataFrame, weight, event: list[str] = EVENT, amount: float = SMOOTHING) -> DataFrame:
    """Blend two position matrices, then smooth."""
    return smooth(blend(p, q, weight, [*event, "entity", "pos"]), by=[*event, "entity"], amount=amount)


def summarise(matrix: DataFrame, event: list[str] = EVENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every published probability, read from the one matrix."""

    def upto(k: int) -> Column:
        return F.sum(F.when(F.col("pos") <= k, F.col("share")).otherwise(0.0))

    return matrix.groupBy(*event, *keep, "entity").agg(
        upto(1).alias("p_win"),
        upto(3).alias("p_podium"),
        upto(5).alias("p_top5"),
        upto(10).alias("p_top10"),
        F.sum(F.col("share") * F.col("pos")).alias("exp_position"),
    )


def check_distribution(matrix: DataFrame, event: list[str] = EVENT, atol: float = 1e-6) -> DataFrame:
    """Problems per event; none if the matrix is a coherent distribution."""
    s = F.col("share")
    bad = F.coalesce(F.isnan(s) | (F.abs(s) == float("inf")), F.lit(True))
    cells = matrix.groupBy(*event).agg(
        F.max(bad.cast("int")).alias("broken"), F.max(((s < -atol) | (s > 1 + atol)).cast("int")).alias("outside")
    )
    rows = matrix.groupBy(*event, "entity").agg(F.sum(s).alias("_t")).groupBy(*event).agg(
        F.max(F.abs(F.col("_t") - 1)).alias("row_gap")
    )
    cols = matrix.groupBy(*event, "pos").agg(F.sum(s).alias("_t")).groupBy(*event).agg(
        F.max(F.abs(F.col("_t") - 1)).alias("column_gap")
    )
    problems = F.array_compact(
        F.array(
            F.when(F.col("broken") == 1, F.lit("non-finite")),
            F.when(F.col("outside") == 1, F.lit("outside [0, 1]")),
            F.when(~(F.col("row_gap") <= atol), F.lit("positions of an entrant")),
            F.when(~(F.col("column_gap") <= atol), F.lit("entrants of a position")),
        )
    )
    return cells.join(rows, event).join(cols, event).select(*event, problems.alias("problems"))


def ranking_forecast(
    df: DataFrame, score: str, temperature, held_score: str | None = None, event: list[str] = EVENT,
) -> DataFrame:
    """Plackett-Luce alone; with held_score, a mixture with the held-back scores."""
    matrix = exact_positions(df, score, temperature, {"share": False}, event=event)
    if held_score is not None:
        alt = exact_positions(df, held_score, temperature, {"share": False}, event=event)
        matrix = blend(alt, matrix, HOLD_BACK_SHARE, [*event, "entity", "pos"])
    return summarise(smooth(matrix, by=[*event, "entity"]), event)


def forecast(
    df: DataFrame, score: str, temperature, weight: float, dnf_prob: str = "dnf_prob", event: list[str] = EVENT, retire_both: bool = False,
) -> DataFrame:
    """One coherent matrix: weight on the plain ranking, the rest with retirements."""
    m = exact_positions(df, score, temperature, {"plain": retire_both, "drawn": True}, dnf_prob, event)
    share = weight * F.col("plain") + (1.0 - weight) * F.col("drawn")
    return smooth(m.select(*event, "entity", "field", "pos", share.alias("share")))


def dnf_probability(entity_rate: str = "drv_dnf_rate_10", team_rate: str = "team_dnf_rate_10") -> Column:
    raw = DNF_ENTITY_SHARE * F.coalesce(entity_rate, F.lit(DNF_UNKNOWN)) + DNF_TEAM_SHARE * F.coalesce(
        team_rate, F.lit(DNF_UNKNOWN)
    )
    return clip(raw, DNF_FLOOR, DNF_CAP)


# -- baselines and stage views -----------------------------------------------------
def baseline_rank(value: str, event: list[str] = EVENT) -> Column:
    """Average-tie rank of a baseline's value; entrants without one share the back."""
    w = W.partitionBy(*event)
    filled = F.coalesce(F.col(value), F.max(value).over(w) + 1, F.lit(1.0))
    # Ranking on (missing last, value) equals ranking on the filled value.
    rank = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(W.partitionBy(*event, value))
    return F.when(filled.isNotNull(), rank + (ties - 1) / 2.0)


def baseline_score(rank: str) -> Column:
    """Strength whose Plackett-Luce odds are rank to the power -1/T."""
    return -F.log(F.col(rank))


def sprint_blend(df: DataFrame, score: str, sprint: str, weight: float, out: str, event: list[str] = EVENT) -> DataFrame:
    """Nudge scores toward the sprint order, rescaled to their own spread; needs two sprint values."""
    w = W.partitionBy(*event)
    df = df.withColumn("_n", F.count(sprint).over(w)).withColumn(
        "_sq", F.coalesce(F.col(sprint), F.max(sprint).over(w) + 1).cast("double")
    )

    def or_one(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))

    order = -(F.col("_sq") - F.avg("_sq").over(w)) / or_one(F.stddev_samp("_sq").over(w))
    df = df.withColumn("_o", F.col(score) + weight * order)
    scaled = (F.col("_o") - F.avg("_o").over(w)) / or_one(F.stddev_pop("_o").over(w)) * or_one(F.stddev_pop(score).over(w))
    use = (F.col("_n") >= 2) & F.lit(weight > 0)
    return df.withColumn(out, F.when(use, scaled).otherwise(F.col(score))).drop("_n", "_sq", "_o")


def projected_weekend(df: DataFrame, quali_score: str, event: list[str] = EVENT) -> DataFrame:
    """The field before qualifying: projected order for the grid, prior averages for the gaps."""
    order = F.row_number().over(W.partitionBy(*event).orderBy(F.desc(quali_score), "entity"))
    return df.withColumn("_o", order).withColumns(
        {
            "grid": F.col("_o"),
            "quali_position": F.col("_o"),
            "quali_gap_to_pole_pct": F.col("drv_pace_gap_pct"),
            "quali_gap_to_teammate_pct": F.col("drv_teammate_quali_edge"),
        }
    ).drop("_o")


def without_columns(df: DataFrame, hidden: list[str], flags: tuple[str, ...] = ("practice_available",)) -> DataFrame:
    """Hide what a stage cannot know: values become null, availability flags 0."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.lit(0 if c in flags else None).cast(types[c]) for c in [*hidden, *flags] if c in types}
    )


def top_order(df: DataFrame, place: str, k: int, event: list[str] = EVENT) -> DataFrame:
    """The first k finishers of each event in order (k = 1: the winner)."""
    turn = F.row_number().over(W.partitionBy(*event).orderBy(place, "entity"))
    return df.where(F.col(place).isNotNull()).withColumn("turn", turn).where(F.col("turn") <= k)
