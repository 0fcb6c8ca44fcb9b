"""Ranking and probability metrics per event, calibration, and paired uncertainty.

Per-event metrics are one or two aggregations over windows of one field.
Kendall's tau counts inversions level by level on rank bits (n log n rows, no
pairs). Whole-table statistics (calibration error, bootstrap) only ever build
bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import ECE_BINS, LOG_FLOOR, LOWER_IS_BETTER, RELIABILITY_EDGES
from ..functions.hashrand import DRAWS, poisson_draws
from ..functions.places import running_total
from ..functions.scalars import safe_corr, wilson_high, wilson_low
from ..session import cut

RANKING = ("ndcg3", "ndcg5", "winner_hit", "podium_overlap", "top5_overlap", "top10_overlap", "position_error")


def _log2(c) -> Column:
    return F.log2(c)


def true_ranks(df: DataFrame, by: list[str], pred: str = "pred", actual: str = "actual", least: int = 3) -> DataFrame:
    """Rows with both values, ranked 1.. on each side; events under ``least`` rows give nothing."""
    w = W.partitionBy(*by)
    d = df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w))
    return d.where(F.col("_n") >= least).withColumns(
        {
            "pred_rank": F.row_number().over(w.orderBy(pred, "entity")),
            "true_rank": F.row_number().over(w.orderBy(actual, "entity")),
        }
    )


def ndcg(k: int) -> Column:
    """Gain 1/log2(true rank + 1), discount 1/log2(predicted rank + 1), over the best possible."""
    gain = 1.0 / _log2(F.col("true_rank") + 1)
    dcg = F.sum(F.when(F.col("pred_rank") <= k, gain / _log2(F.col("pred_rank") + 1)))
    best = F.sum(F.when(F.col("true_rank") <= k, gain / _log2(F.col("true_rank") + 1)))
    return dcg / best


def overlap(k: int) -> Column:
    return F.sum(((F.col("pred_rank") <= k) & (F.col("true_rank") <= k)).cast("int"))


def ranking(df: DataFrame, by: list[str], pred: str = "pred", actual: str = "actual", keep: Sequence[str] = ()) -> DataFrame:
    """Top-k and order metrics per event."""
    d = true_ranks(df, by, pred, actual)
    return d.groupBy(*by, *keep).agg(
        ndcg(3).alias("ndcg3"),
        ndcg(5).alias("ndcg5"),
        overlap(1).alias("winner_hit"),
        overlap(3).alias("podium_overlap"),
        overlap(5).alias("top5_overlap"),
        overlap(10).alias("top10_overlap"),
        F.avg(F.abs(F.col("pred_rank") - F.col("true_rank"))).alias("position_error"),
    )


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average-tie ranks; null where a side is constant."""
    w = W.partitionBy(*by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def avg_rank(c: str) -> Column:
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*by, c)) - 1) / 2.0

    d = d.withColumns({"_x": avg_rank(x), "_y": avg_rank(y)})
    X, Y = F.col("_x"), F.col("_y")
    rho = safe_corr(F.count(F.lit(1)), F.sum(X), F.sum(Y), F.sum(X * X), F.sum(Y * Y), F.sum(X * Y))
    return d.groupBy(*by).agg(rho.alias("spearman"))


def kendall(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-b with ties, without forming pairs.

    With rows ordered by (x, y), a discordant pair is an inversion of y. For each bit
    of y's rank, rows sharing the higher bits are walked in order: a row with the bit
    unset adds one inversion for every earlier row with it set. Every pair is counted
    at exactly one bit."""
    w = W.partitionBy(*by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, "entity", x, y)
    d = d.withColumns({"_y": (F.dense_rank().over(w.orderBy(y)) - 1).cast("long"), "_i": F.row_number().over(w.orderBy(x, y, "entity"))})
    d = cut(d)  # read once for the inversions and once per kind of tie
    top = F.greatest(F.ceil(F.log2(F.max("_y").over(w) + 1)) - 1, F.lit(0)).cast("int")
    bits = d.withColumn("_top", top).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    bits = bits.withColumns(
        {"_high": F.expr("shiftright(_y, _b + 1)"), "_set": F.expr("shiftright(_y, _b) & 1").cast("int")}
    )
    earlier = W.partitionBy(*by, "_b", "_high").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    crossing = F.when(F.col("_set") == 0, F.coalesce(F.sum("_set").over(earlier), F.lit(0))).otherwise(0)
    swaps = bits.withColumn("_c", crossing).groupBy(*by).agg(F.sum("_c").alias("_d"))

    def ties(*cols: str) -> DataFrame:
        n = F.count(F.lit(1))
        name = "_t" + "".join(cols)
        return d.groupBy(*by, *cols).agg((n * (n - 1) / 2).alias("_p")).groupBy(*by).agg(F.sum("_p").alias(name))

    n = F.count(F.lit(1))
    total = d.groupBy(*by).agg((n * (n - 1) / 2).alias("_n0"))
    j = swaps.join(total, by).join(ties(x), by).join(ties(y), by).join(ties(x, y), by)
    n0, n1, n2, n3 = F.col("_n0"), F.col(f"_t{x}"), F.col(f"_t{y}"), F.col(f"_t{x}{y}")
    spread = (n0 - n1) * (n0 - n2)
    tau = F.when(spread > 0, (n0 - n1 - n2 + n3 - 2 * F.col("_d")) / F.sqrt(spread))
    return j.select(*by, tau.alias("kendall"))


# -- probabilities ---------------------------------------------------------------------
def probability(df: DataFrame, by: list[str], actual: str = "actual") -> DataFrame:
    """Win log loss on renormalised probabilities, multi-class and per-entrant Brier scores."""
    w = W.partitionBy(*by)
    d = df.where(F.col(actual).isNotNull()).withColumns(
        {
            "_won": (F.col(actual) == F.min(actual).over(w)).cast("int"),
            "_p": F.col("p_win") / F.sum("p_win").over(w),
        }
    )
    won = F.max(F.when(F.col("_won") == 1, F.col("_p")))

    def brier(p: str, k: int) -> Column:
        hit = (F.col(actual) <= k).cast("int")
        return F.avg((F.col(p) - hit) * (F.col(p) - hit))

    return d.groupBy(*by).agg(
        (-F.log(F.greatest(won, F.lit(LOG_FLOOR)))).alias("win_logloss"),
        F.sum((F.col("_p") - F.col("_won")) * (F.col("_p") - F.col("_won"))).alias("win_brier"),
        brier("p_podium", 3).alias("podium_brier"),
        brier("p_top10", 10).alias("top10_brier"),
        won.alias("p_winner"),
    )


def target_logloss(df: DataFrame, by: list[str], p: str, place: str, out: str) -> DataFrame:
    """Negative log probability of whoever came first on another target."""
    first = F.min_by(F.col(p), F.struct(F.col(place), F.col("entity")))
    d = df.where(F.col(place).isNotNull())
    return d.groupBy(*by).agg((-F.log(F.greatest(first, F.lit(LOG_FLOOR)))).alias(out))


def outcome_rows(df: DataFrame, by: list[str], actual: str = "actual", keep: Sequence[str] = ()) -> DataFrame:
    """Stated probabilities beside what happened, one row per entrant."""
    d = df.where(F.col(actual).isNotNull())
    won = F.col(actual) == F.min(actual).over(W.partitionBy(*by))
    return d.select(
        *by, *keep, "entity", "p_win", won.cast("int").alias("won"),
        "p_podium", (F.col(actual) <= 3).cast("int").alias("podium"),
        "p_top10", (F.col(actual) <= 10).cast("int").alias("top10"),
    )


def reliability(df: DataFrame, p: str, y: str, by: Sequence[str] = (), edges: Sequence[float] = RELIABILITY_EDGES) -> DataFrame:
    """Stated against observed per bucket, right-closed, the first closed on both sides."""
    stated = F.round(p, 12)  # sums of shares may pass an edge by rounding error
    bucket = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        bucket = F.when(stated <= edges[i], i - 1).otherwise(bucket)
    inside = df.where(stated.between(edges[0], edges[-1])).withColumn("bucket", bucket)
    g = inside.groupBy(*by, "bucket").agg(
        F.avg(p).alias("stated"), F.avg(y).alias("observed"), F.sum(y).alias("hits"), F.count(F.lit(1)).alias("n")
    )
    return g.withColumns({"ci_low": wilson_low("hits", "n"), "ci_high": wilson_high("hits", "n")})


def calibration_error(df: DataFrame, p: str, y: str, by: Sequence[str] = (), bins: int = ECE_BINS) -> DataFrame:
    """Size-weighted gap between stated and observed over equal-count buckets.

    Rows are first counted per (p, y). The buckets are then cut through running totals of those counts, which go by
    ranges of p, so no window holds a key's rows. Equal p are ordered by outcome."""
    g = df.groupBy(*by, F.col(p).alias("_p"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_c"))
    g = running_total(g, list(by), ["_p", "_y"], "_c", "_lo", "_n").withColumn("_hi", F.col("_lo") + F.col("_c"))
    # Bucket b of k holds n div k rows, one more for the first n mod k (as array_split does).
    b = g.withColumn("_k", F.least(F.col("_n"), F.lit(bins))).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))
    )
    small, extra = F.expr("_n div _k"), F.col("_n") % F.col("_k")
    start = F.col("_b") * small + F.least(F.col("_b"), extra)
    end = start + small + F.when(F.col("_b") < extra, 1).otherwise(0)
    share = F.least(F.col("_hi"), end) - F.greatest(F.col("_lo"), start)
    b = b.withColumn("_w", share).where("_w > 0")
    per = b.groupBy(*by, "_b", "_n").agg(
        F.sum("_w").alias("_m"),
        (F.sum(F.col("_w") * F.col("_p")) / F.sum("_w")).alias("_s"),
        (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_o"),
    )
    return per.groupBy(*by).agg(
        (F.sum(F.col("_m") * F.abs(F.col("_s") - F.col("_o"))) / F.max("_n")).alias("ece"), F.max("_n").alias("n")
    )


# -- uncertainty -----------------------------------------------------------------------
def bootstrap_means(
    df: DataFrame, key: list[str], by: list[str], values: Sequence[str], replicates: int, tag: str = "boot"
) -> DataFrame:
    """Means of resamples of the rows of each ``by`` group, one row per replicate (null if a replicate draws none).

    A replicate takes each row as often as a Poisson(1) draw says, hashed from the row's ``key``: for many rows that is
    drawing n of n. One digest serves DRAWS replicates. Rows stay where they are: each task sums weight times value per replicate, and only those sums
    are shuffled. All values share the draws, so their differences stay paired."""
    batches = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // DRAWS)))
    rows = df.select(*by, *key, *values).withColumn("_g", batches)
    rows = rows.withColumns({f"_w{i}": w for i, w in enumerate(poisson_draws(tag, *by, *key, "_g"))})
    sums = []
    for i in range(DRAWS):
        w = F.col(f"_w{i}")
        sums += [F.sum(w * F.col(v)).alias(f"_n{i}_{v}") for v in values]
        sums += [F.sum(F.when(F.col(v).isNotNull(), w)).alias(f"_d{i}_{v}") for v in values]
    each = [
        F.struct(
            (F.col("_g") * DRAWS + i + 1).alias("replicate"),
            *[(F.col(f"_n{i}_{v}") / F.nullif(F.col(f"_d{i}_{v}"), F.lit(0))).alias(v) for v in values],
        )
        for i in range(DRAWS)
    ]
    return rows.groupBy(*by, "_g").agg(*sums).select(*by, F.inline(F.array(*each))).where(F.col("replicate") <= replicates)


def bootstrap_intervals(
    df: DataFrame, key: list[str], by: list[str], values: Sequence[str], replicates: int, level: float = 0.95,
    tag: str = "boot",
) -> DataFrame:
    """Mean and percentile interval of each value: (by, metric, mean, ci_low, ci_high, n)."""
    tail = (1 - level) / 2
    means = bootstrap_means(df, key, by, values, replicates, tag).unpivot([*by, "replicate"], list(values), "metric", "_m")
    ci = means.groupBy(*by, "metric").agg(
        F.percentile("_m", F.lit(tail)).alias("ci_low"), F.percentile("_m", F.lit(1 - tail)).alias("ci_high")
    )
    flat = df.select(*by, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(by, list(values), "metric", "_v")
    mean = flat.groupBy(*by, "metric").agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))
    return mean.join(ci, [*by, "metric"])


def better_side(a: Column, b: Column) -> Column:
    """Which side the interval supports, by the metric's direction."""
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    return (
        F.when(F.col("ci_low") > 0, F.when(lower, b).otherwise(a))
        .when(F.col("ci_high") < 0, F.when(lower, a).otherwise(b))
        .otherwise(F.lit("unclear"))
    )


def paired_comparison(
    events: DataFrame, key: list[str], metrics: Sequence[str], reference: str, method: str = "method",
    replicates: int = 5000, by: Sequence[str] = (), tag: str = "boot",
) -> DataFrame:
    """Every other method against the reference, event by event, with a bootstrap interval.

    events: one row per (method, key). Only events both were graded on count."""
    ref = events.where(F.col(method) == reference).select(*key, *by, *[F.col(m).alias(f"_r_{m}") for m in metrics])
    other = events.where(F.col(method) != reference)
    pairs = other.join(ref, [*key, *by]).select(
        *key, *by, method,
        *[(F.col(m) - F.col(f"_r_{m}")).alias(m) for m in metrics],
        *[F.col(m).alias(f"_a_{m}") for m in metrics], *[F.col(f"_r_{m}") for m in metrics],
    )
    group = [*by, method]
    ci = bootstrap_intervals(pairs, key, group, metrics, replicates, tag=tag)
    sides = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"_a_{m}").cast("double").alias("x"), F.col(f"_r_{m}").cast("double").alias("y"))
          for m in metrics]
    )
    means = pairs.select(*group, F.inline(sides)).groupBy(*group, "metric").agg(
        F.avg("x").alias("value"), F.avg("y").alias("reference_value"), F.count(F.lit(1)).alias("n_events")
    )
    out = means.join(ci, [*group, "metric"]).withColumnRenamed("mean", "difference")
    return out.withColumn("better", better_side(F.col(method), F.lit(reference))).drop("n")


def clear_verdict(metric: str = "metric") -> Column:
    """better / worse / unclear for the variant, from its interval."""
    lower = F.col(metric).isin(*LOWER_IS_BETTER)
    up, down = F.col("ci_low") > 0, F.col("ci_high") < 0
    return (
        F.when((up & ~lower) | (down & lower), "better").when((up & lower) | (down & ~lower), "worse").otherwise("unclear")
    )
