"""Session pace from lap events and race-control messages.

Sessions may be huge or lopsided, so nothing here runs one window over a whole
session: running values are computed inside time buckets and carried between
them through one summary row per (session, bucket).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import CLEAN_LAP_FACTOR, MIN_STINT_LAPS
from ..session import cut

BUCKET_US = 600 * 1_000_000
NEVER = 2**62


def carry(
    df: DataFrame,
    by: list[str],
    time: str,
    order: list[Column | str],
    value: Column,
    out: str,
    agg: Callable[[Column], Column],
    following: bool = False,
    bucket_us: int = BUCKET_US,
) -> DataFrame:
    """agg(value) over all rows before (or after) each row in order, the row itself excluded.

    order must start with the time column (or sort within equal times)."""
    df = df.withColumns({"_b": F.expr(f"{time} div {bucket_us}"), "_x": value})
    sums = df.groupBy(*by, "_b").agg(agg(F.col("_x")).alias("_s"))
    across = W.partitionBy(*by).orderBy("_b")
    within = W.partitionBy(*by, "_b").orderBy(*order)
    if following:
        across = across.rowsBetween(1, W.unboundedFollowing)
        within = within.rowsBetween(1, W.unboundedFollowing)
    else:
        across = across.rowsBetween(W.unboundedPreceding, -1)
        within = within.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_c", agg(F.col("_s")).over(across)).drop("_s")
    both = agg(F.col("_x")).over(within)
    pick = F.least if following else F.greatest
    return (
        df.withColumn("_w", both).join(sums, [*by, "_b"])
        .withColumn(out, pick("_w", "_c")).drop("_b", "_x", "_w", "_c")
    )


def not_clear_periods(messages: DataFrame, session: list[str]) -> DataFrame:
    """Spans (session, lo, hi) when any flag was up.

    messages: (session, t, ord, kind, key) with kind raise | clear | clear_all. Each
    raise opens an interval that ends at the next message clearing its key or
    everything; an interval never cleared runs to the end. Overlapping intervals
    merge into spans."""
    order = ["t", "ord"]
    t = F.col("t")
    # Nearest clear of the same key, then nearest clear of everything.
    keyed = carry(messages, [*session, "key"], "t", order, F.when(F.col("kind") == "clear", t), "_own", F.min, True)
    both = carry(keyed, session, "t", order, F.when(F.col("kind") == "clear_all", t), "_all", F.min, True)
    raised = cut(
        both.where(F.col("kind") == "raise").select(
            *session, t.alias("lo"), "ord", F.coalesce(F.least("_own", "_all"), F.lit(NEVER)).alias("hi")
        )
    )
    seen = carry(raised, session, "lo", ["lo", "ord"], F.col("hi"), "_open", F.max)
    starts = seen.withColumn("_start", F.when(F.col("_open").isNull() | (F.col("lo") >= F.col("_open")), F.col("lo")))
    last = carry(starts, session, "lo", ["lo", "ord"], F.col("_start"), "_prev", F.max)
    return cut(
        last.withColumn("_id", F.coalesce("_start", "_prev"))
        .groupBy(*session, "_id").agg(F.max("hi").alias("hi")).withColumnRenamed("_id", "lo")
    )


def green_laps(laps: DataFrame, spans: DataFrame, session: list[str]) -> DataFrame:
    """Laps with ``green``: no span overlaps [start, end).

    A lap overlaps a span exactly when the latest end among spans starting before
    the lap's end lies after the lap's start, so one running maximum over both
    replaces the interval join. laps need (session, start, end) in microseconds."""
    cols = laps.columns
    marks = spans.select(*session, F.col("lo").alias("_t"), F.lit(1).alias("_side"), "hi")
    both = laps.withColumns({"_t": F.coalesce("end", F.lit(0)), "_side": F.lit(0), "hi": F.lit(None).cast("long")})
    both = both.unionByName(marks, allowMissingColumns=True)
    run = carry(both, session, "_t", ["_t", "_side"], F.col("hi"), "_latest", F.max)
    overlap = F.coalesce(F.col("_latest") > F.col("start"), F.lit(False))
    return run.where("_side = 0").withColumn("green", F.col("start").isNotNull() & ~overlap).select(*cols, "green")


def mark_in_laps(laps: DataFrame, pits: DataFrame, session: list[str]) -> DataFrame:
    """Flag laps on the pit list."""
    key = [*session, "entity", "lap"]
    listed = pits.select(*key).distinct().withColumn("_pit", F.lit(True))
    return laps.join(listed, key, "left").withColumn("in_lap", F.coalesce("_pit", F.lit(False))).drop("_pit")


def clean_laps(laps: DataFrame, session: list[str]) -> DataFrame:
    """Mark laps neither in nor out nor under a flag, within 110 % of the entrant's best such lap."""
    key = [*session, "entity"]
    fit = ~F.coalesce("is_out_lap", F.lit(False)) & ~F.col("in_lap") & F.col("green")
    best = laps.where(fit).groupBy(*key).agg(F.min("duration").alias("_best"))
    return laps.join(best, key, "left").withColumn(
        "clean", F.coalesce(fit & (F.col("duration") <= F.col("_best") * CLEAN_LAP_FACTOR), F.lit(False))
    ).drop("_best")


def stint_of_lap(stints: DataFrame, session: list[str]) -> DataFrame:
    """One row per (session, entrant, lap): the last listed stint covering it."""
    laps = F.explode(F.sequence(F.col("lap_start"), F.col("lap_end"))).alias("lap")
    each = stints.where("lap_start <= lap_end").select(*session, "entity", laps, "stint", "compound", "ord")
    last = F.max_by(F.struct("stint", "compound"), "ord").alias("_s")
    return each.groupBy(*session, "entity", "lap").agg(last).select(
        *session, "entity", "lap", F.col("_s.stint").alias("stint"), F.col("_s.compound").alias("compound")
    )


def tag_stints(laps: DataFrame, stints: DataFrame, session: list[str], min_laps: int = MIN_STINT_LAPS) -> DataFrame:
    """Stint and compound per lap, and whether the lap is part of a long run."""
    tagged = laps.join(stint_of_lap(stints, session), [*session, "entity", "lap"], "left")
    key = [*session, "entity", "stint"]
    sizes = tagged.where("clean and stint is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return tagged.join(sizes, key, "left").withColumn(
        "long_run", F.coalesce(F.col("clean") & (F.col("_n") >= min_laps), F.lit(False))
    ).drop("_n")


def driver_pace(
    laps: DataFrame, stints: DataFrame, pits: DataFrame, spans: DataFrame, session: list[str],
    min_laps: int = MIN_STINT_LAPS,
) -> DataFrame:
    """One row per entrant of a session: best, clean median, long run, counts, compound.

    laps: (session, entity, lap, start, duration seconds, is_out_lap), start in microseconds."""
    timed = laps.where("duration is not null").withColumn(
        "end", F.col("start") + F.round(F.col("duration") * 1_000_000).cast("long")
    )
    flagged = cut(mark_in_laps(green_laps(timed, spans, session), pits, session))
    tagged = tag_stints(cut(clean_laps(flagged, session)), stints, session, min_laps)

    def ms(c: Column) -> Column:
        return F.bround(c * 1000).cast("long")

    half = F.lit(0.5)
    return tagged.groupBy(*session, "entity").agg(
        ms(F.min("duration")).alias("best_lap_ms"),
        ms(F.percentile(F.when(F.col("clean"), F.col("duration")), half)).alias("median_lap_ms"),
        ms(F.percentile(F.when(F.col("long_run"), F.col("duration")), half)).alias("long_run_ms"),
        F.count(F.lit(1)).alias("n_laps"),
        F.count(F.when(F.col("clean"), 1)).alias("n_clean_laps"),
        F.mode(F.when(F.col("clean"), F.col("compound")), True).alias("compound_mode"),
    )
