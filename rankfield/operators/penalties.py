"""Grid penalties: places dropped, starts from the back, and laps held back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import BACK_OFFSET, FRONT_RUNNER, HOLD_BACK_SLOT

BACK = float("inf")


def places_for(field: DataFrame, penalties: DataFrame, keys: list[str]) -> DataFrame:
    """Places each entrant drops: 0 for none, infinity for the back (a null in the list)."""
    p = penalties.select(*keys, F.coalesce(F.col("places").cast("double"), F.lit(BACK)).alias("drop"))
    return field.join(p, keys, "left").withColumn("drop", F.coalesce("drop", F.lit(0.0)))


def apply_penalties(df: DataFrame, group: list[str], grid: str = "grid", drop: str = "drop") -> DataFrame:
    """The grid after the penalties, ranked from 1 again.

    An entrant dropping n places lands behind the one that had that slot. group may
    include a sample column to re-rank many grids at once; a group without a
    penalty keeps its grid."""
    d = F.col(drop)
    moved = F.when(d == BACK, F.lit(BACK_OFFSET)).otherwise(d) + F.when(d > 0, 0.5).otherwise(0.0)
    w = W.partitionBy(*group)
    rank = F.row_number().over(w.orderBy(F.col("_key"), F.col(grid), "entity"))
    any_drop = F.max(drop).over(w) > 0
    return (
        df.withColumn("_key", F.col(grid) + moved)
        .withColumns({"_rank": rank, "_any": any_drop})
        .withColumn(grid, F.when(F.col("_any"), F.col("_rank")).otherwise(F.col(grid)))
        .drop("_key", "_rank", "_any")
    )


def held_back(drop: str = "drop", recent: str = "drv_avg_quali_5") -> Column:
    """Front-runners starting from the back whatever they qualify."""
    return F.coalesce((F.col(drop) == BACK) & (F.col(recent) <= FRONT_RUNNER), F.lit(False))


def held_back_scores(df: DataFrame, score: str, held: str, out: str, event: list[str]) -> DataFrame:
    """Lower held entrants to the score at a fixed share of the others; never raise one."""
    w = W.partitionBy(*event)
    place = F.row_number().over(W.partitionBy(*event, held).orderBy(F.desc(score), "entity"))
    df = df.withColumns({"_place": place, "_n": F.count(F.lit(1)).over(w), "_free": F.count(F.when(~F.col(held), 1)).over(w)})
    slot = F.least(F.col("_free"), F.bround(F.col("_n") * HOLD_BACK_SLOT).cast("long"))
    at = F.max(F.when(~F.col(held) & (F.col("_place") == F.col("_slot")), F.col(score))).over(w)
    return (
        df.withColumn("_slot", slot).withColumn("_at", at)
        .withColumn(out, F.when(F.col(held), F.least(F.col(score), F.col("_at"))).otherwise(F.col(score)))
        .drop("_place", "_n", "_free", "_slot", "_at")
    )
