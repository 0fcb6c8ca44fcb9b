"""Places of rows in the order of their group, where one group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.stage import stored


def numbered(df: DataFrame, group: str, order: list[str], more: Callable[[DataFrame], DataFrame] | None = None, weight: str | None = None) -> DataFrame:
    """Add ``pos``, a row's place from 0 in its group, and ``size``, the rows of the group (unless there is such a column), as longs.

    ``group`` must not be null; ``order`` is ascending with nulls first, equal rows follow in any order. Rows are dealt by ranges of
    (group, order), so a large group spreads over many partitions, equal rows included. Only one row per partition
    and group is summed up. ``weight`` names a column of longs whose sum over the rows before it each row gets as ``begin``. ``more`` may add columns to (part, group, offset, size), one row each, which the rows then get too.
    """
    tied = stored(df.withColumn("tie", F.monotonically_increasing_id()), "tied")
    rows = stored(tied.repartitionByRange(group, *order, "tie").withColumn("part", F.spark_partition_id()), "ranges")
    values = {"": F.lit(1).cast("long")} | ({"w_": F.col(weight)} if weight else {})
    counts = rows.groupBy("part", group).agg(*(F.sum(v).alias(f"{k}held") for k, v in values.items()))
    of_group = Window.partitionBy(group)
    offsets = [(F.sum(f"{k}held").over(of_group.orderBy("part")) - F.col(f"{k}held")).alias(f"{k}offset") for k in values]
    spans = counts.select("part", group, *offsets, F.sum("held").over(of_group).alias("size_of_group"))
    inside = Window.partitionBy("part", group).orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, 0)
    before = {f"{k}inside": F.sum(v).over(inside) - v for k, v in values.items()}
    spans = spans.withColumnRenamed("size_of_group", "size") if "size" not in df.columns else spans.drop("size_of_group")
    placed = rows.withColumns(before).join(more(spans) if more else spans, ["part", group]).withColumn("pos", F.col("offset") + F.col("inside"))
    if weight:
        placed = placed.withColumn("begin", F.col("w_offset") + F.col("w_inside"))
    return placed.drop("part", "tie", *(f"{k}{x}" for k in values for x in ("inside", "offset")))


def lookup(rows: DataFrame, key: str, table: DataFrame, uses: DataFrame, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` with ``table`` on ``key``, of which ``table`` has one row each.

    ``uses`` (key, n) says how often ``rows`` has a key. Keys with over 1 / ``share`` of all uses are fewer than
    ``share``: their rows of ``table`` are broadcast, the others are joined by a shuffle.
    """
    total = uses.agg(F.sum("n")).first()[0] or 0
    heavy = uses.where(F.col("n") > total / share).select(key, F.lit(True).alias("heavy"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    light = marked.where("heavy is null").drop("heavy").join(table, key, "left")
    return marked.where("heavy").drop("heavy").join(F.broadcast(table.join(F.broadcast(heavy.drop("heavy")), key)), key, "left").unionByName(light)
