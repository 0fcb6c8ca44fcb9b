from pathlib import Path

from pyspark.sql import Window as W, functions as F

from rankfield.plans.worlds import Worlds
from rankfield.session import cut, kept


def _size(spark) -> int:
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(p.stat().st_size for p in Path(top).rglob("*") if p.is_file())


def test_kept_rows_are_small_and_stay_with_their_series(spark):
    d = spark.range(20000).select((F.col("id") % 40).alias("series"), F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("x"), F.lit("a text").alias("y"))
    d = d.unionByName(d.limit(5).withColumn("series", F.lit(None).cast("long"))).repartition("series")
    cut(d.limit(1))
    sizes = [_size(spark)]
    for store in (cut, kept):
        out = store(d)
        sizes.append(_size(spark))
    assert (sizes[2] - sizes[1]) * 3 < sizes[1] - sizes[0]
    assert out.dtypes == d.dtypes and out.exceptAll(d).count() == 0 and d.exceptAll(out).count() == 0
    w = out.withColumn("n", F.sum("x").over(W.partitionBy("series", "y")))
    assert "Exchange" not in w._jdf.queryExecution().executedPlan().toString()


def test_worlds_store_no_view_twice_and_split_by_series(spark, small):
    from rankfield.sources.contest import Tables

    worlds = Worlds(Tables(spark, small, True), [lambda view, df: df, lambda view, df: df.where("series < 1")])
    assert worlds.landed("calendar", "standings") is worlds
    whole, part = worlds.split(worlds.contest)
    assert part.where("series <> 0").count() == 0 < part.count() == whole.where("series = 0").count()
    assert whole.exceptAll(worlds.contest.where("series % 2 = 0").withColumn("series", (F.col("series") / 2).cast("long"))).count() == 0
