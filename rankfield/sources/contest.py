"""Contest views: the star-schema tables read as ranked events.

A supplier is an entrant, a month an event, twenty consecutive suppliers a
series. A field therefore has at most 20 entrants and an entrant at most one
row per month however large the tables grow; more data means more series.
Raw lines are pre-aggregated per (entrant, month), so a supplier holding a
large share of all lines is combined before anything is shuffled.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..constants import MAX_FIELD, POINTS, SPRINT_POINTS
from ..operators.windows import event_sequence
from ..session import cut, tune

SERIES_SIZE = 20
EVENT = ["series", "season", "round"]
KEY = [*EVENT, "entity"]
SCOPE = ["series"]
HISTORY = ["series", "entity"]


def points_for(position: str | Column, table=POINTS) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    out = F.lit(0)
    for i, p in enumerate(table, start=1):
        out = F.when(position == i, F.lit(p)).otherwise(out)
    return out


class Tables:
    """Lazy views over one folder of parquet tables.

    With ``land``, results are stored (a reliable checkpoint, which keeps the partitioning by
    series) the first time they are read: many views and operators read them several times
    with different columns, and each would otherwise scan the raw lines again."""

    def __init__(self, spark: SparkSession, folder: str, land: bool = False):
        self.spark = tune(spark)
        self.folder = str(folder)
        self.land = land

    def landed(self, *views: str) -> Tables:
        """The same views over stored results; further views are stored too where named."""
        out = self if self.land else Tables(self.spark, self.folder, True)
        for view in views:
            out.__dict__[view] = cut(getattr(out, view))
        return out

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- results ---------------------------------------------------------------
    @cached_property
    def totals(self) -> DataFrame:
        """One row per (entrant, month), from partial sums of the lines."""
        return (
            self.raw("lineitem")
            .groupBy(
                F.expr("l_suppkey div 20").alias("series"),
                F.year("l_shipdate").alias("season"),
                F.month("l_shipdate").alias("round"),
                F.col("l_suppkey").alias("entity"),
            )
            .agg(
                F.count(F.lit(1)).alias("lines"),
                F.sum(F.col("l_quantity").cast("long")).alias("qty"),
                F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("revenue_c"),
                F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
            )
        )

    @cached_property
    def contest(self) -> DataFrame:
        """Results: one row per entrant of an event that was run."""
        return cut(self._results()) if self.land else self._results()

    def _results(self) -> DataFrame:
        event = W.partitionBy(*EVENT)
        base = event_sequence(self.totals.repartition("series"), SCOPE, ["season", "round"])
        clock = F.col("season") * 12 + F.col("round") + F.col("entity")
        df = base.select(
            *EVENT,
            "race_seq",
            "entity",
            F.expr(
                "series * 100 + (entity % 20 + CASE WHEN season % 2 = 1 AND round >= 7 THEN 1 ELSE 0 END) div 2"
            ).alias("team"),
            F.expr("series * 100 + round").alias("venue"),
            F.row_number().over(event.orderBy(F.desc("revenue_c"), "entity")).alias("position"),
            F.row_number().over(event.orderBy(F.desc("qty"), "entity")).alias("slot"),
            F.count(F.lit(1)).over(event).alias("field"),
            F.when(clock % 41 != 0, 100000 + F.max("qty").over(event) - F.col("qty")).alias("best_ms"),
            (F.col("returned") * 2 > F.col("lines")).alias("dnf"),
            F.col("lines").alias("laps"),
            (clock % 53 == 0).alias("no_quali"),
        )
        return df.select(
            *EVENT, "race_seq", "entity", "team", "venue", "position", "field", "best_ms", "dnf", "laps",
            F.when(F.col("entity") % 37 == 5, 0).otherwise(F.col("slot")).alias("grid_listed"),
            F.when(F.col("entity") % 37 == 5, F.col("field")).otherwise(F.col("slot")).alias("grid"),
            F.when(~F.col("no_quali"), F.col("slot")).alias("quali_position"),
            F.when(F.col("dnf"), 0).otherwise(points_for("position")).alias("points"),
            F.when(F.col("dnf"), "Engine")
            .when(F.col("laps") % 3 == 0, "+1 Lap")
            .when(F.col("laps") % 3 == 1, "Lapped")
            .otherwise("Finished").alias("status"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """Results with the outcome columns every feature window reads."""
        return add_outcomes(self.contest)

    # -- calendar and standings --------------------------------------------------
    @cached_property
    def calendar(self) -> DataFrame:
        """Twelve rounds per season of each series, run or not."""
        seasons = (self.contest if self.land else self.totals).select("series", "season").distinct()
        rounds = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("round")
        day = F.when((F.col("season") % 2 == 1) & (F.col("round") % 4 == 0), 21).otherwise(28)
        return seasons.select("series", "season", rounds).select(
            *EVENT,
            F.expr("series * 100 + round").alias("venue"),
            F.make_date("season", "round", F.lit(28)).alias("race_date"),
            F.expr("make_timestamp_ntz(season, round, 28, 14, 0, 0)").alias("race_start"),
            F.when(
                F.col("round") % 6 != 0, F.make_timestamp_ntz("season", "round", day, F.lit(12), F.lit(0), F.lit(0))
            ).alias("quali_start"),
            F.when(
                F.col("round").isin(3, 7), F.expr("make_timestamp_ntz(season, round, 27, 12, 0, 0)")
            ).alias("sprint_start"),
        )

    @cached_property
    def sprint(self) -> DataFrame:
        """Sprint classification of rounds 3 and 7."""
        position = F.row_number().over(W.partitionBy(*EVENT).orderBy(F.desc("laps"), "entity"))
        d = self.contest.where(F.col("round").isin(3, 7)).select(*KEY, "team", "laps")
        d = d.withColumn("position", position)
        return d.select(*KEY, "team", "position", points_for("position", SPRINT_POINTS).alias("points"))

    @cached_property
    def standings(self) -> DataFrame:
        """Totals after each run round, for everyone who has started this season."""
        scored = self.contest.select(*KEY, "team", "points").unionByName(
            self.sprint.select(*KEY, "team", "points")
        )
        per_round = scored.groupBy(*KEY).agg(F.sum("points").alias("points"), F.max("team").alias("team"))
        run = self.contest.select(*EVENT).distinct()
        people = per_round.select("series", "season", "entity").distinct()
        grid = people.join(run, ["series", "season"])
        w = W.partitionBy("series", "season", "entity").orderBy("round")
        held = grid.join(per_round, KEY, "left").select(
            *KEY,
            F.last("team", ignorenulls=True).over(w).alias("team"),
            F.sum("points").over(w).alias("points"),
        )
        rank = F.row_number().over(W.partitionBy(*EVENT).orderBy(F.desc("points"), "entity"))
        return held.where("points is not null").withColumn("position", rank)

    # -- practice ------------------------------------------------------------------
    @cached_property
    def session_pace(self) -> DataFrame:
        """Practice aggregates: the three ten-day parts of a month are the sessions."""
        day = F.dayofmonth("l_shipdate")
        session = F.when(day <= 10, "FP1").when(day <= 20, "FP2").otherwise("FP3")
        first = F.when(F.col("session") == "FP1", 1).when(F.col("session") == "FP2", 11).otherwise(22)
        undated = (F.col("session") == "FP2") & (F.col("round") % 5 == 0)
        return (
            self.raw("lineitem")
            .groupBy(
                F.expr("l_suppkey div 20").alias("series"),
                F.year("l_shipdate").alias("season"),
                F.month("l_shipdate").alias("round"),
                F.col("l_suppkey").alias("entity"),
                session.alias("session"),
            )
            .agg(
                (90000 + 150 * F.min(F.col("l_quantity").cast("long"))).alias("best_lap_ms"),
                (95000 + 10 * F.max(F.col("l_quantity").cast("long"))).alias("_long"),
                F.count(F.lit(1)).alias("n_laps"),
            )
            .select(
                *KEY,
                "session",
                "best_lap_ms",
                F.when(F.col("n_laps") >= 2, F.col("_long")).alias("long_run_ms"),
                "n_laps",
                F.when(
                    ~undated, F.make_timestamp_ntz("season", "round", first, F.lit(10), F.lit(0), F.lit(0))
                ).alias("session_start"),
            )
        )

    @cached_property
    def sprint_quali(self) -> DataFrame:
        d = self.contest.where(F.col("round").isin(3, 7, 11))
        position = F.row_number().over(W.partitionBy(*EVENT).orderBy("laps", "entity"))
        return d.select(
            *KEY,
            position.alias("sq_position"),
            F.expr("make_timestamp_ntz(season, round, 20, 9, 0, 0)").alias("session_start"),
        )

    # -- second sources, with damage the ladders must refuse --------------------------
    @cached_property
    def result_grid(self) -> DataFrame:
        """The grid published with the results: missing for every third event."""
        listed = (F.col("season") * 12 + F.col("round") + F.col("series")) % 3 != 0
        return self.contest.select(*KEY, F.when(listed, F.col("grid_listed")).alias("grid"))

    @cached_property
    def official_grid(self) -> DataFrame:
        """The officially published grid: some events missing, doubled, foreign or partial."""
        clock = F.col("season") * 12 + F.col("round") + F.col("series")
        kept = self.contest.where(clock % 5 != 0).where((clock % 6 != 1) | (F.col("entity") % 2 == 0))
        position = F.when((clock % 7 == 0) & (F.col("grid_listed") == 2), 1).otherwise(F.col("grid_listed"))
        entity = F.when((clock % 11 == 0) & (F.col("grid_listed") == 3), F.col("entity") + 1000000).otherwise(
            F.col("entity")
        )
        return kept.select(*EVENT, entity.alias("entity"), position.alias("position"))

    @cached_property
    def qualifying(self) -> DataFrame:
        return self.contest.where("quali_position is not null").select(*KEY, "team", "quali_position", "best_ms")

    @cached_property
    def session_entries(self) -> DataFrame:
        """Entry lists by session; practice lists are cut short in some events."""
        clock = F.col("season") * 12 + F.col("round") + F.col("series")
        names = F.explode(F.array(*[F.lit(s) for s in ("Q", "SQ", "FP3", "FP2")])).alias("session")
        d = self.contest.select(*KEY, "team", names)
        keep = (
            F.when(F.col("session") == "Q", (clock % 2 == 0) & (F.col("entity") % 3 != 0))
            .when(F.col("session") == "SQ", F.col("round").isin(3, 7, 11))
            .when(F.col("session") == "FP3", (clock % 4 != 1) | (F.col("entity") % 2 == 0))
            .otherwise(clock % 8 != 5)
        )
        return d.where(keep)


def add_outcomes(df: DataFrame) -> DataFrame:
    """Outcome columns: null for an event not run, null finish when not running."""
    ran = F.col("position").isNotNull()
    finish = F.coalesce(F.col("position"), F.lit(MAX_FIELD))
    retired = F.coalesce(F.col("dnf"), F.lit(True))
    return df.withColumns(
        {
            "finish_or_last": finish,
            "scored": F.when(ran, (F.col("points") > 0).cast("int")),
            "dnf_flag": F.col("dnf").cast("int"),
            "finish_when_running": F.when(ran & ~retired, finish),
            "podium_flag": F.when(ran, (F.col("position") <= 3).cast("int")),
            "top10_flag": F.when(ran, (F.col("position") <= 10).cast("int")),
        }
    )
