"""Landing: nested documents to typed rows, key-replace writes, and the ingest log.

Parsers take one row per event document with the API's nesting and return flat
rows; nothing is looped over on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import cut
from ..functions.scalars import is_finished, lap_time_ms, utc

RACE_DOC = (
    "season string, round string, raceName string, date string, time string, "
    "Circuit struct<circuitId:string, circuitName:string, "
    "Location:struct<lat:string, long:string, locality:string, country:string>>, "
    "Qualifying struct<date:string, time:string>, Sprint struct<date:string, time:string>, "
    "Results array<struct<Driver:struct<driverId:string>, Constructor:struct<constructorId:string>, grid:string, "
    "position:string, positionText:string, points:string, laps:string, status:string, "
    "Time:struct<millis:string>, FastestLap:struct<rank:string>>>, "
    "QualifyingResults array<struct<Driver:struct<driverId:string>, Constructor:struct<constructorId:string>, "
    "position:string, Q1:string, Q2:string, Q3:string>>, "
    "SprintResults array<struct<Driver:struct<driverId:string>, Constructor:struct<constructorId:string>, grid:string, "
    "position:string, points:string, status:string>>, "
    "PitStops array<struct<driverId:string, stop:string, lap:string, duration:string>>"
)
STANDINGS_DOC = (
    "season string, round string, DriverStandings array<struct<position:string, points:string, wins:string, "
    "Driver:struct<driverId:string>, Constructors:array<struct<constructorId:string>>>>"
)
DRIVER_DOC = (
    "driverId string, code string, permanentNumber string, givenName string, familyName string, "
    "dateOfBirth string, nationality string"
)


def _int(c: str) -> Column:
    return F.col(c).try_cast("int")


def _double(c: str) -> Column:
    return F.col(c).try_cast("double")


def _session_start(date: str, time: str) -> Column:
    """Start of a session in naive UTC; a date without a time has none."""
    return F.when(F.col(time).isNotNull(), utc(F.concat(F.col(date), F.lit("T"), F.col(time))))


#: When a document arrived: (modification time, path) of its file. Parsers pass it on to their rows.
ARRIVED = "_arrived"


def carried(docs: DataFrame) -> list[str]:
    return [c for c in (ARRIVED,) if c in docs.columns]


def last_arrived(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with one key those of the last document, and only one of its; without ARRIVED."""
    order = W.partitionBy(*keys).orderBy(F.desc(ARRIVED), *[F.col(c).cast("string") for c in rows.columns if c not in (*keys, ARRIVED)])
    return rows.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn", ARRIVED)


def failed_documents(docs: DataFrame, source: str) -> DataFrame:
    """Rows for the ingest log, one per unreadable document; its scope is the file. ``docs`` has _corrupt_record and ARRIVED."""
    bad = docs.where(F.col("_corrupt_record").isNotNull())
    return bad.select(F.lit(source).alias("source"), F.col(ARRIVED)["path"].alias("scope"), F.lit("failed").alias("status"), F.lit("unreadable document").alias("detail")).distinct()


def arrived() -> Column:
    return F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path")).alias(ARRIVED)


def parse_documents(df: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON text to columns; unreadable documents are dropped."""
    keep = [c for c in df.columns if c != text]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = df.select(*keep, F.from_json(F.col(text), f"{schema}, _corrupt_record string", options).alias("_d"))
    good = F.col("_d").isNotNull() & F.col("_d._corrupt_record").isNull()
    return parsed.where(good).select(*keep, "_d.*").drop("_corrupt_record")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read every readable document in a folder; ``unreadable`` gives the log rows of the others."""
    docs = _documents(spark, path, schema)
    return docs.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record", ARRIVED)


def unreadable(spark: SparkSession, path: str, schema: str, source: str) -> DataFrame:
    return failed_documents(cut(_documents(spark, path, schema)), source)


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    docs = (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    )
    return docs.select("*", arrived())


def parse_races(docs: DataFrame) -> DataFrame:
    return docs.select(
        *carried(docs),
        _int("season").alias("season"),
        _int("round").alias("round"),
        F.col("raceName").alias("race_name"),
        F.col("Circuit.circuitId").alias("circuit_id"),
        F.col("Circuit.circuitName").alias("circuit_name"),
        F.col("Circuit.Location.locality").alias("locality"),
        F.col("Circuit.Location.country").alias("country"),
        _double("Circuit.Location.lat").alias("lat"),
        _double("Circuit.Location.long").alias("lon"),
        F.try_to_date("date", "yyyy-MM-dd").alias("race_date"),
        F.col("time").alias("race_time"),
        _session_start("date", "time").alias("race_start_utc"),
        _session_start("Qualifying.date", "Qualifying.time").alias("quali_start_utc"),
        _session_start("Sprint.date", "Sprint.time").alias("sprint_start_utc"),
    )


def parse_drivers(docs: DataFrame, season: Column) -> DataFrame:
    return docs.select(
        *carried(docs),
        season.alias("season"),
        F.col("driverId").alias("driver_id"),
        "code",
        _int("permanentNumber").alias("permanent_number"),
        F.col("givenName").alias("given_name"),
        F.col("familyName").alias("family_name"),
        F.try_to_date("dateOfBirth", "yyyy-MM-dd").alias("dob"),
        "nationality",
    )


def _each(docs: DataFrame, items: str) -> DataFrame:
    return docs.select(*carried(docs), _int("season").alias("season"), _int("round").alias("round"), F.explode(items).alias("r"))


def parse_results(docs: DataFrame) -> DataFrame:
    finished = is_finished("r.status")
    return _each(docs, "Results").select(
        *carried(docs),
        "season",
        "round",
        F.col("r.Driver.driverId").alias("driver_id"),
        F.col("r.Constructor.constructorId").alias("constructor_id"),
        _int("r.grid").alias("grid"),
        _int("r.position").alias("position"),
        F.coalesce(F.col("r.positionText").rlike("^[0-9]+$"), F.lit(False)).alias("classified"),
        F.coalesce(F.col("r.positionText"), F.lit("")).alias("position_text"),
        F.coalesce(_double("r.points"), F.lit(0.0)).alias("points"),
        _int("r.laps").alias("laps"),
        F.coalesce(F.col("r.status"), F.lit("")).alias("status"),
        finished.alias("finished"),
        (~finished).alias("dnf"),
        F.col("r.Time.millis").try_cast("long").alias("millis"),
        _int("r.FastestLap.rank").alias("fastest_lap_rank"),
    )


def parse_qualifying(docs: DataFrame) -> DataFrame:
    times = {f"q{k}_ms": lap_time_ms(f"r.Q{k}") for k in (1, 2, 3)}
    return (
        _each(docs, "QualifyingResults")
        .select(
            *carried(docs),
            "season",
            "round",
            F.col("r.Driver.driverId").alias("driver_id"),
            F.col("r.Constructor.constructorId").alias("constructor_id"),
            _int("r.position").alias("position"),
            *[c.alias(n) for n, c in times.items()],
        )
        .withColumn("best_ms", F.least("q1_ms", "q2_ms", "q3_ms"))
    )


def parse_sprint(docs: DataFrame) -> DataFrame:
    return _each(docs, "SprintResults").select(
        *carried(docs),
        "season",
        "round",
        F.col("r.Driver.driverId").alias("driver_id"),
        F.col("r.Constructor.constructorId").alias("constructor_id"),
        _int("r.grid").alias("grid"),
        _int("r.position").alias("position"),
        F.coalesce(_double("r.points"), F.lit(0.0)).alias("points"),
        F.col("r.status").alias("status"),
    )


def parse_pitstops(docs: DataFrame) -> DataFrame:
    return _each(docs, "PitStops").select(
        *carried(docs),
        "season",
        "round",
        F.col("r.driverId").alias("driver_id"),
        _int("r.stop").alias("stop"),
        _int("r.lap").alias("lap"),
        _double("r.duration").alias("duration_s"),
    )


def parse_standings(docs: DataFrame) -> DataFrame:
    """The team is the last one listed."""
    rows = docs.select(
        *carried(docs),
        _int("season").alias("season"), _int("round").alias("round"), F.explode_outer("DriverStandings").alias("r")
    ).where("r is not null")
    return rows.select(
        *carried(rows),
        "season",
        "round",
        F.col("r.Driver.driverId").alias("driver_id"),
        F.try_element_at("r.Constructors", F.lit(-1))["constructorId"].alias("constructor_id"),
        _int("r.position").alias("position"),
        F.coalesce(_double("r.points"), F.lit(0.0)).alias("points"),
        _int("r.wins").alias("wins"),
    )


# -- writes ------------------------------------------------------------------------
def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Key-replace: rows of ``new`` take the place of rows with the same key. Idempotent."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_scope(base: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Drop every row of each scope present in ``new``, then add its rows."""
    return upsert(base, new, scope)


def write_partitions(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    )


def log_ingest(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Latest status per (source, scope)."""
    return upsert(log, entries, ["source", "scope"])


def ingest_status(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Status of each wanted (source, scope): ok, empty, failed, or never; done = ok or empty."""
    out = wanted.join(log.select("source", "scope", "status"), ["source", "scope"], "left")
    status = F.coalesce("status", F.lit("never"))
    return out.withColumn("status", status).withColumn("done", F.col("status").isin("ok", "empty"))


def work_list(
    scopes: DataFrame, log: DataFrame, stored: DataFrame, live: Column, behind: DataFrame | None = None
) -> DataFrame:
    """Which scopes still need loading and why.

    scopes: (series, season, round, source, scope); stored: scopes that already
    have rows. A logged ok that is not provisional is settled, as are rows stored
    with no log. An empty answer, or totals behind the results, is stale only
    in the live season."""
    have = stored.select("scope").distinct().withColumn("_stored", F.lit(True))
    df = scopes.join(log.select("source", "scope", "status", "detail"), ["source", "scope"], "left").join(
        have, "scope", "left"
    )
    if behind is not None:
        late = behind.select("scope").distinct().withColumn("_behind", F.lit(True))
        df = df.join(late, "scope", "left")
    else:
        df = df.withColumn("_behind", F.lit(None).cast("boolean"))
    status = F.col("status")
    state = (
        F.when(status.isNull() & F.col("_stored").isNotNull(), "settled")
        .when(status.isNull(), "new")
        .when(status == "failed", "failed")
        .when((status == "ok") & F.coalesce(F.col("detail").startswith("provisional"), F.lit(False)), "provisional")
        .when(live & ((status == "empty") | F.col("_behind").isNotNull()), "stale")
        .otherwise("settled")
    )
    return df.withColumn("state", state).drop("_stored", "_behind", "status", "detail")


def events_needing_source(
    races: DataFrame, results: DataFrame, second: DataFrame, now: Column, horizon_days: int, event: list[str]
) -> DataFrame:
    """Counts per event up to the horizon; ``wanted`` marks the ones to fetch.

    Wanted: run events missing grid rows and not settled by the second source,
    and the next event of each scope (its first not over six hours past its start)."""
    *scope, _ = event
    n = results.groupBy(*event).agg(F.count(F.lit(1)).alias("n_results"), F.count("grid").alias("n_grid"))
    m = second.groupBy(*event).agg(F.count(F.lit(1)).alias("n_second"))
    due = races.where(F.col("race_start") <= now + F.make_interval(days=F.lit(horizon_days)))
    df = due.select(*event, "race_start").join(n, event, "left").join(m, event, "left").fillna(0, ["n_results", "n_grid", "n_second"])
    ahead = F.col("race_start") > now - F.make_interval(hours=F.lit(6))
    nxt = due.where(ahead).groupBy(scope[0]).agg(F.min(F.struct(*event[1:])).alias("_next"))
    df = df.join(nxt, scope[0], "left")
    is_next = F.coalesce(F.struct(*event[1:]) == F.col("_next"), F.lit(False))
    missing = (F.col("n_results") > 0) & (F.col("n_grid") < F.col("n_results"))
    settled = (F.col("n_results") > 0) & (F.col("n_second") > 0)
    return df.withColumn("wanted", is_next | (missing & ~settled)).drop("_next")


def repair_status_flags(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recompute the retirement flag from the status text: (repaired rows, counts of what was wrong)."""
    should = ~is_finished("status")
    wrong = results.where(F.col("dnf") != should).groupBy("status", "dnf").agg(F.count(F.lit(1)).alias("rows"))
    fixed = results.withColumns({"dnf": should, "finished": ~should})
    return fixed, wrong


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def data_snapshot(results: DataFrame, columns: list[str]) -> DataFrame:
    """Row count, last event and an order-free fingerprint of the results."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return results.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("season", "round")).alias("_last"),
        F.bit_xor(digest).alias("fingerprint"),
    ).select("n", F.col("_last.season").alias("season"), F.col("_last.round").alias("round"), "fingerprint")


def load_projection(results: DataFrame, races: DataFrame, event: list[str]) -> DataFrame:
    """Column-pruned results with their calendar entry."""
    return results.select(*event, "entity", "team", "grid", "position", "points", "dnf", "laps").join(
        races.select(*event, "venue", "race_date", "race_start"), event
    )


def penalties_for(penalties: DataFrame, season: Column, rnd: Column) -> DataFrame:
    """The event's penalties, places null for the back; anything but 'back' or a positive number is an error."""
    text = F.col("penalty")
    places = text.try_cast("int")
    valid = (text == "back") | F.coalesce(places > 0, F.lit(False))
    checked = F.when(valid, places).otherwise(
        F.raise_error(F.concat(F.lit("penalty must be 'back' or a positive number: "), text)).cast("int")
    )
    return penalties.where((F.col("season") == season) & (F.col("round") == rnd)).withColumn("places", checked)
