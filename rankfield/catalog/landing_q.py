"""Documents, key-replace writes, logs and work lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import is_finished, lap_time_ms, utc
from ..plans import features as ft
from ..session import ensure_checkpoint_dir
from ..sources import landing as op
from ..sources.contest import EVENT, KEY, Tables
from .checks_q import log_table
from .registry import query
from .sqlbase import cte

EV = "series:i season:i round:i "


def _text(c: str):
    return F.col(c).cast("string")


def race_documents(t: Tables):
    """One JSON text per event, as a results service would send it; every 19th is cut short."""
    person = [
        F.struct(F.concat(F.lit("d"), _text("entity")).alias("driverId")).alias("Driver"),
        F.struct(F.concat(F.lit("t"), _text("team")).alias("constructorId")).alias("Constructor"),
    ]
    lap = F.concat(
        F.floor(F.col("best_ms") / 60000).cast("string"), F.lit(":"),
        F.lpad(F.floor((F.col("best_ms") % 60000) / 1000).cast("string"), 2, "0"), F.lit("."),
        F.regexp_replace(F.lpad((F.col("best_ms") % 1000).cast("string"), 3, "0"), "0$", ""),
    )
    result = F.struct(
        *person,
        _text("grid_listed").alias("grid"),
        _text("position").alias("position"),
        F.when(F.col("dnf"), "R").otherwise(_text("position")).alias("positionText"),
        F.when(F.col("points") > 0, _text("points")).alias("points"),
        _text("laps").alias("laps"),
        F.col("status").alias("status"),
    )
    quali = F.struct(
        *person,
        _text("quali_position").alias("position"),
        F.when(F.col("entity") % 5 > 0, lap).alias("Q1"),
        F.when(F.col("entity") % 2 > 0, F.lit("95.5")).alias("Q2"),
        F.lit("").alias("Q3"),
    )
    stop = F.struct(
        F.concat(F.lit("d"), _text("entity")).alias("driverId"), F.lit("1").alias("stop"), _text("laps").alias("lap"),
        F.concat(_text("position"), F.lit(".25")).alias("duration"),
    )
    sprint = F.struct(
        *person, _text("grid_listed").alias("grid"), _text("position").alias("position"), F.col("status").alias("status")
    )
    d = t.contest.groupBy(*EVENT).agg(
        F.collect_list(result).alias("Results"),
        F.collect_list(F.when(F.col("quali_position").isNotNull(), quali)).alias("QualifyingResults"),
        F.collect_list(F.when(F.col("laps") % 4 == 0, stop)).alias("PitStops"),
        F.collect_list(F.when(F.col("round").isin(3, 7), sprint)).alias("SprintResults"),
    )
    date = F.concat_ws("-", _text("season"), F.lpad(_text("round"), 2, "0"), F.lit("28"))
    doc = F.to_json(
        F.struct(
            _text("season").alias("season"),
            _text("round").alias("round"),
            F.concat(F.lit("Event "), _text("round")).alias("raceName"),
            date.alias("date"),
            F.when(F.col("round") % 4 > 0, F.lit("14:00:00Z")).alias("time"),
            F.struct(
                F.concat(F.lit("v"), _text("round")).alias("circuitId"),
                F.struct(F.concat(_text("round"), F.lit(".5")).alias("lat"), F.lit("-").alias("long")).alias("Location"),
            ).alias("Circuit"),
            F.struct(date.alias("date"), F.lit("12:30:00+02:00").alias("time")).alias("Qualifying"),
            "Results", "QualifyingResults", "PitStops", "SprintResults",
        )
    )
    cut = (F.col("season") * 12 + F.col("round") + F.col("series")) % 19 == 0
    return d.select("series", F.when(cut, F.substring(doc, 1, 80)).otherwise(doc).alias("doc"))


def parsed(t: Tables):
    return op.parse_documents(race_documents(t), "doc", op.RACE_DOC)


def _with_series(parse, docs):
    """Run a parser per document set; the series rides along in raceName."""
    marked = docs.withColumn("season", F.concat(_text("series"), F.lpad("season", 5, "0")))
    return parse(marked).withColumns(
        {"series": F.floor(F.col("season") / 100000), "season": F.col("season") % 100000}
    )


cte("docs", "SELECT * FROM contest WHERE (season * 12 + round + series) % 19 <> 0")


@query(
    "a1_parse_races",
    EV + "race_name:s circuit_id:s lat:d lon:d race_date:s race_time:s race_start_utc:t quali_start_utc:t sprint_start_utc:t",
    """SELECT DISTINCT series, season, round, 'Event ' || round AS race_name, 'v' || round AS circuit_id, round + 0.5 AS lat, NULL AS lon,
      make_date(season, round, 28) AS race_date, CASE WHEN round % 4 > 0 THEN '14:00:00Z' END AS race_time,
      CASE WHEN round % 4 > 0 THEN make_timestamp(season, round, 28, 14, 0, 0) END AS race_start_utc,
      make_timestamp(season, round, 28, 10, 30, 0) AS quali_start_utc, CAST(NULL AS TIMESTAMP) AS sprint_start_utc FROM docs""",
)
def _(t):
    return _with_series(op.parse_races, parsed(t))


@query(
    "a2_parse_drivers",
    "season:i driver_id:s code:s permanent_number:i family_name:s dob:s nationality:s",
    """SELECT 2000 AS season, 's' || s_suppkey AS driver_id, upper(substr(s_name, 1, 3)) AS code,
      CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey END AS permanent_number, s_name AS family_name,
      CASE WHEN s_suppkey % 5 > 0 THEN make_date(1980 + s_nationkey, 1, 2) END AS dob, n_name AS nationality
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t):
    d = t.raw("supplier").join(F.broadcast(t.raw("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("s"), _text("s_suppkey")).alias("driverId"),
            F.upper(F.substring("s_name", 1, 3)).alias("code"),
            F.when(F.col("s_suppkey") % 7 > 0, _text("s_suppkey")).otherwise("none").alias("permanentNumber"),
            F.col("s_name").alias("familyName"),
            F.when(F.col("s_suppkey") % 5 > 0, F.concat((F.col("s_nationkey") + 1980).cast("string"), F.lit("-01-02")))
            .otherwise("unknown").alias("dateOfBirth"),
            F.col("n_name").alias("nationality"),
        )
    )
    return op.parse_drivers(op.parse_documents(d.select(doc.alias("doc")), "doc", op.DRIVER_DOC), F.lit(2000))


@query(
    "a3_parse_results",
    EV + "driver_id:s constructor_id:s grid:i position:i classified:b position_text:s points:d laps:i status:s finished:b dnf:b",
    """SELECT series, season, round, 'd' || entity AS driver_id, 't' || team AS constructor_id, grid_listed AS grid, position,
      NOT dnf AS classified, CASE WHEN dnf THEN 'R' ELSE CAST(position AS VARCHAR) END AS position_text, points, laps, status,
      NOT dnf AS finished, dnf FROM docs""",
)
def _(t):
    return _with_series(op.parse_results, parsed(t))


@query(
    "a4_parse_qualifying",
    EV + "driver_id:s position:i q1_ms:i q2_ms:i q3_ms:i best_ms:i",
    """SELECT series, season, round, 'd' || entity AS driver_id, quali_position AS position,
      CASE WHEN entity % 5 > 0 THEN best_ms END AS q1_ms, CASE WHEN entity % 2 > 0 THEN 95500 END AS q2_ms, NULL AS q3_ms,
      least(CASE WHEN entity % 5 > 0 THEN best_ms END, CASE WHEN entity % 2 > 0 THEN 95500 END) AS best_ms
      FROM docs WHERE quali_position IS NOT NULL""",
)
def _(t):
    return _with_series(op.parse_qualifying, parsed(t))


@query(
    "a5_parse_sprint",
    EV + "driver_id:s grid:i position:i points:d status:s",
    """SELECT series, season, round, 'd' || entity AS driver_id, grid_listed AS grid, position, 0.0 AS points, status
      FROM docs WHERE round IN (3, 7)""",
)
def _(t):
    return _with_series(op.parse_sprint, parsed(t))


@query(
    "a6_parse_pitstops",
    EV + "driver_id:s stop:i lap:i duration_s:d",
    """SELECT series, season, round, 'd' || entity AS driver_id, 1 AS stop, laps AS lap, position + 0.25 AS duration_s
      FROM docs WHERE laps % 4 = 0""",
)
def _(t):
    return _with_series(op.parse_pitstops, parsed(t))


@query(
    "a7_parse_standings",
    EV + "driver_id:s constructor_id:s position:i points:d wins:i",
    """SELECT series, season, round, 'd' || entity AS driver_id, 't' || team AS constructor_id, position, points, 0 AS wins FROM standings""",
)
def _(t):
    teams = F.array(
        F.struct(F.lit("t0").alias("constructorId")), F.struct(F.concat(F.lit("t"), _text("team")).alias("constructorId"))
    )
    row = F.struct(
        _text("position").alias("position"),
        F.when(F.col("points") > 0, _text("points")).alias("points"),
        F.lit("0").alias("wins"),
        F.struct(F.concat(F.lit("d"), _text("entity")).alias("driverId")).alias("Driver"),
        teams.alias("Constructors"),
    )
    d = t.standings.groupBy(*EVENT).agg(F.collect_list(row).alias("DriverStandings"))
    doc = F.to_json(F.struct(_text("season").alias("season"), _text("round").alias("round"), "DriverStandings"))
    docs = op.parse_documents(d.select("series", doc.alias("doc")), "doc", op.STANDINGS_DOC)
    return _with_series(op.parse_standings, docs)


@query(
    "a8_is_finished",
    EV + "entity:i finished:b",
    "SELECT series, season, round, entity, CASE WHEN entity % 9 = 0 THEN false ELSE NOT dnf END AS finished FROM contest",
)
def _(t):
    status = F.when(F.col("entity") % 9 > 0, F.when(F.col("entity") % 4 == 0, F.upper("status")).otherwise(F.col("status")))
    # Upper-casing only keeps "lapped" and "+1 lap" readable, as the rule is case-bound elsewhere.
    status = F.when(status == "FINISHED", "Finished").otherwise(status)
    return t.contest.withColumn("finished", is_finished(status))


@query(
    "a9_lap_time_ms",
    EV + "entity:i full_ms:i short_ms:i cut_ms:i bad_ms:i",
    """SELECT series, season, round, entity, laps * 60000 + 5000 + 120 AS full_ms, 30000 + (laps % 10) * 100 AS short_ms,
      7123 AS cut_ms, NULL AS bad_ms FROM contest""",
)
def _(t):
    return t.contest.withColumns(
        {
            "full_ms": lap_time_ms(F.concat(_text("laps"), F.lit(":05.12"))),
            "short_ms": lap_time_ms(F.concat(F.lit("30."), (F.col("laps") % 10).cast("string"))),
            "cut_ms": lap_time_ms(F.when(F.col("laps") > 0, "7.12345")),
            "bad_ms": lap_time_ms(F.concat(_text("laps"), F.lit(" laps"))),
        }
    )


@query(
    "a10_utc",
    "event_id:i at:t",
    "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS at FROM events",
)
def _(t):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return t.raw("events").withColumn("at", utc(F.when(F.col("event_id") % 3 < 2, text).otherwise("soon")))


def _slices(t):
    o = t.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    old = o.where(F.col("o_orderdate") < "1999-01-01")
    new = o.where(F.col("o_orderdate") >= "1998-06-01").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return old, new


@query(
    "a11_upsert",
    "o_orderkey:i o_orderstatus:s o_totalprice:d",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < '1998-06-01'
      UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice + 1 FROM orders WHERE o_orderdate >= '1998-06-01'""",
)
def _(t):
    return op.upsert(*_slices(t), ["o_orderkey"])


cte("regrid", """SELECT series, season, round, entity, position + 1 AS position FROM official_grid
  WHERE (season * 12 + round + series) % 4 = 0 AND entity % 2 = 0""")


@query(
    "a12_replace_scope",
    EV + "entity:i position:i",
    """SELECT series, season, round, entity, position FROM official_grid ANTI JOIN regrid USING (series, season, round)
      UNION ALL SELECT * FROM regrid""",
)
def _(t):
    g = t.official_grid
    e = (F.col("season") * 12 + F.col("round") + F.col("series")) % 4 == 0
    new = g.where(e & (F.col("entity") % 2 == 0)).withColumn("position", F.col("position") + 1)
    return op.replace_scope(g, new, EVENT)


@query(
    "a13_ingest_log",
    "source:s scope:s status:s done:b",
    """SELECT 'results' AS source, concat_ws(':', c.series, c.season, c.round) AS scope, coalesce(s, 'never') AS status,
      coalesce(s, 'never') IN ('ok', 'empty') AS done FROM calendar c LEFT JOIN
      (SELECT scope AS sc, CASE WHEN scope LIKE '%:7' THEN 'ok' ELSE status END AS s FROM logd WHERE scope NOT LIKE '%:4') l
      ON l.sc = concat_ws(':', c.series, c.season, c.round)""",
)
def _(t):
    log = log_table(t).drop(*EVENT).where(~F.col("scope").endswith(":4"))
    again = log.where(F.col("scope").endswith(":7")).withColumn("status", F.lit("ok"))
    wanted = log_table(t).select("source", "scope")
    return op.ingest_status(op.log_ingest(log, again), wanted)


@query(
    "a14_work_list",
    EV + "state:s",
    """SELECT c.series, c.season, c.round, CASE WHEN l.status IS NULL THEN CASE WHEN k.series IS NOT NULL THEN 'settled' ELSE 'new' END
        WHEN l.status = 'failed' THEN 'failed' WHEN l.status = 'ok' AND l.detail LIKE 'provisional%' THEN 'provisional'
        WHEN c.season = 2001 AND (l.status = 'empty' OR b.series IS NOT NULL) THEN 'stale' ELSE 'settled' END AS state
      FROM calendar c LEFT JOIN (SELECT * FROM logd WHERE scope NOT LIKE '%:4') l ON l.scope = concat_ws(':', c.series, c.season, c.round)
      LEFT JOIN (SELECT DISTINCT series, season, round FROM contest) k ON (k.series, k.season, k.round) = (c.series, c.season, c.round)
      LEFT JOIN (SELECT DISTINCT series, season, round FROM calendar WHERE (season * 12 + round + series) % 31 = 0) b
        ON (b.series, b.season, b.round) = (c.series, c.season, c.round)""",
)
def _(t):
    log = log_table(t)
    scope = F.concat_ws(":", *[_text(c) for c in EVENT]).alias("scope")
    stored = t.contest.select(scope)
    behind = t.calendar.where((F.col("season") * 12 + F.col("round") + F.col("series")) % 31 == 0).select(scope)
    scopes = log.select(*EVENT, "source", "scope")
    log = log.drop(*EVENT).where(~F.col("scope").endswith(":4"))
    return op.work_list(scopes, log, stored, F.col("season") == 2001, behind)


@query(
    "a15_events_needing_source",
    EV + "n_results:i n_grid:i n_second:i wanted:b",
    """WITH d AS (SELECT c.series, c.season, c.round, race_start, count(r.entity) AS n_results, count(r.grid) AS n_grid,
        (SELECT count(*) FROM official_grid g WHERE g.series = c.series AND g.season = c.season AND g.round = c.round) AS n_second
        FROM calendar c LEFT JOIN result_grid r USING (series, season, round)
        WHERE race_start <= TIMESTAMP '2001-11-25 12:00:00' + INTERVAL 7 DAY GROUP BY c.series, c.season, c.round, race_start)
      SELECT d.*, (NOT (n_results > 0 AND n_second > 0) AND n_results > 0 AND n_grid < n_results)
        OR (race_start > TIMESTAMP '2001-11-25 06:00:00' AND race_start = (SELECT min(x.race_start) FROM d x
          WHERE x.series = d.series AND x.race_start > TIMESTAMP '2001-11-25 06:00:00')) AS wanted FROM d""",
)
def _(t):
    now = F.lit("2001-11-25 12:00:00").cast("timestamp_ntz")
    return op.events_needing_source(t.calendar, t.result_grid, t.official_grid, now, 7, EVENT)


def _stale_flags(t):
    return t.contest.withColumn("dnf", F.when(F.col("status") == "Lapped", True).otherwise(F.col("dnf")))


@query(
    "a16_repair_status_flags",
    "status:s dnf:b rows:i",
    "SELECT status, true AS dnf, count(*) AS rows FROM contest WHERE status = 'Lapped' GROUP BY status",
)
def _(t):
    return op.repair_status_flags(_stale_flags(t))[1]


@query(
    "a16_repaired_rows",
    EV + "entity:i dnf:b finished:b",
    "SELECT *, NOT dnf AS finished FROM contest",
)
def _(t):
    return op.repair_status_flags(_stale_flags(t))[0]


TABLE_NAMES = ("lineitem", "orders", "supplier", "customer", "events", "part", "nation", "region", "labels")


@query(
    "a17_table_counts",
    "table:s n:i",
    " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {n}" for n in TABLE_NAMES),
)
def _(t):
    return op.table_counts({n: t.raw(n) for n in TABLE_NAMES})


@query(
    "a18_load_projection",
    EV + "entity:i team:i venue:i grid:i position:i points:i dnf:b laps:i race_date:s",
    "SELECT * EXCLUDE (venue), k.venue FROM contest c JOIN calendar k USING (series, season, round)".replace("* EXCLUDE (venue)", "c.* EXCLUDE (venue)").replace(
        "k.venue FROM", "k.venue, k.race_date FROM"),
)
def _(t):
    return op.load_projection(t.contest, t.calendar, EVENT)


@query(
    "a19_save_and_load",
    EV + "entity:i drv_points_rate_5:d",
    """SELECT *, avg(points) OVER (PARTITION BY series, entity ORDER BY race_seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS drv_points_rate_5
      FROM contest""",
)
def _(t):
    ensure_checkpoint_dir(t.spark)
    path = f"{t.spark.sparkContext.getCheckpointDir()}/features-{uuid.uuid4().hex}"
    ft.save(ft.add_form(t.outcomes).select(*KEY, "drv_points_rate_5"), path)
    return ft.load(t.spark, path)


FORECAST_DOC = (
    "series bigint, season int, round int, stage string, generated_at string, "
    "board array<struct<entity:bigint, p_win:double>>"
)


@query(
    "a20_load_predictions",
    EV + "entity:i p_win:d",
    """SELECT series, season, round, entity, round(1.0 / position, 9) AS p_win FROM contest WHERE (season * 12 + round + series) % 13 <> 0""",
)
def _(t):
    board = F.struct("entity", F.round(1.0 / F.col("position"), 9).alias("p_win"))
    d = t.contest.groupBy(*EVENT).agg(F.collect_list(board).alias("board"))
    doc = F.to_json(F.struct(*EVENT, F.lit("post_quali").alias("stage"), "board"))
    cut = (F.col("season") * 12 + F.col("round") + F.col("series")) % 13 == 0
    docs = op.parse_documents(d.select(F.when(cut, F.substring(doc, 1, 60)).otherwise(doc).alias("doc")), "doc", FORECAST_DOC)
    return docs.select(*EVENT, F.explode("board").alias("b")).select(*EVENT, "b.entity", "b.p_win")


@query(
    "a21_data_snapshot",
    "n:i season:i round:i fingerprint:i",
    """SELECT count(*) AS n, max({'s': season, 'r': round}).s AS season, max({'s': season, 'r': round}).r AS round,
      bit_xor(('0x' || substr(md5(concat_ws('|', season, round, entity, position, grid)), 1, 15))::BIGINT) AS fingerprint FROM contest""",
)
def _(t):
    return op.data_snapshot(t.contest, ["season", "round", "entity", "position", "grid"])


def penalty_list(t: Tables):
    """Penalties decided by modulus: every thirteenth entrant in every third round."""
    d = t.contest.where((F.col("entity") + F.col("season")) % 6 == 0).where("round % 3 = 0")
    return d.select(*KEY, F.when(F.col("entity") % 2 == 0, "back").otherwise("5").alias("penalty"))


cte("penalties", """SELECT series, season, round, entity, CASE WHEN entity % 2 = 0 THEN 'back' ELSE '5' END AS penalty,
  CASE WHEN entity % 2 = 0 THEN NULL ELSE 5 END AS places FROM contest WHERE (entity + season) % 6 = 0 AND round % 3 = 0""")


@query(
    "a22_event_penalties",
    EV + "entity:i penalty:s places:i",
    "SELECT * FROM penalties WHERE season = 2000 AND round = 6",
)
def _(t):
    return op.penalties_for(penalty_list(t), F.lit(2000), F.lit(6))
