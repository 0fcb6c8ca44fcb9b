"""Laps, flags and stints read from the event stream table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import laps as op
from ..session import cut
from ..sources.contest import Tables
from .registry import query
from .sqlbase import cte

SESSION = ["pool", "session"]
S = "pool:i session:i "

cte("ev", """SELECT user_id // 20 AS pool, CASE WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 2 ELSE 3 END AS session,
  user_id AS entity, event_id, event_type, epoch_us(ts) AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k, value,
  day(ts) * 3 + hour(ts) // 8 AS lap FROM events""")
cte("flag_messages", """SELECT pool, session, t, event_id AS ord,
  CASE WHEN event_type = 'error' THEN 'raise' WHEN k % 5 = 0 THEN 'clear_all' ELSE 'clear' END AS kind,
  CASE WHEN k % 5 = 1 THEN 'safety car' WHEN k % 5 = 0 AND event_type = 'error' THEN 'red' ELSE 'sector ' || (entity % 3) END AS key
  FROM ev WHERE event_type IN ('error', 'signup')""")
cte("lap_rows", """SELECT pool, session, entity, event_id, lap, t AS start, t + CAST(round(value * 1000000) AS BIGINT) AS "end", value AS duration,
  k % 9 = 0 AS is_out_lap, event_type = 'purchase' AND k % 7 = 0 AS pitted FROM ev WHERE event_type IN ('click', 'view', 'purchase')""")
cte("flag_intervals", """SELECT m.pool, m.session, m.t AS lo, coalesce((SELECT min(c.t) FROM flag_messages c WHERE c.pool = m.pool AND c.session = m.session
    AND (c.t, c.ord) > (m.t, m.ord) AND (c.kind = 'clear_all' OR (c.kind = 'clear' AND c.key = m.key))), 4611686018427387904) AS hi
  FROM flag_messages m WHERE m.kind = 'raise'""")
cte("flag_spans", """SELECT pool, session, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY pool, session ORDER BY lo, hi) AS g FROM
  (SELECT *, CASE WHEN lo < max(hi) OVER (PARTITION BY pool, session ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
   FROM flag_intervals)) GROUP BY pool, session, g""")
cte("lap_green", """SELECT *, NOT EXISTS (SELECT 1 FROM flag_spans s WHERE s.pool = l.pool AND s.session = l.session AND s.lo < l."end" AND l.start < s.hi) AS green
  FROM lap_rows l""")
cte("lap_pitted", """SELECT g.*, EXISTS (SELECT 1 FROM lap_rows p WHERE p.pitted AND (p.pool, p.session, p.entity, p.lap) = (g.pool, g.session, g.entity, g.lap)) AS in_lap
  FROM lap_green g""")
cte("lap_clean", """SELECT *, coalesce(fit AND duration <= min(duration) FILTER (fit) OVER (PARTITION BY pool, session, entity) * 1.10, false) AS clean
  FROM (SELECT *, NOT is_out_lap AND NOT in_lap AND green AS fit FROM lap_pitted)""")
cte("stint_rows", """SELECT DISTINCT pool, session, entity, s.stint, s.ord, session * 30 - 30 + s.a AS lap_start,
  CASE WHEN entity % 11 = 0 AND s.stint = 2 THEN NULL ELSE session * 30 - 30 + s.b END AS lap_end,
  CASE s.stint WHEN 1 THEN CASE WHEN entity % 2 = 0 THEN 'SOFT' ELSE 'MEDIUM' END ELSE 'HARD' END AS compound
  FROM lap_rows, (VALUES (1, 1, 0, 18), (2, 2, 14, 40)) s(stint, ord, a, b)""")
cte("lap_tagged", """SELECT *, coalesce(clean AND stint IS NOT NULL AND count(*) FILTER (clean AND stint IS NOT NULL) OVER (PARTITION BY pool, session, entity, stint) >= 2, false) AS long_run
  FROM (SELECT c.*, (SELECT arg_max(s.stint, s.ord) FROM stint_rows s WHERE (s.pool, s.session, s.entity) = (c.pool, c.session, c.entity) AND c.lap BETWEEN s.lap_start AND s.lap_end) AS stint,
   (SELECT arg_max(s.compound, s.ord) FROM stint_rows s WHERE (s.pool, s.session, s.entity) = (c.pool, c.session, c.entity) AND c.lap BETWEEN s.lap_start AND s.lap_end) AS compound
   FROM lap_clean c)""")


def _events(t: Tables):
    day = F.dayofmonth("ts")
    return t.raw("events").select(
        F.expr("user_id div 20").alias("pool"),
        F.when(day <= 10, 1).when(day <= 20, 2).otherwise(3).alias("session"),
        F.col("user_id").alias("entity"),
        "event_id",
        "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
        (day * 3 + F.floor(F.hour("ts") / 8)).cast("int").alias("lap"),
    )


def messages(t: Tables):
    k, error = F.col("k"), F.col("event_type") == "error"
    return _events(t).where(F.col("event_type").isin("error", "signup")).select(
        *SESSION,
        "t",
        F.col("event_id").alias("ord"),
        F.when(error, "raise").when(k % 5 == 0, "clear_all").otherwise("clear").alias("kind"),
        F.when(k % 5 == 1, "safety car").when((k % 5 == 0) & error, "red")
        .otherwise(F.concat(F.lit("sector "), (F.col("entity") % 3).cast("string"))).alias("key"),
    )


def lap_rows(t: Tables):
    return _events(t).where(F.col("event_type").isin("click", "view", "purchase")).select(
        *SESSION,
        "entity",
        "event_id",
        "lap",
        F.col("t").alias("start"),
        (F.col("t") + F.round(F.col("value") * 1000000).cast("long")).alias("end"),
        F.col("value").alias("duration"),
        (F.col("k") % 9 == 0).alias("is_out_lap"),
        ((F.col("event_type") == "purchase") & (F.col("k") % 7 == 0)).alias("pitted"),
    )


def stint_rows(t: Tables):
    e = lap_rows(t).select(*SESSION, "entity").distinct()
    two = F.array(
        *[F.struct(F.lit(s).alias("stint"), F.lit(s).alias("ord"), F.lit(a).alias("a"), F.lit(b).alias("b"))
          for s, a, b in ((1, 0, 18), (2, 14, 40))]
    )
    base = F.col("session") * 30 - 30
    return e.select(*SESSION, "entity", F.inline(two)).select(
        *SESSION,
        "entity",
        "stint",
        "ord",
        (base + F.col("a")).alias("lap_start"),
        F.when(~((F.col("entity") % 11 == 0) & (F.col("stint") == 2)), base + F.col("b")).alias("lap_end"),
        F.when(F.col("stint") == 2, "HARD").when(F.col("entity") % 2 == 0, "SOFT").otherwise("MEDIUM").alias("compound"),
    )


def _green(t):
    return op.green_laps(lap_rows(t), op.not_clear_periods(messages(t), SESSION), SESSION)


def _clean(t):
    return cut(op.clean_laps(cut(op.mark_in_laps(_green(t), lap_rows(t).where("pitted"), SESSION)), SESSION))


@query("c1_not_clear_periods", S + "lo:i hi:i", "SELECT * FROM flag_spans")
def _(t):
    return op.not_clear_periods(messages(t), SESSION)


@query("c2_green_laps", S + "entity:i event_id:i green:b", "SELECT * FROM lap_green")
def _(t):
    return _green(t)


@query("c3_in_and_out_laps", S + "entity:i event_id:i in_lap:b is_out_lap:b", "SELECT * FROM lap_pitted")
def _(t):
    return op.mark_in_laps(lap_rows(t).withColumn("green", F.lit(True)), lap_rows(t).where("pitted"), SESSION)


@query("c4_clean_laps", S + "entity:i event_id:i clean:b", "SELECT * FROM lap_clean")
def _(t):
    return _clean(t)


@query("c5_stint_tagging", S + "entity:i event_id:i stint:i compound:s", "SELECT * FROM lap_tagged")
def _(t):
    return op.tag_stints(_clean(t), stint_rows(t), SESSION, 2)


@query(
    "c6_long_run",
    S + "entity:i long_run_s:d laps:i",
    """SELECT pool, session, entity, median(duration) AS long_run_s, count(*) AS laps FROM lap_tagged WHERE long_run GROUP BY ALL""",
)
def _(t):
    d = op.tag_stints(_clean(t), stint_rows(t), SESSION, 2).where("long_run")
    return d.groupBy(*SESSION, "entity").agg(
        F.percentile("duration", F.lit(0.5)).alias("long_run_s"), F.count(F.lit(1)).alias("laps")
    )


@query(
    "c7_compound_mode",
    S + "entity:i compound:s",
    """SELECT pool, session, entity, arg_max(compound, (n, -ascii(compound))) AS compound FROM
      (SELECT pool, session, entity, compound, count(*) AS n FROM lap_tagged WHERE clean AND compound IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
)
def _(t):
    d = op.tag_stints(_clean(t), stint_rows(t), SESSION, 2).where("clean and compound is not null")
    return d.groupBy(*SESSION, "entity").agg(F.mode("compound", True).alias("compound"))


@query(
    "c8_driver_pace",
    S + "entity:i best_lap_ms:i median_lap_ms:i long_run_ms:i n_laps:i n_clean_laps:i compound_mode:s",
    """SELECT pool, session, entity, round_even(min(duration) * 1000, 0) AS best_lap_ms,
      round_even(median(duration) FILTER (clean) * 1000, 0) AS median_lap_ms, round_even(median(duration) FILTER (long_run) * 1000, 0) AS long_run_ms,
      count(*) AS n_laps, count(*) FILTER (clean) AS n_clean_laps,
      (SELECT arg_max(compound, (n, -ascii(compound))) FROM (SELECT x.compound, count(*) AS n FROM lap_tagged x WHERE x.clean AND x.compound IS NOT NULL
        AND (x.pool, x.session, x.entity) = (y.pool, y.session, y.entity) GROUP BY x.compound)) AS compound_mode
      FROM lap_tagged y GROUP BY pool, session, entity""",
)
def _(t):
    spans = op.not_clear_periods(messages(t), SESSION)
    return op.driver_pace(lap_rows(t).drop("end"), stint_rows(t), lap_rows(t).where("pitted"), spans, SESSION, 2)
