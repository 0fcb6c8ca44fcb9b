"""DuckDB text shared by the oracles: named CTEs, pulled in by name."""

from __future__ import annotations

import re
from functools import cache

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


@cache
def _read(text: str) -> frozenset[str]:
    """Words that stand where a table does."""
    return frozenset(w for pair in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)|,\s*(?=(\w+)\s+[a-z])", text) for w in pair if w)


def with_ctes(sql: str) -> str:
    used: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        found = _read(text)
        for name in [n for n in CTES if n in found]:
            if name not in used and name not in open_:
                open_.add(name)
                visit(CTES[name])
                used.append(name)

    visit(sql)
    if not used:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in used) + "\n" + sql


def prior_rows(col: str, by: str, n: int, how: str = "avg", seq: str = "race_seq") -> str:
    return f"{how}({col}) OVER (PARTITION BY {by} ORDER BY {seq} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def prior_values(col: str, by: str, n: int | None, stat: str = "avg", seq: str = "race_seq") -> str:
    """Last n non-null values before the row, through a list."""
    values = (
        f"list({col} ORDER BY {seq}) FILTER ({col} IS NOT NULL) "
        f"OVER (PARTITION BY {by} ORDER BY {seq} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    if n is not None:
        values = f"list_slice({values}, -{n}, -1)"
    return f"list_aggregate({values}, '{stat}')"


def uniform_sql(tag: str, *keys: str) -> str:
    parts = ", ".join([f"'{tag}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::BIGINT::DOUBLE + 0.5) / pow(2, 52))"


def gumbel_sql(tag: str, *keys: str) -> str:
    return f"(-ln(-ln({uniform_sql(tag, *keys)})))"


def _ahead_sql(src: str, keys: str, chance: str, nodes: tuple[list[float], list[float]]) -> str:
    """Distribution of the number of others ahead: the product of their polynomials at every node, averaged."""
    pairs = ", ".join(f"({t!r}, {w!r})" for t, w in zip(*nodes, strict=True))
    product = "list_reduce(list_prepend([1.0::DOUBLE], list([1 - p, p])), lambda a, b: list_transform(range(1, len(a) + 2), lambda k: coalesce(a[k], 0) * b[1] + coalesce(a[k - 1], 0) * b[2]))"
    return f"""SELECT {keys}, entity, pos, sum(w * poly[pos]) AS share FROM (SELECT {keys}, entity, t, w, {product} AS poly FROM
      (SELECT {', '.join('x.' + k.strip() for k in keys.split(','))}, x.entity, t, w, {chance} AS p FROM {src} x JOIN {src} y USING ({keys}), (VALUES {pairs}) n(t, w) WHERE x.entity <> y.entity) GROUP BY ALL),
      unnest(range(1, len(poly) + 1)) u(pos) GROUP BY ALL"""


def exact_sql(src: str, keys: str, dnf: bool = False, temp: str = "0.8", score: str = "score", most: int = 20) -> str:
    """Exact position shares of (keys, entity, score, ...), with retirements on request; fields of at most ``most`` entrants."""
    from ..operators.marginals import arrival_nodes, retired_nodes

    arrived = f"1 - exp(-exp(greatest(least((y.{score} - x.{score}) / {temp}, 700), -700)) * t)".replace("/ temperature", "/ x.temperature")
    if not dnf:
        return _ahead_sql(src, keys, arrived, arrival_nodes())
    finish = _ahead_sql(src, keys, f"(1 - y.dnf_prob) * ({arrived})", arrival_nodes())
    back = _ahead_sql(src, keys, "1 - y.dnf_prob + y.dnf_prob * t", retired_nodes(most))
    return f"""SELECT {keys}, entity, f.pos, (1 - dnf_prob) * f.share + dnf_prob * r.share AS share FROM ({finish}) f JOIN ({back}) r USING ({keys}, entity, pos)
      JOIN {src} USING ({keys}, entity)"""


cte(
    "totals",
    """SELECT l_suppkey // 20 AS series, year(l_shipdate) AS season, month(l_shipdate) AS round, l_suppkey AS entity,
  count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue_c,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned
  FROM lineitem GROUP BY ALL""",
)
cte(
    "contest0",
    """SELECT series, season, round, entity,
  dense_rank() OVER (PARTITION BY series ORDER BY season, round) - 1 AS race_seq,
  series * 100 + (entity % 20 + CASE WHEN season % 2 = 1 AND round >= 7 THEN 1 ELSE 0 END) // 2 AS team,
  series * 100 + round AS venue,
  row_number() OVER (PARTITION BY series, season, round ORDER BY revenue_c DESC, entity) AS position,
  row_number() OVER (PARTITION BY series, season, round ORDER BY qty DESC, entity) AS slot,
  count(*) OVER (PARTITION BY series, season, round) AS field,
  CASE WHEN (season * 12 + round + entity) % 41 <> 0
    THEN 100000 + max(qty) OVER (PARTITION BY series, season, round) - qty END AS best_ms,
  returned * 2 > lines AS dnf, lines AS laps, (season * 12 + round + entity) % 53 = 0 AS no_quali
  FROM totals""",
)
cte(
    "contest",
    """SELECT series, season, round, race_seq, entity, team, venue, position, field, best_ms, dnf, laps,
  CASE WHEN entity % 37 = 5 THEN 0 ELSE slot END AS grid_listed,
  CASE WHEN entity % 37 = 5 THEN field ELSE slot END AS grid,
  CASE WHEN NOT no_quali THEN slot END AS quali_position,
  CASE WHEN dnf THEN 0 ELSE coalesce(list_extract([25, 18, 15, 12, 10, 8, 6, 4, 2, 1], CAST(position AS INT)), 0) END AS points,
  CASE WHEN dnf THEN 'Engine' WHEN laps % 3 = 0 THEN '+1 Lap' WHEN laps % 3 = 1 THEN 'Lapped' ELSE 'Finished' END AS status
  FROM contest0""",
)
cte(
    "outcomes",
    """SELECT *, coalesce(position, 24) AS finish_or_last,
  CASE WHEN position IS NOT NULL THEN CAST(points > 0 AS INT) END AS scored, CAST(dnf AS INT) AS dnf_flag,
  CASE WHEN position IS NOT NULL AND NOT coalesce(dnf, true) THEN position END AS finish_when_running,
  CASE WHEN position IS NOT NULL THEN CAST(position <= 3 AS INT) END AS podium_flag,
  CASE WHEN position IS NOT NULL THEN CAST(position <= 10 AS INT) END AS top10_flag
  FROM contest""",
)
cte(
    "calendar",
    """SELECT series, season, CAST(round AS INT) AS round, series * 100 + round AS venue,
  make_date(season, round, 28) AS race_date, make_timestamp(season, round, 28, 14, 0, 0) AS race_start,
  CASE WHEN round % 6 <> 0 THEN make_timestamp(season, round,
    CASE WHEN season % 2 = 1 AND round % 4 = 0 THEN 21 ELSE 28 END, 12, 0, 0) END AS quali_start,
  CASE WHEN round IN (3, 7) THEN make_timestamp(season, round, 27, 12, 0, 0) END AS sprint_start
  FROM (SELECT DISTINCT series, season FROM totals), range(1, 13) AS r(round)""",
)
cte(
    "sprint",
    """SELECT series, season, round, entity, team, position,
  coalesce(list_extract([8, 7, 6, 5, 4, 3, 2, 1], CAST(position AS INT)), 0) AS points
  FROM (SELECT *  EXCLUDE (position, points),
    row_number() OVER (PARTITION BY series, season, round ORDER BY laps DESC, entity) AS position
    FROM contest WHERE round IN (3, 7))""",
)
cte(
    "standings",
    """WITH scored AS (SELECT series, season, round, entity, team, points FROM contest
    UNION ALL SELECT series, season, round, entity, team, points FROM sprint),
  people AS (SELECT DISTINCT series, season, entity FROM contest),
  run AS (SELECT DISTINCT series, season, round FROM contest),
  held AS (SELECT p.series, p.season, r.round, p.entity,
    (SELECT sum(s.points) FROM scored s WHERE s.series = p.series AND s.season = p.season
      AND s.entity = p.entity AND s.round <= r.round) AS points,
    (SELECT arg_max(s.team, s.round) FROM scored s WHERE s.series = p.series AND s.season = p.season
      AND s.entity = p.entity AND s.round <= r.round) AS team
    FROM people p JOIN run r USING (series, season))
  SELECT *, row_number() OVER (PARTITION BY series, season, round ORDER BY points DESC, entity) AS position
  FROM held WHERE points IS NOT NULL""",
)
cte(
    "session_pace",
    """SELECT series, season, round, entity, session, best_lap_ms,
    CASE WHEN n_laps >= 2 THEN long_ms END AS long_run_ms, n_laps,
    CASE WHEN NOT (session = 'FP2' AND round % 5 = 0) THEN make_timestamp(season, round,
      CASE session WHEN 'FP1' THEN 1 WHEN 'FP2' THEN 11 ELSE 22 END, 10, 0, 0) END AS session_start
  FROM (SELECT l_suppkey // 20 AS series, year(l_shipdate) AS season, month(l_shipdate) AS round, l_suppkey AS entity,
    CASE WHEN day(l_shipdate) <= 10 THEN 'FP1' WHEN day(l_shipdate) <= 20 THEN 'FP2' ELSE 'FP3' END AS session,
    90000 + 150 * min(CAST(l_quantity AS BIGINT)) AS best_lap_ms,
    95000 + 10 * max(CAST(l_quantity AS BIGINT)) AS long_ms, count(*) AS n_laps
    FROM lineitem GROUP BY ALL)""",
)
cte(
    "sprint_quali",
    """SELECT series, season, round, entity,
  row_number() OVER (PARTITION BY series, season, round ORDER BY laps, entity) AS sq_position,
  make_timestamp(season, round, 20, 9, 0, 0) AS session_start
  FROM contest WHERE round IN (3, 7, 11)""",
)
cte(
    "result_grid",
    """SELECT series, season, round, entity,
  CASE WHEN (season * 12 + round + series) % 3 <> 0 THEN grid_listed END AS grid FROM contest""",
)
cte(
    "official_grid",
    """SELECT series, season, round,
  CASE WHEN (season * 12 + round + series) % 11 = 0 AND grid_listed = 3 THEN entity + 1000000 ELSE entity END AS entity,
  CASE WHEN (season * 12 + round + series) % 7 = 0 AND grid_listed = 2 THEN 1 ELSE grid_listed END AS position
  FROM contest WHERE (season * 12 + round + series) % 5 <> 0
    AND ((season * 12 + round + series) % 6 <> 1 OR entity % 2 = 0)""",
)
cte(
    "qualifying",
    "SELECT series, season, round, entity, team, quali_position, best_ms FROM contest WHERE quali_position IS NOT NULL",
)
cte(
    "session_entries",
    """SELECT series, season, round, entity, team, session
  FROM contest, (VALUES ('Q'), ('SQ'), ('FP3'), ('FP2')) AS s(session)
  WHERE CASE session
    WHEN 'Q' THEN (season * 12 + round + series) % 2 = 0 AND entity % 3 <> 0
    WHEN 'SQ' THEN round IN (3, 7, 11)
    WHEN 'FP3' THEN (season * 12 + round + series) % 4 <> 1 OR entity % 2 = 0
    ELSE (season * 12 + round + series) % 8 <> 5 END""",
)
