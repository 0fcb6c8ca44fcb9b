"""Query registration. A column spec types both sides of a comparison.

Spec: "name:t ..." with t one of i (long), d (double, 6 decimals; rounded to 10 first so
that a value on a rounding edge does not depend on the order of a sum), s (string),
b (boolean), t (timestamp as text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.contest import Tables
from .sqlbase import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark_cast(name: str, kind: str):
    c = F.col(name)
    return {
        "i": lambda: c.cast("long"),
        "d": lambda: F.round(F.round(c.cast("double"), 10), 6),
        "s": lambda: c.cast("string"),
        "b": lambda: c.cast("boolean"),
        "t": lambda: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
    }[kind]().alias(name)


def _sql_cast(name: str, kind: str) -> str:
    q = f'"{name}"'
    return {
        "i": f"CAST({q} AS BIGINT)",
        "d": f"round(round(CAST({q} AS DOUBLE), 10), 6)",
        "s": f"CAST({q} AS VARCHAR)",
        "b": f"CAST({q} AS BOOLEAN)",
        "t": f"strftime({q}, '%Y-%m-%d %H:%M:%S')",
    }[kind] + f" AS {q}"


def query(name: str, spec: str, sql: str | None = None, land: bool = True):
    """Register a query. land: store the results first, for queries that read them more than once."""
    columns = [tuple(part.split(":")) for part in spec.split()]

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder, land)).select(*[_spark_cast(n, k) for n, k in columns])

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(f"SELECT {', '.join(_sql_cast(n, k) for n, k in columns)} FROM ({sql}) AS _q")
        return fn

    return register
