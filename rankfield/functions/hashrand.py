"""Deterministic randomness: every draw is a hash of its keys.

A draw depends only on what it is for (event, entity, replicate, ...), never on
partitioning, task retries or executor loss.
"""

from __future__ import annotations

from functools import reduce
from math import e, factorial

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def uniform(tag: str | Column, *keys: str | Column) -> Column:
    """Uniform in (0, 1), 52 bits of md5 over the tag and the keys."""
    parts = [F.lit(tag) if isinstance(tag, str) else tag] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def gumbel(tag: str | Column, *keys: str | Column) -> Column:
    return -F.log(-F.log(uniform(tag, *keys)))


def below(n: str | Column, tag: str, *keys: str | Column) -> Column:
    """Integer in [0, n)."""
    n = F.col(n) if isinstance(n, str) else n
    return F.floor(uniform(tag, *keys) * n).cast("long")


#: Poisson(1) counts by 16-bit draws: how many of these a draw reaches, as hexadecimal digits.
_CUTS = [round(65536 * sum(1 / factorial(i) for i in range(k + 1)) / e) for k in range(12)]
POISSON_CUTS = [f"{c:04x}" for c in _CUTS if c < 65536]
#: Draws in one digest.
DRAWS = 8


def poisson_draws(tag: str, *keys: str | Column) -> list[Column]:
    """DRAWS independent Poisson(1) counts from one md5 over the tag and the keys (digits compare like numbers)."""
    digest = F.md5(F.concat_ws("|", F.lit(tag), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))
    draws = [F.substring(digest, 4 * i + 1, 4) for i in range(DRAWS)]
    return [reduce(lambda a, b: a + b, [(d >= F.lit(c)).cast("int") for c in POISSON_CUTS]) for d in draws]


def bucket(buckets: int, *keys: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast(
        "long"
    ) % F.lit(buckets)


def dense_index(df: DataFrame, keys: list[str], within: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """0-based index of the rows inside ``within``, without one window over them all.

    Rows are numbered inside hash buckets; bucket counts (at most ``buckets``
    rows per group) turn the local number into a global one.
    """
    b = df.withColumn("_b", bucket(buckets, *keys))
    sizes = b.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*within).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*within)
    sizes = sizes.select(
        *within,
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias(f"{out}_count"),
    )
    local = F.row_number().over(W.partitionBy(*within, "_b").orderBy(*keys))
    return (
        b.withColumn("_r", local)
        .join(sizes, [*within, "_b"])
        .withColumn(out, (F.col("_offset") + F.col("_r") - 1).cast("long"))
        .drop("_b", "_r", "_offset")
    )

