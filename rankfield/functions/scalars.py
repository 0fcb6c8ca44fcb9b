"""Small column expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ..constants import WILSON_Z

# --- fixed values: accented letters and their plain forms --------------------
ACCENTED = "áàâäãåčćçďéèêëěíìîïłñńňóòôöõøřšśťúùûüůýÿžźż"
PLAIN = "aaaaaacccdeeeeeiiiilnnnoooooorsstuuuuuyyzzz"
# --- end of fixed values ------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Null stays null (least/greatest alone would return a bound)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def fold(c: str | Column) -> Column:
    """Lower case, accents removed, trimmed."""
    return F.trim(F.translate(F.lower(col(c)), ACCENTED, PLAIN))


def is_finished(status: str | Column) -> Column:
    s = col(status)
    running = s.startswith("Finished") | s.startswith("+") | (F.lower(F.trim(s)) == "lapped")
    return F.coalesce(running, F.lit(False))


def lap_time_ms(text: str | Column) -> Column:
    """'M:SS.fff' or 'SS.fff' to milliseconds; anything else is null."""
    c = F.trim(col(text))
    pattern = r"^(?:(\d+):)?(\d+)\.(\d+)$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))

    millis = F.substring(F.rpad(part(3), 3, "0"), 1, 3).cast("long")
    return F.when(
        c.rlike(pattern),
        F.coalesce(part(1).cast("long"), F.lit(0)) * 60000 + part(2).cast("long") * 1000 + millis,
    )


def utc(text: str | Column) -> Column:
    """Text with an offset to a naive UTC timestamp (session time zone pinned to UTC)."""
    return F.try_to_timestamp(col(text)).cast(T.TimestampNTZType())


def wilson_low(hits: str | Column, n: str | Column, z: float = WILSON_Z) -> Column:
    return F.when(col(n) > 0, F.greatest(F.lit(0.0), _centre(hits, n, z) - _half(hits, n, z))).otherwise(0.0)


def wilson_high(hits: str | Column, n: str | Column, z: float = WILSON_Z) -> Column:
    return F.when(col(n) > 0, F.least(F.lit(1.0), _centre(hits, n, z) + _half(hits, n, z))).otherwise(1.0)


def _rate(hits, n) -> Column:
    return col(hits) / F.nullif(col(n).cast("double"), F.lit(0.0))


def _centre(hits, n, z: float) -> Column:
    m = F.nullif(col(n).cast("double"), F.lit(0.0))
    return (_rate(hits, n) + z * z / (2 * m)) / (1 + z * z / m)


def _half(hits, n, z: float) -> Column:
    m = F.nullif(col(n).cast("double"), F.lit(0.0))
    p = _rate(hits, n)
    return z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)


def safe_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; null where either side is constant."""
    cov = n * sxy - sx * sy
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(spread > 1e-9, cov / F.sqrt(spread))
