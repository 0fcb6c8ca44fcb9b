"""Exact finishing positions of a Plackett-Luce field, without draws.

Entrants race with exponential arrival times whose rates are exp(score / T). Given an entrant's own arrival, every other
one is ahead independently, so the number ahead has a Poisson-binomial distribution. Averaging over the own
arrival gives all positions: the trapezoid rule on the logarithm of time, whose integrand is analytic and falls off
doubly exponentially. Its error grows with the field and as rates come close (20 alike: 2e-5 with NODES points), and shows in
the entrants of a position, who must sum to one: a field that misses that by more than TOLERANCE is integrated again with half
the step, which squares the error.

With retirements, an entrant that finishes is behind those that arrive earlier and finish. One that retires has a
uniform place among the retired behind all who finish: given it, the others are ahead independently again, with
probabilities that are linear in it, so Gauss-Legendre points are exact.

A field is one row; the only Python is arithmetic on whole Arrow columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import FIELD_LIMIT

EVENT = ["series", "race_seq"]
STEP = 0.35
FIRST, LAST = -30.1, 3.5
NODES = int((LAST - FIRST) / STEP) + 1
#: How far the entrants of a position may be from one in all, and how often the step is halved for it.
TOLERANCE, HALVINGS = 1e-7, 4
#: Cells that are worked on at once: they stay in a core's cache.
CELLS = 1 << 16


def arrival_nodes(halvings: int = 0) -> tuple[list[float], list[float]]:
    """Times relative to an entrant's mean arrival, and their weights."""
    z = FIRST + STEP / 2**halvings * np.arange((NODES - 1) * 2**halvings + 1)
    weight = np.exp(z - np.exp(z))
    return np.exp(z).tolist(), (weight / weight.sum()).tolist()


def retired_nodes(field: int) -> tuple[list[float], list[float]]:
    """Gauss-Legendre points on (0, 1), exact for the polynomials of a field."""
    x, w = np.polynomial.legendre.leggauss(field // 2 + 1)
    return ((x + 1) / 2).tolist(), (w / 2).tolist()


def _kernel(retiring: bool):  # noqa: ANN202
    """A function on Arrow columns of fields; nested, so that it travels with the plan."""
    nodes = [arrival_nodes(k) for k in range(HALVINGS + 1)]
    cells, tolerance = CELLS, TOLERANCE

    space: dict = {}

    def room(name, *shape):  # noqa: ANN001, ANN002, ANN202
        """Memory that is used again from block to block."""
        import numpy as np

        size = int(np.prod(shape))
        if name not in space or space[name].size < size:
            space[name] = np.empty(size)
        return space[name][:size].reshape(shape)

    def counts(name, p):  # noqa: ANN001, ANN202
        """Distribution of the number ahead among some others, from their probabilities (others, fields, entrants, points)."""
        import numpy as np

        out, moved = room(name, len(p) + 1, *p.shape[1:]), room("moved", len(p) + 1, *p.shape[1:])
        out[0], out[1:] = 1.0, 0.0
        for j, one in enumerate(p, 1):  # so many can be ahead by now
            np.multiply(out[:j], one, out=moved[:j])
            out[:j] -= moved[:j]
            out[1 : j + 1] += moved[:j]
        return out

    def ahead(p, weights):  # noqa: ANN001, ANN202
        """Mean distribution over the points of the number ahead: both halves of the others, joined by a product of matrices."""
        import numpy as np

        n = len(p)
        low, high = counts("low", p[: n // 2]), counts("high", p[n // 2 :])
        low *= np.array(weights)
        both = np.moveaxis(low, 0, 2) @ np.moveaxis(high, 0, 3)
        out = np.zeros((*both.shape[:2], n + 1))
        for k in range(len(low)):
            out[..., k : k + len(high)] += both[:, :, k]
        return out[..., :n]  # no entrant is ahead of itself

    def marginals(z, d, halvings):  # noqa: ANN001, ANN202
        import numpy as np

        n = z.shape[1]
        times, weights = nodes[halvings]
        rate = np.exp(np.clip(z.T[:, :, None] - z[None], -700, 700))
        p = room("p", *rate.shape, len(times))
        np.multiply(rate[..., None], -np.array(times), out=p)
        np.maximum(p, -40.0, out=p)  # surely ahead; smaller powers are slow
        np.subtract(1.0, np.exp(p, out=p), out=p)
        own = np.arange(n)
        p[own, :, own] = 0.0
        if not retiring:
            return ahead(p, weights)
        out = d.T[:, :, None, None]
        p *= 1.0 - out
        finish = ahead(p, weights)
        places, shares = np.polynomial.legendre.leggauss(n // 2 + 1)
        back = np.repeat(1.0 - out + out * ((places + 1) / 2), n, axis=2)
        back[own, :, own] = 0.0
        return (1.0 - d)[..., None] * finish + d[..., None] * ahead(back, shares / 2)

    def coherent(z, d):  # noqa: ANN001, ANN202
        """All positions, with as many points as it takes for the entrants of each to sum to one."""
        import numpy as np

        out = marginals(z, d, 0)
        for halvings in range(1, len(nodes)):
            off = np.abs(out.sum(axis=1) - 1.0).max(axis=1) > tolerance
            if not off.any():
                break
            out[off] = marginals(z[off], d[off], halvings)
        return out

    def run(scores, rates):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        size = np.diff(scores.offsets.to_numpy())
        z = scores.flatten().to_numpy(zero_copy_only=False).astype(float)
        d = rates.flatten().to_numpy(zero_copy_only=False).astype(float)
        begin = np.cumsum(size) - size
        ends = np.concatenate(([0], np.cumsum(size * size)))
        out = np.empty(ends[-1])
        for n in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == n)
            step = max(1, cells // (n * n * len(nodes[0][0])))
            for low in range(0, len(at), step):
                own = at[low : low + step]
                where = begin[own][:, None] + np.arange(n)
                cell = ends[own][:, None] + np.arange(n * n)
                out[cell] = coherent(z[where], d[where]).reshape(len(own), n * n)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))

    return run


def _shares(retiring: bool, fields: Column) -> Column:
    """The shares of every position for the entrants of an array (entity, z, d), entrant by entrant."""
    from pyspark.sql.functions import arrow_udf

    compute = arrow_udf(_kernel(retiring), "array<double>")
    # Without a score an entrant comes last; without a rate it never retires.
    score = F.transform(fields, lambda e: F.coalesce(F.nanvl(e["z"], F.lit(-1e9)), F.lit(-1e9)))
    return compute(score, F.transform(fields, lambda e: F.coalesce(e["d"], F.lit(0.0))))


def exact_positions(df: DataFrame, score: str, temperature, halves: dict[str, bool], dnf_prob: str | None = None, event: list[str] = EVENT) -> DataFrame:
    """A row per (event, entity, pos) with ``field`` and a column for each half: the probability of that position.

    ``halves`` names the columns and says of each whether entrants retire with ``dnf_prob``. Entrants without a score come
    last; a field of more than FIELD_LIMIT entrants is refused.
    """
    from .listwise import _fields

    rows = _fields(df, score, temperature, dnf_prob, event)
    rows = rows.withColumns({f"_{name}": _shares(retiring, F.col("_f")) for name, retiring in halves.items()})
    one = rows.select(*event, F.col("_field").alias("field"), *(f"_{h}" for h in halves), F.posexplode("_f").alias("_i", "_e"))
    n = F.col("field").cast("int")
    cell = F.col("_i") * n + F.col("pos") - 1
    return one.withColumn("pos", F.explode(F.sequence(F.lit(1), n))).select(
        *event, F.col("_e.entity").alias("entity"), "field", "pos", *(F.get(f"_{h}", cell).alias(h) for h in halves)
    )
