"""A linear pairwise ranker on grouped rows, fitted without forming pairs.

Least squares over all within-event pairs, (label_i - label_j) ~ w (x_i - x_j), equals
a weighted regression on event-centred rows: summed over the pairs of a set S it is
|S| times the squared deviations from S's mean. For pairs that must include one of the
top k, the pairs split into those inside the top set A and those across to the rest B;
across, the sum is |B| dev(A) + |A| dev(B) + |A||B| (mean_A - mean_B)^2. Either way the
fit is one pass over rows, so a field of any size costs its rows, not their square.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import RECENCY_FLOOR

EVENT = ["series", "race_seq"]


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing feature columns: {missing}")


def prepare(df: DataFrame, label: str, event: list[str] = EVENT) -> DataFrame:
    """Rows with a label, with a number per event (groups stay whole: one key per event)."""
    return df.where(F.col(label).isNotNull()).withColumn("group", F.concat_ws(":", *[F.col(c).cast("string") for c in event]))


def recency_weights(df: DataFrame, weight: float, latest: Column | int, out: str = "weight") -> DataFrame:
    """One weight per event: decays per season back from the latest, floored."""
    latest = F.lit(latest) if isinstance(latest, int) else latest
    age = latest - F.col("season")
    return df.withColumn(out, F.greatest(F.pow(F.lit(float(weight)), -age / 2.0), F.lit(RECENCY_FLOOR)))


def filled(df: DataFrame, features: Sequence[str], event: list[str] = EVENT) -> DataFrame:
    """Missing inputs take the event's mean, so they contribute nothing; an all-missing event takes 0."""
    w = W.partitionBy(*event)
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.avg(f).over(w), F.lit(0.0)) for f in features})


def regression_rows(
    df: DataFrame, features: Sequence[str], label: str, weight: str, event: list[str] = EVENT, top: int | None = None
) -> DataFrame:
    """Weighted rows whose least squares equals that of the event's pairs; each event weighs the same."""
    cols = [label, *features]
    d = filled(prepare(df, label, event), features, event).withColumn(label, F.col(label).cast("double"))
    w = W.partitionBy(*event)
    if top is None:
        n = F.count(F.lit(1)).over(w)
        d = d.withColumn("_n", n).where("_n > 1")
        pairs = F.col("_n") * (F.col("_n") - 1) / 2.0
        centred = [(F.col(c) - F.avg(c).over(w)).alias(c) for c in cols]
        return d.select(*event, *centred, (F.col(weight) * F.col("_n") / pairs).alias("_w"))
    turn = F.row_number().over(w.orderBy(F.desc(label), "entity"))
    d = d.withColumn("_a", turn <= top)
    d = d.withColumns({"_na": F.count(F.when(F.col("_a"), 1)).over(w), "_nb": F.count(F.when(~F.col("_a"), 1)).over(w)})
    na, nb = F.col("_na"), F.col("_nb")
    pairs = na * (na - 1) / 2.0 + na * nb
    d = d.withColumn("_pairs", pairs).where("_pairs > 0")
    side = W.partitionBy(*event, "_a")
    inner = d.select(
        *event,
        *[(F.col(c) - F.avg(c).over(side)).alias(c) for c in cols],
        (F.col(weight) * F.when(F.col("_a"), na + nb).otherwise(na) / F.col("_pairs")).alias("_w"),
    )
    def gap(c: str) -> Column:
        return F.avg(F.when(F.col("_a"), F.col(c))) - F.avg(F.when(~F.col("_a"), F.col(c)))

    across = d.groupBy(*event).agg(
        *[gap(c).alias(c) for c in cols], F.max(F.col(weight) * na * nb / F.col("_pairs")).alias("_w")
    ).where("_w > 0")
    return inner.unionByName(across)


def gain_rows(df: DataFrame, features: Sequence[str], label: str, weight: str, event: list[str] = EVENT, gain: str = "exponential") -> DataFrame:
    """Weighted rows whose least squares equals that of an event's pairs, each pair weighing what swapping it costs.

    A pair of turns i < j weighs (g_i - g_j) (d_i - d_j), with the gain g of the label (``exponential``: 2^label - 1,
    ``linear``: the label) and the discount d = 1 / log2(1 + turn). That is a sum of products of functions of one
    row, so over an event centred at its mean the pairs' squares are those of its rows, each weighing the sum of its
    pairs, and of two rows of sums: with G and D the sums of g z and d z, G D' + D G' is half the square of
    G + D less half that of G - D. No pair is formed; the weights of the second are negative."""
    cols = [label, *features]
    d = filled(prepare(df, label, event), features, event).withColumn(label, F.col(label).cast("double"))
    w = W.partitionBy(*event)
    worth = F.col(label) if gain == "linear" else F.pow(F.lit(2.0), F.col(label)) - 1
    turn = F.row_number().over(w.orderBy(F.desc(label), "entity"))
    d = d.withColumns({"_g": worth, "_d": 1 / F.log2(1.0 + turn)}).withColumns({c: F.col(c) - F.avg(c).over(w) for c in cols})
    n, g, k, both = F.count(F.lit(1)).over(w), F.sum("_g").over(w), F.sum("_d").over(w), F.sum(F.col("_g") * F.col("_d")).over(w)
    d = d.withColumns({"_total": n * both - g * k, "_c": n * F.col("_g") * F.col("_d") + both - k * F.col("_g") - g * F.col("_d")}).where("_total > 0")
    inner = d.select(*event, *cols, (F.col(weight) * F.col("_c") / F.col("_total")).alias("_w"))
    sums = d.groupBy(*event).agg(
        *[F.sum(F.col("_g") * F.col(c)).alias(f"_g_{c}") for c in cols], *[F.sum(F.col("_d") * F.col(c)).alias(f"_d_{c}") for c in cols],
        F.max(F.col(weight) / F.col("_total")).alias("_s"),
    )
    sides = F.array(*[
        F.struct(*[(F.col(f"_g_{c}") + sign * F.col(f"_d_{c}")).alias(c) for c in cols], (sign * F.col("_s") / 2).alias("_w")) for sign in (1.0, -1.0)
    ])
    return inner.unionByName(sums.select(*event, F.inline(sides)))


@dataclass(frozen=True)
class Ranker:
    """Coefficient vectors of one or more members; scores average their standardised outputs."""

    features: tuple[str, ...]
    members: tuple[tuple[float, ...], ...]

    def _raw(self, member: int) -> Column:
        total = F.lit(0.0)
        for f, c in zip(self.features, self.members[member]):
            total = total + F.lit(c) * F.col(f)
        return total

    def score(self, df: DataFrame, out: str = "score", event: list[str] = EVENT) -> DataFrame:
        """Standardised within the event; a constant field is only centred."""
        require(df, self.features)
        w = W.partitionBy(*event)
        names = [f"_s{i}" for i in range(len(self.members))]
        originals = {f: F.col(f) for f in self.features}
        d = filled(df.withColumns({f"_keep_{f}": c for f, c in originals.items()}), self.features, event)
        d = d.withColumns({n: self._raw(i) for i, n in enumerate(names)})
        total = F.lit(0.0)
        for n in names:
            sd = F.stddev_pop(n).over(w)
            total = total + (F.col(n) - F.avg(n).over(w)) / F.when(sd > 1e-9, sd).otherwise(1.0)
        d = d.withColumn(out, total / len(names)).drop(*self.features, *names)
        return d.withColumnsRenamed({f"_keep_{f}": f for f in self.features})

    def contributions(self, df: DataFrame, event: list[str] = EVENT, keep: Sequence[str] = ()) -> DataFrame:
        """Additive share of each feature in the score, long form; an entrant's rows sum to its score."""
        require(df, self.features)
        w = W.partitionBy(*event)
        d = filled(df.select(*event, "entity", *keep, *[F.col(f).alias(f"_x_{f}") for f in self.features]), [f"_x_{f}" for f in self.features], event)
        x = [f"_x_{f}" for f in self.features]
        d = d.withColumns({c: F.col(c) - F.avg(c).over(w) for c in x})
        scale = {}
        for i, m in enumerate(self.members):
            raw = sum((F.lit(c) * F.col(n) for n, c in zip(x, m)), F.lit(0.0))
            d = d.withColumn(f"_r{i}", raw)
            sd = F.stddev_pop(f"_r{i}").over(w)
            scale[f"_d{i}"] = F.when(sd > 1e-9, sd).otherwise(1.0)
        d = d.withColumns(scale)
        parts = []
        for j, (f, n) in enumerate(zip(self.features, x)):
            share = sum((F.lit(m[j]) * F.col(n) / F.col(f"_d{i}") for i, m in enumerate(self.members)), F.lit(0.0))
            parts.append(F.struct(F.lit(f).alias("feature"), (share / len(self.members)).alias("contribution")))
        return d.select(*event, "entity", *keep, F.inline(F.array(*parts)))


def train(
    df: DataFrame, features: Sequence[str], label: str, weight: str = "weight", event: list[str] = EVENT,
    top: int | None = None, ridge: float = 0.0,
) -> Ranker:
    """Fit one member: a distributed weighted least squares; only the coefficients reach the driver."""
    require(df, [label, *features])
    rows = regression_rows(df, features, label, weight, event, top)
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    lr = LinearRegression(
        featuresCol="_x", labelCol=label, weightCol="_w", fitIntercept=False, standardization=False, regParam=ridge,
        solver="normal",
    )
    model = lr.fit(data)
    return Ranker(tuple(features), (tuple(float(c) for c in model.coefficients),))


def ensemble(rankers: Sequence[Ranker]) -> Ranker:
    return Ranker(rankers[0].features, tuple(m for r in rankers for m in r.members))


def grouped_contributions(
    long: DataFrame, groups: dict[str, str], keys: Sequence[str], gap: Column | None = None
) -> DataFrame:
    """Sum contributions within feature groups. Where ``gap`` holds (a grid pulled away from
    qualifying), the qualifying position counts as one-lap pace, not as the grid."""
    pairs = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    group = F.coalesce(F.try_element_at(pairs, F.col("feature")), F.col("feature"))
    if gap is not None:
        group = F.when(gap & (F.col("feature") == "quali_position"), "one_lap_pace").otherwise(group)
    return long.withColumn("group", group).groupBy(*keys, "group").agg(F.sum("contribution").alias("contribution"))


def explain(grouped: DataFrame, labels: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """One sentence per entrant: the largest group for it and the largest against it."""
    name = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    label = F.coalesce(F.try_element_at(name, F.col("group")), F.col("group"))
    c = F.round("contribution", 9)
    d = grouped.withColumns({"_label": label, "_c": c})
    up = F.max(F.when(F.col("_c") > 0, F.struct(F.col("_c"), F.col("_label").alias("l")))).alias("_up")
    down = F.min(F.when(F.col("_c") < 0, F.struct(F.col("_c"), F.col("_label").alias("l")))).alias("_down")
    g = d.groupBy(*keys).agg(up, down)
    text = F.concat_ws(
        ", ",
        F.when(F.col("_up").isNotNull(), F.concat(F.lit("helped by "), F.col("_up.l"))),
        F.when(F.col("_down").isNotNull(), F.concat(F.lit("held back by "), F.col("_down.l"))),
    )
    sentence = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1000))
    return g.select(*keys, sentence.alias("why"))
