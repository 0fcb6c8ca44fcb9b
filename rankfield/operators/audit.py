"""Audits of the features and the model, and the track record of logged forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import BIAS_FAIL, BIAS_WARN

EVENT = ["series", "season", "round"]
PASS, WARN, FAIL = "PASS", "WARN", "FAIL"


# -- black-box tests of a feature build ---------------------------------------------
def tamper(results: DataFrame, chosen: Column, columns: Sequence[str] = ("position", "points", "dnf")) -> DataFrame:
    """Reverse the finishing order of the chosen events: every outcome column is mirrored."""
    w = W.partitionBy(*EVENT)
    place = F.row_number().over(w.orderBy("position", "entity"))
    d = results.withColumns({"_place": place, "_n": F.count(F.lit(1)).over(w)})
    hit = d.where(chosen)
    other = hit.select(*EVENT, F.col("_place").alias("_m"), *[F.col(c).alias(f"_{c}") for c in columns])
    swapped = hit.withColumn("_m", F.col("_n") + 1 - F.col("_place")).join(other, [*EVENT, "_m"])
    swapped = swapped.withColumns({c: F.col(f"_{c}") for c in columns})
    return d.where(~chosen).select(*results.columns).unionByName(swapped.select(*results.columns))


def compare_builds(
    a: DataFrame, b: DataFrame, features: Sequence[str], cutoff: int, keys: Sequence[str] = (*EVENT, "entity"), tol: float = 1e-9
) -> DataFrame:
    """Rows changed per feature, up to the cut-off event and after it. Null to number counts as a change."""
    right = b.select(*keys, *[F.col(f).cast("double").alias(f"_b_{f}") for f in features])
    d = a.select(*keys, "race_seq", *[F.col(f).cast("double").alias(f) for f in features]).join(right, list(keys))

    def moved(f: str) -> Column:
        x, y = F.col(f), F.col(f"_b_{f}")
        return ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tol, F.lit(False)))

    early = F.col("race_seq") <= cutoff
    one = d.agg(
        *[F.count(F.when(moved(f) & early, 1)).alias(f"e_{f}") for f in features],
        *[F.count(F.when(moved(f) & ~early, 1)).alias(f"l_{f}") for f in features],
    )
    rows = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"e_{f}").alias("before"), F.col(f"l_{f}").alias("after")) for f in features]
    )
    return one.select(F.inline(rows))


def leakage_status(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """FAIL where a feature moved before the cut."""
    status = F.when(F.max("before") > 0, FAIL).otherwise(PASS).alias("status")
    return changes.groupBy(*by).agg(status, F.count_distinct("feature").alias("features"))


# -- inputs and contributions ------------------------------------------------------------
def input_coverage(df: DataFrame, classes: dict[str, Sequence[str]], optional: Sequence[str] = ("Practice",)) -> DataFrame:
    """Mean share of values per input class; a required class without any fails."""
    names = sorted({f for fs in classes.values() for f in fs})
    one = df.agg(*[(F.count(n) / F.count(F.lit(1)) * 100).alias(n) for n in names])
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("input"), F.lit(len(fs)).alias("features"),
                (sum((F.col(f) for f in fs), F.lit(0.0)) / len(fs)).alias("coverage_pct"),
            )
            for label, fs in classes.items()
        ]
    )
    out = one.select(F.inline(rows))
    dead = F.col("coverage_pct") < 1.0
    status = F.when(dead & F.col("input").isin(*optional), WARN).when(dead, FAIL).otherwise(PASS)
    return out.withColumn("status", status)


def contribution_share(long: DataFrame, classes: dict[str, str], event: Sequence[str] = ("series", "race_seq")) -> DataFrame:
    """Mean share of absolute contributions per input class over events, in per cent."""
    pairs = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    d = long.withColumns(
        {"input": F.coalesce(F.try_element_at(pairs, F.col("feature")), F.lit("Other")), "_a": F.abs("contribution")}
    )
    per = d.groupBy(*event, "input").agg(F.sum("_a").alias("_a"))
    total = F.sum("_a").over(W.partitionBy(*event))
    share = per.withColumn("_s", F.when(total > 0, F.col("_a") / total).otherwise(0.0))
    return share.groupBy("input").agg((F.avg("_s") * 100).alias("share_pct"))


def bias_audit(bias: DataFrame, most: int = 4, scope: Sequence[str] = ("series",)) -> DataFrame:
    """Fail when a most-raced entrant is mis-rated, warn when anyone is far off."""
    turn = F.row_number().over(W.partitionBy(*scope).orderBy(F.desc("events"), "entity"))
    d = bias.withColumn("_t", turn)
    g = d.groupBy(*scope).agg(
        F.max(F.abs("entity_bias")).alias("worst"), F.max(F.when(F.col("_t") <= most, F.abs("entity_bias"))).alias("regulars")
    )
    status = F.when(F.col("regulars") > BIAS_WARN, FAIL).when(F.col("worst") > BIAS_FAIL, WARN).otherwise(PASS)
    return g.withColumn("status", status)


def accuracy_audit(comparison: DataFrame, reference: str, key_metric: str = "win_logloss") -> DataFrame:
    """Fail if the reference is clearly better on the key metric, warn on any other."""
    lost = F.col("better") == reference
    g = comparison.groupBy("method").agg(
        F.bool_or(lost & (F.col("metric") == key_metric)).alias("_key"), F.sum(lost.cast("int")).alias("worse"),
        F.sum((F.col("better") == F.col("method")).cast("int")).alias("better"),
    )
    status = F.when(F.col("_key"), FAIL).when(F.col("worse") > 0, WARN).otherwise(PASS)
    return g.select("method", "better", "worse", status.alias("status"))


def calibration_audit(reliability: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Buckets outside their own interval; warn above max(2, a quarter)."""
    off = ~F.col("stated").between(F.col("ci_low"), F.col("ci_high"))
    g = reliability.groupBy(*by).agg(F.sum(off.cast("int")).alias("off"), F.count(F.lit(1)).alias("buckets"))
    limit = F.greatest(F.lit(2), F.floor(F.col("buckets") / 4))
    return g.withColumn("status", F.when(F.col("off") > limit, WARN).otherwise(PASS))


def plausibility(table: DataFrame, incoherent: DataFrame, event: Sequence[str] = ("series", "race_seq")) -> DataFrame:
    """Failed coherence predicates per event of a published table."""
    p = {c: F.col(c) for c in ("p_win", "p_podium", "p_top5", "p_top10")}
    nested = (p["p_win"] <= p["p_podium"] + 1e-9) & (p["p_podium"] <= p["p_top5"] + 1e-9) & (p["p_top5"] <= p["p_top10"] + 1e-9)
    g = table.groupBy(*event).agg(
        F.sum("p_win").alias("_w"), F.sum("p_podium").alias("_p"), F.bool_and(nested).alias("_nested"), F.min("p_win").alias("_lo"),
        F.max("p_win").alias("_hi"), (F.max("exp_position") - F.min("exp_position")).alias("_span"),
    )
    g = g.join(incoherent.select(*event, (F.size("problems") > 0).alias("_bad")), list(event))
    failed = F.array_compact(
        F.array(
            F.when(F.col("_bad"), F.lit("distribution")),
            F.when(F.abs(F.col("_w") - 1) >= 1e-6, F.lit("win sum")),
            F.when(F.abs(F.col("_p") - 3) >= 1e-6, F.lit("podium sum")),
            F.when(~F.col("_nested"), F.lit("nesting")),
            F.when(F.col("_lo") <= 0, F.lit("zero chance")),
            F.when(F.col("_hi") >= 0.90, F.lit("false certainty")),
            F.when(F.col("_hi") <= 0.08, F.lit("coin toss")),
            F.when(F.col("_span") <= 5.0, F.lit("narrow span")),
        )
    )
    return g.select(*event, failed.alias("failed")).withColumn("status", F.when(F.size("failed") > 0, FAIL).otherwise(PASS))


# -- the log of forecasts ---------------------------------------------------------------
def stage_columns(log: DataFrame) -> DataFrame:
    """Stage of each logged forecast: post_quali once the grid is known, else by practice."""
    stage = F.coalesce(F.col("stage"), F.when(F.col("grid_known"), "post_quali").otherwise("pre_quali"))
    practice = F.coalesce("practice_data", F.lit(False))
    weekend = F.when((stage == "pre_quali") & ~practice, "pre_practice").otherwise(stage)
    note = F.when(
        stage == "post_quali",
        F.when(F.col("grid_source") == "qualifying", "qualifying order, penalties pending")
        .when(F.col("grid_source").isNotNull(), "official grid").otherwise(""),
    ).otherwise(F.when(practice, "with this weekend's practice").otherwise("before practice data"))
    step = F.when(stage == "post_quali", "post_quali").otherwise("pre_quali")
    return log.withColumns({"weekend_stage": weekend, "step": step, "note": note})


def append_forecasts(
    log: DataFrame, new: DataFrame, window_days: float = 5.0, practice_wait_hours: float = 1.0
) -> DataFrame:
    """Which new forecasts get written: first write wins per (event, stage).

    A stage reopens for a penalty the latest logged forecast did not have, or when the
    official grid replaces the qualifying order. Without a grid, a forecast too far out
    waits, and one made before the last practice session waits until qualifying is near."""
    key = [*EVENT, "stage"]
    latest = log.groupBy(*key).agg(
        F.max_by(F.struct("grid_source", "penalties"), "generated_at").alias("_l")
    )
    d = new.join(latest, key, "left")
    fresh = F.size(F.array_except(F.coalesce("penalties", F.array().cast("array<bigint>")), F.coalesce(F.col("_l.penalties"), F.array().cast("array<bigint>")))) > 0
    official = (F.col("_l.grid_source") == "qualifying") & ~F.col("grid_source").isin("qualifying", "projected")
    opened = F.col("_l").isNull() | fresh | F.coalesce(official, F.lit(False))
    seconds = F.unix_timestamp(F.col("race_start").cast("timestamp")) - F.unix_timestamp(F.col("generated_at").cast("timestamp"))
    early = ~F.col("grid_known") & (seconds > window_days * 86400)
    to_quali = F.unix_timestamp(F.col("quali_start").cast("timestamp")) - F.unix_timestamp(F.col("generated_at").cast("timestamp"))
    waiting = (F.col("stage") == "pre_quali") & ~F.coalesce("practice_complete", F.lit(True)) & (to_quali > practice_wait_hours * 3600)
    return d.where(opened & ~F.coalesce(early, F.lit(False)) & ~F.coalesce(waiting, F.lit(False))).drop("_l")


def before_start(log: DataFrame) -> DataFrame:
    """Forecasts made after the start are not forecasts."""
    return log.where(F.col("race_start").isNull() | (F.col("generated_at") <= F.col("race_start")))


def final_forecasts(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The last forecast logged before each event started."""
    last = F.max_by(F.struct(*columns), "generated_at").alias("_d")
    return before_start(log).groupBy(*EVENT).agg(last).select(*EVENT, "_d.*")


def forecast_history(log: DataFrame, winners: DataFrame) -> DataFrame:
    """Per run event the ordered steps; consecutive runs with the same stage, note and pick merge.

    log: (event, generated_at, race_start, step, note, pick, p_pick); winners: (event, winner)."""
    d = before_start(log).join(winners, EVENT)
    w = W.partitionBy(*EVENT).orderBy("generated_at")
    same = F.struct("step", "note", "pick").eqNullSafe(F.lag(F.struct("step", "note", "pick")).over(w))
    d = d.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_g", F.sum("_new").over(w))
    return d.groupBy(*EVENT, "_g", "step", "note", "pick", "winner").agg(
        F.count(F.lit(1)).alias("runs"), F.min("p_pick").alias("p_low"), F.max("p_pick").alias("p_high"),
        F.max_by("p_pick", "generated_at").alias("p_pick"), F.max("generated_at").alias("made"),
    ).withColumn("hit", F.col("pick") == F.col("winner")).withColumnRenamed("_g", "turn")


def coherent(docs: DataFrame, keys: Sequence[str], tol: float = 0.02) -> DataFrame:
    """Whether published win chances are the first column of the logged matrix.

    docs: (keys, matrix_ids, matrix, field: array of (entity, p_win)). Without a full matrix: true."""
    whole = (F.size("matrix_ids") == F.size("matrix")) & (F.size("matrix") > 0)
    rows = docs.where(whole).select(*keys, F.explode(F.arrays_zip("matrix_ids", "matrix")).alias("r")).select(
        *keys, F.col("r.matrix_ids").alias("entity"), F.try_element_at("r.matrix", F.lit(1)).alias("_first")
    )
    stated = docs.select(*keys, F.inline("field"))
    ok = F.abs(F.col("_first") - F.coalesce("p_win", F.lit(0.0))) <= tol
    checked = rows.join(stated, [*keys, "entity"]).groupBy(*keys).agg(F.bool_and(ok).alias("_ok"))
    return docs.select(*keys).join(checked, list(keys), "left").select(*keys, F.coalesce("_ok", F.lit(True)).alias("coherent"))


def board(table: DataFrame, keys: Sequence[str], by: str = "p_win", top: int = 10) -> DataFrame:
    """The first entrants by win chance (largest first) or expected finish (smallest first)."""
    order = F.col(by).asc() if by == "exp_position" else F.col(by).desc()
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(order, "entity"))
    return table.withColumn("row", turn).where(F.col("row") <= top)
