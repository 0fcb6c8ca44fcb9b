"""The flagship: walk-forward log loss and NDCG of recent form against the grid, paired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import metrics as mt
from ..session import cut
from ..sources.contest import Tables
from . import evaluate as ev


def flagship(spark: SparkSession, folder: str, replicates: int = 5000) -> DataFrame:
    from ..catalog.listwise_q import baselines

    t = Tables(spark, folder)
    scores = cut(baselines(t, ("grid", "recent_form")))
    targets = ev.window_targets(ev.completed_events(scores, 0), 1998, None)
    rows, _ = ev.walk_forward(scores.drop("season", "round"), targets)
    rows = cut(rows)
    return mt.paired_comparison(
        rows, ["series", "race_seq"], ["ndcg5", "win_logloss", "podium_brier"], "grid", replicates=replicates
    ).select(
        "method", "metric", "n_events", *[F.round(c, 6).alias(c) for c in ("value", "reference_value", "difference", "ci_low", "ci_high")], "better",
    )
