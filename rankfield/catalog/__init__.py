"""Registered queries: each name has a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from importlib import import_module
from importlib.util import find_spec

from .registry import ORACLES, QUERIES

MODULES = (
    "windows_q", "ladders_q", "features_q", "checks_q", "landing_q", "resolve_q", "laps_q", "listwise_q",
    "metrics_q", "evaluate_q", "variants_q", "ranker_q", "projection_q", "replay_q", "audit_q", "live_q",
)


def load():
    for m in MODULES:
        if find_spec(f"{__name__}.{m}"):
            import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
