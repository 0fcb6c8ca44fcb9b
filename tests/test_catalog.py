"""A cross-section of registered queries against their oracles on the smallest tables."""

import duckdb
import pytest

from rankfield.catalog import load
from rankfield.check import TABLES, canonical

QUERIES, ORACLES = load()
SAMPLE = (
    "a3_parse_results", "a14_work_list", "b3_map_driver", "c2_green_laps", "d3_resolve_grid", "e2_roll_over_valid", "e17_form_set",
    "g6_rolling_temperature", "h2_apply", "i4_kendall", "i13_bootstrap_mean", "k12_clinch_round", "k13_allocate_odds", "l7_positions_in_range", "m11_forecast_history",
)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_oracle(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    got, want = canonical(QUERIES[name](spark, small).toPandas()), canonical(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and got.equals(want)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
