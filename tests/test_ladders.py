import pytest
from pyspark.sql import functions as F

from rankfield.operators import ladders as op

KEY = "series int, season int, round int"
FIELD = [f"d{i:02d}" for i in range(20)]


def cands(spark, rows):
    return spark.createDataFrame([(0, 1, 1, "s", *r) for r in rows], f"{KEY}, source string, entity string, position int")


def entrants(spark):
    return spark.createDataFrame([(0, 1, 1, d) for d in FIELD], f"{KEY}, entity string")


@pytest.mark.parametrize(
    "rows, problem",
    [
        ([(d, i + 1) for i, d in enumerate(FIELD)], None),
        ([(d, i + 1) for i, d in enumerate(FIELD)] + [("d00", 30)], "entity twice"),
        ([(d, i + 12) for i, d in enumerate(FIELD)], "position out of range"),
        ([(d, max(i, 1)) for i, d in enumerate(FIELD)], "slot twice"),
        ([(d, 0) for d in FIELD], None),
        ([(d, i + 1) for i, d in enumerate(FIELD[:-1])] + [("zz", 20)], "stranger"),
        ([(d, i + 1) for i, d in enumerate(FIELD[:17])], "coverage"),
    ],
)
def test_each_grid_defect(spark, rows, problem):
    got = op.check_grid(cands(spark, rows), entrants(spark)).first().problems
    assert got == ([problem] if problem else [])


@pytest.mark.parametrize(
    "rows, problem",
    [
        ([(d, f"t{i // 2}") for i, d in enumerate(FIELD)], None),
        ([(d, f"t{i // 3}") for i, d in enumerate(FIELD)], "team too large"),
        ([(d, None if i == 3 else f"t{i // 2}") for i, d in enumerate(FIELD)], "no team"),
        ([(d, f"t{i // 2}") for i, d in enumerate(FIELD[:10])], "field size"),
        ([(d, f"t{i // 2}") for i, d in enumerate(FIELD)] + [("d00", "t0")], "entity twice"),
    ],
)
def test_each_entry_defect(spark, rows, problem):
    d = spark.createDataFrame([(0, 1, 1, "s", *r) for r in rows], f"{KEY}, source string, entity string, team string")
    assert op.check_entries(d).first().problems == ([problem] if problem else [])


def grid(spark, rows, name):
    return spark.createDataFrame([(0, 1, 1, *r) for r in rows], f"{KEY}, entity string, {name} int")


def test_ladder_falls_through_to_a_clean_source(spark):
    frame = grid(spark, [(d, None) for d in FIELD], "grid")
    quali = grid(spark, [(d, i + 1) for i, d in enumerate(FIELD)] + [("zz", 21)], "quali_position")
    stale = grid(spark, [("zz", 1)] + [(d, i + 2) for i, d in enumerate(FIELD[:-1])], "position")
    got = op.resolve_grid(frame, quali, stale).collect()
    assert {r.grid_source for r in got} == {"qualifying"} and sorted(r.grid for r in got) == list(range(1, 21))


def test_pit_lane_starts_from_the_back(spark):
    frame = grid(spark, [(d, i) for i, d in enumerate(FIELD)], "grid")
    none = grid(spark, [], "quali_position")
    got = {r.entity: r.grid for r in op.resolve_grid(frame, none, grid(spark, [], "position")).collect()}
    assert got["d00"] == 20 and got["d01"] == 1


def test_next_event_error_when_nothing_is_left(spark):
    d = spark.createDataFrame([(0, 1, 1, True)], f"{KEY}, ran boolean").withColumn("race_start", F.lit(None).cast("timestamp_ntz"))
    now = F.lit("2000-01-01").cast("timestamp_ntz")
    assert op.next_event(d, now, ["series"]).count() == 0
    with pytest.raises(LookupError, match="no event left"):
        op.next_event(d, now, ["series"], require=True)


def test_grid_holes_are_filled_in_field_order(spark):
    d = spark.createDataFrame([(0, "a", 2), (0, "b", None), (0, "c", 1), (0, "d", None)], "series int, entity string, grid int")
    assert {r.entity: r.grid for r in op.starting_grid(d, ["series"]).collect()} == {"a": 2, "b": 3, "c": 1, "d": 4}
