import json
import os

import pytest
from pyspark.sql import functions as F

from rankfield.functions.scalars import fold, is_finished, lap_time_ms, utc
from rankfield.sources import landing as op
from rankfield.streaming.landing import land


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("x")).first().x


@pytest.mark.parametrize("text, ms", [("1:23.456", 83456), ("23.4", 23400), ("1:02.34567", 62345), ("", None), (None, None), ("DNF", None), ("1:23", None)])
def test_lap_times(spark, text, ms):
    assert one(spark, text, lap_time_ms) == ms


@pytest.mark.parametrize("status, done", [("Finished", True), ("+1 Lap", True), (" lapped ", True), ("Engine", False), ("", False), (None, False)])
def test_status(spark, status, done):
    assert one(spark, status, is_finished) is done


def test_fold_and_utc(spark):
    assert one(spark, "  Pérez ", fold) == "perez" and one(spark, "Hülkenberg", fold) == "hulkenberg"
    assert str(one(spark, "2024-05-01T12:30:00+02:00", utc)) == "2024-05-01 10:30:00" and one(spark, "soon", utc) is None


def race(rnd, points="25"):
    return {
        "season": "2024", "round": str(rnd), "raceName": "R", "date": "2024-05-01", "time": "14:00:00Z",
        "Results": [{"Driver": {"driverId": "a"}, "Constructor": {"constructorId": "t"}, "position": "1", "positionText": "1", "points": points, "status": "Finished"}],
    }


def test_unreadable_documents_are_logged(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(race(1), indent=1))
    (tmp_path / "b.json").write_text('{"season": "2024", "round": ')
    docs = op.read_documents(spark, str(tmp_path), op.RACE_DOC)
    assert [(r.round, r.points, r.finished) for r in op.parse_results(docs).collect()] == [(1, 25.0, True)]
    failed = op.unreadable(spark, str(tmp_path), op.RACE_DOC, "results").collect()
    assert [(r.source, r.scope.endswith("b.json"), r.status) for r in failed] == [("results", True, "failed")]


def test_stream_lands_once_and_replaces(spark, tmp_path):
    src, table, progress, log = (str(tmp_path / n) for n in ("in", "table", "progress", "log"))
    (tmp_path / "in").mkdir()

    def run():
        land(spark, src, op.RACE_DOC, op.parse_results, table, ["season", "round", "driver_id"], ["season"], progress, log)
        return sorted((r["round"], r["points"]) for r in spark.read.parquet(table).collect())

    (tmp_path / "in" / "1.json").write_text(json.dumps(race(1)))
    assert run() == [(1, 25.0)]
    (tmp_path / "in" / "2.json").write_text(json.dumps(race(2)))
    (tmp_path / "in" / "3.json").write_text(json.dumps(race(1, "18")))
    assert run() == [(1, 18.0), (2, 25.0)]
    assert run() == [(1, 18.0), (2, 25.0)]
    # Two documents of one key and a broken one in a single batch: the last file wins, the broken one is logged.
    for i, (name, text) in enumerate((("6.json", json.dumps(race(3, "10"))), ("5.json", json.dumps(race(3, "12"))), ("7.json", "{"))):
        (tmp_path / "in" / name).write_text(text)
        os.utime(tmp_path / "in" / name, (2_000_000_000 + i, 2_000_000_000 + i))
    assert run() == [(1, 18.0), (2, 25.0), (3, 12.0)]
    assert [(r.status, r.scope.endswith("7.json")) for r in spark.read.parquet(log).collect()] == [("failed", True)]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    once = op.upsert(base, new, ["k"])
    twice = op.upsert(once, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "x"), (3, "y")]


def test_bad_penalty_is_an_error(spark):
    d = spark.createDataFrame([(1, 1, "a", "back"), (1, 1, "b", "5"), (1, 2, "c", "-3")], "season int, round int, entity string, penalty string")
    assert {r.entity: r.places for r in op.penalties_for(d, F.lit(1), F.lit(1)).collect()} == {"a": None, "b": 5}
    with pytest.raises(Exception, match="penalty must be"):
        op.penalties_for(d, F.lit(1), F.lit(2)).collect()


def test_ingest_log_keeps_the_last_status(spark):
    log = spark.createDataFrame([("r", "1", "failed", ""), ("r", "2", "empty", "")], "source string, scope string, status string, detail string")
    log = op.log_ingest(log, spark.createDataFrame([("r", "1", "ok", "")], log.schema))
    wanted = spark.createDataFrame([("r", "1"), ("r", "2"), ("r", "3")], "source string, scope string")
    assert {r.scope: (r.status, r.done) for r in op.ingest_status(log, wanted).collect()} == {"1": ("ok", True), "2": ("empty", True), "3": ("never", False)}
