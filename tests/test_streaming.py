"""Streams of readings from files, with batches that arrive late and out of order."""

from __future__ import annotations

import json
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from slotwise.policy import ZONE
from slotwise.streaming import commits, readings


def put(folder, name: str, rows: list[tuple[str, str, int]]) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"facility": f, "at": at, "batch": at, "value": v}) for f, at, v in rows))


def run(query):
    query = query.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_latest_never_moves_back(spark, tmp_path):
    put(tmp_path / "in", "1.json", [("a", "2026-01-01T00:10:00Z", 5), ("b", "2026-01-01T00:00:00Z", 1)])
    out = readings.latest(readings.source(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("latest_seen").option("checkpointLocation", str(tmp_path / "c"))
    run(out)
    assert {(r.facility, r.success.value, r.state) for r in spark.table("latest_seen").collect()} == {("a", 5, "reporting"), ("b", 1, "reporting")}
    put(tmp_path / "in", "2.json", [("a", "2026-01-01T00:05:00Z", 9), ("b", "2026-01-01T00:20:00Z", 2)])
    seen = []
    again = readings.latest(readings.source(spark, str(tmp_path / "in"))).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c"))
    run(again)
    assert [(r.facility, r.success.value) for r in seen] == [("b", 2)]


def test_latest_keeps_attempts_and_survives_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def batch(name: str, rows: list[tuple]) -> dict:
        named = [dict(zip(("facility", "at", "batch", "value", "state", "error_code"), r, strict=True)) for r in rows]
        (folder / name).write_text("\n".join(json.dumps(r) for r in named))
        seen: list = []
        stream = readings.latest(readings.source(spark, str(folder), schema=readings.ATTEMPTED))
        run(stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")))
        return {r.facility: (r.success and r.success.value, r.attempt.state, r.attempt.error_code, r.state) for r in seen}

    at = lambda minute: f"2026-01-01T00:{minute:02}:00Z"
    assert batch("1.json", [("a", at(1), at(0), 5, "success", None), ("b", None, at(0), None, "failed", "request_failed")]) == {"a": (5, "success", None, "reporting"), "b": (None, "failed", "request_failed", "failed")}
    assert batch("2.json", [("a", None, at(15), None, "failed", "invalid_response")]) == {"a": (5, "failed", "invalid_response", "failed")}
    assert batch("3.json", [("a", at(0), at(0), 9, "success", None), ("b", at(16), at(15), 7, "success", None)]) == {"b": (7, "success", None, "reporting")}
    assert batch("4.json", [("a", at(31), at(30), 6, "success", None), ("a", None, at(30), None, "failed", "x"), ("a", at(31), at(30), 8, "success", None)]) == {"a": (6, "success", None, "reporting")}
    assert {(r.facility, r.value) for r in readings.latest_state(spark, str(tmp_path / "c")).collect()} == {("a", 6), ("b", 7)}
    assert {(r.facility, r.state) for r in readings.latest_state(spark, str(tmp_path / "c"), "attempt").collect()} == {("a", "success"), ("b", "success")}


def test_windows(spark, tmp_path):
    put(tmp_path / "in", "1.json", [("a", "2026-01-01T00:01:00Z", 5), ("a", "2026-01-01T00:14:00Z", 7), ("a", "2026-01-01T00:16:00Z", 1), ("a", "2026-01-01T00:50:00Z", 3)])
    stream = readings.source(spark, str(tmp_path / "in"))
    for name, make, mode in (("won", readings.slots, "complete"), ("halves", readings.hours, "complete"), ("runs", readings.sessions, "complete")):
        run(make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)))
    assert sorted(r.value for r in spark.table("won").collect()) == [1, 3, 7]
    assert [(r.median, r.n) for r in spark.table("halves").collect()] == [(4.0, 4)]
    assert sorted(r.n for r in spark.table("runs").collect()) == [1, 3]


def test_hours_of_deviations(spark, tmp_path):
    """Winners of slots against the usual of their local hour; no usual, no slot; one slot, no hour."""
    day = "2026-01-10T"
    rows = [("a", "12:01", 5), ("a", "12:14", 7), ("a", "12:16", 1), ("a", "12:50", 30), ("a", "13:05", 9), ("a", "13:40", 9), ("a", "14:00", 9), ("b", "12:00", 2), ("b", "12:20", 2)]
    put(tmp_path / "in", "1.json", [(f, f"{day}{at}:00Z", v) for f, at, v in rows])
    put(tmp_path / "in", "2.json", [("a", "2026-01-12T00:00:00Z", 1)])
    usual = spark.createDataFrame([("a", "2026-01-10", 6, 4.0), ("a", "2026-01-10", 7, None), ("a", "2026-01-10", 8, 1.0), ("b", "2026-01-09", 6, 1.0)], "facility string, local_date string, local_hour int, median double").withColumn("local_date", F.to_date("local_date"))
    stream = readings.source(spark, str(tmp_path / "in"), files_a_trigger=1)
    run(readings.deviation_hours(stream, usual, ZONE).writeStream.outputMode("append").format("memory").queryName("departures").option("checkpointLocation", str(tmp_path / "c")))
    assert [(r.facility, r.hour.hour, r.deviation, r.n) for r in spark.table("departures").collect()] == [("a", 12, 3.0, 3)]


def test_published_versions(spark, tmp_path):
    registry = spark.createDataFrame([("a",), ("z",)], "facility string")
    put(tmp_path / "in", "1.json", [("a", "2026-01-01T00:10:00Z", 5)])
    path = str(tmp_path / "out")
    run(readings.publish(readings.source(spark, str(tmp_path / "in")), registry, path, str(tmp_path / "c")))
    put(tmp_path / "in", "2.json", [("a", "2026-01-01T00:05:00Z", 9)])
    run(readings.publish(readings.source(spark, str(tmp_path / "in")), registry, path, str(tmp_path / "c")))
    found = {r.facility: (r.state, r.success and r.success.value) for r in commits.read(spark, path).collect()}
    assert found == {"a": ("reporting", 5), "z": ("missing", None)} and commits.versions(spark, path) == [1, 2]


def test_a_batch_is_published_once_whether_the_failure_came_before_or_after(spark, tmp_path):
    path, table = str(tmp_path / "t"), lambda n: spark.range(n)
    assert commits.read(spark, path) is None and commits.versions(spark, path) == []
    (tmp_path / "t" / "data" / "half" / "_temporary").mkdir(parents=True)
    (tmp_path / "t" / "drafts").mkdir()
    (tmp_path / "t" / "drafts" / "half").write_text("{")

    def dies():
        raise OSError("the driver died")

    with pytest.raises(OSError, match="died"):
        commits.update(spark, path, lambda old: table(1), source="s", batch=0, before_claim=dies)
    assert commits.read(spark, path) is None
    assert commits.update(spark, path, lambda old: table(1), source="s", batch=0) == 1
    assert commits.update(spark, path, lambda old: table(9), source="s", batch=0) is None
    assert commits.update(spark, path, lambda old: old.union(table(2)), source="s", batch=1) == 2
    assert commits.update(spark, path, lambda old: old, source="other", batch=0) == 3
    assert commits.read(spark, path).count() == 3 and commits.read(spark, path, 1).count() == 1
    assert commits.entry(spark, path, 3)["batches"] == {"s": 1, "other": 0}
    assert commits.tidy(spark, path) == 3 and commits.read(spark, path).count() == 3


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    writers, barrier = 5, threading.Barrier(5)

    def write(k: int) -> int:
        first = [True]

        def together():  # all have merged into the same version before any claims
            if first.pop() if first else False:
                barrier.wait(60)

        mine = spark.range(k, k + 1)
        return commits.update(spark, path, lambda old: mine if old is None else old.union(mine), tries=20, before_claim=together)

    with ThreadPoolExecutor(writers) as pool:
        numbers = list(pool.map(write, range(writers)))
    assert sorted(numbers) == commits.versions(spark, path) == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in commits.read(spark, path).collect()) == [0, 1, 2, 3, 4]


def test_one_of_many_claims_is_granted(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        for number in range(1, 6):
            granted = list(pool.map(lambda k: commits.claim(spark, str(tmp_path), number, {"data": f"d{k}", "batches": {}}), range(8)))
            assert sum(granted) == 1 and commits.entry(spark, str(tmp_path), number)["data"] == f"d{granted.index(True)}"


def test_late_readings_replace_earlier_ones_of_their_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda at, value: json.dumps({"facility": "a", "at": at, "batch": "2026-01-01T00:00:00Z", "value": value})
    (folder / "1.json").write_text("\n".join([row("2026-01-01T00:01:00Z", 1), row("2026-01-01T00:03:00Z", 3)]))
    start = lambda: run(readings.deduplicated(readings.source(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")))
    start()
    assert [(r.value, r.records) for r in spark.table("once").collect()] == [(3, 2)]
    (folder / "2.json").write_text("\n".join([row("2026-01-01T00:02:00Z", 2), row("2026-01-01T09:00:00Z", 9)]))
    start()
    assert [(r.value, r.records) for r in spark.table("once").collect()] == [(9, 4)]


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    registry = spark.createDataFrame([("a",), ("b",)], "facility string")
    reading = lambda f, minute, value: spark.createDataFrame([(f, f"2026-01-01 00:{minute}:00", value, 0)], "facility string, t string, value int, pos int").selectExpr("facility", "timestamp(t) at", "timestamp(t) batch", "value", "pos")
    tried = spark.createDataFrame([], "facility string, batch timestamp, state string, error_code string")
    path = str(tmp_path / "out")
    others = [reading("b", "07", 7)]
    between = lambda: others and readings.publish_once(others.pop(), tried, registry, path)
    assert readings.publish_once(reading("a", "05", 5), tried, registry, path, before_claim=between) == 2
    found = {r.facility: r.success.value for r in commits.read(spark, path, 2).collect()}
    assert found == {"a": 5, "b": 7}
    busy = lambda: readings.publish_once(reading("b", "08", 8), tried, registry, path)
    with pytest.raises(RuntimeError, match="faster"):
        readings.publish_once(reading("a", "09", 9), tried, registry, path, tries=2, before_claim=busy)
