"""History files: choice of sources, rejections, duplicates, compaction, snapshots; parsers."""

from __future__ import annotations

import gzip
import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotwise.operators import latest
from slotwise.operators import places as places_
from slotwise.sources import artifacts, history, parsers

DAY = "2026-09-13"


def line(**changes) -> str:
    row = {"facility": "north", "metric": "wait", "wait_minutes": 30, "observed_at": f"{DAY}T10:00:05+00:00", "batch_id": f"{DAY}T10:00:00+00:00", "latency_ms": 100}
    return json.dumps(row | changes)


@pytest.fixture
def store(tmp_path):
    def put(kind: str, day: str, name: str, body: bytes | str) -> None:
        place = tmp_path / kind / "wait" / f"dt={day}"
        place.mkdir(parents=True, exist_ok=True)
        (place / name).write_bytes(body.encode() if isinstance(body, str) else body)

    put.root = str(tmp_path)
    return put


def rows(spark, store, source="raw"):
    chosen = spark.createDataFrame([(DAY, source)], "d string, source string").select(F.col("d").cast("date").alias("dt"), "source")
    return history.validated(history.lines(spark, store.root, "wait", chosen), F.lit("2026-10-01").cast("timestamp"))


def test_rejections(spark, store):
    bad = [line(wait_minutes=True), line(wait_minutes="3"), line(facility=" "), '{"facility": "x"}', "not json", line(batch_id="2026-09-12T10:00:00+00:00"), line(observed_at=f"{DAY}T09:00:00+00:00"), line(latency_ms=-1), line(observed_at="soon")]
    store("raw", DAY, "a.jsonl", "\n".join([line(wait_minutes=0), "", *bad]))
    found = [r.reject_reason for r in rows(spark, store).orderBy("line").collect()]
    assert found == [None, "wait_minutes", "wait_minutes", "text", "fields", "fields", "wrong partition or future observation", "order", "latency_ms", "timestamp"]


def test_duplicates_keep_the_latest(spark, store):
    store("raw", DAY, "a.jsonl", "\n".join([line(), line(observed_at=f"{DAY}T10:00:09+00:00", wait_minutes=31), line(metric="other"), line(facility="south")]))
    store("raw", DAY, "b.jsonl", line(batch_id=f"{DAY}T05:00:00-05:00", observed_at=f"{DAY}T05:00:07-05:00"))
    at = lambda d: F.lit(d).cast("timestamp")
    records, counts, issues = history.history(rows(spark, store), at(DAY), at("2026-09-14"), "wait")
    assert {(r.facility, r.wait_minutes) for r in records.collect()} == {("north", 31), ("south", 30)}
    assert counts.first().asDict() == {"duplicate_records": 2, "conflicting_duplicates": 2, "rejected_records": 0}
    assert issues.isEmpty()


def test_corrupt_object_is_one_rejection(spark, store):
    store("compacted", DAY, "data.jsonl.gz", b"not gzip")
    found = rows(spark, store, "compacted").collect()
    assert [r.reject_reason for r in found] == ["BadGzipFile"]
    store("compacted", DAY, "data.jsonl.gz", gzip.compress(line().encode()))
    assert [r.reject_reason for r in rows(spark, store, "compacted").collect()] == [None]


def test_choice_of_sources(spark, store):
    for day in ("2026-09-10", "2026-09-11", "2026-09-13"):
        store("raw", day, "a.jsonl", line())
    for day in ("2026-09-10", "2026-09-12"):
        store("compacted", day, "data.jsonl.gz", gzip.compress(b"x"))
    raw, packed = history.listing(spark, f"{store.root}/raw"), history.listing(spark, f"{store.root}/compacted")
    said = history.fingerprint(raw).where("dt = '2026-09-10'").select("dt", "fingerprint")
    found = history.choose(spark, "2026-09-09", "2026-09-13", raw, packed, said, F.lit("2026-09-13").cast("date"))
    assert {str(r.dt)[-2:]: (r.source, r.completeness) for r in found.collect()} == {
        "09": ("missing", "missing"), "10": ("compacted", "snapshot_matches_raw"), "11": ("raw", "raw_snapshot"), "12": ("compacted", "unverified_no_raw"), "13": ("raw", "open_day"),
    }


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    path = str(tmp_path / "snapshot")
    name = history.write_snapshot(df, path)
    assert history.identity(df.orderBy(F.desc("k"))) == name
    assert history.read_snapshot(spark, path, name).count() == 3
    with pytest.raises(ValueError, match="frozen"):
        history.read_snapshot(spark, path, "other")


def test_compaction(spark, store):
    store("raw", DAY, "b.jsonl", line(wait_minutes=2) + "\n")
    store("raw", DAY, "a.jsonl", line(wait_minutes=1) + "\n")
    name = history.compact(spark, store.root, "wait", DAY)
    kept = spark.read.text(f"{store.root}/compacted/wait/dt={DAY}").select(F.get_json_object("value", "$.wait_minutes").alias("w"))
    assert sorted(r.w for r in kept.collect()) == ["1", "2"] and len(name) == 64


def test_published_minutes(spark):
    df = spark.createDataFrame([("wait=5 wait=5",), ("wait=5 wait=6",), ("wait=-1",), ("",), (None,)], "t string")
    found = [tuple(r.m) for r in df.select(parsers.published_minutes(F.col("t"), r"wait=(-?\d+)").alias("m")).collect()]
    assert found == [("ok", 5), ("conflict", None), ("invalid", None), ("missing", None), ("missing", None)]
    page = lambda text, name="Hill House": f"<h1>{name}</h1><h4 class='wait-time-menu'>{text}</h4>"
    pages = [page("Current ER Wait Time: 12 Minutes"), page("current er wait time: -1 minutes"), page("Closed " + "x" * 300), page("Current ER Wait Time: 12 Minutes", "Other")]
    df = spark.createDataFrame([(x,) for x in pages], "h string")
    rows = [r.w for r in df.select(parsers.published_wait(F.col("h"), "Hill House").alias("w")).collect()]
    assert [(r.status, r.detail, r.minutes) for r in rows] == [("available", None, 12), ("invalid", "negative_wait_sentinel", None), ("invalid", "missing_or_conflicting_widget", None), ("failed", "unexpected page", None)]
    assert len(rows[2].evidence) == 200 and rows[3].evidence is None


def test_ranges_of_departments(spark):
    one = {"Name": "n", "IsEDDep": True, "IsASAP": True, "CanShowWaitInfo": True, "WaitTime": 9, "WaitTimeLower": 5, "MaxValueHit": False}
    cases = [[one], [one, one], [one | {"WaitTime": 4}], [one | {"WaitTimeLower": 9, "MaxValueHit": True}], [one | {"WaitTimeLower": None}], [one | {"CanShowWaitInfo": False}], [one | {"WaitTime": "9"}], [one | {"MaxValueHit": "no"}], [one | {"IsEDDep": False}], [{k: v for k, v in one.items() if k != "MaxValueHit"}], [one | {"CanShowWaitInfo": "true"}]]
    df = spark.createDataFrame([(json.dumps({"OnMyWayDepartments": c}),) for c in cases] + [("{}",)], "t string")
    found = [tuple(r.m) for r in df.select(parsers.wait_range(F.col("t"), "n").alias("m")).collect()]
    failed = lambda detail: ("failed", detail, None, None, None)
    assert found == [
        ("available", None, 5, 9, False), failed("missing or duplicate ER department"), ("invalid", "invalid_wait_bounds", None, None, None), ("available", None, 9, None, True), ("available", None, 9, 9, False),
        ("unavailable", "wait_not_displayed", None, None, None), ("invalid", "invalid_wait_bounds", None, None, None), ("invalid", "invalid_cap_flag", None, None, None), failed("missing or duplicate ER department"),
        failed("missing wait fields"), failed("invalid wait visibility flag"), failed("invalid department list"),
    ]


def test_schedules_and_slots(spark):
    row = lambda k, **more: {"id": k, "attributes": {"active": True, "hidden": False, "appointment-types": [], "service": {"permalink": "emergency-room"}} | more, "relationships": {"facility": {"data": {"id": "7"}}}}
    place = {"id": "7", "type": "facilities", "attributes": {"permalink": "hill", "facility-type": "Emergencydepartment"}}
    whole = lambda rows, included=(place,): {"data": rows, "meta": {"record-count": len(rows)}, "included": list(included)}
    cases = [whole([row("1"), row("2"), row("3", service={"permalink": "other"})]), whole([row("1"), row("1")]), whole([row("1", hidden=True)]), whole([]), whole([row("1")], []), whole([row("1")]) | {"meta": {"record-count": 2}}, {"x": 1}]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases], "t string")
    found = [(r.s.detail, r.s.ids) for r in df.select(parsers.schedules(F.col("t"), "7", "hill").alias("s")).collect()]
    assert found == [(None, ["1", "2"]), ("missing or duplicate ER schedules", None), ("unexpected ER schedule scope", None), ("missing or duplicate ER schedules", None), ("missing or unexpected emergency facility", None), ("incomplete schedule listing", None), ("invalid public API envelope", None)]
    slot = lambda k, times, next_time=None: {"schedule-id": k, "appointment-type-id": "", "times": times, "next-time": next_time}
    day = "2026-09-14T"
    cases = [
        [slot("1", [f"{day}11:00:00Z", f"{day}06:00:00-05:00", f"{day}10:30:00+00:00"]), slot("2", ["2026-09-15T12:00:00Z"], f"{day}10:15:00Z")], [slot("1", []), slot("2", [])], [slot("1", [f"{day}11:00:00Z"])],
        [slot("1", []), slot("9", [])], [slot("1", [f"{day}09:59:00Z"]), slot("2", [])], [slot("1", [f"{day}11:00:00"]), slot("2", [])], [slot("1", []), slot("2", [], f"{day}09:00:00Z")],
    ]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases], "t string")
    at = lambda t: F.lit(t).cast("timestamp")
    made = df.select(parsers.arrival_slots(F.col("t"), F.array(F.lit("1"), F.lit("2")), at(f"{day}10:00:00Z"), at("2026-09-15T10:00:00Z")).alias("s")).select("s.status", "s.detail", F.date_format("s.next_available_at", "HH:mm").alias("next"), F.size("s.available_slots").alias("n"), "s.slots_beyond_window")
    assert [tuple(r) for r in made.collect()] == [
        ("available", None, "10:15", 2, 1), ("unavailable", "no_slots_returned", None, 0, 0), ("failed", "incomplete slot response", None, None, None), ("failed", "unexpected slot schedule or appointment type", None, None, None),
        ("failed", "expired slot", None, None, None), ("failed", "invalid timestamp", None, None, None), ("failed", "expired next slot", None, None, None),
    ]


def test_polls_and_attempts(spark):
    df = spark.createDataFrame([("a", '{"wait": 5, "beds": "7"}'), ("b", '{"wait": 5.5}'), ("c", "[]"), ("d", '{"beds": 1}')], "facility string, body string").selectExpr("*", "'x' batch_id", "'y' observed_at", "3 latency_ms")
    rows = parsers.polled_metrics(df)
    assert {(r.facility, r.metric, r.wait_minutes) for r in rows.collect()} == {("a", "wait", 5), ("a", "beds", 7), ("b", None, None), ("c", None, None), ("d", "beds", 1)}
    fetches = spark.createDataFrame(
        [("ok", "m", "available", None, "ok", None), ("part", "m", "available", None, "ok", None), ("part", "n", "invalid", "invalid_wait_bounds", "ok", None), ("bad", "m", "invalid", "r2", "ok", None), ("bad", "n", "invalid", "r1", "ok", None), ("http", None, None, None, "http_error", 503), ("late", None, None, None, "deadline", None), ("odd", None, None, "expired slot", "invalid", None), ("less", "n", "available", None, "ok", None)],
        "facility string, metric string, status string, detail string, outcome string, http_status int",
    )
    expected = spark.createDataFrame([(x,) for x in ("ok", "part", "bad", "http", "late", "odd", "less", "none")], "facility string")
    found = {r.facility: (r.state, r.error_code, r.error_detail, r.http_status) for r in parsers.attempts(expected, fetches, "m").collect()}
    assert found == {
        "ok": ("success", None, None, None), "part": ("partial", "invalid_source_value", "invalid_wait_bounds", None), "bad": ("failed", "invalid_source_value", "r1, r2", None), "http": ("failed", "request_failed", "http_error", 503),
        "late": ("failed", "collection_deadline", None, None), "odd": ("failed", "invalid_response", "expired slot", None), "less": ("failed", "expected_metric_missing", None, None), "none": ("failed", "request_failed", None, None),
    }
    summary = parsers.run_summary(parsers.attempts(expected, fetches, "m"), fetches.where("metric IS NOT NULL")).first().asDict()
    assert summary == {"expected_facilities": 8, "success": 1, "partial": 1, "failed": 6, "records": 6}


def test_routes_and_their_changes(spark):
    good = {"routes": [{"summary": {"lengthInMeters": 5, "travelDurationInSeconds": 60, "trafficDelayDurationInSeconds": 0}, "legs": [{"path": {"type": "LineString", "coordinates": [[0, 0], [-90.0, 35.0]]}}]}]}
    two = {"routes": [good["routes"][0] | {"legs": good["routes"][0]["legs"] * 2}]}
    df = spark.createDataFrame([(json.dumps(good), 35.0), (json.dumps(two), 35.0), (json.dumps(good), 36.0), ("x", 35.0)], "t string, lat double")
    assert [r.r.status for r in df.select(parsers.route(F.col("t"), F.col("lat"), F.lit(-90.0), 100).alias("r")).collect()] == ["ok", "invalid", "invalid", "invalid"]
    run = lambda rows: spark.createDataFrame(rows, "origin string, slug string, seconds int")
    assert [tuple(r) for r in parsers.route_changes(run([("o", "a", 100), ("o", "b", 5)]), run([("o", "a", 150), ("p", "b", 5)])).collect()] == [("o", "a", 100, 150, 50, 1.5)]


def test_load_is_pruned_and_pinned(spark, store):
    for day, wait in (("2026-09-12", 1), (DAY, 2), ("2026-09-14", 3)):
        store("raw", day, "a.jsonl", line(wait_minutes=wait, batch_id=f"{day}T10:00:00+00:00", observed_at=f"{day}T10:00:05+00:00"))
    store("raw", "2026-09-12", "b.jsonl", "not json")
    said = spark.createDataFrame([(DAY, history.compact(spark, store.root, "wait", DAY))], "d string, fingerprint string").select(F.col("d").cast("date").alias("dt"), "fingerprint")
    at = lambda t: F.lit(t).cast("timestamp")
    records, counts, issues, parts = history.load(spark, store.root, "wait", at("2026-09-12T00:00:00Z"), at("2026-09-14T00:00:00Z"), at("2026-09-20T00:00:00Z"), said)
    assert sorted(r.wait_minutes for r in records.collect()) == [1, 2] and counts.first().rejected_records == 1 and issues.count() == 1
    assert {str(r.dt): r.source for r in parts.collect()} == {"2026-09-12": "raw", DAY: "compacted"}
    with pytest.raises(ValueError, match="start < end"):
        history.load(spark, store.root, "wait", at("2026-09-14T00:00:00Z"), at("2026-09-12T00:00:00Z"), at("2026-09-20T00:00:00Z"), said)
    listed = history.listing(spark, f"{store.root}/raw/wait").cache()
    listed.count()
    store("raw", "2026-09-14", "a.jsonl", line(wait_minutes=9))
    chosen = spark.createDataFrame([("2026-09-14", "raw")], "d string, source string").select(F.col("d").cast("date").alias("dt"), "source")
    with pytest.raises(Exception, match="changed since"):
        history.lines(spark, store.root, "wait", chosen, listed).collect()


def test_batches_leave_a_summary_even_without_records(spark, tmp_path):
    none = spark.createDataFrame([], "facility string, wait int")
    summary = spark.createDataFrame([(8, 0)], "expected int, success int")
    history.write_batch(spark, str(tmp_path), "wait", none, summary, "dt=2026-09-13/x")
    assert spark.read.json(f"{tmp_path}/operations/wait/dt=2026-09-13/x").first().expected == 8 and not (tmp_path / "raw").exists()
    history.write_batch(spark, str(tmp_path), "wait", spark.createDataFrame([("a", 1)], "facility string, wait int"), summary, "dt=2026-09-13/x")
    assert spark.read.json(f"{tmp_path}/raw/wait/dt=2026-09-13/x").count() == 1


def test_supplied_tables_are_checked(spark, tmp_path):
    registry = spark.createDataFrame([("a",), ("b",)], "facility string")
    kind = "facility string, success struct<at:timestamp,batch:timestamp,value:int>, attempt struct<batch:timestamp,state:string>, state string"
    from datetime import datetime

    at = lambda h: datetime(2026, 1, 1, h)
    good = [("a", (at(2), at(1), 5), (at(1), "success"), "reporting"), ("b", None, (at(1), "failed"), "failed")]
    now = F.lit("2026-01-01T03:00:00Z").cast("timestamp")
    assert artifacts.latest_problems(spark.createDataFrame(good, kind), registry, now).isEmpty()
    bad = [("a", (at(4), at(1), 5), (at(1), "success"), "reporting"), ("a", None, None, "reporting"), ("x", None, None, "missing")]
    found = {(r.key, r.problem) for r in artifacts.latest_problems(spark.createDataFrame(bad, kind), registry, now).collect()}
    assert found == {("a", "observation"), ("a", "state"), ("a", "reporting without an attempt"), ("a", "repeated"), ("b", "missing"), ("x", "unknown")}
    with pytest.raises(ValueError, match="a: observation"):
        artifacts.require(artifacts.latest_problems(spark.createDataFrame(bad, kind), registry, now))
    (tmp_path / "routes.json").write_text(json.dumps({"routes": [{"origin": "o", "slug": "a", "seconds": {"night": 1, "am": 2, "pm": 3}}, {"origin": "o", "slug": "z", "seconds": {"night": -1}}]}))
    routes = artifacts.route_profiles(spark, str(tmp_path / "routes.json"))
    assert {(r.key, r.problem) for r in artifacts.route_problems(routes, registry).collect()} == {("o|z", "profiles"), ("o|z", "seconds"), ("o|z", "unknown")}
    places = spark.createDataFrame([("a", 35.0, -90.0), (" ", 1.0, 1.0), ("c", 91.0, None)], "facility string, latitude double, longitude double")
    assert {(r.key, r.problem) for r in artifacts.place_problems(places).collect()} == {(" ", "name"), ("c", "coordinates")}


def test_models_are_checked(spark):
    kind = "facility string, local_date string, local_hour int, state string, days int, eligible_days int, samples long, observed_slots long, coverage double, median double, low double, high double, distribution array<struct<value:int,n:bigint>>"
    rows = [("a", "d", 1, "supported", 8, 20, 3, 3, 0.9, 2.0, 1.0, 3.0, [(1, 1), (2, 2)]), ("b", "d", 1, "insufficient_history", 1, 20, 3, 3, 0.1, None, None, None, None), ("c", "d", 24, "supported", 9, 8, 4, 3, 0.9, 0.0, 1.0, 3.0, [(1, 1)])]
    found = {(r.key, r.problem) for r in artifacts.model_problems(spark.createDataFrame(rows, kind)).collect()}
    assert found == {("c|d|24", p) for p in ("hour", "support", "quartiles", "distribution")}


def test_contexts_end_at_midnight_and_after_two_hours(spark):
    rows = [("2026-09-14T10:00:00Z", "2026-09-14T11:59:59Z"), ("2026-09-14T10:00:00Z", "2026-09-14T12:00:00Z"), ("2026-09-14T10:00:00Z", "2026-09-14T09:59:59Z"), ("2026-09-15T04:30:00Z", "2026-09-15T05:00:00Z"), ("2026-09-15T04:30:00Z", "2026-09-15T04:59:00Z")]
    df = spark.createDataFrame(rows, "g string, n string").selectExpr("timestamp(g) g", "timestamp(n) n")
    assert [r[0] for r in df.select(latest.context_available(F.col("g"), F.col("n"), "America/Chicago")).collect()] == [True, False, False, False, True]


def test_candidates_of_a_context(spark):
    rows = spark.createDataFrame([("a", None), ("b", "closed"), ("c", None)], "slug string, adult string").select("slug", F.create_map(F.lit("adult"), "adult").alias("eligibility"))
    assert sorted(r.slug for r in places_.candidates(rows, "adult").collect()) == ["a", "c"]
    for bad in (rows.where("slug = 'b'"), rows.unionByName(rows)):
        with pytest.raises(ValueError, match="distinct"):
            places_.candidates(bad, "adult")


def test_registry_and_canonical_order(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"facilities": [{"slug": "b", "collection_enabled": True}, {"slug": "a", "collection_enabled": False}]}))
    assert [(r.pos, r.slug) for r in history.registry(spark, str(tmp_path / "r.json")).collect()] == [(0, "b")]
    assert history.registry(spark, str(tmp_path / "r.json"), include_map_only=True).count() == 2
    df = spark.createDataFrame([(2, "a", "m", 1), (1, "b", "m", 2), (1, "a", "m", 3)], "observed int, facility string, metric string, batch int")
    assert [r.batch for r in history.points(df).collect()] == [3, 2, 1] == [r.batch for r in history.ordered(df).collect()]
    history.write_json(df.where("batch = 1"), str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == [{"observed": 2, "facility": "a", "metric": "m", "batch": 1}]


def test_raw_batches_land_under_their_day(spark, tmp_path):
    rows = [json.loads(line()), json.loads(line(batch_id="2026-09-14T00:10:00+02:00", observed_at="2026-09-14T00:11:00+02:00", wait_minutes=7))]
    history.write_raw(spark.createDataFrame([tuple(r[f] for f in history.FIELDS) for r in rows], "batch_id string, facility string, latency_ms int, metric string, observed_at string, wait_minutes int"), str(tmp_path), "wait")
    found = history.listing(spark, f"{tmp_path}/raw/wait").where("key LIKE '%part-%'").select("dt").distinct().collect()
    assert [str(r.dt) for r in found] == [DAY]


def test_raw_objects_are_read_without_python(spark, store, capsys):
    store("raw", DAY, "a.jsonl", line() + "\r\n\x85" + line(facility="south"))
    store("raw", DAY, "b.jsonl", line().encode() + b"\n\xff")
    found = rows(spark, store)
    assert sorted((r.line or 0, r.facility, r.reject_reason) for r in found.collect()) == [(0, None, "UnicodeDecodeError"), (1, "north", None), (3, "south", None)]
    found.explain()
    assert "Arrow" not in capsys.readouterr().out


def test_compacted_objects_are_unzipped_in_pieces(spark, store):
    """Lines keep their numbers over pieces, no piece holds much of an object, and one that is cut off gives no line."""
    breaks = ["\n", "\r\n", "\r", " \n", "\n\n"]
    text = "".join(line(wait_minutes=k, facility="é" * (k % 7 + 1)) + breaks[k % 5] for k in range(20_000))
    body = gzip.compress(text.encode())
    batch = pa.RecordBatch.from_pydict({"dt": [None] * 2, "key": ["a", "b"], "content": [body, body[:-9]]})
    pieces = [r for b in history.unzipped(iter([batch])) for r in b.to_pylist()]
    assert [(r["key"], r["error"]) for r in pieces if r["error"]] == [("b", "EOFError")] and {r["key"] for r in pieces if r["text"]} == {"a"}
    assert "".join(r["text"] or "" for r in pieces) == text and max(len(r["text"] or "") for r in pieces) < history.PIECE + 1_000 < len(text)
    store("compacted", DAY, "data.jsonl.gz", body)
    expected = [(k, json.loads(t)["wait_minutes"]) for k, t in enumerate(re.split(history.LINE_BREAK, text), 1) if t.strip()]
    assert sorted((r.line, r.wait_minutes) for r in rows(spark, store, "compacted").collect()) == expected


def test_history_is_decoded_once(spark, store, capsys):
    """Records, counters and issues read what has been decoded, not the objects."""
    store("raw", DAY, "a.jsonl", "\n".join([line(), line(), "x"]))
    at = lambda d: F.lit(d).cast("timestamp")
    records, counts, issues, _ = history.load(spark, store.root, "wait", at(DAY), at("2026-09-14"), at("2026-10-01"), spark.createDataFrame([], "dt date, fingerprint string"))
    assert (records.count(), counts.first().duplicate_records, counts.first().rejected_records, issues.count()) == (1, 1, 1, 1)
    assert not any(f.endswith(".jsonl") for df in (records, counts, issues) for f in df.inputFiles())
