"""The digest manifest: what is opened, and when."""

from __future__ import annotations

import json
import os
import shutil
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from slotwise.sources import history, manifest


def record(day: date, value: int) -> str:
    at = f"{day}T00:05:00+00:00"
    return json.dumps({"facility": "a", "metric": "wait", "wait_minutes": value, "observed_at": at, "batch_id": at, "latency_ms": 1})


def put(root: str, day: date, name: str, text: str) -> str:
    folder = f"{root}/raw/wait/dt={day}"
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(text)
    return path


def unseen(path: str, text: str) -> None:
    """Another content of the same length and time: only who opens the object can tell."""
    was = os.stat(path)
    assert len(text) == was.st_size
    with open(path, "w") as f:
        f.write(text)
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))


@pytest.fixture
def days(tmp_path):
    first = date(2026, 3, 1)
    for k in range(40):
        put(str(tmp_path), first + timedelta(days=k), "a.jsonl", record(first + timedelta(days=k), 10 + k))
    return str(tmp_path), [first + timedelta(days=k) for k in range(40)]


def tags(df) -> dict[str, str]:
    return {r.key.split("wait/")[1]: r.etag for r in df.collect()}


def test_a_listing_of_days_looks_at_their_folders_only(spark, days):
    root, dates = days
    found = tags(history.listing(spark, f"{root}/raw/wait", str(dates[3]), str(dates[5])))
    assert sorted(found) == [f"dt={d}/a.jsonl" for d in dates[3:6]]
    assert manifest.day_folders(spark, f"{root}/raw/wait", str(dates[38])) == [f"{root}/raw/wait/dt={d}" for d in dates[38:]]
    assert manifest.day_folders(spark, f"{root}/none") == [] and history.listing(spark, f"{root}/none", "2026-01-01", "2026-01-02", f"{root}/m").count() == 0


def test_names_are_listed_without_opening(spark, days, tmp_path):
    root, dates = days
    named = manifest.objects(spark, [f"{root}/raw/wait"]).select("path", "length", "modificationTime")
    assert "content" not in named._jdf.queryExecution().executedPlan().toString()


def test_known_objects_are_not_opened_again(spark, days):
    root, dates = days
    table, place = f"{root}/manifest", f"{root}/raw/wait"
    args = (str(dates[0]), str(dates[9]), table)
    before = tags(history.listing(spark, place, *args))
    assert len(before) == 10 == manifest.known(spark, table).count()
    assert before == tags(history.listing(spark, place, str(dates[0]), str(dates[9])))
    unseen(f"{place}/dt={dates[2]}/a.jsonl", record(dates[2], 99))
    assert tags(history.listing(spark, place, *args)) == before != tags(history.listing(spark, place, str(dates[0]), str(dates[9])))
    # A new object of the same day does not have its neighbour opened, a changed one is digested again.
    put(root, dates[2], "b.jsonl", record(dates[2], 50))
    put(root, dates[3], "a.jsonl", record(dates[3], 7))
    after = tags(history.listing(spark, place, *args))
    assert {k for k in after if after[k] != before.get(k)} == {f"dt={dates[2]}/b.jsonl", f"dt={dates[3]}/a.jsonl"}
    assert manifest.known(spark, table).count() == 12


def test_rivals_that_append_the_same_digests(spark, days):
    root, dates = days
    table, place = f"{root}/manifest", f"{root}/raw/wait"
    once = tags(history.listing(spark, place, str(dates[0]), str(dates[1]), table))
    spark.read.parquet(table).withColumn("dt", F.col("dt").cast("date")).write.mode("append").partitionBy("dt").parquet(table)
    assert tags(history.listing(spark, place, str(dates[0]), str(dates[1]), table)) == once and manifest.known(spark, table).count() == 2


def test_a_read_of_one_day_of_many_opens_that_day(spark, days):
    root, dates = days
    at = lambda d: F.lit(f"{d}T00:00:00Z").cast("timestamp")
    said = spark.createDataFrame([], "dt date, fingerprint string")
    for k in range(40):  # nobody else's objects may be touched: they are unreadable as such
        if k not in (7, 8):
            shutil.rmtree(f"{root}/raw/wait/dt={dates[k]}")
            os.symlink("/nowhere", f"{root}/raw/wait/dt={dates[k]}")
    records, _, _, parts = history.load(spark, root, "wait", at(dates[7]), at(dates[9]), at("2026-06-01"), said, manifest=f"{root}/manifest")
    assert sorted(r.wait_minutes for r in records.collect()) == [17, 18] and parts.where("source = 'raw'").count() == 2
    chosen = spark.createDataFrame([(dates[7], "raw")], "dt date, source string")
    files = history.lines(spark, root, "wait", chosen).inputFiles()
    assert [f.split("/dt=")[1] for f in files] == [f"{dates[7]}/a.jsonl"]


def test_content_that_changed_behind_the_manifest_ends_the_read(spark, days):
    root, dates = days
    at = lambda d: F.lit(f"{d}T00:00:00Z").cast("timestamp")
    said = spark.createDataFrame([], "dt date, fingerprint string")
    load = lambda: history.load(spark, root, "wait", at(dates[4]), at(dates[5]), at("2026-06-01"), said, manifest=f"{root}/manifest")[0].collect()
    assert [r.wait_minutes for r in load()] == [14]
    unseen(f"{root}/raw/wait/dt={dates[4]}/a.jsonl", record(dates[4], 88))
    with pytest.raises(Exception, match="changed since it was listed"):
        load()
