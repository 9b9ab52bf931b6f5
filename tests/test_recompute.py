"""Late objects change the results that stand on them, and no others."""

from __future__ import annotations

import json
import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from slotwise.sources import history
from slotwise.streaming import commits, recompute

FIRST, LOOKBACK = date(2026, 3, 1), 5
DAYS = [FIRST + timedelta(days=k) for k in range(20)]


def put(root: str, day: date, name: str, values: list[int]) -> None:
    folder = f"{root}/raw/wait/dt={day}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        for k, v in enumerate(values):
            at = f"{day}T{k:02}:05:00+00:00"
            f.write(json.dumps({"facility": "a", "metric": "wait", "wait_minutes": v, "observed_at": at, "batch_id": at, "latency_ms": 1}) + "\n")


def results(spark, root: str):
    """A result that looks back: the sum and number of the values of the days before."""
    chosen = spark.createDataFrame([(d, "raw") for d in DAYS if os.path.isdir(f"{root}/raw/wait/dt={d}")], "dt date, source string")

    def make(days):
        rows = history.validated(history.lines(spark, root, "wait", chosen), F.lit("2027-01-01").cast("timestamp")).where("reject_reason IS NULL").select("dt", "wait_minutes")
        met = rows.select(F.explode(F.sequence(F.date_add("dt", 1), F.date_add("dt", LOOKBACK))).alias("day"), "wait_minutes").join(days, "day")
        return met.groupBy("day").agg(F.sum("wait_minutes").alias("total"), F.count(F.lit(1)).alias("n"))

    return make


def run(spark, root: str, path: str) -> list[str]:
    prints = history.fingerprint(history.listing(spark, f"{root}/raw/wait", str(DAYS[0]), str(DAYS[-1]), f"{path}/manifest")).select("dt", "fingerprint")
    return recompute.refresh(spark, path, prints, results(spark, root), str(DAYS[0]), str(DAYS[-1]), LOOKBACK)


def held(spark, path: str) -> dict[str, tuple[int, int]]:
    return {str(r.day): (r.total, r.n) for r in spark.read.parquet(f"{path}/days").collect()}


def files(path: str) -> dict[str, tuple]:
    return {d: tuple(sorted((f, os.stat(f"{path}/days/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/days/{d}") if f.startswith("part"))) for d in os.listdir(f"{path}/days") if d.startswith("day=")}


def full(spark, root: str, path: str) -> dict[str, tuple[int, int]]:
    run(spark, root, path)
    return held(spark, path)


@pytest.fixture
def store(spark, tmp_path):
    root, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k, d in enumerate(DAYS):
        if k not in (8, 9, 10, 11, 12, 13):
            put(root, d, "a.jsonl", [k, k + 1])
    assert len(run(spark, root, path)) == 20
    return root, path


def test_a_late_object_changes_the_days_it_must(spark, store, tmp_path):
    root, path = store
    assert run(spark, root, path) == [] and commits.versions(spark, f"{path}/fingerprints") == [1]
    before = files(path)
    put(root, DAYS[4], "late.jsonl", [100])
    again = run(spark, root, path)
    assert again == [str(d) for d in DAYS[3:11]]
    assert held(spark, path) == full(spark, root, str(tmp_path / "other"))
    after = files(path)
    assert {d for d in before if before[d] == after.get(d)} == {d for d in before if d[4:] not in again} and len(after) == len(before)


def test_a_day_that_vanishes_takes_its_results_with_it(spark, store, tmp_path):
    root, path = store
    os.remove(f"{root}/raw/wait/dt={DAYS[7]}/a.jsonl")
    os.rmdir(f"{root}/raw/wait/dt={DAYS[7]}")
    assert str(DAYS[12]) in held(spark, path)
    run(spark, root, path)
    found = held(spark, path)
    assert str(DAYS[12]) not in found and found == full(spark, root, str(tmp_path / "other"))


def test_a_run_that_dies_is_made_again(spark, store):
    root, path = store
    put(root, DAYS[2], "late.jsonl", [7])
    prints = history.fingerprint(history.listing(spark, f"{root}/raw/wait")).select("dt", "fingerprint")

    def dies(days):
        raise OSError("died")

    with pytest.raises(OSError, match="died"):
        recompute.refresh(spark, path, prints, dies, str(DAYS[0]), str(DAYS[-1]), LOOKBACK)
    assert run(spark, root, path) == [str(d) for d in DAYS[1:9]]
