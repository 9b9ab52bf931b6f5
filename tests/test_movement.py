"""Screens of a day stand on what was known when it began."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from slotwise.functions.time import calendar
from slotwise.operators import dedup, movement
from slotwise.policy import ZONE, Movement

#: A local midnight of the zone, in winter.
START = datetime(2024, 1, 8, 6, tzinfo=timezone.utc)
POLICY = Movement(horizons_minutes=(60, 120), cadence_seconds=3600, gap_seconds=7200, tolerance_seconds=1800, minimum_pairs=5, minimum_days=1, lookback_days=3)


def screens(spark, values: list[int]) -> tuple[dict, list]:
    rows = [("a", START + timedelta(hours=k, minutes=1), START + timedelta(hours=k), v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "facility string, at timestamp, batch timestamp, value int")
    slots, cal = dedup.slot_winners(df, 3600, ZONE), calendar(spark, "2024-01-01", "2024-01-20", ZONE, 3600)
    moves = movement.changes(slots, cal, POLICY)
    days = slots.select(F.col("local_date").alias("day")).distinct()
    return {(str(r.day), r.horizon_minutes): r.p90 for r in movement.daily_screens(moves, days, POLICY).collect()}, moves.collect()


def test_a_jump_at_midnight_does_not_reach_the_screen_of_its_own_day(spark):
    values = [10] * 72 + [500] * 48  # the jump is between the last reading of the third day and the first of the fourth
    found, _ = screens(spark, values)
    assert found["2024-01-11", 60] == 0 == found["2024-01-11", 120]
    later, moves = screens(spark, [10] * 71 + [500] * 49)
    assert later["2024-01-11", 60] is not None and max(abs(r.change) for r in moves) == 490


def test_screens_are_those_of_windows_cut_before_anything_is_paired(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 90, 24 * 6).tolist()
    found, _ = screens(spark, values)
    for day in range(1, 6):
        name = str((START + timedelta(days=day)).date())
        window = values[max(0, day - POLICY.lookback_days) * 24 : day * 24]
        for horizon, steps in ((60, 1), (120, 2)):
            sizes = [abs(b - a) for a, b in zip(window, window[steps:], strict=False)]
            assert np.isclose(found[name, horizon], np.quantile(sizes, 0.9)), (name, horizon)


def test_complete_days_end_before_the_day_of_now(spark):
    rows = spark.createDataFrame([("a", START + timedelta(hours=k)) for k in range(96)], "facility string, at timestamp")
    now = F.lit(START + timedelta(hours=80)).cast("timestamp")
    kept = movement.complete_days(rows, now, POLICY).agg(F.min("at"), F.max("at"), F.count("at")).first()
    assert kept[2] == 72


def test_travel_can_be_ordered_by_drive_wait_and_total(spark):
    from slotwise.operators import places

    rows = spark.createDataFrame([("a", 10.0, 30, 40.0), ("b", 20.0, 5, 25.0), ("c", None, 1, None), ("d", 5.0, None, None), ("e", 20.0, 20, 40.0)], "slug string, drive double, wait int, total double")
    order = lambda by: "".join(r.slug for r in places.ranked(rows, by).collect())
    assert (order("drive"), order("wait"), order("total"), order("other")) == ("dabec", "cbead", "baedc", "dabec")


def test_places_without_a_campus_are_not_on_the_map(spark):
    from slotwise.operators import views

    cells = spark.createDataFrame([("a", 3, 2, 50.0), ("b", 3, 0, None), ("c", 3, 1, 1.0)], "facility string, bin int, readings int, delta double")
    campus = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0), ("c", None, None)], "facility string, latitude double, longitude double")
    only = spark.createDataFrame([("x", 5.0, 6.0), ("y", None, None)], "facility string, latitude double, longitude double")
    assert {(r.facility, r.state) for r in views.snapshot(cells, 3, campus, only).collect()} == {("a", "above"), ("b", "empty"), ("x", "unpublished")}
