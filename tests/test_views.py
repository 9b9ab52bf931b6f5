"""Views, areas, movement and places on small tables whose answers are known."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from slotwise.functions.geo import distance_km
from slotwise.functions.time import calendar
from slotwise.operators import baseline, dedup, movement, places, views
from slotwise.policy import ZONE, Baseline, Movement

END = 1789405200  # 2026-09-14T17:00:00Z
HOUR = 3600


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def at(seconds: int):
    import datetime

    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)


def test_bands_at_their_bounds(spark):
    deltas = [-45, -40, -25, -20, -15, -10, 0, 10, 15, 20, 39, 40]
    found = [r[0] for r in table(spark, [(float(d),) for d in deltas], "d double").select(views.delta_band(F.col("d"))).collect()]
    assert found == ["far_below", "far_below", "below", "below", "slightly_below", "near", "near", "near", "slightly_above", "above", "above", "far_above"]


def test_heatmap_and_its_summary(spark):
    rows = [("a", END - 2 * HOUR, 5.0), ("a", END - 2 * HOUR + 900, 30.0), ("a", END - 2 * HOUR + 1800, 50.0), ("a", END - HOUR + 60, None), ("a", END - 200 * HOUR, -90.0), ("c", END - HOUR, 10.0), ("c", END - 3 * HOUR, -10.0), ("c", END - 5 * HOUR, -10.5)]
    points = table(spark, [(f, at(t), d) for f, t, d in rows], "facility string, at timestamp, delta double")
    cells = views.heatmap(points, table(spark, [("a",), ("b",), ("c",)], "facility string"), END - 55 * 60, 168)
    assert cells.count() == 3 * 168 and views.heatmap(points, points, END, 24).where("facility = 'a'").count() == 96
    by = {(r.facility, r.bin): r for r in cells.where("readings > 0").collect()}
    assert (by["a", END - 2 * HOUR].delta, by["a", END - 2 * HOUR].readings) == (30.0, 3) and by["a", END - HOUR].delta is None and len(by) == 5
    found = {r.facility: tuple(r)[1:] for r in views.heatmap_summary(cells).collect()}
    assert found == {"a": (2, 1, 1, 0, 30.0), "b": (0, 0, 0, 0, None), "c": (3, 3, 0, 1, None)}


def test_marker_states(spark):
    rows = [(0, None), (None, 3.0), (1, None), (1, 10.0), (1, 10.1), (1, -10.0), (1, -10.1)]
    found = [r[0] for r in table(spark, rows, "n int, d double").select(views.marker_state(F.col("n"), F.col("d"), 10)).collect()]
    assert found == ["empty", "empty", "unsupported", "near", "above", "near", "below"]


def test_index_of_the_shown_bin():
    shown = lambda wanted, follow=False: views.resolve_index(10, 1000, 100, wanted, follow)
    assert [shown(None), shown(1300), shown(1349), shown(1350), shown(949), shown(950), shown(2000), shown(1300, True)] == [9, 3, 3, 4, 9, 0, 9, 9]


def test_visible_range(spark):
    lines = {"steps": [(END - 48 * HOUR, 900), (END - 23 * HOUR, 40), (END, 60)], "flat": [(END, 0)], "negative": [(END - HOUR, -20), (END, -5)], "none": [(END - 90 * HOUR, 7)]}
    df = table(spark, [(f, at(t), v) for f, ts in lines.items() for t, v in ts], "facility string, at timestamp, value int")
    found = {r.facility: (r.low, r.high) for r in views.visible_range(df, F.timestamp_seconds(F.lit(END - 24 * HOUR)), F.timestamp_seconds(F.lit(END)), 24 * HOUR).collect()}
    assert found["steps"] == (0, 65) and found["flat"] == (0, 10) and found["none"] == (0, 10)
    assert found["negative"][0] < -20 and found["negative"][1] == 0
    crossing = table(spark, [("x", at(0), 100), ("x", at(10), 0), ("y", at(0), 100), ("y", at(10), 0)], "facility string, at timestamp, value int")
    crossed = views.visible_range(crossing, F.timestamp_seconds(F.lit(5)), F.timestamp_seconds(F.lit(10)), 10).collect()
    assert {(r.low, r.high) for r in crossed} == {(0, 55)}
    assert {(r.low, r.high) for r in views.visible_range(crossing, F.timestamp_seconds(F.lit(5)), F.timestamp_seconds(F.lit(10)), 9).collect()} == {(0, 10)}


def test_areas_count_their_members(spark):
    members = table(spark, [("x", "a", 1), ("x", "b", 0), ("x", "quiet", 2), ("y", "b", 0)], "area string, facility string, pos int")
    rows = [("a", END - HOUR, "near"), ("a", END - HOUR + 60, "above"), ("b", END - HOUR, "above"), ("b", END - 2 * HOUR, "no_range"), ("other", END - HOUR, "above"), ("a", END - 2 * HOUR, "below"), ("a", END - 999 * HOUR, "above")]
    points = table(spark, [(f, at(t), s) for f, t, s in rows], "facility string, at timestamp, state string")
    bins = views.area_counts(points, members, END, 168)
    assert bins.count() == 2 * 168
    by = {(r.area, r.bin): tuple(r)[2:] for r in bins.where("reporting > 0").collect()}
    assert by == {("x", END - HOUR): (2, 2, 2, 0, "b,a", ""), ("x", END - 2 * HOUR): (2, 1, 0, 1, "", "a"), ("y", END - HOUR): (1, 1, 1, 0, "b", ""), ("y", END - 2 * HOUR): (1, 0, 0, 0, "", "")}
    assert {r.area: tuple(r)[1:] for r in views.typical_count(bins).collect()} == {"x": (0, 1, 2), "y": (1, 1, 1)}
    tallies = {(r.area, r.facility): tuple(r)[2:] for r in views.area_tallies(points, members, END, 168).collect()}
    assert tallies == {("x", "a"): (2, 2, 1, 1), ("x", "b"): (2, 1, 1, 0), ("x", "quiet"): (0, 0, 0, 0), ("y", "b"): (2, 1, 1, 0)}
    now = views.area_now(table(spark, [("a", True, 5), ("b", False, 5)], "facility string, current boolean, value int"), table(spark, [("a", "above_usual"), ("b", "above_usual")], "facility string, unusual string"), members)
    assert {r.area: tuple(r)[1:] for r in now.collect()} == {"x": (3, 1, 0, 1, 0, 2, 0), "y": (1, 0, 0, 0, 0, 1, 0)}
    paused = views.area_now(table(spark, [("a", True, 5)], "facility string, current boolean, value int"), table(spark, [], "facility string, unusual string"), members, paused=True)
    assert {r.area: (r.compared, r.paused) for r in paused.collect()} == {"x": (0, 1), "y": (0, 0)}


def test_ticks_at_local_midnights(spark):
    week = views.ticks(END, 168, 100, ZONE, spark).orderBy("bin").collect()
    assert len(week) == 7 and all(r.local_hour == 0 for r in week) and [r["index"] for r in week] == [12 + 24 * k for k in range(7)]
    assert views.ticks(END, 168, 3, ZONE, spark).count() == 3
    assert sorted(r.local_hour for r in views.ticks(END, 24, 9, ZONE, spark).collect()) == [0, 6, 18]


def test_segments_cross_midnight(spark):
    times = [("a", END), ("a", END + 600), ("a", END + 1801), ("a", END + 8 * HOUR - 60), ("a", END + 8 * HOUR + 60), ("b", END)]
    df = table(spark, [(f, at(t)) for f, t in times], "facility string, at timestamp")
    found = {(r.facility, int(r.start.timestamp()), int(r.end.timestamp()), r.readings) for r in views.segments(df, 1200).withColumns({"start": F.col("start"), "end": F.col("end")}).collect()}
    assert {x[3] for x in found} == {1, 2} and len(found) == 4


# ---------------------------------------------------------------- places


@pytest.fixture(scope="module")
def registry(spark):
    rng = random.Random(3)
    rows = [(f"p{k:03d}", k, rng.choice(["West", "East End", None]), rng.uniform(-89.9, 89.9) if k % 3 else 35 + rng.uniform(0, 3), rng.uniform(-180, 180) if k % 3 else -90 + rng.uniform(0, 3)) for k in range(300)]
    rows += [("edge1", 300, None, 10.0, 179.99), ("edge2", 301, None, 10.0, -179.99), ("pole1", 302, None, 89.9, 0.0), ("pole2", 303, None, 89.9, 170.0)]
    return table(spark, rows, "facility string, pos int, region string, latitude double, longitude double")


def test_places_within_reach_are_all_pairs_within_reach(spark, registry):
    a, b_ = registry.alias("a"), registry.alias("b")
    km = distance_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    for limit in (50, 400):
        expected = {(r.x, r.y) for r in a.join(b_, F.col("a.pos") < F.col("b.pos")).where(km <= limit).select(F.col("a.facility").alias("x"), F.col("b.facility").alias("y")).collect()}
        found = [(r.a, r.b) for r in places.within(registry, limit).collect()]
        assert len(found) == len(set(found)) and set(found) == expected and ("edge1", "edge2") in expected
    with pytest.raises(ValueError, match="at most"):
        places.pairs(spark.range(places.REGISTRY_ROWS + 1).selectExpr("cast(id as string) facility", "id pos", "0D latitude", "0D longitude"))


def test_areas_of_a_chain_a_pair_and_regions(spark):
    rows = [("far", 0, "West", 60.0), ("c", 1, "West", 35.8), ("a", 2, "East End", 35.0), ("b", 3, None, 35.4), ("p", 4, "West", 50.0), ("q", 5, "West", 50.1)]
    places_ = table(spark, [(f, p, r, lat, -90.0) for f, p, r, lat in rows], "facility string, pos int, region string, latitude double, longitude double")
    found = places.areas(places_, places.neighbour_groups(places_, 50))
    assert [tuple(r) for r in found.orderBy("place").collect()] == [
        (0, "all", "all", "All hospitals", 6, "far,c,a,b,p,q"), (1, "near-c", "near", "c / a / b", 3, "c,a,b"),
        (2, "region-west", "region", "West", 4, "far,c,p,q"), (3, "region-east-end", "region", "East End", 1, "a"),
    ]
    assert places.areas_problem(found, places_) is None and places.areas_problem(found.where("place > 0"), places_) is not None
    assert places.areas_problem(found, places_.where("facility <> 'q'")) is not None
    assert places.area_members(found, places_).count() == 14
    named = places_.withColumn("name", F.upper("facility"))
    labels = lambda **more: [r.label for r in places.areas(named, places.neighbour_groups(places_, 50), **more).orderBy("place").collect()][:2]
    assert labels() == ["All hospitals", "C / A / B"] and labels(all_label="All", known={"a": "Around A"}) == ["All", "Around A"]


def test_origins(spark):
    rows = ['{"latitude": 35.1, "longitude": -90}', '{"latitude": 91, "longitude": 0}', '{"latitude": 1}', '{"latitude": 1, "longitude": 2, "name": "x"}', '{"latitude": "1", "longitude": 2}', "[]", None]
    found = [r[0] for r in table(spark, [(x,) for x in rows], "o string").select(places.origin_problem(F.col("o"))).collect()]
    assert found == [None, "coordinates", "keys", "keys", "coordinates", "keys", "keys"]


def test_entrances(spark):
    kind = "struct<latitude:double,longitude:double,label:string,source_url:string,method:string,reviewed_on:string>"
    rows = table(spark, [("a", 0, (35.0, -90.0), None), ("b", 1, (36.0, -90.0), None)], f"slug string, pos int, campus_point struct<latitude:double,longitude:double>, emergency_entrance {kind}")
    set_ = places.set_entrance(rows, "b", {"latitude": 36.001, "longitude": -90.0, "method": "site_visit", "reviewed_on": "2026-01-01"})
    assert [(r.slug, r.method, r.meters and round(r.meters)) for r in places.review_rows(set_).orderBy("pos").collect()] == [("a", None, None), ("b", "site_visit", 111)]
    assert places.set_entrance(set_, "b", None).where("emergency_entrance IS NOT NULL").isEmpty()
    with pytest.raises(ValueError, match="nobody"):
        places.lookup(rows, "nobody")
    collection = places.feature_collection(set_).first().collection
    assert collection.count('"type":"Feature"') == 3 and collection.index('"a"') < collection.index('"b"')


# ---------------------------------------------------------------- movement and baselines

START = 1788498000  # 2026-09-04T05:00:00Z, a local midnight ten days before END


def sawtooth(spark, skip=()):
    rows = [("a", START + 900 * k, (k % 8) * 5) for k in range(960) if k not in skip] + [("a", END, 99999)]
    df = table(spark, [(f, at(t), at(t), v) for f, t, v in rows], "facility string, at timestamp, batch timestamp, value int")
    return movement.complete_days(dedup.slot_winners(df, 900, ZONE), F.timestamp_seconds(F.lit(END)), Movement())


def test_movement_of_a_sawtooth(spark):
    cal = calendar(spark, "2026-08-10", "2026-09-15", ZONE, 900)
    by = lambda skip=(): {r.horizon_minutes: r for r in movement.stability(movement.changes(sawtooth(spark, skip), cal, Movement()), Movement()).collect()}
    full = by()
    assert (full[15].pairs, full[15].days, full[15].median_abs_change, full[15].p90_abs_change, full[15].rise_share) == (959, 10, 5, 35, 0)
    assert math.isclose(full[15].fall_share, 119 / 959) and (full[30].median_abs_change, full[30].p90_abs_change) == (10, 30)
    assert by({400})[15].pairs == 957
    assert all(r.median_abs_change is None and r.rise_share is None for r in by(set(range(96, 960))).values())


def test_run_lengths_of_a_sorted_array(spark):
    df = table(spark, [([1, 1, 2, 5, 5, 5],), ([7],), ([],)], "v array<int>")
    assert [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.select(baseline.distribution(F.col("v"))).collect()] == [[(1, 2), (2, 1), (5, 3)], [(7, 1)], None]


def test_days_that_are_not_known_yet_do_not_count(spark):
    rows = [("a", START - 86400 * d + 3600 * h + 900 * q, 20 + (60 if d == 1 else 0)) for d in range(-1, 28) for h in range(24) for q in range(4)]
    df = table(spark, [(f, at(t), at(t), v) for f, t, v in rows], "facility string, at timestamp, batch timestamp, value int")
    slots, cal = dedup.slot_winners(df, 900, ZONE), calendar(spark, "2026-08-01", "2026-09-06", ZONE, 900)
    asked = table(spark, [("a", "2026-09-04", 3, k) for k in ("2026-09-03", "2026-09-04")], "facility string, d string, local_hour int, k string").select("facility", F.col("d").cast("date").alias("local_date"), "local_hour", F.col("k").cast("date").alias("known_before"))
    found = {str(r.known_before): r for r in baseline.models(asked, slots, cal, Baseline()).collect()}
    assert found["2026-09-03"].observed_slots < found["2026-09-04"].observed_slots and found["2026-09-03"].expected_slots == found["2026-09-04"].expected_slots
    assert {r.value for r in found["2026-09-03"].distribution} == {20} and 80 in {r.value for r in found["2026-09-04"].distribution}
