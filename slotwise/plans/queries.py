"""Queries over the test tables, one or more for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import stats
from slotwise.functions.geo import distance_m
from slotwise.functions.time import local_date, local_hour, weekend
from slotwise.operators import association, baseline, benefit, dedup, forecast, latest, models, movement, places, views
from slotwise.plans import bindings as b
from slotwise.plans import studies
from slotwise.session import cut, shared_dir
from slotwise.sources import history, pages, parsers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def second(c: str):
    return F.unix_seconds(c)


def usual(spark: SparkSession, sf_dir: str, policy=b.HOURLY) -> DataFrame:
    found = b.slots(spark, sf_dir)
    return baseline.models(b.targets(found), found, b.local_calendar(spark, sf_dir), policy)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of the slot series against its model."""
    return baseline.compare(b.slots(spark, sf_dir), usual(spark, sf_dir), b.HOURLY)


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(spark, sf_dir)
    return rows.withColumn("state", views.point_state(F.col("median"), F.col("percentile"), F.col("delta"), b.HOURLY))


def generated(spark: SparkSession, sf_dir: str) -> int:
    """When the views are made: half an hour before the end of the readings."""
    return b.span(spark, sf_dir).end - 1800


@query
def slot_series(spark, sf_dir):
    return b.slots(spark, sf_dir).select("facility", "slot", second("at").alias("at"), "value", F.col("local_date").cast("string").alias("local_date"), "local_hour")


@query
def local_calendar_dst(spark, sf_dir):
    from slotwise.functions.time import calendar

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    cal = calendar(spark, "2026-03-07", "2026-03-09", b.ZONE, 900).unionByName(calendar(spark, "2026-10-31", "2026-11-02", b.ZONE, 900))
    return cal.select(F.col("local_date").cast("string").alias("local_date"), "local_hour", "n_slots")


def _models(df):
    n = F.aggregate("distribution", F.lit(0).cast("bigint"), lambda a, d: a + d["n"])
    return df.select(
        "facility", F.col("local_date").cast("string").alias("local_date"), "local_hour", "state", "group", "hour_radius", "days", "eligible_days", "samples", "observed_slots", "expected_slots",
        F.round("coverage", 9).alias("coverage"), F.round("median", 6).alias("median"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.size("distribution").alias("n_values"), n.alias("n_distribution"),
    )


@query
def usual_models(spark, sf_dir):
    return _models(usual(spark, sf_dir))


@query
def usual_models_default_policy(spark, sf_dir):
    return _models(usual(spark, sf_dir, b.HOURLY.but(minimum_samples=64)))


@query
def compare_readings(spark, sf_dir):
    rows = compared(spark, sf_dir)
    return rows.select("facility", second("at").alias("at"), "value", "group", F.round("delta", 6).alias("delta"), F.round("percentile", 6).alias("percentile"), "unusual")


@query
def recent_trend(spark, sf_dir):
    rows = baseline.trend(b.slots(spark, sf_dir), b.HOURLY_TREND)
    return rows.select("facility", second("at").alias("at"), "value", "state", F.round("delta", 6).alias("delta"), "samples")


@query
def replay_summary(spark, sf_dir):
    return baseline.replay_summary(compared(spark, sf_dir))


@query
def threshold_sensitivity(spark, sf_dir):
    return baseline.sensitivity(compared(spark, sf_dir), [5, 10, 20], [5, 10, 20])


@query
def trend_reversals(spark, sf_dir):
    return baseline.reversals(baseline.trend(b.slots(spark, sf_dir), b.HOURLY_TREND), 7200)


@query
def supported_keys(spark, sf_dir):
    strict = usual(spark, sf_dir, b.HOURLY.but(minimum_samples=40, fallback_hour_radius=1))
    both = usual(spark, sf_dir).select("facility", "local_date", "local_hour", F.col("median").alias("delta")).unionByName(strict.select("facility", "local_date", "local_hour", F.col("median").alias("delta")))
    found = baseline.supported_by_all(both, ["facility", "local_date", "local_hour"], 2)
    return found.select("facility", F.col("local_date").cast("string").alias("local_date"), "local_hour")


@query
def model_groups(spark, sf_dir):
    return usual(spark, sf_dir).groupBy("facility", "group", "state").agg(F.count(F.lit(1)).alias("models"))


@query
def history_points(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(generated(spark, sf_dir)))
    rows = baseline.history_points(compared(spark, sf_dir), usual(spark, sf_dir), now)
    return rows.select("facility", second("at").alias("at"), "value", *[F.round(c, 6).alias(c) for c in ("median", "low", "high", "delta", "percentile")], "days", F.round("coverage", 9).alias("coverage"), "group")


@query
def collection_latency(spark, sf_dir):
    found = b.readings(spark, sf_dir).withColumn("latency_ms", F.col("pos") % 997)
    known = b.event_registry(found).select("facility").unionByName(spark.createDataFrame([("absent",)], "facility string"))
    return baseline.latency(found, known, F.timestamp_seconds(F.lit(generated(spark, sf_dir)))).select("facility", "samples", F.round("median_ms", 6).alias("median_ms"), F.round("p95_ms", 6).alias("p95_ms"))


@query
def movement_stability(spark, sf_dir):
    rows = movement.stability(movement.changes(b.slots(spark, sf_dir), b.local_calendar(spark, sf_dir), b.MOVES), b.MOVES)
    return rows.select("facility", "horizon_minutes", "pairs", "days", *[F.round(c, 6).alias(c) for c in ("median_abs_change", "p90_abs_change", "rise_share", "fall_share")])


@query
def movement_pairs(spark, sf_dir):
    rows = movement.changes(b.slots(spark, sf_dir), b.local_calendar(spark, sf_dir), b.MOVES)
    return rows.select("facility", "horizon_minutes", second("at").alias("at"), "change")


@query
def recent_stability(spark, sf_dir):
    """Movement over the complete local days before the last one."""
    now = F.timestamp_seconds(F.lit(generated(spark, sf_dir)))
    rows = movement.stability(movement.changes(movement.complete_days(b.slots(spark, sf_dir), now, b.MOVES), b.local_calendar(spark, sf_dir), b.MOVES), b.MOVES)
    return rows.select("facility", "horizon_minutes", "pairs", "days", *[F.round(c, 6).alias(c) for c in ("median_abs_change", "p90_abs_change", "rise_share", "fall_share")])


@query
def heatmap_cells(spark, sf_dir):
    rows = compared(spark, sf_dir)
    out = views.heatmap(rows, b.slots(spark, sf_dir), generated(spark, sf_dir), 72)
    return out.select("facility", "bin", "readings", F.round("delta", 6).alias("delta"), "band")


@query
def heatmap_summary(spark, sf_dir):
    return views.heatmap_summary(views.heatmap(compared(spark, sf_dir), b.slots(spark, sf_dir), generated(spark, sf_dir), 72)).withColumn("largest", F.round("largest", 6))


@query
def map_snapshot(spark, sf_dir):
    now = generated(spark, sf_dir)
    start, end, size = views.window(now, 72)
    cells = views.heatmap(compared(spark, sf_dir), b.slots(spark, sf_dir), now, 72)
    here = b.event_registry(b.readings(spark, sf_dir)).select("facility", F.when(F.col("pos") != 1, F.col("pos") + 30.0).alias("latitude"), F.lit(-90.0).alias("longitude"))
    shown = start + size * views.resolve_index((end - start) // size, start, size, end - 7200, False)
    # The places of one region publish no waiting time.
    return views.snapshot(cells, shown, here, b.registry(spark, sf_dir).where("region = 'ASIA'"))


def _members(spark, sf_dir):
    places_ = b.event_places(spark, sf_dir)
    return places.area_members(places.areas(places_, places.neighbour_groups(places_, 50)), places_)


@query
def area_counts(spark, sf_dir):
    return views.area_counts(stated(spark, sf_dir), _members(spark, sf_dir), generated(spark, sf_dir), 168)


@query
def area_tallies(spark, sf_dir):
    return views.area_tallies(stated(spark, sf_dir), _members(spark, sf_dir), generated(spark, sf_dir), 168)


@query
def typical_area_count(spark, sf_dir):
    return views.typical_count(views.area_counts(stated(spark, sf_dir), _members(spark, sf_dir), generated(spark, sf_dir), 168))


@query
def area_now(spark, sf_dir):
    """The latest readings against their usual, by area; a reading of the last two hours is current."""
    now = F.timestamp_seconds(F.lit(b.span(spark, sf_dir).end))
    rows = stated(spark, sf_dir)
    last = rows.groupBy("facility").agg(F.max_by(F.struct("at", "value", "unusual"), "at").alias("r"))
    current = F.unix_micros(now) - F.unix_micros("r.at") < b.FRESH.stale_after_seconds * 1_000_000
    return views.area_now(last.select("facility", current.alias("current"), "r.value"), last.select("facility", "r.unusual"), _members(spark, sf_dir))


@query
def batch_gaps(spark, sf_dir):
    return views.gaps(b.readings(spark, sf_dir), 1200).select(second("from").alias("from"), second("to").alias("to"), "seconds")


@query
def gap_segments(spark, sf_dir):
    rows = views.segments(b.readings(spark, sf_dir), 3600)
    return rows.select("facility", second("start").alias("start"), second("end").alias("end"), "readings")


@query
def axis_range(spark, sf_dir):
    rows = views.visible_range(b.slots(spark, sf_dir), F.timestamp_seconds(F.lit(b.span(spark, sf_dir).end - 3 * 86400)), F.timestamp_seconds(F.lit(b.span(spark, sf_dir).end - 86400)), 7200)
    return rows.select("facility", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query
def axis_ticks(spark, sf_dir):
    return views.ticks(generated(spark, sf_dir), 168, 4, b.ZONE, spark).withColumn("hours", F.lit(168)).unionByName(views.ticks(generated(spark, sf_dir), 24, 4, b.ZONE, spark).withColumn("hours", F.lit(24)))


@query
def latest_wins(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", F.floor("value").cast("int").alias("value"))
    return dedup.latest_by_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query
def duplicate_counters(spark, sf_dir):
    rows = b.readings(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "at"))
    return dedup.duplicate_counts(rows, ["facility", "hour"], ["at", "pos"], ["pos"], ["value"])


@query
def first_of_hour(spark, sf_dir):
    return dedup.first_per_hour(b.readings(spark, sf_dir)).select("facility", second("hour").alias("hour"), second("at").alias("at"), "value")


@query
def latest_of_bin(spark, sf_dir):
    return dedup.latest_per_bin(b.readings(spark, sf_dir).select("facility", "at", "pos", "value"), 4 * 3600).select("facility", "bin", "pos", "value")


@query
def live_merge(spark, sf_dir):
    rows = b.readings(spark, sf_dir).select("facility", "at", "value")
    end = b.span(spark, sf_dir).end
    live = rows.where(second("at") >= end - 2 * 86400).withColumn("value", F.col("value") + 1)
    return dedup.merge_live(rows.where(second("at") < end - 86400), live, 3600).select("facility", "slot", second("at").alias("at"), "value")


@query
def registry_coverage(spark, sf_dir):
    found = b.readings(spark, sf_dir)
    known = b.event_registry(found).where("pos > 0").select("facility").unionByName(spark.createDataFrame([("absent",)], "facility string"))
    return history.coverage(found, known)


@query
def unknown_facilities(spark, sf_dir):
    found = b.readings(spark, sf_dir)
    return history.unknown_facilities(found, b.event_registry(found).where("pos > 1").select("facility"))


def _entries(spark, sf_dir):
    found = b.readings(spark, sf_dir)
    cut = F.timestamp_seconds(F.lit(b.span(spark, sf_dir).end - 5 * 3600))
    kind = "facility string, success struct<at:timestamp,batch:timestamp,value:int>, attempt struct<batch:timestamp,state:string,error_code:string>"
    start = latest.merge(spark.createDataFrame([], kind), found.where(F.col("at") < cut), found.limit(0).select("facility", "batch", F.lit("").alias("state"), F.lit("").alias("error_code")), b.event_registry(found))
    tried = found.where(F.col("at") >= cut).groupBy("facility").agg(F.max("batch").alias("batch")).select("facility", "batch", F.when(F.col("facility") < "f", "failed").otherwise("success").alias("state"), F.when(F.col("facility") < "f", "request_failed").alias("error_code"))
    known = b.event_registry(found).select("facility").unionByName(spark.createDataFrame([("absent",)], "facility string"))
    return latest.merge(start.select("facility", "success", "attempt"), found.where((F.col("at") >= cut) & (F.col("facility") >= "f")), tried, known)


@query
def latest_state(spark, sf_dir):
    return latest.freshness(_entries(spark, sf_dir), F.timestamp_seconds(F.lit(b.span(spark, sf_dir).end)), b.FRESH).select("facility", second("at").alias("at"), "value", "state", F.round("age_seconds", 3).alias("age_seconds"), "current", "labels")


@query
def latest_health(spark, sf_dir):
    return latest.health(_entries(spark, sf_dir), F.timestamp_seconds(F.lit(b.span(spark, sf_dir).end)), b.FRESH).withColumn("last_success_at", second("last_success_at"))


@query
def place_distances(spark, sf_dir):
    rows = places.pairs(b.registry(spark, sf_dir))
    return rows.select("a", "b", F.round("km", 6).alias("km"), places.distance_band(F.col("km"), 50, 150).alias("band"))


@query
def place_separation(spark, sf_dir):
    r = b.registry(spark, sf_dir)
    return r.select("facility", F.round(distance_m(F.col("latitude"), F.col("longitude"), F.lit(35.0), F.lit(-90.0)), 3).alias("meters"))


@query
def neighbour_groups(spark, sf_dir):
    return places.neighbour_groups(b.registry(spark, sf_dir), 50)


@query
def area_groups(spark, sf_dir):
    r = b.registry(spark, sf_dir)
    return places.areas(r, places.neighbour_groups(r, 50))


def _registry_rows(spark, sf_dir):
    k = F.col("pos")
    point = lambda off: F.struct((F.col("latitude") + off).alias("latitude"), F.col("longitude").alias("longitude"), F.lit("x").alias("label"), F.when(k % 7 != 3, "https://example.org").otherwise("").alias("source_url"))
    entrance = F.when(k % 5 == 0, F.struct((F.col("latitude") + k / 2000).alias("latitude"), F.col("longitude").alias("longitude"), F.lit("e").alias("label"), F.lit("https://example.org").alias("source_url"), F.lit("site_visit").alias("method"), F.lit("2024-01-02").alias("reviewed_on")))
    return b.registry(spark, sf_dir).select(
        F.col("facility").alias("slug"), k.alias("pos"), (k % 11 != 1).alias("collection_enabled"), F.when(k % 13 != 2, "active").otherwise("closed").alias("active_status"),
        F.array(F.lit("general_emergency")).alias("service_applicability"), F.when(k % 6 != 4, F.array(F.lit("adult"), F.lit("child"))).otherwise(F.array(F.lit("child"))).alias("age_applicability"),
        F.when(k % 9 != 5, F.date_sub(F.lit("2024-01-31").cast("date"), k * 4).cast("string")).alias("travel_verified_on"), point(0.0).alias("campus_point"), entrance.alias("emergency_entrance"),
    )


@query
def destination_eligibility(spark, sf_dir):
    rows = _registry_rows(spark, sf_dir)
    return rows.select("slug", places.refusal("adult", F.lit("2024-01-31").cast("date")).alias("reason"), places.arrival_point()["kind"].alias("arrival"))


@query
def place_features(spark, sf_dir):
    return places.features(_registry_rows(spark, sf_dir)).select("slug", "kind", F.get_json_object("feature", "$.geometry.coordinates[1]").cast("double").alias("latitude"))


@query
def entrance_review(spark, sf_dir):
    return places.review_rows(_registry_rows(spark, sf_dir)).select("slug", "pos", F.round("latitude", 6).alias("latitude"), "method", "reviewed_on", F.round("meters", 3).alias("meters"))


@query
def travel_comparison(spark, sf_dir):
    routes = b.routes(spark, sf_dir).select("origin", F.col("facility").alias("slug"), F.when((F.col("o") % 3 == 2) & (F.col("pos") == 3), "failed").otherwise("ok").alias("status"), (600 + F.col("o") * 300 + F.col("pos") * 900).alias("seconds"))
    found = b.slots(spark, sf_dir)
    now = latest.newest(b.readings(spark, sf_dir)).select("facility", "success.value")
    complete = movement.complete_days(found, F.timestamp_seconds(F.lit(generated(spark, sf_dir))), b.MOVES)
    moves = movement.travel_screen(movement.changes(complete, b.local_calendar(spark, sf_dir), b.MOVES), b.MOVES)
    rows = places.compare_travel(routes, now, moves, b.MOVES.horizons_minutes)
    return places.ranked(rows.select("origin", "slug", "drive", "wait", F.round("total", 6).alias("total"), "horizon_minutes", F.round("p90", 6).alias("p90"), "closest"), "total")


@query
def order_rank_ties(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    return stats.with_average_rank(rows, "q", ["l_returnflag", "l_linenumber"], "place").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.sum("place").alias("total"))


@query
def false_discovery(spark, sf_dir):
    rows = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("family"), F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") * 7919 % 1000 + 1) / 20000.0).alias("p"))
    return stats.benjamini_hochberg(rows, "p", "k", ["family"]).select("k", "family", F.round("q", 9).alias("q"))


@query
def value_spread(spark, sf_dir):
    return stats.spread(b.readings(spark, sf_dir), "value", ["facility"])


@query
def lower_medians(spark, sf_dir):
    return b.readings(spark, sf_dir).groupBy("facility", local_date(F.col("at"), b.ZONE).cast("string").alias("local_date")).agg(stats.lower_median("value").alias("low"), stats.median("value").alias("mid"))


@query
def argmin_argmax(spark, sf_dir):
    return b.readings(spark, sf_dir).groupBy("facility").agg(F.min_by("pos", F.struct("value", "pos")).alias("least"), F.max_by("pos", F.struct("value", "pos")).alias("most"))


@query
def value_distribution(spark, sf_dir):
    return b.readings(spark, sf_dir).groupBy("facility", "value").count().withColumnRenamed("count", "n")


@query
def local_parts(spark, sf_dir):
    at = F.col("at")
    return b.readings(spark, sf_dir).groupBy(local_hour(at, b.ZONE).alias("local_hour"), weekend(local_date(at, b.ZONE)).alias("weekend")).agg(F.count(F.lit(1)).alias("n"))


@query
def zero_share(spark, sf_dir):
    return association.zero_share(b.readings(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 20)), 0.1)


def _series(spark, sf_dir):
    return association.deviations(compared(spark, sf_dir), b.PAIRS)


@query
def hourly_deviations(spark, sf_dir):
    return _series(spark, sf_dir).select("facility", "bin", F.round("deviation", 6).alias("deviation"))


@query
def deviation_changes(spark, sf_dir):
    return association.changes(_series(spark, sf_dir), b.PAIRS).select("facility", "bin", F.round("deviation", 6).alias("deviation"))


@query
def demeaned_deviations(spark, sf_dir):
    return association.without_hours(_series(spark, sf_dir), b.PAIRS).select("facility", "bin", F.round("deviation", 6).alias("deviation"))


@query
def pair_episodes(spark, sf_dir):
    found = b.event_registry(b.readings(spark, sf_dir))
    return association.episodes(_series(spark, sf_dir), places.name_pairs(found), 0, b.PAIRS)


@query
def pair_tests(spark, sf_dir):
    rows = association.period_tests(_series(spark, sf_dir), b.event_registry(b.readings(spark, sf_dir)), b.PAIRS)
    numbers = ("r", "n_eff", "p", "system_r", "system_p", "residual_r", "residual_p", "q", "reverse_r")
    return association.is_candidate(rows, b.PAIRS).select(*association.KEY, "bins", "days", "state", *[F.round(c, 6).alias(c) for c in numbers], "robust", "dominant", "candidate")


@query
def pair_correlations(spark, sf_dir):
    series = _series(spark, sf_dir)
    tests = association.tests_of(b.event_registry(b.readings(spark, sf_dir)), b.PAIRS).where("family = 'co_deviation'")
    return association.correlate(association.aligned(series, tests, b.PAIRS), b.PAIRS).select("leader", "follower", "n", F.round("r", 6).alias("r"))


@query
def pair_effects(spark, sf_dir):
    """The parts of every pair test that need no error function."""
    rows = association.period_tests(_series(spark, sf_dir), b.event_registry(b.readings(spark, sf_dir)), b.PAIRS)
    return rows.select(*association.KEY, "bins", "days", "state", *[F.round(c, 6).alias(c) for c in ("r", "n_eff", "system_r", "residual_r", "reverse_r")])


@query
def pair_bootstrap(spark, sf_dir):
    tests = association.tests_of(b.event_registry(b.readings(spark, sf_dir)), b.PAIRS).where("family = 'co_deviation'")
    found = association.bootstrap(association.aligned(_series(spark, sf_dir), tests, b.PAIRS), b.PAIRS)
    return found.select(*association.KEY, F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _study(spark, sf_dir):
    """Discovery in the first half of the days with usual values, confirmation in the rest."""
    series = cut(_series(spark, sf_dir))
    low, high = series.agg(F.min("bin"), F.max("bin")).first()
    middle = 0 if low is None else (low + (high - low) // 2) // 86400 * 86400
    found = b.event_registry(b.readings(spark, sf_dir))
    places_ = b.event_places(spark, sf_dir)
    km = places.pairs(places_).withColumn("band", places.distance_band(F.col("km"), b.STUDY.neighbor_km, b.STUDY.far_km))
    start, end = (0, 0) if low is None else (low, high + b.STUDY.bin_seconds)
    zeros = association.zero_heavy(b.slots(spark, sf_dir).where("value >= 0"), start, middle, end, b.STUDY.zero_heavy_share)
    return association.study(series.where(F.col("bin") < middle), series.where(F.col("bin") >= middle), found, km, zeros, b.STUDY)


@query
def pair_study(spark, sf_dir):
    rows = _study(spark, sf_dir)[0]
    return rows.select(*association.KEY, "label", "band", *[F.round(c, 6).alias(c) for c in ("r", "q", "later_r", "confirmation_q", "discovery_low", "discovery_high", "confirmation_low", "confirmation_high")])


@query
def pair_families(spark, sf_dir):
    tests = _study(spark, sf_dir)[2]
    return tests.groupBy("period", "family").agg(F.count(F.lit(1)).alias("pairs"), F.count("p").alias("tested"), F.count_if("candidate").alias("candidates"))


@query
def series_support(spark, sf_dir):
    found = b.readings(spark, sf_dir)
    rows = association.series_support(_series(spark, sf_dir), association.zero_share(found), b.event_registry(found), b.PAIRS)
    return rows.select("facility", "bins", F.round("zero_share", 9).alias("zero_share"), F.round("lag1", 6).alias("lag1"))


@query
def pair_bands(spark, sf_dir):
    found = b.event_registry(b.readings(spark, sf_dir))
    rows = association.period_tests(_series(spark, sf_dir), found, b.PAIRS)
    pairs = found.alias("x").join(found.alias("y"), F.col("x.pos") < F.col("y.pos")).select(F.col("x.facility").alias("a"), F.col("y.facility").alias("b"), places.distance_band((F.col("y.pos") - F.col("x.pos")) * 45.0, 50, 150).alias("band"))
    return association.band_summary(rows, pairs, b.PAIRS)


@query
def forecast_grid(spark, sf_dir):
    return dedup.forecast_grid(b.readings(spark, sf_dir), b.CADENCE)


MODELS = forecast.MODELS


def phase(spark, sf_dir, name="development"):
    """Replays begin after fifteen days, and their origins are scored from three days later to the end of the readings."""
    s = b.span(spark, sf_dir)
    first = s.start // 86400 * 86400
    return studies.Phase(name, first + 15 * 86400, first + 18 * 86400, s.end)


def _grid(spark, sf_dir):
    return dedup.forecast_grid(b.readings(spark, sf_dir), b.CADENCE)


def _usual(spark, sf_dir):
    """The usual medians of asked targets, from the grid's own winners."""
    won = b.slot_winners(b.readings(spark, sf_dir).where("value >= 0"), b.CADENCE, b.ZONE)
    return lambda asked, delay=0: forecast.usual_medians(won, b.local_calendar(spark, sf_dir), asked, b.REPLAY, b.HOURLY, delay)


def _replay(spark, sf_dir, delay=0):
    grid, p = _grid(spark, sf_dir), phase(spark, sf_dir)
    asked = forecast.origins(grid, p.warm, p.end, b.REPLAY)
    return forecast.replay(grid, _usual(spark, sf_dir)(asked, delay), p.warm, p.end, b.REPLAY, delay)


@query
def forecast_replay(spark, sf_dir):
    return _replay(spark, sf_dir)


@query
def forecast_replay_delayed(spark, sf_dir):
    return _replay(spark, sf_dir, 1)


def _long(spark, sf_dir):
    return forecast.long_form(_replay(spark, sf_dir))


@query
def forecast_scores(spark, sf_dir):
    return forecast.score_models(_long(spark, sf_dir)).drop("place")


@query
def forecast_winners(spark, sf_dir):
    return forecast.winners(forecast.score_models(_long(spark, sf_dir)))


@query
def forecast_intervals(spark, sf_dir):
    rows = forecast.intervals(_long(spark, sf_dir), b.REPLAY).where("lo_80 IS NOT NULL")
    return rows.select("facility", "origin", "horizon_minutes", "model", *[F.round(c, 6).alias(c) for c in ("lo_80", "hi_80", "lo_95", "hi_95")])


@query
def forecast_interval_scores(spark, sf_dir):
    return forecast.score(forecast.intervals(_long(spark, sf_dir), b.REPLAY), ["facility", "horizon_minutes", "model"], b.REPLAY)


def _chosen(spark, sf_dir, rows):
    """Carry-forward against the median of the usual, for every facility and horizon."""
    return rows.select("facility", "horizon_minutes").distinct().select("*", F.lit("carry_forward").alias("benchmark"), F.lit("m1_median").alias("candidate"))


@query
def forecast_gain(spark, sf_dir):
    rows = _long(spark, sf_dir)
    found = forecast.bootstrap_gain(forecast.paired(rows, _chosen(spark, sf_dir, rows)), b.REPLAY)
    return found.select("facility", "horizon_minutes", *[F.round(c, 6).alias(c) for c in ("gain", "gain_low", "gain_high")])


@query
def forecast_gate_scores(spark, sf_dir):
    rows = forecast.intervals(_long(spark, sf_dir), b.REPLAY)
    return forecast.gate_scores(rows, _chosen(spark, sf_dir, rows), b.REPLAY)


def _phase(spark, sf_dir):
    """The phase, bound to what the readings are and not to where they lie."""
    grid = _grid(spark, sf_dir)
    return studies.run_phase(phase(spark, sf_dir), grid, _usual(spark, sf_dir), b.REPLAY, history.identity(grid))


@query
def forecast_gates(spark, sf_dir):
    """The decisions of a development phase over all benchmarks and fitted candidates."""
    return _phase(spark, sf_dir)[0]


@query
def candidate_fits(spark, sf_dir):
    return _phase(spark, sf_dir)[2]


@query
def model_candidates(spark, sf_dir):
    p = phase(spark, sf_dir)
    rows, _ = models.replay_candidates(_grid(spark, sf_dir), p.warm, p.end, b.REPLAY)
    return rows.withColumn("prediction", F.round("prediction", 6))


@query
def profile_forecasts(spark, sf_dir):
    p = phase(spark, sf_dir)
    rows = models.replay_profile(_grid(spark, sf_dir), p.warm, p.end, b.REPLAY)
    return rows.withColumn("prediction", F.round("prediction", 6))


@query
def training_support(spark, sf_dir):
    p = phase(spark, sf_dir)
    return models.trimmed(models.windows(_grid(spark, sf_dir), p.warm, p.end, b.REPLAY), b.REPLAY)[1]


@query
def seasonal_autocorrelation(spark, sf_dir):
    return forecast.seasonal(dedup.forecast_grid(b.readings(spark, sf_dir), b.CADENCE), [1, 4, 24, 168], b.CADENCE)


@query
def seasonal_variance(spark, sf_dir):
    rows = b.slots(spark, sf_dir).withColumn("weekend", weekend(F.col("local_date")))
    return forecast.explained(rows, ["local_hour"], "by_hour").join(forecast.explained(rows, ["local_hour", "weekend"], "by_hour_and_day"), "facility")


def benefit_spans(spark, sf_dir):
    """Discovery from the twelfth day on, confirmation from the twenty-first to the end of the readings."""
    s = b.span(spark, sf_dir)
    first = s.start // 86400 * 86400
    middle = first + 21 * 86400
    return {"discovery": (first + 12 * 86400, middle), "confirmation": (middle, max(middle, s.end))}


def _opportunities(spark, sf_dir):
    found = b.slots(spark, sf_dir)
    moves = movement.changes(found, b.local_calendar(spark, sf_dir), b.MOVES)
    days = found.select(F.col("local_date").alias("day")).distinct()
    screens = movement.daily_screens(moves, days, b.MOVES)
    seconds = F.create_map(F.lit("night"), F.col("base"), F.lit("am"), F.col("base") + 600, F.lit("pm"), F.col("base") + 300)
    routes = b.routes(spark, sf_dir).withColumn("base", 900 + (F.col("o") * 7 + F.col("pos") * 5) % 9 * 600).select("origin", F.col("facility").alias("slug"), seconds.alias("seconds"))
    end = b.span(spark, sf_dir).end
    return {name: benefit.opportunities(found, screens, routes, first, last, end, b.MOVES.horizons_minutes, b.RULES) for name, (first, last) in benefit_spans(spark, sf_dir).items()}


@query
def benefit_opportunities(spark, sf_dir):
    parts = _opportunities(spark, sf_dir)
    rows = parts["discovery"].unionByName(parts["confirmation"])
    return rows.select("origin", "slot", F.col("day").cast("string").alias("day"), "profile", "closest", "alternative", *[F.round(c, 6).alias(c) for c in ("drive_c", "drive_a", "p90_c", "p90_a", "D", "A", "A60", "A_stress")])


@query
def benefit_rules(spark, sf_dir):
    return studies.benefit_periods(_opportunities(spark, sf_dir), b.RULES).drop("low", "high")


@query
def benefit_intervals(spark, sf_dir):
    rows = studies.benefit_periods(_opportunities(spark, sf_dir), b.RULES).where("origin = 'all'")
    return rows.select("period", "rule", "claims", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query
def benefit_selection(spark, sf_dir):
    found = studies.benefit_decision(studies.benefit_periods(_opportunities(spark, sf_dir), b.RULES), b.RULES)
    return found.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query
def page_text(spark, sf_dir):
    p = b.table(spark, sf_dir, "pages").select("page_id", pages.page_parts(F.col("html")).alias("p"))
    return p.select("page_id", F.length("p.text").alias("chars"), F.size("p.headings").alias("headings"), F.size("p.hidden").alias("hidden"))


@query
def scraped_numbers(spark, sf_dir):
    rows = b.table(spark, sf_dir, "pages").select("page_id", parsers.published_minutes(F.col("url"), r"\?page=(-?\d+)").alias("m"))
    return rows.select("page_id", "m.status", "m.minutes")


@query
def json_property(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return rows.select("event_id", parsers.upstream_integer(F.col("k")).alias("k"))


@query
def top_pairs_by_route(spark, sf_dir):
    o, c = b.table(spark, sf_dir, "orders"), b.table(spark, sf_dir, "customer")
    met = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.min("o_orderkey").alias("first"))
    return met.orderBy(F.desc("orders"), "c_nationkey", "o_orderpriority").limit(20)


def _store(spark, sf_dir):
    """A history folder of the events: raw lines by day, of which the first closed day is compacted; and the compacted fingerprints."""
    root = f"{shared_dir(spark)}/slotwise/history-{uuid.uuid4().hex}"
    rows = b.readings(spark, sf_dir)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    records = rows.select("facility", F.lit("wait").alias("metric"), F.col("value").alias("wait_minutes"), iso(F.col("at")).alias("observed_at"), iso(F.col("batch")).alias("batch_id"), (F.col("pos") % 997).cast("int").alias("latency_ms"))
    history.write_raw(records, root, "wait")
    day = str(rows.agg(F.min(F.to_date("batch"))).first()[0])
    said = history.compact(spark, root, "wait", day)
    return root, spark.createDataFrame([(day, said)], "d string, fingerprint string").select(F.col("d").cast("date").alias("dt"), "fingerprint")


def _loaded(spark, sf_dir):
    root, said = _store(spark, sf_dir)
    s = b.span(spark, sf_dir)
    at = lambda k: F.timestamp_seconds(F.lit(k))
    return history.load(spark, root, "wait", at(s.start // 86400 * 86400), at(s.end), at(s.end), said, "wait")


@query
def history_records(spark, sf_dir):
    records = _loaded(spark, sf_dir)[0]
    return records.select(F.unix_micros("batch").alias("batch"), "facility", F.unix_micros("observed").alias("observed"), "wait_minutes", "latency_ms")


@query
def history_counters(spark, sf_dir):
    _, counts, issues, _ = _loaded(spark, sf_dir)
    return counts.select("duplicate_records", "rejected_records").crossJoin(issues.agg(F.count(F.lit(1)).alias("issues")))


@query
def history_partitions(spark, sf_dir):
    return _loaded(spark, sf_dir)[3].select(F.col("dt").cast("string").alias("dt"), "source", "completeness")


@query
def collection_summary(spark, sf_dir):
    """Attempts of every batch, as one run: a facility without a reading in the last batch has failed."""
    found = b.readings(spark, sf_dir)
    last = found.agg(F.max("batch").alias("batch"))
    rows = found.join(F.broadcast(last), "batch").select("facility", F.lit("wait").alias("metric"), F.when(F.col("value") >= 0, "available").otherwise("invalid").alias("status"), F.lit(None).cast("string").alias("detail"), F.lit("ok").alias("outcome"), F.lit(None).cast("int").alias("http_status"))
    return parsers.run_summary(parsers.attempts(b.event_registry(found), rows, "wait"), rows)


@query
def route_changes(spark, sf_dir):
    r = b.routes(spark, sf_dir)
    run = lambda k: r.where((F.col("o") + F.col("pos")) % k != 0).select("origin", F.col("facility").alias("slug"), (600 + F.col("o") * 60 * k + F.col("pos") * 900).alias("seconds"))
    return parsers.route_changes(run(5), run(7)).withColumn("ratio", F.round("ratio", 9))
