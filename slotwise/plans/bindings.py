"""Bindings of the engine's roles to tables: readings from events, the registry from nations."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions.time import calendar, local_date
from slotwise.operators.dedup import slot_winners
from slotwise.operators.places import small
from slotwise.policy import ZONE, Association, Baseline, Benefit, Forecast, Freshness, Movement

CADENCE = 3600
HOURLY = Baseline(cadence_seconds=CADENCE, minimum_samples=24)
HOURLY_TREND = HOURLY.but(trend_minutes=180, trend_tolerance_minutes=90, gap_seconds=5400)
MOVES = Movement(horizons_minutes=(60, 120, 240), cadence_seconds=CADENCE, gap_seconds=7200, tolerance_seconds=1800)
PAIRS = Association(minimum_slots=1, minimum_bins=60, minimum_days=7, minimum_day_bins=6, minimum_others=3, lags=(1, 2, 3))
#: Both periods of the study lie in the few days for which usual values are supported.
STUDY = replace(PAIRS, minimum_bins=48, minimum_days=2)
REPLAY = Forecast(cadence_seconds=CADENCE, horizons_minutes=(60, 120, 180, 240), origin_seconds=3600, daily_slots=24, weekly_slots=168, minimum_errors=20, minimum_training_slots=200, minimum_training_coverage=0.5, minimum_matched=30, minimum_days=5)
RULES = Benefit(slot_seconds=CADENCE, evaluation_every_slots=1, minimum_claims=20, minimum_days=3, minimum_precision=0.25, minimum_lower_bound=0.2, confirmation_claims=10, confirmation_days=2, confirmation_precision=0.25)
FRESH = Freshness(stale_after_seconds=7200)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(facility, at, batch, value, pos) of every event; the session's zone is set to UTC, as all instants are."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("facility"), at.alias("at"), F.window(at, "15 minutes")["start"].alias("batch"), F.floor("value").cast("int").alias("value"), F.col("event_id").alias("pos")
    )


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_winners(readings(spark, sf_dir), CADENCE, ZONE)


class Span(NamedTuple):
    """What the readings of a table cover: the local days of the first and the last, and the hours around them as epoch seconds."""

    first: date
    last: date
    start: int
    end: int


def span(spark: SparkSession, sf_dir: str) -> Span:
    """The span of the readings, from one aggregate of two values; a table without readings has the day of the epoch."""
    at = F.col("at")
    low, high = readings(spark, sf_dir).agg(F.min(F.struct(F.unix_seconds(at).alias("s"), local_date(at, ZONE).alias("d"))), F.max(F.struct(F.unix_seconds(at).alias("s"), local_date(at, ZONE).alias("d")))).first()
    if low is None:
        return Span(date(1970, 1, 1), date(1970, 1, 1), 0, CADENCE)
    return Span(low.d, high.d, low.s // CADENCE * CADENCE, (high.s // CADENCE + 1) * CADENCE)


def local_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours of all local days with readings and of the days that their models look back on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    s = span(spark, sf_dir)
    return calendar(spark, str(s.first - timedelta(days=HOURLY.lookback_days)), str(s.last), ZONE, CADENCE)


def targets(found: DataFrame) -> DataFrame:
    """Every facility with each hour of every local day from its table's first to its last."""
    days = found.agg(F.min("local_date").alias("a"), F.max("local_date").alias("b"))
    spine = found.select("facility").distinct().crossJoin(F.broadcast(days)).where("a IS NOT NULL")
    dated = spine.select("facility", F.explode(F.sequence("a", "b")).alias("local_date"))
    return dated.select("facility", "local_date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("local_hour"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from nations, at coordinates derived from their keys."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    rows = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return rows.select(
        F.col("n_name").alias("facility"), k.cast("int").alias("pos"), F.col("r_name").alias("region"),
        (35 + (k % 5) * 0.25 + F.floor(k / 10) * 2.0).alias("latitude"), (-90 + F.floor(k / 5) * 0.45).alias("longitude"),
    )


def event_registry(found: DataFrame) -> DataFrame:
    """The facilities of the readings in alphabetical order, with their position. One row a facility is numbered."""
    names = found.select("facility").distinct()
    return names.select((F.row_number().over(Window.orderBy("facility")) - 1).alias("pos"), "facility")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, facility, o, pos): from every place of the registry to every facility, a route table of their product."""
    here = registry(spark, sf_dir).select(F.col("facility").alias("origin"), F.col("pos").alias("o"))
    there = event_registry(readings(spark, sf_dir))
    # A route table holds every pair; both sides are small dimensions, met on a constant key.
    return here.withColumn("k", F.lit(1)).join(small(there.withColumn("k", F.lit(1))), "k").drop("k")


def event_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facilities of the readings as places: the first three near each other, the rest far off, in two regions."""
    k = F.col("pos")
    return event_registry(readings(spark, sf_dir)).select("facility", "pos", F.when(k % 2 == 0, "North Side").otherwise("South Side").alias("region"), (35 + k * 0.3 + F.when(k > 2, 5.0).otherwise(0.0)).alias("latitude"), F.lit(-90.0).alias("longitude"))
