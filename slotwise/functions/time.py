"""Instants, slots and local calendars. The session time zone is UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """A timestamp from ISO text that states its offset; null for naive or malformed text."""
    aware = text.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$")
    return F.when(aware, F.try_to_timestamp(text))


def slot(at: Column, cadence: int) -> Column:
    """Number of the slot that begins at or before an instant."""
    return F.floor(F.unix_micros(at) / (cadence * 1_000_000)).cast("bigint")


def slot_end(at: Column, cadence: int) -> Column:
    """Epoch second that ends the slot of an instant: slots hold [end - cadence, end)."""
    return (slot(at, cadence) + 1) * cadence


def local(at: Column, zone: str) -> Column:
    return F.from_utc_timestamp(at, zone)


def local_date(at: Column, zone: str) -> Column:
    return F.to_date(local(at, zone))


def local_hour(at: Column, zone: str) -> Column:
    return F.hour(local(at, zone))


def weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def circular_hours(hour: Column, radius: int) -> Column:
    return F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda o: F.pmod(hour + o, F.lit(24)))


def calendar(spark: SparkSession, first: str, last: str, zone: str, cadence: int) -> DataFrame:
    """(local_date, local_hour, n_slots) for the local days ``first`` to ``last``.

    Slots are counted through the actual instants between local midnights, so days with a clock
    change have fewer or more of them.
    """
    bounds = spark.range(1).select(
        F.to_utc_timestamp(F.lit(first).cast("timestamp"), zone).alias("a"),
        F.to_utc_timestamp(F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"), zone).alias("b"),
    )
    slots = bounds.select(F.explode(F.sequence("a", F.col("b") - F.expr(f"interval {cadence} seconds"), F.expr(f"interval {cadence} seconds"))).alias("at"))
    return slots.groupBy(local_date(F.col("at"), zone).alias("local_date"), local_hour(F.col("at"), zone).alias("local_hour")).agg(F.count(F.lit(1)).alias("n_slots"))


def expected_slots(cal: DataFrame, hour: int, radius: int) -> DataFrame:
    """(local_date, expected): slots of each day within ``radius`` hours of ``hour``, around the clock."""
    hours = [(hour + o) % 24 for o in range(-radius, radius + 1)]
    return cal.where(F.col("local_hour").isin(hours)).groupBy("local_date").agg(F.sum("n_slots").alias("expected"))


def reference_window(now: Column, days: int, zone: str) -> tuple[Column, Column]:
    """Instants that bound the complete local days before today's."""
    today = local_date(now, zone)
    midnight = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    return midnight(F.date_sub(today, days)), midnight(today)
