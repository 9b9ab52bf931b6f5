"""Rows that win: latest by key, by slot, by hour. Ties are broken by an explicit order, never by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.time import local_date, local_hour, slot, slot_end


def latest_by_key(rows: DataFrame, key: list[str], rank: list[str]) -> DataFrame:
    """For each key, the row of the highest rank."""
    everything = F.struct(*rows.columns)
    return rows.groupBy(*key).agg(F.max_by(everything, F.struct(*rank)).alias("row")).select("row.*")


def duplicate_counts(rows: DataFrame, key: list[str], rank: list[str], scan: list[str], content: list[str]) -> DataFrame:
    """One row: records beyond the first of their key, and records that differ from the winner so far, in scan order."""
    before = Window.partitionBy(*key).orderBy(*scan).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.select(F.struct(*content).alias("now"), F.max_by(F.struct(*content), F.struct(*rank)).over(before).alias("winner"))
    return marked.agg(F.count("winner").alias("duplicate_records"), F.count_if(F.col("winner").isNotNull() & (F.col("winner") != F.col("now"))).alias("conflicting_duplicates"))


def slot_winners(readings: DataFrame, cadence: int, zone: str) -> DataFrame:
    """(facility, slot, at, value, local_date, local_hour): the reading of the highest (at, batch, value) in each slot."""
    won = readings.groupBy("facility", slot(F.col("at"), cadence).alias("slot")).agg(F.max(F.struct("at", "batch", "value")).alias("w"))
    return won.select("facility", "slot", F.col("w.at").alias("at"), F.col("w.value").alias("value"), local_date(F.col("w.at"), zone).alias("local_date"), local_hour(F.col("w.at"), zone).alias("local_hour"))


def forecast_grid(readings: DataFrame, cadence: int) -> DataFrame:
    """(facility, slot_end, value, collisions) of non-negative readings; slots are labelled by their end."""
    kept = readings.where("value >= 0")
    won = kept.groupBy("facility", slot_end(F.col("at"), cadence).alias("slot_end")).agg(F.max(F.struct("at", "batch", "value")).alias("w"), (F.count(F.lit(1)) - 1).alias("collisions"))
    return won.select("facility", "slot_end", F.col("w.value").alias("value"), "collisions")


def first_per_hour(readings: DataFrame) -> DataFrame:
    """The first reading of each facility and UTC hour."""
    return readings.groupBy("facility", F.date_trunc("hour", "at").alias("hour")).agg(F.min_by(F.struct("at", "value"), F.struct("at", "batch", "value")).alias("r")).select("facility", "hour", "r.*")


def latest_per_bin(points: DataFrame, bin_seconds: int) -> DataFrame:
    """The last point of each facility in each bin; bins are named by their first epoch second."""
    start = F.floor(F.unix_micros("at") / (bin_seconds * 1_000_000)).cast("bigint") * bin_seconds
    others = [c for c in points.columns if c != "facility"]
    return points.groupBy("facility", start.alias("bin")).agg(F.max(F.struct("at", *[c for c in others if c != "at"])).alias("p")).select("facility", "bin", "p.*")


def merge_live(prepared: DataFrame, live: DataFrame, cadence: int) -> DataFrame:
    """Live readings added to a prepared history: the prepared row wins at an equal instant, the latest in a slot."""
    both = prepared.withColumn("origin", F.lit(1)).unionByName(live.withColumn("origin", F.lit(0)))
    once = latest_by_key(both, ["facility", "at"], ["origin", "value"])
    return latest_by_key(once.withColumn("slot", slot(F.col("at"), cadence)), ["facility", "slot"], ["at", "value"]).drop("origin")

