"""Latest state by facility: monotonic merge, freshness, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.policy import Freshness


def newest(readings: DataFrame) -> DataFrame:
    """The latest reading of each facility; of equal instants the first in input order (pos)."""
    return readings.groupBy("facility").agg(F.max_by(F.struct("at", "batch", "value"), F.struct("at", -F.col("pos"))).alias("success"))


def merge(previous: DataFrame, readings: DataFrame, attempts: DataFrame, registry: DataFrame) -> DataFrame:
    """(facility, success, attempt, state): a success never moves back, nor does an attempt of an older batch.

    ``previous`` has facility, success, attempt; ``attempts`` facility, batch, state, error_code.
    """
    old = previous.select("facility", F.col("success").alias("old_success"), F.col("attempt").alias("old_attempt"))
    tried = attempts.groupBy("facility").agg(F.max_by(F.struct("batch", "state", "error_code"), "batch").alias("new_attempt"))
    rows = registry.select("facility").join(old, "facility", "left").join(newest(readings), "facility", "left").join(tried, "facility", "left")
    success = F.when(F.col("old_success").isNull() | (F.col("success.at") > F.col("old_success.at")), F.coalesce("success", "old_success")).otherwise(F.col("old_success"))
    attempt = F.when(F.col("old_attempt").isNull() | (F.col("new_attempt.batch") > F.col("old_attempt.batch")), F.coalesce("new_attempt", "old_attempt")).otherwise(F.col("old_attempt"))
    out = rows.select("facility", success.alias("success"), attempt.alias("attempt"))
    return out.withColumn("state", F.when(F.col("attempt.state") == "failed", "failed").when(F.col("success").isNotNull(), "reporting").otherwise("missing"))


def age(now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros("success.at")) / 1_000_000


def freshness(entries: DataFrame, now: Column, policy: Freshness) -> DataFrame:
    """Age, whether the reading is current, and its labels, at a time of reading."""
    seconds = age(now)
    current = F.coalesce((seconds >= 0) & (seconds < policy.stale_after_seconds), F.lit(False)) & (F.col("state") != "failed")
    labels = F.array_compact(F.array(F.when(seconds < 0, "clock_mismatch"), F.when(seconds >= policy.stale_after_seconds, "stale"), F.when(F.col("state") == "failed", "failed_attempt"), F.when(F.col("success").isNull(), "missing")))
    return entries.select("facility", F.col("success.at").alias("at"), F.col("success.value").alias("value"), "state", seconds.alias("age_seconds"), current.alias("current"), F.array_join(labels, ",").alias("labels"))


def health(entries: DataFrame, now: Column, policy: Freshness) -> DataFrame:
    """One row: configured, with_reading, failed, missing, current, status, last_success_at."""
    view = freshness(entries, now, policy)
    out = view.agg(
        F.count(F.lit(1)).alias("configured"), F.count("at").alias("with_reading"), F.count_if(F.col("state") == "failed").alias("failed_latest_attempt"),
        F.count_if(F.col("at").isNull()).alias("missing"), F.count_if("current").alias("fresh"), F.max("at").alias("last_success_at"),
    )
    return out.withColumn("status", F.when((F.col("configured") > 0) & (F.col("fresh") == F.col("configured")), "ok").when(F.col("fresh") > 0, "warn").otherwise("fail"))


def context_available(generated: Column, now: Column, zone: str) -> Column:
    """A context counts for two hours, and not past the next local midnight."""
    seconds = (F.unix_micros(now) - F.unix_micros(generated)) / 1_000_000
    same_day = F.to_date(F.from_utc_timestamp(generated, zone)) == F.to_date(F.from_utc_timestamp(now, zone))
    return (seconds >= 0) & (seconds < 7200) & same_day
