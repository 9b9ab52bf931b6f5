"""Movement: signed changes between readings a fixed horizon apart, never across a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.stats import quantile
from slotwise.functions.time import reference_window
from slotwise.operators.places import small
from slotwise.policy import Movement


def complete_days(slots: DataFrame, now: Column, policy: Movement) -> DataFrame:
    """The slots of the complete local days before that of ``now``, so that a day never describes itself."""
    start, end = reference_window(now, policy.lookback_days, policy.zone)
    return slots.where((F.col("at") >= start) & (F.col("at") < end))


def changes(slots: DataFrame, cal: DataFrame, policy: Movement) -> DataFrame:
    """(facility, horizon_minutes, at, local_date, until, change): the i-th and the (i + steps)-th slot reading, and the local days of both.

    Both lie on adequately covered days, their distance is the horizon within the tolerance, and no
    step between them exceeds the gap. Negative readings do not take part. One window sort serves all
    horizons.
    """
    used = slots.where("value >= 0")
    whole_day = cal.groupBy("local_date").agg(F.sum("n_slots").alias("expected"))
    covered = used.groupBy("facility", "local_date").count().join(small(whole_day, 100_000), "local_date").where(F.col("count") >= policy.minimum_day_coverage * F.col("expected"))
    order = Window.partitionBy("facility").orderBy("at")
    micros = F.unix_micros("at")
    table = used.join(covered.select("facility", "local_date", F.lit(True).alias("covered")), ["facility", "local_date"], "left")
    table = table.withColumn("gap", micros - F.lag(micros).over(order))
    seconds = policy.cadence_seconds
    rows = []
    for horizon in policy.horizons_minutes:
        steps = max(1, horizon * 60 // seconds)
        later = F.lead(F.struct(micros.alias("at"), "value", "covered", "local_date"), steps).over(order)
        widest = F.max("gap").over(order.rowsBetween(1, steps))
        rows.append(F.struct(F.lit(horizon).alias("horizon_minutes"), later.alias("b"), widest.alias("widest")))
    pairs = table.withColumn("all", F.array(*rows)).select("facility", "at", "local_date", "value", "covered", F.explode("all").alias("h"))
    distance = F.abs(F.col("h.b.at") - F.unix_micros("at") - F.col("h.horizon_minutes").cast("bigint") * 60_000_000)
    kept = pairs.where(F.col("covered") & F.col("h.b.covered") & (distance <= policy.tolerance_seconds * 1_000_000) & (F.col("h.widest") <= policy.gap_seconds * 1_000_000))
    return kept.select("facility", "h.horizon_minutes", "at", "local_date", F.col("h.b.local_date").alias("until"), (F.col("h.b.value") - F.col("value")).alias("change"))


def stability(moves: DataFrame, policy: Movement) -> DataFrame:
    """Support, size quantiles and rise / fall shares by facility and horizon; null without support."""
    enough = (F.col("pairs") >= policy.minimum_pairs) & (F.col("days") >= policy.minimum_days)
    size = F.abs(F.col("change"))
    limit = policy.meaningful_minutes
    out = moves.groupBy("facility", "horizon_minutes").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("local_date").alias("days"), quantile(size, 0.5).alias("median_abs_change"), quantile(size, 0.9).alias("p90_abs_change"),
        F.avg((F.col("change") >= limit).cast("int")).alias("rise_share"), F.avg((F.col("change") <= -limit).cast("int")).alias("fall_share"),
    )
    return out.select("facility", "horizon_minutes", "pairs", "days", *[F.when(enough, F.col(c)).alias(c) for c in ("median_abs_change", "p90_abs_change", "rise_share", "fall_share")])


def travel_screen(moves: DataFrame, policy: Movement) -> DataFrame:
    """(facility, horizon_minutes, p90) that travel comparisons use; null without support."""
    return stability(moves, policy).select("facility", "horizon_minutes", F.col("p90_abs_change").alias("p90"))


def daily_screens(moves: DataFrame, days: DataFrame, policy: Movement) -> DataFrame:
    """(facility, day, horizon_minutes, p90) from the lookback days before each day.

    Both readings of a change lie in those days: one that ends on the day itself is not yet known when it begins.
    Changes are first gathered by the local days of their two readings, then each day is exploded to the later days that use it,
    a bounded number, so that the join stays an equi-join.
    """
    by_day = moves.groupBy("facility", "horizon_minutes", "local_date", "until").agg(F.collect_list(F.abs("change")).alias("sizes"))
    spread = by_day.withColumn("day", F.explode(F.transform(F.sequence(F.lit(1), F.lit(policy.lookback_days)), lambda k: F.date_add("local_date", k))))
    met = spread.where("until < day").join(small(days.select("day").distinct(), 100_000), "day").select("facility", "horizon_minutes", "day", "local_date", F.explode("sizes").alias("size"))
    out = met.groupBy("facility", "day", "horizon_minutes").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("local_date").alias("days"), quantile("size", 0.9).alias("p90"))
    return out.select("facility", "day", "horizon_minutes", F.when((F.col("pairs") >= policy.minimum_pairs) & (F.col("days") >= policy.minimum_days), F.col("p90")).alias("p90"))
