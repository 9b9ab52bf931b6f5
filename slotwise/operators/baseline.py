"""Past-only usual values with ordered fallback groups, comparison and trend.

A target is a facility's local day and hour. Its reference is the local days before it. Readings are
first reduced to cells by (facility, local day, local hour); every target is then exploded into the
cells it needs (lookback days x hours of the widest group, a bounded number), and meets them in one equi-join, so that no
range join is planned. Expected slots come from the calendar, so days without any reading count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.stats import mid_rank, quantile
from slotwise.functions.time import weekend
from slotwise.operators.places import small
from slotwise.policy import Baseline

GROUPS = ("weekday_weekend", "wider_hours", "all_days")
TARGET = ("facility", "local_date", "local_hour", "known_before")


def cells(slots: DataFrame) -> DataFrame:
    """(facility, local_date, local_hour, values, observed)."""
    return slots.groupBy("facility", "local_date", "local_hour").agg(F.collect_list("value").alias("values"), F.count(F.lit(1)).alias("observed"))


def _support(targets: DataFrame, table: DataFrame, cal: DataFrame, policy: Baseline) -> DataFrame:
    """Support and values of every fallback group, in an array ``groups`` a target.

    A target is exploded once, into the hours of the widest group; which groups a cell serves is a condition of
    the aggregates. Dealt by target, days and targets are aggregated after one shuffle.
    """
    key = [c for c in TARGET if c in targets.columns]
    wide = max(policy.hour_radius, policy.fallback_hour_radius)
    offsets = F.explode(F.transform(F.sequence(F.lit(-wide), F.lit(wide)), lambda o: F.struct(F.pmod(F.col("local_hour") + o, F.lit(24)).alias("hour"), F.abs(o).alias("far"))))
    days = F.explode(F.transform(F.sequence(F.lit(1), F.lit(policy.lookback_days)), lambda k: F.date_sub("local_date", k)))
    needed = targets.select(*key, days.alias("day")).select("*", offsets.alias("o")).select(*key, "day", "o.hour", "o.far")
    source = table.select("facility", F.col("local_date").alias("day"), F.col("local_hour").alias("hour"), "values", "observed")
    slots = small(cal.select(F.col("local_date").alias("day"), F.col("local_hour").alias("hour"), "n_slots"), 1_000_000)
    met = needed.join(source, ["facility", "day", "hour"], "left").join(slots, ["day", "hour"], "left")
    if "known_before" in key:
        unknown = F.col("day") >= F.col("known_before")
        met = met.withColumns({"values": F.when(~unknown, F.col("values")), "observed": F.when(~unknown, F.col("observed"))})
    met = met.repartition(*key)
    figures = []
    for r in sorted({policy.hour_radius, policy.fallback_hour_radius}):
        inside = F.col("far") <= r
        figures += [
            F.coalesce(F.sum(F.when(inside, F.col("observed"))), F.lit(0)).alias(f"observed_{r}"), F.coalesce(F.sum(F.when(inside, F.col("n_slots"))), F.lit(0)).alias(f"expected_{r}"),
            F.flatten(F.collect_list(F.when(inside, F.col("values")))).alias(f"values_{r}"),
        ]
    by_day = met.groupBy(*key, "day").agg(*figures)
    parts = []
    for place, name in enumerate(GROUPS):
        r = policy.hour_radius if place == 0 else policy.fallback_hour_radius
        mine = F.lit(True) if name == GROUPS[2] else weekend(F.col("day")) == weekend(F.col("local_date"))
        observed, expected = F.col(f"observed_{r}"), F.col(f"expected_{r}")
        enough = mine & (expected > 0) & (observed >= policy.minimum_day_coverage * expected)
        parts.append(
            F.struct(
                F.lit(name).alias("group"), F.lit(place).alias("place"), F.lit(r).alias("hour_radius"), F.count_if(enough).alias("days"), F.count_if(mine).alias("eligible_days"),
                F.coalesce(F.sum(F.when(mine, observed)), F.lit(0)).alias("observed_slots"), F.coalesce(F.sum(F.when(mine, expected)), F.lit(0)).alias("expected_slots"),
                F.flatten(F.collect_list(F.when(enough, F.col(f"values_{r}")))).alias("values"),
            )
        )
    return by_day.groupBy(*key).agg(F.array(*parts).alias("groups"))


def sorted_quantile(values: Column, p: float) -> Column:
    """Interpolated quantile of a sorted array."""
    at = (F.size(values) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def distribution(values: Column) -> Column:
    """(value, n) pairs of a sorted array, in order, from the places where runs begin."""
    n = F.size(values)
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1)))
    ends = lambda b: F.concat(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), F.array(n))
    pairs = F.zip_with(begins, ends(begins), lambda a, e: F.struct(F.get(values, a).alias("value"), (e - a).cast("bigint").alias("n")))
    return F.when(n > 0, pairs)


def models(targets: DataFrame, slots: DataFrame, cal: DataFrame, policy: Baseline) -> DataFrame:
    """The first sufficient group of every target, else the last with its support.

    A target is (facility, local_date, local_hour), and known_before where the days from that one on are not known yet.
    """
    key = [c for c in TARGET if c in targets.columns]
    found = _support(targets.select(*key), cells(slots), cal, policy)
    ratio = lambda g: F.coalesce(F.try_divide(g["observed_slots"], g["expected_slots"]), F.lit(0.0))
    sufficient = lambda g: (g["days"] >= policy.minimum_days) & (F.size(g["values"]) >= policy.minimum_samples) & (ratio(g) >= policy.minimum_coverage)
    first = F.get(F.filter("groups", sufficient), F.lit(0))
    best = found.select(*key, first.isNotNull().alias("ok"), F.coalesce(first, F.get("groups", F.lit(len(GROUPS) - 1))).alias("g"))
    best = best.select(*key, "ok", "g.*", F.sort_array("g.values").alias("sorted"), ratio(F.col("g")).alias("coverage"))
    values = F.col("sorted")
    return best.select(
        *key, F.when(F.col("ok"), "supported").otherwise("insufficient_history").alias("state"), "group", "hour_radius",
        "days", "eligible_days", F.size("values").cast("bigint").alias("samples"), "observed_slots", "expected_slots", "coverage",
        F.date_sub("local_date", policy.lookback_days).alias("reference_start"), F.col("local_date").alias("reference_end_exclusive"),
        F.when(F.col("ok"), sorted_quantile(values, 0.5)).alias("median"),
        F.when(F.col("ok"), sorted_quantile(values, policy.band_low)).alias("low"),
        F.when(F.col("ok"), sorted_quantile(values, policy.band_high)).alias("high"),
        F.when(F.col("ok"), distribution(values)).alias("distribution"),
    )


def compare(readings: DataFrame, usual: DataFrame, policy: Baseline) -> DataFrame:
    """Readings (with local_date, local_hour) against their models: delta, percentile, verdict."""
    met = readings.join(usual.select("facility", "local_date", "local_hour", "state", "group", "median", "low", "high", "distribution"), ["facility", "local_date", "local_hour"], "left")
    delta = F.col("value") - F.col("median")
    rank = mid_rank(F.col("distribution"), F.col("value"))
    with_rank = met.withColumns({"delta": delta, "percentile": F.when(F.col("state") == "supported", rank)})
    verdict = (
        F.when(F.coalesce(F.col("state"), F.lit("")) != "supported", "insufficient_history")
        .when((F.col("percentile") >= policy.unusual_high) & (F.col("delta") >= policy.meaningful_minutes), "above_usual")
        .when((F.col("percentile") <= policy.unusual_low) & (F.col("delta") <= -policy.meaningful_minutes), "below_usual")
        .otherwise("no_large_departure")
    )
    return with_rank.withColumn("unusual", verdict).drop("distribution")


def trend(slots: DataFrame, policy: Baseline) -> DataFrame:
    """Each reading against the median about ``trend_minutes`` ago, if those readings have no gap. Instants count in microseconds."""
    far = (policy.trend_minutes + policy.trend_tolerance_minutes) * 60_000_000
    near = max(policy.trend_minutes - policy.trend_tolerance_minutes, 0) * 60_000_000
    frame = Window.partitionBy("facility").orderBy("us").rangeBetween(-far, -near)
    seen = slots.withColumn("us", F.unix_micros("at"))
    seen = seen.withColumns({"samples": F.count("value").over(frame), "ago": F.percentile("value", F.lit(0.5)).over(frame), "points": F.collect_list("us").over(frame)})
    widest = F.array_max(F.zip_with(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))), lambda b, a: b - a))
    fine = (F.col("samples") >= policy.trend_minimum_samples) & (F.coalesce(widest, F.lit(0)) <= policy.gap_seconds * 1_000_000)
    delta = F.when(fine, F.col("value") - F.col("ago"))
    state = F.when(~fine, "insufficient_recent_history").when(delta >= policy.meaningful_minutes, "rising").when(delta <= -policy.meaningful_minutes, "falling").otherwise("little_change")
    return seen.select("facility", "at", "value", state.alias("state"), delta.alias("delta"), "samples")


def history_points(compared: DataFrame, usual: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The points of the last days with the model behind each: what a published history shows.

    ``compared`` comes from ``compare``; ``usual`` adds the days and coverage that support the model.
    """
    shown = compared.where((F.col("at") >= now - F.make_dt_interval(F.lit(days))) & (F.col("at") <= now))
    support = usual.select("facility", "local_date", "local_hour", "days", "coverage")
    return shown.join(support, ["facility", "local_date", "local_hour"], "left").select("facility", "at", "value", "median", "low", "high", "delta", "percentile", "days", "coverage", "group")


def latency(readings: DataFrame, registry: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Samples, median and 95th percentile of the collection latency of the last days, for every registered facility."""
    recent = readings.where((F.col("at") >= now - F.make_dt_interval(F.lit(days))) & (F.col("at") <= now))
    seen = recent.groupBy("facility").agg(F.count(F.lit(1)).alias("samples"), quantile("latency_ms", 0.5).alias("median_ms"), quantile("latency_ms", 0.95).alias("p95_ms"))
    return registry.select("facility").join(seen, "facility", "left").select("facility", F.coalesce("samples", F.lit(0)).alias("samples"), "median_ms", "p95_ms")


def replay_summary(compared: DataFrame) -> DataFrame:
    """Support rate, deviations and verdict shares of a replay, by facility."""
    ok = F.col("state") == "supported"
    return compared.groupBy("facility").agg(
        F.count(F.lit(1)).alias("comparisons"),
        F.count_if(ok).alias("supported"),
        F.round(F.avg(F.abs("delta")), 6).alias("mean_abs_deviation"),
        F.round(quantile(F.abs(F.col("delta")), 0.5), 6).alias("median_abs_deviation"),
        F.count_if(ok & F.col("value").between(F.col("low"), F.col("high"))).alias("in_band"),
        F.count_if(F.col("unusual").isin("above_usual", "below_usual")).alias("unusual"),
    )


def sensitivity(compared: DataFrame, tails: list[int], minutes: list[int]) -> DataFrame:
    """How many readings would be unusual for each tail and distance."""
    spark = compared.sparkSession
    grid = spark.createDataFrame([(t, m) for t in tails for m in minutes], "tail int, minutes int")
    far = ((F.col("percentile") >= 100 - F.col("tail")) & (F.col("delta") >= F.col("minutes"))) | ((F.col("percentile") <= F.col("tail")) & (F.col("delta") <= -F.col("minutes")))
    return compared.where("percentile IS NOT NULL").crossJoin(F.broadcast(grid)).groupBy("tail", "minutes").agg(F.count(F.lit(1)).alias("compared"), F.count_if(far).alias("unusual"))


def supported_by_all(candidates: DataFrame, key: list[str], n: int) -> DataFrame:
    """Keys for which all ``n`` candidates have a delta."""
    return candidates.groupBy(*key).agg(F.count("delta").alias("supported")).where(F.col("supported") == n).select(*key)


def reversals(trends: DataFrame, within_seconds: int) -> DataFrame:
    """Trend states and how often the next reading within the limit turned round, by facility."""
    order = Window.partitionBy("facility").orderBy("at")
    following = F.lead(F.struct("at", "state")).over(order)
    pairs = trends.withColumn("next", following)
    close = F.unix_micros("next.at") - F.unix_micros("at") < within_seconds * 1_000_000
    moving = F.col("state").isin("rising", "falling") & F.col("next.state").isin("rising", "falling") & close
    return pairs.groupBy("facility").agg(
        F.count_if(F.col("state") == "rising").alias("rising"), F.count_if(F.col("state") == "falling").alias("falling"), F.count_if(F.col("state") == "little_change").alias("little_change"),
        F.count_if(moving).alias("followed"), F.count_if(moving & (F.col("state") != F.col("next.state"))).alias("reversed"),
    )
