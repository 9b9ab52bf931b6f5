"""Binned views of the readings: heatmap, area counts, gaps, segments, snapshots, ranges, ticks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions.stats import median
from slotwise.functions.time import local
from slotwise.operators.places import small
from slotwise.policy import Baseline


def delta_band(delta: Column) -> Column:
    """Seven bands; the boundaries belong to the outer band below and to the inner band above."""
    return (
        F.when(delta.isNull(), "unsupported").when(delta <= -40, "far_below").when(delta <= -20, "below").when(delta < -10, "slightly_below")
        .when(delta <= 10, "near").when(delta < 20, "slightly_above").when(delta < 40, "above").otherwise("far_above")
    )


def point_state(median: Column, percentile: Column, delta: Column, policy: Baseline) -> Column:
    """Whether a reading is above, below or near its usual range: far out in the distribution and a meaningful distance away."""
    above = (percentile >= policy.unusual_high) & (delta >= policy.meaningful_minutes)
    below = (percentile <= policy.unusual_low) & (delta <= -policy.meaningful_minutes)
    return F.when(median.isNull(), "no_range").when(above, "above").when(below, "below").otherwise("near")


def marker_state(readings: Column, delta: Column, meaningful: float) -> Column:
    """State of a map marker; a delta of exactly the meaningful distance is near."""
    none = F.coalesce(readings, F.lit(0)) == 0
    return F.when(none, "empty").when(delta.isNull(), "unsupported").when(delta > meaningful, "above").when(delta < -meaningful, "below").otherwise("near")


def bin_start(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at) / (seconds * 1_000_000)).cast("bigint") * seconds


def window(generated: int, hours: int) -> tuple[int, int, int]:
    """(start, end, bin seconds): bins of 15 minutes up to a day, else an hour; the last one holds ``generated`` or ends there."""
    size = 900 if hours <= 24 else 3600
    end = -(-generated // size) * size
    return end - hours * 3600, end, size


def spine(rows: DataFrame, generated: int, hours: int) -> DataFrame:
    """``rows`` with every bin of the window."""
    start, end, size = window(generated, hours)
    return rows.withColumn("bin", F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(end - size).cast("bigint"), F.lit(size).cast("bigint"))))


def heatmap(points: DataFrame, facilities: DataFrame, generated: int, hours: int) -> DataFrame:
    """Every facility and bin of the last hours, with the count of readings and the median supported delta.

    ``points`` has facility, at, delta; ``generated`` is an epoch second.
    """
    start, end, size = window(generated, hours)
    binned = points.withColumn("bin", bin_start(F.col("at"), size)).where(F.col("bin").between(start, end - size))
    cells = binned.groupBy("facility", "bin").agg(F.count(F.lit(1)).alias("readings"), median("delta").alias("delta"))
    out = spine(facilities.select("facility").distinct(), generated, hours).join(cells, ["facility", "bin"], "left").withColumn("readings", F.coalesce("readings", F.lit(0)))
    return out.withColumn("band", F.when(F.col("readings") == 0, "empty").otherwise(delta_band(F.col("delta"))))


def heatmap_summary(cells: DataFrame, meaningful: float = 10) -> DataFrame:
    """Cells with readings, with a delta, and strictly beyond the meaningful distance; the largest delta above it, null if none is."""
    above, below = F.col("delta") > meaningful, F.col("delta") < -meaningful
    return cells.groupBy("facility").agg(
        F.count_if(F.col("readings") > 0).alias("observed"), F.count("delta").alias("supported"), F.count_if(above).alias("above"),
        F.count_if(below).alias("below"), F.max(F.when(above, F.col("delta"))).alias("largest"),
    )


def _latest_states(points: DataFrame, members: DataFrame, generated: int, hours: int) -> DataFrame:
    """(area, facility, bin, state): the last reading of each facility in each bin of the window stands for it."""
    start, end, size = window(generated, hours)
    binned = points.withColumn("bin", bin_start(F.col("at"), size)).where(F.col("bin").between(start, end - size))
    latest = binned.groupBy("facility", "bin").agg(F.max_by("state", F.struct("at", "state")).alias("state"))
    return latest.join(small(members), "facility")


def area_counts(points: DataFrame, members: DataFrame, generated: int, hours: int) -> DataFrame:
    """Every bin of every area, empty ones included: who reports, has a range, and stands above or below.

    ``points`` has facility, at, state; ``members`` area, facility, pos. Names stand in the order of pos.
    """
    found = _latest_states(points, members, generated, hours)
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("state") == s, F.struct("pos", "facility"))))
    names = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<struct<pos:int,facility:string>>")), lambda x: x["facility"]), ",")
    cells = found.groupBy("area", "bin").agg(
        F.count(F.lit(1)).alias("reporting"), F.count_if(F.col("state") != "no_range").alias("compared"), of("above").alias("up"), of("below").alias("down")
    )
    out = spine(members.select("area").distinct(), generated, hours).join(cells, ["area", "bin"], "left")
    n = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)).cast("bigint")
    return out.select(
        "area", "bin", F.coalesce("reporting", F.lit(0)).alias("reporting"), F.coalesce("compared", F.lit(0)).alias("compared"),
        n("up").alias("n_above"), n("down").alias("n_below"), names(F.col("up")).alias("above"), names(F.col("down")).alias("below"),
    )


def area_tallies(points: DataFrame, members: DataFrame, generated: int, hours: int) -> DataFrame:
    """By area and facility, in how many bins it reports, has a range, and stands above or below; zeros for silent ones."""
    tally = _latest_states(points, members, generated, hours).groupBy("area", "facility").agg(
        F.count(F.lit(1)).alias("reporting"), F.count_if(F.col("state") != "no_range").alias("compared"), F.count_if(F.col("state") == "above").alias("above"), F.count_if(F.col("state") == "below").alias("below")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return members.select("area", "facility").join(tally, ["area", "facility"], "left").select("area", "facility", *[zero(c) for c in ("reporting", "compared", "above", "below")])


def typical_count(bins: DataFrame) -> DataFrame:
    """By area: the lower median of the facilities above usual, over bins with a compared facility, and the bins with any above."""
    compared = F.col("compared") > 0
    return bins.groupBy("area").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_above) FILTER (WHERE compared > 0)").cast("bigint").alias("typical"),
        F.count_if(F.col("n_above") > 0).alias("periods_with_above"), F.count_if(compared).alias("periods"),
    )


#: The state that each verdict of a comparison stands for.
STATES = {"above_usual": "above", "below_usual": "below", "no_large_departure": "near", "insufficient_history": "no_range"}


def area_now(current: DataFrame, verdicts: DataFrame, members: DataFrame, paused: bool = False) -> DataFrame:
    """By area: members, and how many stand above, below, have a range, have none, are not current.

    ``current`` has facility, current, value (the freshness view); ``verdicts`` facility, unusual, of the same
    readings. Without a valid context (``paused``) current readings are not compared.
    """
    known = F.coalesce(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("unusual")], F.lit("no_range"))
    rows = members.join(small(current.select("facility", "current", "value")), "facility", "left").join(small(verdicts.select("facility", "unusual")), "facility", "left")
    there = F.coalesce(F.col("current") & F.col("value").isNotNull(), F.lit(False))
    rows = rows.withColumn("state", F.when(~there, "not_current").when(F.lit(paused), "paused").otherwise(known))
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return rows.groupBy("area").agg(
        F.count(F.lit(1)).alias("total"), n("above").alias("above"), n("below").alias("below"), n("above", "below", "near").alias("compared"),
        n("no_range").alias("no_range"), n("not_current").alias("not_current"), n("paused").alias("paused"),
    )


def gaps(batches: DataFrame, gap_seconds: int) -> DataFrame:
    """Consecutive distinct batches further apart than the gap. A window over one row a batch."""
    distinct = batches.select("batch").distinct().withColumn("day", F.to_date("batch"))
    # Batches are chained within their day; the first of a day follows the last of the latest day before it.
    edge = distinct.groupBy("day").agg(F.max("batch").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("day"))).select("day", "before")
    order = Window.partitionBy("day").orderBy("batch")
    chained = distinct.join(small(edge, 100_000), "day").withColumn("from", F.coalesce(F.lag("batch").over(order), F.col("before")))
    seconds = (F.unix_micros("batch") - F.unix_micros("from")) / 1_000_000
    return chained.where(seconds > gap_seconds).select("from", F.col("batch").alias("to"), seconds.alias("seconds"))


def segments(readings: DataFrame, gap_seconds: int) -> DataFrame:
    """Runs of readings that no step longer than the gap interrupts.

    Readings are chained within a facility's day; the small table of the days' first and last readings chains
    the days, so that no task holds all readings of a facility.
    """
    day = F.to_date("at")
    rows = readings.select("facility", "at", day.alias("day"))
    order = Window.partitionBy("facility", "day").orderBy("at")
    wide = lambda a, b: F.unix_micros(b) - F.unix_micros(a) > gap_seconds * 1_000_000
    inner = rows.withColumn("new", F.coalesce(wide(F.lag("at").over(order), F.col("at")), F.lit(False)).cast("int"))
    inner = inner.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = inner.groupBy("facility", "day", "part").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count(F.lit(1)).alias("n"))
    chain = Window.partitionBy("facility").orderBy("start")
    linked = parts.withColumn("new", F.coalesce(wide(F.lag("end").over(chain), F.col("start")), F.lit(True)).cast("int"))
    linked = linked.withColumn("segment", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    return linked.groupBy("facility", "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("readings"))


def snapshot(cells: DataFrame, bin_: int, campuses: DataFrame, map_only: DataFrame) -> DataFrame:
    """One bin on the map: facilities with a campus, and map-only places with one, whose state is that they publish no waiting time."""
    here = cells.where(F.col("bin") == bin_).join(campuses.where("latitude IS NOT NULL"), "facility")
    shown = here.select("facility", "latitude", "longitude", marker_state(F.col("readings"), F.col("delta"), 10).alias("state"))
    return shown.unionByName(map_only.where("latitude IS NOT NULL").select("facility", "latitude", "longitude", F.lit("unpublished").alias("state")))


def resolve_index(n_bins: int, start: int, size: int, wanted: int | None, follow: bool) -> int:
    """Index of the shown bin: the one whose start is nearest to the wanted (halves go up), or the last if it lies outside or none is wanted."""
    if follow or wanted is None:
        return n_bins - 1
    index = math.floor((wanted - start) / size + 0.5)
    return index if 0 <= index < n_bins else n_bins - 1


def visible_range(readings: DataFrame, start: Column, end: Column, gap_seconds: int) -> DataFrame:
    """The axis of each facility's line in a window, from its values and where it crosses the edges; gaps are not crossed.

    Zero always belongs to the axis. Both ends get 6 % of the span, rounded outwards to half a power of ten;
    an end at zero stays there. A line without extent, or none at all, has the axis 0 to 10.
    """
    order = Window.partitionBy("facility").orderBy("at")
    steps = readings.withColumns({"t": F.unix_micros("at") / 1e6, "t0": F.lag(F.unix_micros("at")).over(order) / 1e6, "v0": F.lag("value").over(order)})
    a, b = F.unix_micros(start) / 1e6, F.unix_micros(end) / 1e6
    joined = (F.col("t") - F.col("t0") <= gap_seconds) & F.col("t0").isNotNull()
    at = lambda x: F.col("v0") + (F.col("value") - F.col("v0")) * (x - F.col("t0")) / (F.col("t") - F.col("t0"))
    values = F.array(
        F.when(F.col("t").between(a, b), F.col("value").cast("double")),
        F.when(joined & (F.col("t0") < a) & (F.col("t") > a), at(a)),
        F.when(joined & (F.col("t0") < b) & (F.col("t") > b), at(b)),
    )
    drawn = steps.select("facility", F.explode(values).alias("v")).groupBy("facility").agg(F.least(F.lit(0.0), F.min("v")).alias("low"), F.greatest(F.lit(0.0), F.max("v")).alias("high"))
    span = F.col("high") - F.col("low")
    step = F.pow(F.lit(10.0), F.floor(F.log10(span))) / 2
    flat = F.coalesce(span == 0, F.lit(True))
    low = F.when(flat, 0.0).when(F.col("low") < 0, F.floor((F.col("low") - span * 0.06) / step) * step).otherwise(0.0)
    high = F.when(flat, 10.0).when(F.col("high") > 0, F.ceil((F.col("high") + span * 0.06) / step) * step).otherwise(0.0)
    return drawn.select("facility", low.alias("low"), high.alias("high"))


def ticks(generated: int, hours: int, limit: int, zone: str, spark: SparkSession) -> DataFrame:
    """Marks on the time axis: local midnights, or full six hours up to a day; thinned evenly to ``limit``, never the first bin."""
    start, _, size = window(generated, hours)
    here = local(F.timestamp_seconds("bin"), zone)
    every = 6 if hours <= 24 else 24
    marks = spine(spark.range(1), generated, hours).where((F.col("bin") > start) & (F.minute(here) == 0) & (F.hour(here) % every == 0))
    # A window of hours has a bounded number of marks.
    numbered = marks.select("bin", (F.row_number().over(Window.orderBy("bin")) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    kept = numbered.where(F.col("k") % F.ceil(F.col("n") / max(1, limit)) == 0)
    return kept.select("bin", ((F.col("bin") - start) / size).cast("int").alias("index"), F.hour(here).alias("local_hour"))
