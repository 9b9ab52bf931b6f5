"""Results by day that follow late changes of the days they stand on.

A result for a local day looks back on a bounded number of days. After a run the fingerprints of the source days (``history.fingerprint``) are
kept in a versioned table; the next run compares them, and makes again only the results that a changed, new or vanished day can
reach: its own, as UTC and local days overlap by one, and those that look back on it. Their partitions are overwritten, those
that have no rows any more are removed, and all others stay as they are. The fingerprints are published last, so that a
run that dies has its days made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.session import cut
from slotwise.streaming import commits


def changed_days(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """The days (dt) whose fingerprints differ, or that only one of two tables (dt, fingerprint) has."""
    if before is None:
        return now.select("dt").distinct()
    met = now.select("dt", F.col("fingerprint").alias("a")).join(before.select("dt", F.col("fingerprint").alias("b")), "dt", "full_outer")
    return met.where(~F.col("a").eqNullSafe(F.col("b"))).select("dt")


def reached(days: DataFrame, lookback_days: int, overlap_days: int = 1) -> DataFrame:
    """The local days (day) whose results stand on readings of the UTC days ``dt``, by looking back or by their own readings."""
    span = F.sequence(F.date_sub("dt", overlap_days), F.date_add("dt", lookback_days + overlap_days))
    return days.select(F.explode(span).alias("day")).distinct()


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def refresh(spark: SparkSession, path: str, fingerprints: DataFrame, make: Callable[[DataFrame], DataFrame], first: str, last: str, lookback_days: int) -> list[str]:
    """Bring the results of the days from ``first`` to ``last`` up to date; gives the days that were made again.

    ``make`` takes a table (day) and gives the results of these days, with a column ``day``. They lie below ``path``/days.
    """
    fingerprints = cut(fingerprints.select("dt", "fingerprint"))
    before = commits.read(spark, f"{path}/fingerprints")
    days = cut(reached(changed_days(fingerprints, before), lookback_days).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    wanted = sorted(str(r.day) for r in days.collect())  # a range of days, not data
    if wanted:
        made = cut(make(days))
        made.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/days")
        filled = {str(r.day) for r in made.select("day").distinct().collect()}
        for day in set(wanted) - filled:
            place, system = _folder(spark, f"{path}/days/day={day}")
            system.delete(place, True)
    if wanted or before is None or not changed_days(fingerprints, before).isEmpty():
        commits.update(spark, f"{path}/fingerprints", lambda old: fingerprints)
    return wanted
