"""A digest manifest of stored objects: what an object holds is read once, not at every listing.

The manifest is an append-only table of (key, length, modified, etag) by day. A listing takes names, sizes and
modification times of the days that are asked for, without opening an object, and meets the manifest by all three; only
objects that it lacks, because they are new or have changed, are opened, digested and appended. The scan that
digests them asks for nothing older than the oldest of them, so that a day that grows is not read again as a whole.
Two that append at the same time append the same digests, which are one again when they are read. The manifest tells what an
object held when it was digested: a read of its content still compares the digest (``history.lines``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KIND = "key string, length bigint, modified timestamp, etag string, dt date"
_IDENTITY = ["key", "length", "modified"]


def day_folders(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> list[str]:
    """Folders ``dt=...`` below a root, of a range of days or all; one listing of the root."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in (system.listStatus(place) if system.exists(place) else []) if f.isDirectory())
    return [f"{root}/{n}" for n in names if n.startswith("dt=") and (first is None or n[3:] >= first) and (last is None or n[3:] <= last)]


def objects(spark: SparkSession, places: list[str]) -> DataFrame:
    """Every object below the places, as (path, length, modificationTime, content, dt); a column that is not used is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(places)
    day = F.regexp_extract("path", r"/dt=(\d{4}-\d{2}-\d{2})/", 1)
    return files.withColumn("dt", F.when(day != "", day.cast("date")))


def known(spark: SparkSession, manifest: str) -> DataFrame:
    """What the manifest holds, each object version once."""
    from slotwise.sources.history import exists

    rows = spark.read.schema(_KIND).parquet(manifest) if exists(spark, manifest) else spark.createDataFrame([], _KIND)
    return rows.groupBy("dt", *_IDENTITY).agg(F.max("etag").alias("etag"))


def listed(spark: SparkSession, places: list[str], manifest: str) -> DataFrame:
    """(key, dt, length, etag) of the objects below the places, after the manifest has been brought up to date."""
    named = objects(spark, places).select(F.col("path").alias("key"), "dt", "length", F.col("modificationTime").alias("modified"))
    lacking = _lacking(named, known(spark, manifest))
    days = lacking.groupBy("dt").agg(F.min("modified").alias("since")).collect()
    if days:
        stale = [p for p in places if any(d.dt is None or f"/dt={d.dt}" in p or "/dt=" not in p for d in days)]
        found = objects(spark, stale).where(F.col("modificationTime") >= F.lit(min(d.since for d in days)))
        told = found.select(F.col("path").alias("key"), "length", F.col("modificationTime").alias("modified"), F.md5("content").alias("etag"), "dt")
        _lacking(told, known(spark, manifest)).write.mode("append").partitionBy("dt").parquet(manifest)
    told = known(spark, manifest).drop("dt")
    changed = F.raise_error(F.concat(F.lit("changed while it was listed: "), F.col("key"))).cast("string")
    return named.join(told, _IDENTITY, "left").select("key", "dt", "length", F.coalesce("etag", changed).alias("etag"))


def _lacking(named: DataFrame, have: DataFrame) -> DataFrame:
    return named.join(have.select(*_IDENTITY), _IDENTITY, "left_anti")
