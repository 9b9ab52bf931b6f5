"""Provenance-preserving reads of partitioned JSON-lines history, and the writers that make it.

Layout below a root: ``raw/<dataset>/dt=YYYY-MM-DD/*.jsonl`` and ``compacted/<dataset>/dt=.../data.jsonl.gz``.
Days are chosen before anything is read: a closed day whose compacted fingerprint equals that of its
raw files is read compacted, else raw, else compacted without proof, else it is missing. The sources of
a day are never mixed. Everything is a DataFrame; a corrupt object is one rejection and ends nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions.time import instant
from slotwise.operators.dedup import duplicate_counts, latest_by_key
from slotwise.session import cut
from slotwise.session import stored as kept
from slotwise.sources.manifest import day_folders, listed, objects

# The closed fields of a record, in order of name.
FIELDS = ("batch_id", "facility", "latency_ms", "metric", "observed_at", "wait_minutes")
SCHEMA = "facility string, metric string, wait_minutes int, observed_at string, batch_id string, latency_ms int"
#: Every line boundary of text, not the line feed alone.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
MOST_ISSUES = 25
#: Characters of an unzipped object that are in memory at a time, and records of a raw object that is written.
PIECE, RECORDS_A_FILE = 1 << 20, 50_000
#: Names of raw objects (Spark's text writer ends its files in .txt) and of compacted ones.
RAW, PACKED = r"\.(jsonl|txt)$", r"\.gz$"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def listing(spark: SparkSession, root: str, first: str | None = None, last: str | None = None, manifest: str | None = None) -> DataFrame:
    """(key, dt, length, etag) of the objects below a root, or in the folders of a range of days. The tag is a digest of the content.

    With a ``manifest`` only objects that it does not know are opened.
    """
    places = day_folders(spark, root, first, last) if first or last else [root] if exists(spark, root) else []
    if not places:
        return spark.createDataFrame([], "key string, dt date, length bigint, etag string")
    if manifest is not None:
        return listed(spark, places, manifest)
    return objects(spark, places).select(F.col("path").alias("key"), "dt", "length", F.md5("content").alias("etag"))


def fingerprint(objects: DataFrame) -> DataFrame:
    """(dt, fingerprint, objects): a SHA-256 of each day's keys, sizes and tags in key order, as canonical JSON."""
    named = F.concat(F.lit('{"ETag":"'), F.col("etag"), F.lit('","Key":"'), F.regexp_extract("key", r"([^/]+/[^/]+/dt=.*)$", 1), F.lit('","Size":'), F.col("length").cast("string"), F.lit("}"))
    return objects.groupBy("dt").agg(F.sort_array(F.collect_list(F.struct("key", named.alias("j")))).alias("o")).select(
        "dt", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("o", lambda x: x["j"]), ","), F.lit("]")), 256).alias("fingerprint"), F.size("o").alias("objects")
    )


def choose(spark: SparkSession, first: str, last: str, raw: DataFrame, compacted: DataFrame, stored: DataFrame, today: Column) -> DataFrame:
    """(dt, source, completeness, objects) of every day of a range; missing days appear. ``stored`` has dt, fingerprint.

    Fixed values: the names of sources and of completeness.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("dt"))
    rows = days.join(fingerprint(raw), "dt", "left").join(stored.select("dt", F.col("fingerprint").alias("said")), "dt", "left")
    rows = rows.join(compacted.select("dt", F.lit(True).alias("packed")).distinct(), "dt", "left")
    has_raw, packed = F.col("objects").isNotNull(), F.coalesce("packed", F.lit(False))
    matched = has_raw & packed & (F.col("dt") < today) & (F.col("said") == F.col("fingerprint"))
    source = F.when(matched, "compacted").when(has_raw, "raw").when(packed, "compacted").otherwise("missing")
    state = F.when(matched, "snapshot_matches_raw").when(has_raw & (F.col("dt") >= today), "open_day").when(has_raw, "raw_snapshot").when(packed, "unverified_no_raw").otherwise("missing")
    n = F.when(F.col("source") == "raw", F.col("objects")).when(F.col("source") == "compacted", 1).otherwise(0)
    return rows.withColumn("source", source).withColumn("completeness", state).select("dt", "source", "completeness", n.cast("int").alias("objects"))


def _pieces(body: bytes) -> Iterator[str]:
    """Text of a gzip object, in pieces of about ``PIECE`` characters that end with a line feed."""
    with io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(body)), encoding="utf-8", newline="\n") as text:
        while found := text.readlines(PIECE):
            yield "".join(found)


def unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dt, key, first, text, error) of gzip objects: pieces of text with the number of lines before, or the name of the error.

    An object is unzipped twice, piece by piece: first to learn whether it is whole, so that a corrupt one gives no line.
    """
    breaks = re.compile(LINE_BREAK)

    def row(batch: pa.RecordBatch, i: int, first: int, text: str | None, error: str | None) -> pa.RecordBatch:
        dated = batch.slice(i, 1)
        return pa.RecordBatch.from_arrays([dated.column(0), dated.column(1), pa.array([first], pa.int32()), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["dt", "key", "first", "text", "error"])

    for batch in batches:
        for i in range(batch.num_rows):
            body, first = batch.column(2)[i].as_py(), 0
            try:
                for _ in _pieces(body):
                    pass
            except (OSError, EOFError, UnicodeError, zlib.error) as error:
                yield row(batch, i, 0, None, type(error).__name__)
                continue
            for text in _pieces(body):
                yield row(batch, i, first, text, None)
                first += len(breaks.findall(text))


def texts(files: DataFrame, source: str) -> DataFrame:
    """(dt, key, first, text, error) of the objects of a source. Python sees the compressed ones alone."""
    if source == "compacted":
        return files.select("dt", "key", "content").mapInArrow(unzipped, "dt date, key string, first int, text string, error string")
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select("dt", "key", F.lit(0).alias("first"), F.when(valid, text).alias("text"), F.when(~valid, "UnicodeDecodeError").alias("error"))


def folders(root: str, dataset: str, chosen: DataFrame) -> dict[str, list[str]]:
    """The folders of the chosen source of each day, by source. A range of days is a bounded list."""
    found: dict[str, list[str]] = {"raw": [], "compacted": []}
    for r in chosen.where(F.col("source").isin(*found)).select("dt", "source").collect():
        found[r.source].append(f"{root}/{r.source}/{dataset}/dt={r.dt}")
    return found


def lines(spark: SparkSession, root: str, dataset: str, chosen: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """(dt, key, line, text, error) of the chosen source of every day, with line numbers from 1.

    Only the chosen days' folders are read. ``pinned`` is a listing (key, etag): an object that is not in it, or whose
    content has changed since, ends the read with an error.
    """
    patterns, found = {"raw": "*.{jsonl,txt}", "compacted": "*.gz"}, []
    for source, places in folders(root, dataset, chosen).items():
        if places:
            files = spark.read.format("binaryFile").option("pathGlobFilter", patterns[source]).option("recursiveFileLookup", "true").load(places)
            files = files.select(F.col("path").alias("key"), "content", F.regexp_extract("path", r"/dt=(\d{4}-\d{2}-\d{2})/", 1).cast("date").alias("dt"))
            if pinned is not None:
                # The reader lists the same objects in the driver: their digests are broadcast, so that no content is shuffled.
                known = files.join(F.broadcast(pinned.select("key", "etag")), "key", "left")
                same = F.coalesce(F.md5("content") == F.col("etag"), F.lit(False))
                files = known.withColumn("content", F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("changed since it was listed: "), F.col("key"))).cast("binary"))).drop("etag")
            found.append(texts(files, source))
    if not found:
        return spark.createDataFrame([], "dt date, key string, line int, text string, error string")
    each = reduce(DataFrame.unionByName, found).select("dt", "key", "first", "error", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_BREAK)).alias("at", "text"))
    whole = F.col("error").isNull()
    return each.where(~whole | (F.trim("text") != "")).select("dt", "key", F.when(whole, F.col("first") + F.col("at") + 1).alias("line"), F.when(whole, F.col("text")).alias("text"), "error")


def load(spark: SparkSession, root: str, dataset: str, start: Column, end: Column, now: Column, stored: DataFrame, metric: str | None = None, manifest: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records, counters, first issues and partitions of the batches in [start, end).

    ``stored`` has dt and fingerprint of the compacted days. The folders of those days alone are listed, a source is chosen for each, and what is read
    is pinned to that listing. ``manifest`` is a table of digests, kept from one read to the next. Days are read side by side, as tasks; their rows, counters and issues are merged by the plan.
    """
    utc = lambda t: F.to_date(t)
    first, last, today, late = spark.range(1).select(utc(start).cast("string"), utc(end - F.expr("interval 1 microsecond")).cast("string"), utc(now).cast("string"), end > now).first()
    if first > last or late:
        raise ValueError("start < end <= now is needed")
    raw, packed = (cut(listing(spark, f"{root}/{kind}/{dataset}", first, last, manifest and f"{manifest}/{kind}/{dataset}")) for kind in ("raw", "compacted"))
    inside = lambda objects, pattern: objects.where(F.col("dt").between(first, last) & F.col("key").rlike(pattern))
    partitions = cut(choose(spark, first, last, inside(raw, RAW), inside(packed, PACKED), stored, F.lit(today).cast("date")))
    # Records, counters and issues are three reads of the rows, which are decoded and checked once.
    rows = kept(validated(lines(spark, root, dataset, partitions, raw.unionByName(packed)), now), "validated")
    records, counts, issues = history(rows, start, end, metric)
    return records, counts, issues, partitions


def validated(rows: DataFrame, now: Column) -> DataFrame:
    """Lines as records with ``reject_reason``: the first rule that fails, in order, or null."""
    row = F.from_json("text", SCHEMA)
    keys = F.array_sort(F.json_object_keys("text"))
    whole = lambda name: F.get_json_object("text", f"$.{name}").rlike(r"^-?\d+$") & ~F.coalesce(F.regexp_like("text", F.lit(rf'"{name}"\s*:\s*"')), F.lit(False))
    out = rows.withColumn("r", row).withColumn("keys", keys).withColumns({"batch": instant(F.col("r.batch_id")), "observed": instant(F.col("r.observed_at"))})
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(no(F.col("keys") == F.array(*[F.lit(f) for f in FIELDS])), "fields")
        .when(no(F.trim("r.facility") != "") | no(F.trim("r.metric") != ""), "text")
        .when(no(whole("wait_minutes")) | F.col("r.wait_minutes").isNull(), "wait_minutes")
        .when(no(whole("latency_ms")) | no(F.col("r.latency_ms") >= 0), "latency_ms")
        .when(F.col("batch").isNull() | F.col("observed").isNull(), "timestamp")
        .when(F.col("observed") < F.col("batch"), "order")
        .when((F.to_date("batch") != F.col("dt")) | (F.col("observed") > now), "wrong partition or future observation")
    )
    return out.select("dt", "key", "line", "batch", "observed", *[F.col(f"r.{f}").alias(f) for f in FIELDS], reason.alias("reject_reason"))


def history(rows: DataFrame, start: Column, end: Column, metric: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records (one a batch instant, facility and metric), counters, and the first issues, from validated rows."""
    ok = rows.where(F.col("reject_reason").isNull() & (F.col("batch") >= start) & (F.col("batch") < end))
    ok = ok if metric is None else ok.where(F.col("metric") == metric)
    key, rank, scan = ["batch", "facility", "metric"], ["observed", "key", "line"], ["dt", "key", "line"]
    records = latest_by_key(ok, key, rank).select(*FIELDS, "batch", "observed", "key", "line")
    counts = duplicate_counts(ok, key, rank, scan, list(FIELDS)).crossJoin(rows.agg(F.count("reject_reason").alias("rejected_records")))
    issues = rows.where("reject_reason IS NOT NULL").orderBy("dt", "key", "line").limit(MOST_ISSUES).select("key", "line", "reject_reason")
    return records, counts, issues


def ordered(records: DataFrame) -> DataFrame:
    """Canonical order, for a sink."""
    return records.orderBy("observed", "facility", "metric", "batch")


def coverage(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Observations and missing batches of each registered facility; unknown ones are marked."""
    batches = records.agg(F.count_distinct("batch").alias("batches"))
    counts = records.groupBy("facility").agg(F.count(F.lit(1)).alias("n"))
    rows = registry.select("facility", F.lit(True).alias("known")).join(counts, "facility", "full_outer").crossJoin(F.broadcast(batches))
    n = F.coalesce("n", F.lit(0))
    return rows.select("facility", n.alias("observations"), F.when(F.col("known"), F.col("batches") - n).alias("missing_in_observed_batches"), F.coalesce("known", F.lit(False)).alias("known"))


def unknown_facilities(records: DataFrame, registry: DataFrame) -> DataFrame:
    return records.select("facility").distinct().join(registry, "facility", "left_anti")


def write_raw(records: DataFrame, root: str, dataset: str) -> None:
    """Append records as JSON lines under the day of their batch."""
    text = F.to_json(F.struct(*[F.col(f) for f in ("facility", "metric", "wait_minutes", "observed_at", "batch_id", "latency_ms")]))
    records.select(text.alias("value"), F.to_date(instant(F.col("batch_id"))).alias("dt")).write.mode("append").option("maxRecordsPerFile", RECORDS_A_FILE).partitionBy("dt").text(f"{root}/raw/{dataset}")


PART_BYTES = 128 << 20


def compact(spark: SparkSession, root: str, dataset: str, day: str) -> str | None:
    """A day's raw lines in object order, as gzip files of about 128 MB of text, and their fingerprint; nothing for an empty day."""
    folder = f"{root}/raw/{dataset}/dt={day}"
    objects = cut(listing(spark, folder).where(F.col("key").rlike(RAW)))
    total = objects.agg(F.sum("length")).first()[0]
    if not total:
        return None
    rows = spark.read.option("pathGlobFilter", "*.{jsonl,txt}").text(folder).withColumn("key", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())
    parts = rows.repartitionByRange(-(-total // PART_BYTES), "key", "at").sortWithinPartitions("key", "at")
    parts.select("value").write.mode("overwrite").option("compression", "gzip").text(f"{root}/compacted/{dataset}/dt={day}")
    return fingerprint(objects).first().fingerprint


def write_batch(spark: SparkSession, root: str, dataset: str, records: DataFrame, summary: DataFrame, name: str) -> None:
    """A collection batch: its records as JSON lines, if there are any, and always its summary as JSON."""
    if not records.isEmpty():
        records.select(F.to_json(F.struct(*[F.col(c) for c in records.columns])).alias("value")).write.mode("overwrite").text(f"{root}/raw/{dataset}/{name}")
    summary.coalesce(1).write.mode("overwrite").json(f"{root}/operations/{dataset}/{name}")


def points(records: DataFrame) -> DataFrame:
    """Canonical order of points without their batch, for a sink."""
    return records.orderBy("observed", "facility", "metric")


def write_snapshot(records: DataFrame, path: str) -> str:
    """Write records as Parquet and return their identity: a digest over row digests, in any order."""
    records.write.mode("overwrite").parquet(path)
    return identity(records)


def identity(records: DataFrame) -> str:
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(records.columns)])), 256)
    halves = records.select(F.conv(F.substring(row, 1, 14), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring(row, 15, 14), 16, 10).cast("decimal(38,0)").alias("b"))
    n, a, b = halves.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    return hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest()


def read_snapshot(spark: SparkSession, path: str, expected: str) -> DataFrame:
    records = spark.read.parquet(path)
    if identity(records) != expected:
        raise ValueError("the snapshot is not the one that was frozen")
    return records


def registry(spark: SparkSession, path: str, *, include_map_only: bool = False) -> DataFrame:
    """Facilities of a JSON registry file, with their position; by default those that are collected."""
    rows = spark.read.json(path, multiLine=True)
    rows = rows.select(F.posexplode("facilities").alias("pos", "f")).select("pos", "f.*") if "facilities" in rows.columns else rows.withColumn("pos", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    return rows if include_map_only else rows.where("collection_enabled")


def write_json(df: DataFrame, path: str) -> None:
    """A small result as one JSON document, replaced as a whole; non-finite numbers are an error."""
    import os
    import tempfile

    rows = [json.loads(r) for r in df.toJSON().collect()]
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w") as f:
        json.dump(rows, f, allow_nan=False, separators=(",", ":"))
    os.replace(name, path)
