"""Streams of readings: windows with watermarks, and the monotonic latest state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slotwise.functions.time import local_date, local_hour
from slotwise.streaming import commits

READING = "facility string, at timestamp, batch timestamp, value int"
#: A reading, or an attempt that gave none.
ATTEMPTED = READING + ", state string, error_code string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, files_a_trigger: int = 64, schema: str = READING) -> DataFrame:
    """Batches of JSON readings as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(path)


def slots(stream: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """The winner of each slot: highest instant, then batch, then value."""
    windowed = stream.withWatermark("at", late).groupBy("facility", F.window("at", f"{minutes} minutes"))
    return windowed.agg(F.max(F.struct("at", "batch", "value")).alias("w")).select("facility", F.col("window.start").alias("slot"), "w.at", "w.value")


def hours(stream: DataFrame, minimum: int = 2, late: str = "1 hour") -> DataFrame:
    """Hourly medians with a minimum count."""
    out = stream.withWatermark("at", late).groupBy("facility", F.window("at", "1 hour")).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= minimum).select("facility", F.col("window.start").alias("hour"), "median", "n")


def deviation_hours(stream: DataFrame, usual: DataFrame, zone: str, minutes: int = 15, minimum: int = 2, late: str = "1 hour") -> DataFrame:
    """(facility, hour, deviation, n): hourly medians of what the winner of each slot differs from the usual of its local day and hour.

    ``usual`` is a table with facility, local_date, local_hour and median, made from the days before each; slots whose hour has none and hours of
    fewer than ``minimum`` slots stay out. A slot is settled when the watermark has passed it and an hour when its slots are, so the query runs in append mode.
    """
    windowed = stream.withWatermark("at", late).groupBy("facility", F.window("at", f"{minutes} minutes")).agg(F.max(F.struct("at", "batch", "value")).alias("w"))
    at = F.col("w.at")
    won = windowed.select("facility", F.window_time("window").alias("end"), "w.value", local_date(at, zone).alias("local_date"), local_hour(at, zone).alias("local_hour"))
    met = won.join(usual.where("median IS NOT NULL").select("facility", "local_date", "local_hour", "median"), ["facility", "local_date", "local_hour"])
    out = met.groupBy("facility", F.window("end", "1 hour")).agg(F.percentile(F.col("value") - F.col("median"), F.lit(0.5)).alias("deviation"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= minimum).select("facility", F.col("window.start").alias("hour"), "deviation", "n")


def sessions(stream: DataFrame, gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of readings closed by a gap."""
    out = stream.withWatermark("at", late).groupBy("facility", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"))
    return out.select("facility", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "highest")


def deduplicated(stream: DataFrame) -> DataFrame:
    """One row for each batch and facility, the latest reading; a late one still replaces it.

    As in a read of the history, nothing is dropped for being late, so the state has every key and no watermark.
    """
    won = stream.groupBy("batch", "facility").agg(F.max(F.struct("at", "value")).alias("w"), F.count(F.lit(1)).alias("records"))
    return won.select("batch", "facility", "w.at", "w.value", "records")


_SUCCESS, _ATTEMPT = "at timestamp, batch timestamp, value int", "batch timestamp, state string, error_code string"
LATEST = f"facility string, success struct<{_SUCCESS.replace(' ', ':').replace(',:', ',')}>, attempt struct<{_ATTEMPT.replace(' ', ':').replace(',:', ',')}>, state string"


class Latest(StatefulProcessor):
    """A facility's latest success and latest attempt, neither of which moves back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.success, self.attempt = handle.getValueState("success", _SUCCESS), handle.getValueState("attempt", _ATTEMPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        success, attempt = self.success.get(), self.attempt.get()
        moved = False
        for frame in rows:
            read = frame[frame["value"].notna()]
            if len(read) and (success is None or read["at"].max() > success[0]):
                best = read.sort_values(["at", "batch", "value"], ascending=[False, True, True], kind="stable").iloc[0]
                success, moved = (best["at"], best["batch"], int(best["value"])), True
            tried = frame[frame["batch"].notna()]
            if len(tried) and (attempt is None or tried["batch"].max() > attempt[0]):
                # Of one batch a success outranks a failure.
                last = tried.sort_values(["batch", "state"], ascending=[False, False], kind="stable").iloc[0]
                attempt, moved = (last["batch"], last["state"], None if pd.isna(last["error_code"]) else last["error_code"]), True
        if moved:
            if success is not None:
                self.success.update(success)
            if attempt is not None:
                self.attempt.update(attempt)
            state = "failed" if attempt is not None and attempt[1] == "failed" else "reporting" if success is not None else "missing"
            yield pd.DataFrame({"facility": [key[0]], "success": [success and dict(zip(("at", "batch", "value"), success, strict=True))], "attempt": [attempt and dict(zip(("batch", "state", "error_code"), attempt, strict=True))], "state": [state]})

    def close(self) -> None:
        pass


def latest(stream: DataFrame) -> DataFrame:
    """(facility, success, attempt, state) of each facility whose latest reading or attempt has moved on, as updates.

    ``stream`` has facility, at, batch, value, and may have state and error_code: a row without a value is an attempt that gave
    no reading. Readings and attempts out of order never move a facility back. The state is one row a facility, kept by the
    state store of the checkpoint, where it can be read (``latest_state``); it needs Spark's RocksDB store, which is
    set for the session where none is named.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    have = set(stream.columns)
    success = F.when(F.col("value").isNotNull(), "success").otherwise("failed")
    rows = stream.select("facility", "at", "batch", F.col("value").cast("int").alias("value"), (F.coalesce("state", success) if "state" in have else success).alias("state"), (F.col("error_code") if "error_code" in have else F.lit(None).cast("string")).alias("error_code"))
    return rows.groupBy("facility").transformWithStateInPandas(Latest(), LATEST, "Update", "None")


def latest_state(spark: SparkSession, checkpoint: str, name: str = "success") -> DataFrame:
    """The state that a stream of ``latest`` has stored: (facility, and the fields of success or attempt)."""
    kept = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return kept.select("key.facility", "value.*")


_EMPTY = "facility string, success struct<at:timestamp,batch:timestamp,value:int>, attempt struct<batch:timestamp,state:string,error_code:string>"


def _merged(old: DataFrame | None, readings: DataFrame, attempts: DataFrame, registry: DataFrame) -> DataFrame:
    from slotwise.operators.latest import merge

    before = readings.sparkSession.createDataFrame([], _EMPTY) if old is None else old.select("facility", "success", "attempt")
    return merge(before, readings, attempts, registry)


def publish(stream: DataFrame, registry: DataFrame, path: str, checkpoint: str):
    """Merge each micro-batch into the published table (``commits.read``), one version a batch.

    The log names the last batch of this stream that it holds, so that a batch that is run again after a failure, before or
    after its version was published, is published once.
    """

    def put(batch: DataFrame, number: int) -> None:
        attempts = batch.groupBy("facility").agg(F.max("batch").alias("batch")).select("facility", "batch", F.lit("success").alias("state"), F.lit(None).cast("string").alias("error_code"))
        readings = batch.withColumn("pos", F.monotonically_increasing_id())
        commits.update(batch.sparkSession, path, lambda old: _merged(old, readings, attempts, registry), source=checkpoint, batch=number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def publish_once(readings: DataFrame, attempts: DataFrame, registry: DataFrame, path: str, tries: int = commits.TRIES, before_claim=None) -> int:
    """Merge readings and attempts into the newest version and publish the next one; gives its number."""
    return commits.update(readings.sparkSession, path, lambda old: _merged(old, readings, attempts, registry), tries=tries, before_claim=before_claim)
