"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("a cluster must name its shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage ended by a reliable checkpoint."""
    folder = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a larger intermediate as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/slotwise/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
