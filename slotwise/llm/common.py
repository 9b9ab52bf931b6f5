"""Session helpers shared by the operators: shared folder, lineage cuts, safe column handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.session import cut, shared_dir, stored

__all__ = ["HOT_KEYS", "col", "cut", "digest", "fresh", "looked_up", "read", "shared_dir", "running_totals", "stored", "whole_row"]

#: Rows of a table that are broadcast at most; of a larger one, those of the most frequent keys.
HOT_KEYS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own names cannot clash with them."""
    return F.struct(*[col(c) for c in df.columns])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores, whichever the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def digest(text: Column) -> Column:
    """128-bit identity of a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key, with the number of rows that have it in ``count``), null where it has none.

    A table of up to ``hot_keys`` rows is broadcast. Of a larger one, keys that more than one in ``hot_keys`` of the
    counted rows have are broadcast, of which there are fewer than ``hot_keys``; the other keys, none of
    which has many rows, meet theirs in a shuffle. ``rows`` should be a stored table: it is read twice then.
    """
    table = stored(table, "lookup")
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(count), F.lit(0))).first()
    if n <= hot_keys:
        return rows.join(F.broadcast(table), key, "left")
    hot = table.where(F.col(count) * F.lit(hot_keys) > F.lit(total))
    cold = table.where(F.col(count) * F.lit(hot_keys) <= F.lit(total))
    often = rows.join(F.broadcast(hot), key)
    seldom = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("shuffle_merge"), key, "left")
    return often.unionByName(seldom)


def running_totals(rows: DataFrame, group: str, value: str, tie: str, at: str, a_bucket: int = 20_000, buckets_a_block: int = 1_000) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, within each ``group``, as ``at``.

    The order is by a hash of ``tie``, which must be unique: rows are dealt to buckets of about ``a_bucket`` by it and summed there;
    sums of buckets are added up within blocks, and those of blocks within the group. So a task sees a bucket, the
    buckets of a block or the blocks of a group, never the rows of a large group. ``rows`` should be a stored table.
    """
    buckets = max(1, -(-rows.count() // a_bucket))
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(tie), F.lit(buckets)))
    sums = cut(placed.groupBy(group, "bucket").agg(F.sum(value).alias("total")).withColumn("block", F.floor(F.col("bucket") / buckets_a_block)))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy(group, "block").agg(F.sum("total").alias("total"))
    blocks = blocks.select(group, "block", F.coalesce(F.sum("total").over(before([group], "block")), F.lit(0)).alias("from_block"))
    within = sums.withColumn("from_bucket", F.coalesce(F.sum("total").over(before([group, "block"], "bucket")), F.lit(0)))
    firsts = cut(within.join(blocks, [group, "block"]).select(group, "bucket", (F.col("from_block") + F.col("from_bucket")).alias("first")))
    own = F.coalesce(F.sum(value).over(before([group, "bucket"], tie)), F.lit(0))
    return placed.withColumn("own", own).join(firsts, [group, "bucket"]).withColumn(at, F.col("first") + F.col("own")).drop("own", "first", "bucket")
