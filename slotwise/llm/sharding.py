"""Shards by jump consistent hashing, with gapless row numbers in each shard.

The key alone decides the shard: a 64-bit linear congruential generator seeded by the key jumps
through ever larger shard counts, and the last jump below the count is the shard. Nothing is stored,
and one more shard takes over its fair part of the rows and moves no others. Jumps run in an Arrow
batch function, because they need wrapping 64-bit products.

Slots number the rows of a shard from 0, ordered by (bucket, key, checksum, size): buckets are a digest of
these three modulo a count that grows with the table, so that rows of one key spread. Rows that are equal in
them are counted before the shuffle and numbered as a block; blocks are numbered within (shard, bucket), and
the small table of bucket sizes gives each bucket its first slot. So no task sees a whole shard, the rows
of a hot key or the copies of a hot row.

Defined cases: a null key counts as 0 for shard and bucket and comes first; a null text has 0 bytes
and the checksum of the empty text; equal rows take neighbouring slots; texts of any length are
measured whole and do not travel; an empty table gives an empty result; further columns, whatever
their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import col, cut, stored

ROWS_A_BUCKET = 20_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, for ``shards`` shards."""
    state = keys.astype(np.uint64)
    shard = np.full(len(state), -1, np.int64)
    jump = np.zeros(len(state), np.int64)
    todo = np.arange(len(state))
    while len(todo):
        shard[todo] = jump[todo]
        state[todo] = state[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        jump[todo] = ((shard[todo] + 1) * (float(1 << 31) / ((state[todo] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        todo = todo[jump[todo] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jump(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(jump_hash(part.to_numpy(np.int64), shards))

    return jump(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")))


def assign_shards(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    blocks = stored(rows.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "blocks")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // rows_a_bucket))
    named = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("0")), "text_crc32", "size")
    bucket = F.pmod(F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
    blocks = blocks.withColumns({"bucket": bucket, "shard": shard_of(F.col("id"), shards), "grown_shard": shard_of(F.col("id"), shards + 1)})
    sizes = cut(blocks.groupBy("shard", "bucket").agg(F.sum("n").alias("rows")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut(sizes.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocks.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(firsts, ["shard", "bucket"]).withColumn("at", F.col("first") + F.col("at"))
    placed = numbered.select("id", "size", "text_crc32", "shard", "grown_shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("slot"))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
