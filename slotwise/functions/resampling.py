"""Bootstrap of day blocks by counted draws.

A draw is a hash of (seed, resample, number), so that every resample is known without those before it: resamples
are rows that Spark spreads over tasks, the same on every run and after the loss of an executor, and SQL can draw them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.stats import quantile

#: Parts into which the resamples of a test are dealt.
PARTS = 20


def draw(seed: int, resample: Column, number: Column, size: Column) -> Column:
    """A place from 0 to below ``size``: the first 32 bits of the MD5 of ``seed:resample:number``, modulo the size."""
    of = F.md5(F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), number.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(of, 1, 8), 16, 10).cast("bigint"), size).cast("int")


def picks(sizes: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(size, part, resample, picks): what every resample draws from ``size`` blocks, as often as there are blocks."""
    numbers = F.sequence(F.lit(0), F.col("size") - 1)
    each = sizes.select("size", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    return each.select("size", (F.col("resample") % PARTS).alias("part"), "resample", F.transform(numbers, lambda j: draw(seed, F.col("resample"), j, F.col("size"))).alias("picks"))


def ratio_intervals(blocks: DataFrame, by: list[str], resamples: int, seed: int, tail: float = 0.025) -> DataFrame:
    """(by, low, high): the interval of the ratio of two sums over blocks drawn with replacement.

    ``blocks`` has (by, k, size, top, bottom): a test's totals in its block ``k`` of ``size``; blocks without a row count as zeros. Resamples whose
    lower sum is zero do not count; a test without others has no row. The draws depend on the size alone, so tests over the
    same blocks draw the same ones. A test's totals, one a day of a period, travel as an array to the parts of the resamples.
    """
    zero = F.lit(0.0)
    rows = blocks.select(*by, F.col("k").cast("int"), F.col("size").cast("int"), F.col("top").cast("double"), F.col("bottom").cast("double"))
    whole = rows.groupBy(*by).agg(F.max("size").alias("size")).select(*by, F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k"), "size", zero.alias("top"), zero.alias("bottom"))
    filled = rows.unionByName(whole).groupBy(*by, "k").agg(F.max("size").alias("size"), F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
    tests = filled.groupBy(*by).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("k", "top", "bottom"))).alias("blocks"))
    drawn = picks(tests.select("size").distinct(), resamples, seed)
    met = tests.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).join(drawn, ["size", "part"])
    chosen = F.transform("picks", lambda k: F.get("blocks", k))
    total = F.aggregate(chosen, F.struct(zero.alias("top"), zero.alias("bottom")), lambda s, b: F.struct((s["top"] + b["top"]).alias("top"), (s["bottom"] + b["bottom"]).alias("bottom")))
    sums = met.select(*by, total.alias("total")).where("total.bottom > 0")
    return sums.select(*by, (F.col("total.top") / F.col("total.bottom")).alias("ratio")).groupBy(*by).agg(quantile("ratio", tail).alias("low"), quantile("ratio", 1 - tail).alias("high"))
