"""Column statistics against plain Python."""

from __future__ import annotations

import math
import statistics
import time

from pyspark.sql import functions as F

from slotwise.functions import stats
from slotwise.functions.geo import coordinate, distance_km
from slotwise.functions.time import calendar, instant


def test_medians_and_quantiles(spark):
    values = [5, 1, 9, 3, 3, 8]
    row = spark.createDataFrame([(v,) for v in values], "v int").agg(stats.median("v").alias("m"), stats.quantile("v", 0.9).alias("q"), stats.lower_median("v").alias("low")).first()
    assert row.m == statistics.median(values) and row.low == statistics.median_low(values)
    assert math.isclose(row.q, 8 + 0.5 * (9 - 8))


def test_average_ranks_of_groups(spark):
    rows = [("a", v) for v in (0, 0, 5, 3, None)] + [(None, v) for v in (2, 2, 2)] + [("b", 7)]
    df = spark.createDataFrame(rows, "g string, v int")
    small = df.withColumn("r", stats.average_rank("v", ["g"])).collect()
    large = stats.with_average_rank(df, "v", ["g"], "r").collect()
    assert sorted(map(str, small)) == sorted(map(str, large)) and {r.v: r.r for r in large if r.g == "a"} == {None: 0, 0: 1.5, 3: 3, 5: 4}


def test_array_median_of_nulls_and_ties(spark):
    df = spark.createDataFrame([([None, 4.0, 1.0],), ([],), ([2.0],)], "v array<double>")
    assert [r[0] for r in df.select(stats.array_median(F.col("v"))).collect()] == [2.5, None, 2.0]


def test_p_value_needs_freedom(spark):
    df = spark.createDataFrame([(0.5, 30.0), (0.5, 3.0), (None, 30.0)], "r double, n double")
    found = [r[0] for r in df.select(stats.p_value(F.col("r"), F.col("n"))).collect()]
    assert math.isclose(found[0], math.erfc(abs(math.atanh(0.5)) * math.sqrt(27) / math.sqrt(2))) and found[1:] == [None, None]


def test_false_discovery_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.9), ("d", None)], "k string, p double")
    found = {r.k: r.q for r in stats.benjamini_hochberg(df, "p", "k", []).collect()}
    assert math.isclose(found["a"], 0.03) and math.isclose(found["b"], 0.03) and math.isclose(found["c"], 0.9) and found["d"] is None


def test_distance(spark):
    row = spark.range(1).select(distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"), coordinate(F.lit(float("nan")), 90).alias("nan"), coordinate(F.lit(-90.0), 90).alias("pole")).first()
    assert math.isclose(row.half, math.pi * 6371.0088) and not row.nan and row.pole


def test_days_with_a_clock_change(spark):
    by_day = {str(r.local_date): r.n for r in calendar(spark, "2026-03-07", "2026-03-09", "America/Chicago", 900).groupBy("local_date").agg(F.sum("n_slots").alias("n")).collect()}
    assert by_day == {"2026-03-07": 96, "2026-03-08": 92, "2026-03-09": 96}


def test_instants_need_an_offset(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-01T00:00:00",), ("x",), (None,), ("2026-13-01T00:00:00Z",)], "t string")
    assert [r[0] is not None for r in df.select(instant(F.col("t"))).collect()] == [True, False, False, False, False]


def test_erfc_is_that_of_the_library(spark):
    xs = [0.0, 1e-300, 1e-9, 0.01, 0.3, 1.0, 1.7, 2.4999, 2.5, 2.5001, 3.0, 5.0, 9.0, 15.0, 26.0, 40.0, -0.5, -3.0, None]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect()
    for r in rows:
        assert (r.y is None) == (r.x is None) and (r.x is None or math.isclose(r.y, math.erfc(r.x), rel_tol=1e-12, abs_tol=1e-300)), r


def test_false_discovery_of_a_large_family(spark):
    """Linear in the family: against plain Python, with ties and nulls, in a time that a quadratic frame does not keep."""
    ps = [None if k % 11 == 0 else (k * 7919 % 5003 + 1) / 20000 for k in range(150_000)]
    df = spark.range(len(ps)).select(F.col("id").alias("k"), F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 5003 + 1) / 20000.0).alias("p"))
    began = time.time()
    found = {r.k: r.q for r in stats.benjamini_hochberg(df, "p", "k", []).collect()}
    assert time.time() - began < 30
    order = sorted((k for k, p in enumerate(ps) if p is not None), key=lambda k: (ps[k], k))
    lowest, expected = 1.0, dict.fromkeys(range(len(ps)))
    for rank in range(len(order), 0, -1):
        lowest = expected[order[rank - 1]] = min(lowest, ps[order[rank - 1]] * len(order) / rank)
    assert found == expected
