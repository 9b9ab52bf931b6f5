"""Exact statistics as columns and as table operators. No sketches: results are exact."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile(x: Column | str, p: float) -> Column:
    """Linear interpolation at (n - 1) p, over any order of input."""
    return F.percentile(x, F.lit(p))


def median(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


def lower_median(x: str) -> Column:
    """The lower of the middle two for even counts; the state holds distinct values with their counts."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{x}`)")


def array_median(values: Column) -> Column:
    """Median of the non-null entries of an array; null if there is none."""
    kept = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(kept)
    low, high = F.get(kept, F.floor((n - 1) / 2).cast("int")), F.get(kept, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def average_rank(x: str, by: list[str]) -> Column:
    """Zero-based rank within ``by``; ties share their mean rank."""
    order, ties = Window.partitionBy(*by).orderBy(x), Window.partitionBy(*by, x)
    return F.rank().over(order) - 1 + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def with_average_rank(rows: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """``rows`` with ``average_rank`` as a column, for groups of any size.

    Equal values are counted before the shuffle, distinct values are numbered, and rows find their value's rank in a join, so
    that no task sorts a whole group's rows. Nulls come first, as in a sort.
    """
    counts = rows.groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(*[F.col(c).alias(f"rank_of_{c}") for c in (*by, x)], (before + (F.col("n") - 1) / F.lit(2.0)).alias(name))
    same = F.lit(True)
    for c in (*by, x):
        same &= F.col(c).eqNullSafe(F.col(f"rank_of_{c}"))
    return rows.join(ranks, same).drop(*[f"rank_of_{c}" for c in (*by, x)])


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation; null if either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def mid_rank(distribution: Column, value: Column) -> Column:
    """Percentile of a value in (value, n) pairs; equal values count half."""
    below = F.aggregate(distribution, F.lit(0.0), lambda a, d: a + d["n"] * F.when(d["value"] < value, 1.0).when(d["value"] == value, 0.5).otherwise(0.0))
    return F.try_divide(100 * below, F.aggregate(distribution, F.lit(0).cast("bigint"), lambda a, d: a + d["n"]))


#: Below, erfc is one less a series of positive terms; above, a continued fraction. Both are taken far enough to be exact in a double.
_ERFC_TURN, _ERFC_TERMS, _ERFC_LEVELS = 2.5, 80, 80


def erfc(x: Column) -> Column:
    """The complementary error function, in columns; to 12 places of relative accuracy for x >= 0."""
    size = F.abs(x)
    square = size * size
    term = lambda a, k: a["term"] * 2 * square / (2 * k + 1)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_ERFC_TERMS)), F.struct(size.alias("term"), size.alias("sum")), lambda a, k: F.struct(term(a, k).alias("term"), (a["sum"] + term(a, k)).alias("sum")), lambda a: a["sum"]
    )
    fraction = F.aggregate(F.sequence(F.lit(_ERFC_LEVELS), F.lit(1), F.lit(-1)), size, lambda f, k: size + k / 2.0 / f)
    scale = F.exp(-square) / math.sqrt(math.pi)
    upper = F.when(size < _ERFC_TURN, 1 - 2 * scale * series).otherwise(scale / fraction)
    return F.when(x.isNotNull(), F.when(x >= 0, upper).otherwise(2 - upper))


def p_value(r: Column, n_eff: Column, controls: int = 0) -> Column:
    """Two-sided p of a correlation by Fisher's transformation; null without degrees of freedom."""
    freedom = n_eff - 3 - controls
    bounded = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r))
    return F.when(r.isNotNull() & (freedom > 0), erfc(F.abs(F.atanh(bounded)) * F.sqrt(F.greatest(freedom, F.lit(0.0))) / math.sqrt(2)))


def benjamini_hochberg(tests: DataFrame, p: str, order: str, by: list[str], q: str = "q") -> DataFrame:
    """``tests`` with adjusted values: the running minimum of p m / rank from the largest p down. Nulls stay null and do not count."""
    none = F.col(p).isNull()
    group = Window.partitionBy(*(by or [F.lit(0)]), none)
    # From the largest p down, so that ranks and the minimum are running values of one order: a frame that ends with its group is made anew for each row.
    down = group.orderBy(F.desc(p), F.desc(order))
    m = F.count(F.lit(1)).over(group)
    ranked = tests.withColumn("bh_p", F.col(p) * m / (m - F.row_number().over(down) + 1))
    lowest = F.min("bh_p").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn(q, F.when(~none, F.least(F.lit(1.0), lowest))).drop("bh_p")


def spread(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median, 90th percentile, minimum and maximum, rounded half-even to two places."""
    return rows.groupBy(*by).agg(*[F.bround(e, 2).alias(n) for n, e in {"median": median(value), "p90": quantile(value, 0.9), "min": F.min(value), "max": F.max(value)}.items()])
