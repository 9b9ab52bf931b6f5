"""Association of pairs of facilities: deviations, rank correlations with effective sample sizes, FDR, episodes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.resampling import PARTS
from slotwise.functions.stats import average_rank, benjamini_hochberg, median, p_value, pearson
from slotwise.functions.time import local_hour
from slotwise.operators.places import name_pairs, small
from slotwise.policy import Association
from slotwise.session import cut


def deviations(compared: DataFrame, policy: Association) -> DataFrame:
    """(facility, bin, deviation): median supported delta of each hour with enough slots."""
    bins = (F.floor(F.unix_micros("at") / (policy.bin_seconds * 1_000_000)).cast("bigint") * policy.bin_seconds).alias("bin")
    return compared.where("delta IS NOT NULL").groupBy("facility", bins).agg(median("delta").alias("deviation"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= policy.minimum_slots).select("facility", "bin", "deviation")


def zero_share(readings: DataFrame, most: float = 0.1) -> DataFrame:
    """Share of zero readings by facility, and whether it is zero-heavy."""
    share = F.avg((F.col("value") == 0).cast("int"))
    return readings.groupBy("facility").agg(share.alias("zero_share"), (share > most).alias("zero_heavy"))


def zero_heavy(readings: DataFrame, begin: int, middle: int, end: int, most: float) -> DataFrame:
    """(facility, zero_heavy): whether more than ``most`` of its readings are zero in either of two periods, given in epoch seconds."""
    at = F.unix_seconds("at")
    inside = readings.where((at >= begin) & (at < end)).withColumn("later", at >= middle)
    shares = inside.groupBy("facility", "later").agg(F.avg((F.col("value") == 0).cast("int")).alias("share"))
    return shares.groupBy("facility").agg((F.max("share") > most).alias("zero_heavy"))


def changes(series: DataFrame, policy: Association) -> DataFrame:
    """Differences to the bin just before, where there is one."""
    before = series.select("facility", (F.col("bin") + policy.bin_seconds).alias("bin"), F.col("deviation").alias("last"))
    return series.join(before, ["facility", "bin"]).select("facility", "bin", (F.col("deviation") - F.col("last")).alias("deviation"))


def without_hours(series: DataFrame, policy: Association) -> DataFrame:
    """The series less each facility's mean of the local hour."""
    hour = local_hour(F.timestamp_seconds("bin"), policy.zone)
    return series.withColumn("deviation", F.col("deviation") - F.avg("deviation").over(Window.partitionBy("facility", hour)))


def aligned(series: DataFrame, tests: DataFrame, policy: Association) -> DataFrame:
    """(test columns, bin, x, y): the leader's value and the follower's, ``lag`` bins later."""
    x = series.select(F.col("facility").alias("leader"), "bin", F.col("deviation").alias("x"))
    y = series.select(F.col("facility").alias("follower"), F.col("bin").alias("y_bin"), F.col("deviation").alias("y"))
    led = tests.join(x, "leader").withColumn("y_bin", F.col("bin") + F.col("lag_hours") * policy.bin_seconds)
    return led.join(y, ["follower", "y_bin"]).select("family", "leader", "follower", "lag_hours", "bin", "y_bin", "x", "y")


KEY = ["family", "leader", "follower", "lag_hours"]


def correlate(rows: DataFrame, policy: Association, control: str | None = None) -> DataFrame:
    """Spearman correlation of x and y by test, the effective n, and p; partial if there is a control column."""
    rows = rows.where(f"{control} IS NOT NULL") if control else rows
    ranks = rows.withColumns({"rx": average_rank("x", KEY), "ry": average_rank("y", KEY), **({"rc": average_rank(control, KEY)} if control else {})})
    before = Window.partitionBy(*KEY).orderBy("bin")
    next_to = F.lag("bin").over(before) == F.col("bin") - policy.bin_seconds
    pairs = ranks.withColumns({"px": F.when(next_to, F.lag("rx").over(before)), "py": F.when(next_to, F.lag("ry").over(before))})
    lag1 = lambda a, b: F.when(F.count(a) > 2, F.coalesce(_partial(a, b), F.lit(0.0))).otherwise(0.0)
    figures = [F.count(F.lit(1)).alias("n"), pearson("rx", "ry").alias("rxy"), lag1("px", "rx").alias("ax"), lag1("py", "ry").alias("ay")]
    if control:
        figures += [pearson("rx", "rc").alias("rxc"), pearson("ry", "rc").alias("ryc")]
    out = pairs.groupBy(*KEY).agg(*figures)
    product = F.col("ax") * F.col("ay")
    n_eff = F.when(product > -1, F.least(F.col("n").cast("double"), F.col("n") * (1 - product) / (1 + product))).otherwise(F.col("n").cast("double"))
    r = F.col("rxy")
    if control:
        usable = (F.abs("rxc") < 1) & (F.abs("ryc") < 1)
        r = F.when(usable, (r - F.col("rxc") * F.col("ryc")) / F.sqrt((1 - F.col("rxc") * F.col("rxc")) * (1 - F.col("ryc") * F.col("ryc"))))
    few = F.col("n") < 4
    out = out.select(*KEY, "n", F.when(~few, r).alias("r"), F.when(~few, n_eff).alias("n_eff"))
    return out.withColumn("p", p_value(F.col("r"), F.col("n_eff"), 1 if control else 0))


def _partial(a: str, b: str):
    """Correlation over the rows where ``a`` is present."""
    x, y = F.col(a), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def tests_of(registry: DataFrame, policy: Association) -> DataFrame:
    """Every pair of the registry in each family: co-deviation, same-time change, lagged change both ways."""
    kinds = [("co_deviation", False, 0), ("same_time_change", False, 0), *[("lagged_change", turn, lag) for lag in policy.lags for turn in (False, True)]]
    made = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("turned"), F.lit(lag).alias("lag_hours")) for f, t, lag in kinds])).alias("k")
    rows = name_pairs(registry).select("a", "b", made)
    return rows.select("k.family", F.when(F.col("k.turned"), F.col("b")).otherwise(F.col("a")).alias("leader"), F.when(F.col("k.turned"), F.col("a")).otherwise(F.col("b")).alias("follower"), "k.lag_hours")


#: Values in the middle of a bin, among which is every median without two of its members.
_MIDDLE = 5


def with_swing(rows: DataFrame, series: DataFrame, policy: Association) -> DataFrame:
    """``rows`` with ``swing``: the median at their y_bin over all facilities but the two of the test, if these are enough.

    A bin's values are ranked once. Without two members the k-th value is that of rank k, moved up by one for each of
    the two that ranks no higher; so all medians of a bin lie among the few values in its middle, and a pair's row needs these, the
    number of values and two ranks. ``series`` has facility, bin, deviation, is_level.
    """
    by = ["is_level", "bin"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("deviation", "facility")) - 1
    ranked = series.withColumns({"place": rank, "n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    base = F.greatest(F.floor((F.col("n") - 3) / 2), F.lit(0))
    middle = ranked.groupBy("is_level", F.col("bin").alias("y_bin"), "n").agg(*[F.max(F.when(F.col("place") == base + k, F.col("deviation"))).alias(f"middle_{k}") for k in range(_MIDDLE)])
    place = lambda who: ranked.select("is_level", F.col("bin").alias("y_bin"), F.col("facility").alias(who), F.col("place").alias(f"{who}_place"))
    met = rows.join(middle, ["is_level", "y_bin"], "left").join(place("leader"), ["is_level", "y_bin", "leader"], "left").join(place("follower"), ["is_level", "y_bin", "follower"], "left")
    nowhere = F.col("n") + 1
    one, two = F.coalesce("leader_place", nowhere), F.coalesce("follower_place", nowhere)
    low, high = F.least(one, two), F.greatest(one, two)
    others = F.col("n") - F.col("leader_place").isNotNull().cast("int") - F.col("follower_place").isNotNull().cast("int")

    def value(k: Column) -> Column:
        at = k + (k >= low).cast("int")
        at = at + (at >= high).cast("int") - base
        return F.coalesce(*[F.when(at == j, F.col(f"middle_{j}")) for j in range(_MIDDLE)])

    swing = (value(F.floor((others - 1) / 2)) + value(F.floor(others / 2))) / 2
    return met.withColumn("swing", F.when(others >= policy.minimum_others, swing)).drop("n", "leader_place", "follower_place", *[f"middle_{k}" for k in range(_MIDDLE)])


def period_tests(series: DataFrame, registry: DataFrame, policy: Association) -> DataFrame:
    """All tests of a period with support, correlation, system-wide and residual-hour checks, q and the reverse lag."""
    series = cut(series)
    tests = tests_of(registry, policy).join(series.select(F.col("facility").alias("leader")).distinct(), "leader", "left_semi").join(series.select(F.col("facility").alias("follower")).distinct(), "follower", "left_semi")
    level, delta = series, changes(series, policy)
    is_level = F.col("family") == "co_deviation"
    both = lambda f: aligned(f(level), tests.where(is_level), policy).unionByName(aligned(f(delta), tests.where(~is_level), policy))
    rows = both(lambda s: s)
    rows = with_swing(rows.withColumn("is_level", is_level), level.withColumn("is_level", F.lit(True)).unionByName(delta.withColumn("is_level", F.lit(False))), policy).drop("is_level")
    by_day = rows.groupBy(*KEY, F.floor(F.col("bin") / 86400).alias("day")).count()
    support = by_day.groupBy(*KEY).agg(F.sum("count").alias("bins"), F.count_if(F.col("count") >= policy.minimum_day_bins).alias("days"))
    main = correlate(rows, policy)
    partial = correlate(rows, policy, "swing").select(*KEY, F.col("r").alias("system_r"), F.col("p").alias("system_p"))
    residual = correlate(both(lambda s: without_hours(s, policy)), policy).select(*KEY, F.col("r").alias("residual_r"), F.col("p").alias("residual_p"))
    enough = (F.col("bins") >= policy.minimum_bins) & (F.col("days") >= policy.minimum_days)
    out = tests.join(support, KEY, "left").join(main, KEY, "left").join(partial, KEY, "left").join(residual, KEY, "left")
    out = out.withColumns({"bins": F.coalesce("bins", F.lit(0)), "days": F.coalesce("days", F.lit(0))})
    ok = F.coalesce(enough, F.lit(False))
    out = out.select(*KEY, "bins", "days", F.when(ok, "tested").otherwise("insufficient_support").alias("state"), *[F.when(ok, F.col(c)).alias(c) for c in ("r", "n_eff", "p", "system_r", "system_p", "residual_r", "residual_p")])
    out = out.withColumn("name", F.concat_ws("|", "leader", "follower", F.col("lag_hours").cast("string")))
    out = benjamini_hochberg(out, "p", "name", ["family"]).drop("name")
    back = out.where("family = 'lagged_change'").select("family", F.col("follower").alias("leader"), F.col("leader").alias("follower"), "lag_hours", F.col("r").alias("reverse_r"))
    return out.join(back, KEY, "left")


def is_candidate(tests: DataFrame, policy: Association) -> DataFrame:
    """``tests`` with the verdicts robust, dominant and candidate."""
    sign = F.signum("r")
    same = lambda r, p: F.coalesce((F.col(r) * sign > 0) & (F.col(p) < policy.robust_p), F.lit(False))
    robust = same("system_r", "system_p") & same("residual_r", "residual_p")
    dominant = (F.col("family") != "lagged_change") | F.coalesce(F.abs("r") > F.abs("reverse_r"), F.lit(False))
    strong = F.coalesce((F.col("q") <= policy.fdr_q) & (F.abs("r") >= policy.discovery_effect), F.lit(False))
    return tests.withColumns({"robust": robust, "dominant": dominant}).withColumn("candidate", strong & F.col("robust") & F.col("dominant"))


def confirm(first: DataFrame, later: DataFrame, policy: Association) -> DataFrame:
    """Candidates of the first period, tested again in the later one with FDR over them alone."""
    chosen = is_candidate(first, policy).where("candidate").select(*KEY, F.signum("r").alias("sign"))
    again = is_candidate(later, policy).select(*KEY, "r", "p", "robust", "dominant")
    met = chosen.join(again, KEY).withColumn("name", F.concat_ws("|", *[F.col(k).cast("string") for k in KEY]))
    met = benjamini_hochberg(met, "p", "name", []).drop("name")
    good = (F.col("q") <= policy.fdr_q) & (F.col("r") * F.col("sign") >= policy.confirmation_effect) & F.col("robust") & F.col("dominant")
    return met.select(*KEY, F.col("q").alias("confirmation_q"), F.coalesce(good, F.lit(False)).alias("confirmed"))


def band_summary(tests: DataFrame, distances: DataFrame, policy: Association) -> DataFrame:
    """By family and distance band: pairs, median r, share of positive r, significant tests. ``distances`` has a, b, band."""
    both = distances.select(F.col("a").alias("leader"), F.col("b").alias("follower"), "band").unionByName(distances.select(F.col("b").alias("leader"), F.col("a").alias("follower"), "band"))
    met = tests.where("r IS NOT NULL").join(small(both, 100_000), ["leader", "follower"])
    return met.groupBy("family", "band").agg(F.count(F.lit(1)).alias("pairs"), F.round(median("r"), 6).alias("median_r"), F.avg((F.col("r") > 0).cast("int")).alias("positive_share"), F.count_if(F.col("q") <= policy.fdr_q).alias("significant"))


def family_counts(tests: DataFrame) -> DataFrame:
    """How many pairs of each family were tested, of how many."""
    return tests.groupBy("family").agg(F.count(F.lit(1)).alias("pairs"), F.count("p").alias("tested"))


def series_support(series: DataFrame, zeros: DataFrame, registry: DataFrame, policy: Association) -> DataFrame:
    """(facility, bins, zero_share, lag1) of every facility: its bins, share of zero readings, and lag-1 autocorrelation of its deviations."""
    before = series.select("facility", (F.col("bin") + policy.bin_seconds).alias("bin"), F.col("deviation").alias("last"))
    lag1 = series.join(before, ["facility", "bin"]).groupBy("facility").agg(F.when(F.count(F.lit(1)) > 2, F.coalesce(pearson("last", "deviation"), F.lit(0.0))).otherwise(0.0).alias("lag1"))
    bins = series.groupBy("facility").agg(F.count(F.lit(1)).alias("bins"))
    rows = registry.select("facility").join(bins, "facility", "left").join(zeros.select("facility", "zero_share"), "facility", "left").join(lag1, "facility", "left")
    return rows.select("facility", F.coalesce("bins", F.lit(0)).alias("bins"), "zero_share", F.coalesce("lag1", F.lit(0.0)).alias("lag1"))


def episodes(series: DataFrame, pairs: DataFrame, threshold: float, policy: Association, limit: int = 5) -> DataFrame:
    """The longest runs of consecutive bins in which both of a pair stand above the threshold."""
    a = series.where(F.col("deviation") >= threshold)
    hits = pairs.join(a.select(F.col("facility").alias("a"), "bin", F.col("deviation").alias("da")), "a").join(a.select(F.col("facility").alias("b"), "bin", F.col("deviation").alias("db")), ["b", "bin"])
    order = Window.partitionBy("a", "b").orderBy("bin")
    runs = hits.withColumn("run", F.col("bin") - policy.bin_seconds * F.row_number().over(order))
    found = runs.groupBy("a", "b", "run").agg(F.min("bin").alias("start"), (F.max("bin") + policy.bin_seconds).alias("end"), F.count(F.lit(1)).alias("hours"), median("da").alias("median_a"), median("db").alias("median_b"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("hours"), "start"))
    return found.withColumn("place", place).where(F.col("place") <= limit).drop("run")


def _ranks(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ranks from 0 in every resample, a row of ``weight``, which says how often each value occurs in it; ties share their mean."""
    order = np.argsort(values, kind="stable")
    ends = np.flatnonzero(np.append(values[order][1:] != values[order][:-1], True))
    upto = np.cumsum(weight[:, order], axis=1)[:, ends]
    ranks = upto - (np.diff(upto, axis=1, prepend=0) + 1) / 2
    return ranks[:, np.searchsorted(values[order][ends], values)]


def _rank_correlations(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rank correlation in every resample; not a number without variance."""
    n = weight.sum(1, keepdims=True)
    a, b = (r - (weight * r).sum(1, keepdims=True) / n for r in (_ranks(x, weight), _ranks(y, weight)))
    of = lambda p, q: (weight * p * q).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return of(a, b) / np.sqrt(of(a, a) * of(b, b))


def bootstrap(rows: DataFrame, policy: Association) -> DataFrame:
    """95 % interval of the rank correlation of each test by resampling of UTC days, drawn by hashes of (seed, test, resample, number).

    The resamples of a test are dealt to ``PARTS`` tasks, each with the test's rows, one an hour of a period. A resample is how often
    each day is drawn, and its ranks are sums of those weights. Correlations without variance do not count, and below 20 there is no interval.
    """
    resamples, seed = policy.resamples, policy.seed

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        days, day = np.unique(frame["bin"].to_numpy() // 86400, return_inverse=True)
        name = "|".join(map(str, key[:-1]))
        mine = range(int(key[-1]), resamples, PARTS)
        times = np.zeros((len(mine), len(days)))
        for row, r in zip(times, mine, strict=True):
            for j in range(len(days)):
                row[int(hashlib.md5(f"{seed}:{name}:{r}:{j}".encode()).hexdigest()[:8], 16) % len(days)] += 1
        found = _rank_correlations(x, y, times[:, day])
        return pd.DataFrame({**dict(zip(KEY, key, strict=False)), "r": [float(v) if np.isfinite(v) else None for v in found]}, columns=[*KEY, "r"])

    dealt = rows.select(*KEY, "bin", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    each = dealt.groupBy(*KEY, "part").applyInPandas(run, "family string, leader string, follower string, lag_hours int, r double")
    values = each.groupBy(*KEY).agg(F.sort_array(F.collect_list("r")).alias("v"))
    end = lambda q: F.when(F.size("v") >= 20, F.get("v", F.floor(q * (F.size("v") - 1)).cast("int")))
    return values.select(*KEY, end(0.025).alias("low"), end(0.975).alias("high"))


def merged(first: DataFrame, later: DataFrame) -> DataFrame:
    """The series of two periods as one; where both have a bin, the later one counts."""
    both = first.withColumn("period", F.lit(0)).unionByName(later.withColumn("period", F.lit(1)))
    return both.groupBy("facility", "bin").agg(F.max_by("deviation", "period").alias("deviation"))


def study(first: DataFrame, later: DataFrame, registry: DataFrame, distances: DataFrame, zeros: DataFrame, policy: Association) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Discovery over all pairs of one period's series, confirmation of its candidates in another's.

    Gives the candidates with their label, both periods' correlation and interval and the confirmation's q; the episodes of
    the confirmed ones; and all tests with a column ``period``. ``distances`` has a, b, km, band; ``zeros`` facility, zero_heavy.
    A pair with a zero-heavy facility stays exploratory.
    """
    tests = {name: cut(is_candidate(period_tests(s, registry, policy), policy)) for name, s in (("discovery", first), ("confirmation", later))}
    found = tests["discovery"].where("candidate")
    again = confirm(tests["discovery"], tests["confirmation"], policy)
    heavy = zeros.where("zero_heavy").select("facility")
    of_pair = lambda c: heavy.select(F.col("facility").alias(c), F.lit(True).alias(f"heavy_{c}"))
    km = distances.select(F.col("a").alias("leader"), F.col("b").alias("follower"), "km", "band").unionByName(distances.select(F.col("b").alias("leader"), F.col("a").alias("follower"), "km", "band"))
    rows = found.select(*KEY, "r", "q").join(tests["confirmation"].select(*KEY, F.col("r").alias("later_r"), F.col("p").alias("later_p")), KEY, "left").join(again, KEY, "left")
    rows = rows.join(small(km, 100_000), ["leader", "follower"], "left").join(of_pair("leader"), "leader", "left").join(of_pair("follower"), "follower", "left")
    rows = rows.withColumn("label", F.when(F.coalesce("heavy_leader", "heavy_follower", F.lit(False)), "exploratory").when(F.coalesce("confirmed", F.lit(False)), "confirmed").otherwise("not_supported")).drop("heavy_leader", "heavy_follower")
    for name, series in (("discovery", first), ("confirmation", later)):
        level = F.col("family") == "co_deviation"
        wanted = found.select(*KEY)
        aligned_rows = aligned(series, wanted.where(level), policy).unionByName(aligned(changes(series, policy), wanted.where(~level), policy))
        rows = rows.join(bootstrap(aligned_rows, policy).select(*KEY, F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high")), KEY, "left")
    rows = cut(rows)
    pairs = rows.where("label = 'confirmed'").select(F.col("leader").alias("a"), F.col("follower").alias("b")).distinct()
    return rows, episodes(merged(first, later), pairs, policy.episode_minutes, policy), tests["discovery"].withColumn("period", F.lit("discovery")).unionByName(tests["confirmation"].withColumn("period", F.lit("confirmation")))
