"""Forecast grid, rolling-origin replay of benchmark models, scores, intervals and gates, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.resampling import ratio_intervals
from slotwise.functions.stats import quantile
from slotwise.functions.time import local_date, local_hour
from slotwise.operators.baseline import models
from slotwise.policy import Baseline, Forecast

# The benchmark models in order of preference; the names of metrics below are fixed too.
MODELS = ("carry_forward", "daily_naive", "weekly_naive", "m1_median")


def origins(grid: DataFrame, start: int, end: int, policy: Forecast) -> DataFrame:
    """(facility, origin, horizon_minutes, target): hourly origins of every facility; targets at or past the end are left out."""
    spine = grid.select("facility").distinct().select("facility", F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(max(start, end - 1)).cast("bigint"), F.lit(policy.origin_seconds).cast("bigint"))).alias("origin"))
    rows = spine.select("*", F.explode(F.array(*[F.lit(h) for h in policy.horizons_minutes])).alias("horizon_minutes"))
    return rows.withColumn("target", F.col("origin") + 60 * F.col("horizon_minutes")).where(F.col("target") < end)


def usual_targets(asked: DataFrame, policy: Forecast, delay_slots: int = 0) -> DataFrame:
    """``asked`` (facility, origin, target) with local_date and local_hour of the target and known_before, the origin's local day.

    A forecast over local midnight uses what was known before the day of its origin, not before that of its target.
    """
    at = lambda c: F.timestamp_seconds(c)
    return asked.withColumns(
        {
            "local_date": local_date(at(F.col("target")), policy.zone),
            "local_hour": local_hour(at(F.col("target")), policy.zone),
            "known_before": local_date(at(F.col("origin") - delay_slots * policy.cadence_seconds), policy.zone),
        }
    )


def usual_medians(slots: DataFrame, cal: DataFrame, asked: DataFrame, policy: Forecast, baseline: Baseline, delay_slots: int = 0) -> DataFrame:
    """(facility, origin, target, m1_median): the usual median of each target's local day and hour. ``slots`` has the grid's winners."""
    keyed = usual_targets(asked.select("facility", "origin", "target").distinct(), policy, delay_slots)
    key = ["facility", "local_date", "local_hour", "known_before"]
    found = models(keyed.select(*key).distinct(), slots, cal, baseline).select(*key, F.col("median").alias("m1_median"))
    return keyed.join(found, key).select("facility", "origin", "target", "m1_median")


def spikes(grid: DataFrame, asked: DataFrame, policy: Forecast, delay_slots: int = 0) -> DataFrame:
    """(facility, origin, p90) of the trailing days up to the cutoff, where they have enough slots.

    Origins are exploded to the days that they look back on, a bounded number, and meet the slots of each in an equi-join.
    """
    window, cut = policy.spike_days * 86400, delay_slots * policy.cadence_seconds
    day = lambda c: F.floor(c / 86400).cast("bigint")
    days = asked.select("facility", "origin").distinct().withColumn("day", F.explode(F.sequence(day(F.col("origin") - window), day(F.col("origin") - cut))))
    values = grid.select("facility", "slot_end", "value", day(F.col("slot_end")).alias("day"))
    met = days.join(values, ["facility", "day"]).where((F.col("slot_end") > F.col("origin") - window) & (F.col("slot_end") <= F.col("origin") - cut))
    found = met.groupBy("facility", "origin").agg(F.count(F.lit(1)).alias("n"), quantile("value", 0.9).alias("p90"))
    return found.where(F.col("n") >= policy.spike_minimum).select("facility", "origin", "p90")


def replay(grid: DataFrame, usual: DataFrame, start: int, end: int, policy: Forecast, delay_slots: int = 0) -> DataFrame:
    """Benchmark predictions of every origin and horizon, with the actual value.

    ``usual`` comes from ``usual_medians``. Nothing is predicted if the latest available slot is empty. Every
    lookup is an equi-join on (facility, slot).
    """
    cut = delay_slots * policy.cadence_seconds
    value = lambda name, at: grid.select("facility", F.col("slot_end").alias(at), F.col("value").alias(name))
    rows = origins(grid, start, end, policy).withColumns(
        {
            "cutoff": F.col("origin") - cut,
            "daily_at": F.col("target") - policy.daily_slots * policy.cadence_seconds,
            "weekly_at": F.col("target") - policy.weekly_slots * policy.cadence_seconds,
        }
    )
    rows = rows.join(value("actual", "target"), ["facility", "target"], "left").join(value("current", "cutoff"), ["facility", "cutoff"], "left")
    rows = rows.join(value("day", "daily_at"), ["facility", "daily_at"], "left").join(value("week", "weekly_at"), ["facility", "weekly_at"], "left")
    rows = rows.join(usual, ["facility", "origin", "target"], "left")
    there = F.col("current").isNotNull()
    rows = rows.select(
        "facility", "origin", "target", "horizon_minutes", "actual",
        F.col("current").cast("double").alias("carry_forward"),
        F.when(there & (F.col("daily_at") <= F.col("cutoff")), F.col("day")).cast("double").alias("daily_naive"),
        F.when(there & (F.col("weekly_at") <= F.col("cutoff")), F.col("week")).cast("double").alias("weekly_naive"),
        F.when(there, F.col("m1_median")).cast("double").alias("m1_median"),
    )
    rows = rows.join(spikes(grid, rows, policy, delay_slots), ["facility", "origin"], "left")
    return rows.withColumn("spike", F.coalesce(F.col("actual") > F.col("p90"), F.lit(False))).drop("p90")


def with_candidates(rows: DataFrame, predictions: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """The long form of the benchmark ``rows`` with the candidates' predictions beside them, matched over all models.

    ``predictions`` has facility, model, origin, horizon_minutes, prediction; a row that a candidate lacks is null.
    """
    wide = predictions.groupBy("facility", "origin", "horizon_minutes").agg(*[F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(m) for m in candidates])
    return long_form(rows.join(wide, ["facility", "origin", "horizon_minutes"], "left"), (*MODELS, *candidates))


def long_form(rows: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """(facility, origin, target, horizon_minutes, actual, spike, matched, model, place, prediction)."""
    matched = F.col("actual").isNotNull()
    for m in models:
        matched &= F.col(m).isNotNull()
    made = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("place"), F.col(m).alias("prediction")) for k, m in enumerate(models)])).alias("m")
    keys = [c for c in rows.columns if c not in models]
    return rows.select(*keys, matched.alias("matched"), made).select(*keys, "matched", "m.*")


def metrics(rows: DataFrame, by: list[str], only: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates of the error metrics over the rows for which ``only`` holds."""
    only = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    scored = only & F.col("actual").isNotNull() & F.col("prediction").isNotNull()
    error = F.when(scored, F.col("prediction") - F.col("actual"))
    target = only & F.col("actual").isNotNull()
    day = F.floor(F.col("origin") / 86400)
    return [
        c.alias(prefix + n)
        for n, c in {
            "origins": F.count_if(only), "targets": F.count_if(target), "missing_targets": F.count_if(only & F.col("actual").isNull()), "scored": F.count(error),
            "abstentions_with_target": F.count_if(target) - F.count(error), "availability_with_target": F.round(F.try_divide(F.count(error), F.count_if(target)), 9),
            "days": F.count_distinct(F.when(scored, day)), "mae": F.round(F.avg(F.abs(error)), 9), "rmse": F.round(F.sqrt(F.avg(error * error)), 9), "bias": F.round(F.avg(error), 9),
        }.items()
    ]


def score_models(rows: DataFrame) -> DataFrame:
    """All, matched, zero-target and spike-target metrics by facility, horizon and model, in one aggregation."""
    by = ["facility", "horizon_minutes", "model", "place"]
    parts = [("", None), ("matched_", F.col("matched")), ("zero_", F.col("actual") == 0), ("spike_", F.col("spike"))]
    return rows.groupBy(*by).agg(*[c for prefix, only in parts for c in metrics(rows, by, only, prefix)])


def winners(scores: DataFrame) -> DataFrame:
    """The model of least matched error by facility and horizon; of equals the first in order."""
    ok = scores.where("matched_mae IS NOT NULL")
    return ok.groupBy("facility", "horizon_minutes").agg(F.min_by("model", F.struct("matched_mae", "place")).alias("winner"))


def intervals(rows: DataFrame, policy: Forecast) -> DataFrame:
    """Empirical bands from the model's own errors whose targets lie in the trailing days before the origin.

    Errors are keyed by target day and origins exploded to the few days they may use, so that the
    range condition refines an equi-join.
    """
    window = policy.interval_days * 86400
    errors = rows.where("actual IS NOT NULL AND prediction IS NOT NULL").select("facility", "horizon_minutes", "model", F.col("target").alias("t"), (F.col("actual") - F.col("prediction")).alias("e"), F.floor(F.col("target") / 86400).cast("bigint").alias("day"))
    asked = rows.where("prediction IS NOT NULL").select("facility", "horizon_minutes", "model", "origin", F.explode(F.sequence(F.floor((F.col("origin") - window) / 86400).cast("bigint"), F.floor(F.col("origin") / 86400).cast("bigint"))).alias("day"))
    met = asked.join(errors, ["facility", "horizon_minutes", "model", "day"]).where((F.col("t") > F.col("origin") - window) & (F.col("t") <= F.col("origin")))
    tails = sorted({q for level in policy.levels for q in ((1 - level / 100) / 2, 1 - (1 - level / 100) / 2)})
    found = met.groupBy("facility", "horizon_minutes", "model", "origin").agg(F.count(F.lit(1)).alias("errors"), *[quantile("e", q).alias(f"q{k}") for k, q in enumerate(tails)]).where(F.col("errors") >= policy.minimum_errors)
    out = rows.join(found, ["facility", "horizon_minutes", "model", "origin"], "left")
    for level in policy.levels:
        low, high = tails.index((1 - level / 100) / 2), tails.index(1 - (1 - level / 100) / 2)
        for end, k in (("lo", low), ("hi", high)):
            out = out.withColumn(f"{end}_{level}", F.when(F.col("errors").isNotNull(), F.greatest(F.lit(0.0), F.col("prediction") + F.col(f"q{k}"))))
    return out.drop("errors", *[f"q{k}" for k in range(len(tails))])


def score(rows: DataFrame, by: list[str], policy: Forecast) -> DataFrame:
    """Metrics with the coverage and median width of each band."""
    extra = []
    for level in policy.levels:
        lo, hi = F.col(f"lo_{level}"), F.col(f"hi_{level}")
        banded = F.col("actual").isNotNull() & lo.isNotNull()
        extra += [
            F.round(F.avg(F.when(banded, F.col("actual").between(lo, hi).cast("int"))), 9).alias(f"coverage_{level}"),
            F.round(F.percentile(F.when(banded, hi - lo), F.lit(0.5)), 9).alias(f"width_{level}"),
            F.count_if(banded).alias(f"intervals_{level}"),
        ]
    return rows.groupBy(*by).agg(*metrics(rows, by), *extra)


def chosen_models(scores: DataFrame, benchmarks: tuple[str, ...], candidates: tuple[str, ...]) -> DataFrame:
    """(facility, horizon_minutes, benchmark, candidate): of each kind the model of least matched error; without any, the first in order."""
    of = lambda names, name: F.min_by(F.when(F.col("model").isin(*names), F.col("model")), F.when(F.col("model").isin(*names), F.struct(F.coalesce("matched_mae", F.lit(float("inf"))), "place"))).alias(name)
    return scores.groupBy("facility", "horizon_minutes").agg(of(benchmarks, "benchmark"), of(candidates, "candidate"))


def paired(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(facility, horizon_minutes, origin, actual, b, c): predictions of the chosen benchmark and candidate, in origins that both predict and that have a target."""
    key = ["facility", "horizon_minutes"]
    picked = rows.join(F.broadcast(chosen) if chosen.count() <= 100_000 else chosen, key).where("actual IS NOT NULL AND prediction IS NOT NULL AND model IN (benchmark, candidate)")
    side = lambda c: F.max(F.when(F.col("model") == F.col(c), F.col("prediction")))
    return picked.groupBy(*key, "origin", "actual").agg(side("benchmark").alias("b"), side("candidate").alias("c")).where("b IS NOT NULL AND c IS NOT NULL")


def bootstrap_gain(pairs: DataFrame, policy: Forecast, level: float = 0.95) -> DataFrame:
    """Gain in error and its interval by paired day blocks, by facility and horizon; no interval for a single day.

    The draws follow from the policy's seed and the number of days, the same for all facilities and horizons that have as many.
    """
    key = ["facility", "horizon_minutes"]
    gain = F.abs(F.col("b") - F.col("actual")) - F.abs(F.col("c") - F.col("actual"))
    daily = pairs.groupBy(*key, F.floor(F.col("origin") / 86400).alias("day")).agg(F.sum(gain).alias("top"), F.count(F.lit(1)).alias("bottom"))
    numbered = daily.select(*key, "top", "bottom", (F.row_number().over(Window.partitionBy(*key).orderBy("day")) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(*key)).alias("size"))
    found = ratio_intervals(numbered.where("size > 1"), key, policy.resamples, policy.seed, (1 - level) / 2)
    means = numbered.groupBy(*key).agg((F.sum("top") / F.sum("bottom")).alias("gain"))
    return means.join(found, key, "left").select(*key, "gain", F.col("low").alias("gain_low"), F.col("high").alias("gain_high"))


def gate_scores(rows: DataFrame, chosen: DataFrame, policy: Forecast) -> DataFrame:
    """What the gates look at, by facility and horizon: both models on the matched origins, the candidate also on all its own."""
    key = ["facility", "horizon_minutes"]
    met = paired(rows, chosen)
    error = lambda m: F.col(m) - F.col("actual")
    mae, rmse = (lambda m: F.round(F.avg(F.abs(error(m))), 9)), (lambda m: F.round(F.sqrt(F.avg(error(m) * error(m))), 9))
    both = met.groupBy(*key).agg(F.count(F.lit(1)).alias("matched"), F.count_distinct(F.floor(F.col("origin") / 86400)).alias("days"), mae("b").alias("b_mae"), rmse("b").alias("b_rmse"), mae("c").alias("c_mae"), rmse("c").alias("c_rmse"))
    own = score(rows.join(chosen.select(*key, F.col("candidate").alias("model")), [*key, "model"]), key, policy)
    own = own.select(*key, F.col("availability_with_target").alias("availability"), *[f"coverage_{level}" for level in policy.levels])
    return chosen.join(both, key, "left").join(own, key, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


def gates(scores: DataFrame, gain: DataFrame, fits: DataFrame, policy: Forecast) -> DataFrame:
    """Eight release checks by facility and horizon, and whether all hold.

    ``scores`` comes from ``gate_scores``, ``gain`` from ``bootstrap_gain``; ``fits`` has facility, candidate,
    fit_failure, update_seconds.
    """
    key = ["facility", "horizon_minutes"]
    met = scores.join(gain.select(*key, "gain", "gain_low"), key, "left").join(fits, ["facility", "candidate"], "left")
    covered = F.lit(True)
    for level in policy.levels:
        covered &= F.abs(F.col(f"coverage_{level}") - level / 100) <= policy.interval_tolerance
    gained = F.col("b_mae") - F.col("c_mae")
    checks = {
        "support": (F.col("matched") >= policy.minimum_matched) & (F.col("days") >= policy.minimum_days),
        "gain_check": gained >= F.greatest(F.lit(policy.minimum_gain), policy.minimum_gain_fraction * F.col("b_mae")),
        "rmse": F.col("c_rmse") <= F.col("b_rmse"),
        "bootstrap": F.col("gain_low") > 0,
        "availability": F.coalesce("availability", F.lit(0.0)) >= policy.minimum_availability,
        "fit_failure_check": F.coalesce("fit_failure", F.lit(0.0)) <= policy.maximum_fit_failure,
        "coverage": covered,
        "runtime": F.coalesce("update_seconds", F.lit(0.0)) <= policy.maximum_update_seconds,
    }
    out = met.select(*key, "benchmark", "candidate", "matched", F.round(gained, 9).alias("gain"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    passes = F.lit(True)
    for n in checks:
        passes &= F.col(n)
    return out.withColumn("passes", passes)


def fit_failures(fits: DataFrame, begin: int) -> DataFrame:
    """(facility, candidate, fit_failure, update_seconds) of the fits from ``begin`` on: the share of failed fits, and the longest day of all fits together."""
    scored = fits.where(F.col("fit") >= begin)
    shares = scored.groupBy("facility", F.col("model").alias("candidate")).agg(F.avg((F.col("status") == "fit_failed").cast("int")).alias("fit_failure"))
    longest = scored.groupBy("fit").agg(F.sum("seconds").alias("s")).agg(F.max("s").alias("update_seconds"))
    return shares.crossJoin(F.broadcast(longest))


def seasonal(grid: DataFrame, lags: list[int], cadence: int) -> DataFrame:
    """Autocorrelation at each lag by facility, by equi self-joins; null at 50 pairs or fewer."""
    parts = None
    for lag in lags:
        later = grid.select("facility", (F.col("slot_end") - lag * cadence).alias("slot_end"), F.col("value").alias("later"))
        r = F.try_divide(F.covar_pop("value", "later"), F.stddev_pop("value") * F.stddev_pop("later"))
        one = grid.join(later, ["facility", "slot_end"]).groupBy("facility").agg(F.lit(lag).alias("lag"), F.count(F.lit(1)).alias("pairs"), F.when(F.count(F.lit(1)) > 50, F.round(r, 6)).alias("r"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def explained(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Share of a facility's variance that the group means explain."""
    mean = F.avg("value").over(Window.partitionBy("facility", *by))
    return rows.withColumn("rest", F.col("value") - mean).groupBy("facility").agg(F.round(1 - F.try_divide(F.var_pop("rest"), F.var_pop("value")), 6).alias(name))
