"""Forecast models that are refitted every UTC midnight: a profile with persistence, and autoregressions.

A fit's training window is a dense set of rows (facility, fit, slot_end, value). Outages are found by a window
over it, the profile is groups and lags over it, all in DataFrame plans. Only the likelihood of the
autoregressions runs in pandas, one task a facility and fit, whose input is one window.

The autoregressions are fitted by exact maximum likelihood with missing slots: AR(1) about a mean (a
constant, or with daily Fourier terms) by the Markov factors between observed slots, with the mean by
generalised least squares for each phi; the integrated one by a Kalman filter of level and difference, the
level diffuse. phi is searched on a grid that is refined three times, so a fit does not depend on a start value and
cannot fail to converge; it fails only where the values do not vary.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.stats import median
from slotwise.functions.time import local
from slotwise.policy import Forecast

KINDS = ("arima_100", "arima_110", "arima_100_fourier")
CANDIDATES = (*KINDS, "profile_ar")
DAY = 86400
_FIT = ["facility", "fit"]


def windows(grid: DataFrame, start: int, end: int, policy: Forecast, delay_slots: int = 0) -> DataFrame:
    """(facility, fit, cutoff, slot_end, value): the dense training window of each daily fit; value is null where a slot is missing."""
    cadence, delay = policy.cadence_seconds, delay_slots * policy.cadence_seconds
    slots = policy.training_days * DAY // cadence
    fits = grid.select("facility").distinct().withColumn("fit", F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(max(start, end - 1)).cast("bigint"), F.lit(DAY).cast("bigint"))))
    spine = fits.withColumn("cutoff", F.col("fit") - delay)
    spine = spine.withColumn("slot_end", F.explode(F.sequence(F.col("cutoff") - (slots - 1) * cadence, F.col("cutoff"), F.lit(cadence).cast("bigint"))))
    return spine.join(grid.select("facility", "slot_end", F.col("value").cast("double").alias("value")), ["facility", "slot_end"], "left").select("facility", "fit", "cutoff", "slot_end", "value")


def trimmed(rows: DataFrame, policy: Forecast) -> tuple[DataFrame, DataFrame]:
    """The windows after their last long outage, and (facility, fit, whole, supported) of every window.

    A missing slot belongs to a long outage once the run of missing slots that it ends is over the limit. A window
    is supported if what is left has enough values, enough of its slots, and the last one; ``whole`` windows had
    no long outage at all.
    """
    past = Window.partitionBy(*_FIT).orderBy("slot_end")
    all_of = Window.partitionBy(*_FIT)
    seen = F.coalesce(F.last(F.when(F.col("value").isNotNull(), F.col("slot_end")), ignorenulls=True).over(past), F.min("slot_end").over(all_of) - policy.cadence_seconds)
    long = F.col("value").isNull() & (F.col("slot_end") - seen > policy.maximum_missing_run * policy.cadence_seconds)
    marked = rows.withColumn("long", long).withColumn("outage", F.max(F.when(F.col("long"), F.col("slot_end"))).over(all_of))
    after = F.col("outage").isNull() | (F.col("slot_end") > F.col("outage"))
    there = F.col("value").isNotNull()
    support = marked.groupBy(*_FIT).agg(
        F.first("outage").isNull().alias("whole"), F.count_if(after & there).alias("n"), F.count_if(after).alias("slots"), F.bool_or((F.col("slot_end") == F.col("cutoff")) & there).alias("last")
    )
    enough = (F.col("n") >= policy.minimum_training_slots) & (F.col("n") >= policy.minimum_training_coverage * F.col("slots")) & F.col("last")
    return marked.where(after).drop("long", "outage"), support.select(*_FIT, "whole", F.coalesce(enough, F.lit(False)).alias("supported"))


def cell_of(slot_end: Column, policy: Forecast) -> Column:
    """Local hour of a slot's midpoint, plus 24 at weekends."""
    here = local(F.timestamp_seconds(slot_end - policy.cadence_seconds // 2), policy.zone)
    return F.hour(here) + F.when(F.weekday(here) >= 5, 24).otherwise(0)


def profile(rows: DataFrame, steps: list[int], policy: Forecast) -> tuple[DataFrame, DataFrame]:
    """(facility, fit, cell, usual) and (facility, fit, step, beta) from trimmed windows.

    A cell's usual value is its median, or that of the whole window below 8 values. beta is the least-squares
    persistence through zero of the deviations ``step`` slots ahead, between 0 and 1.
    """
    keyed = rows.withColumn("cell", cell_of(F.col("slot_end"), policy))
    overall = rows.groupBy(*_FIT).agg(median("value").alias("overall"))
    own = keyed.where("value IS NOT NULL").groupBy(*_FIT, "cell").agg(median("value").alias("m"), F.count(F.lit(1)).alias("n"))
    cells = overall.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(47)))).join(own, [*_FIT, "cell"], "left")
    cells = cells.select(*_FIT, "cell", F.when(F.col("n") >= 8, F.col("m")).otherwise(F.col("overall")).alias("usual"))
    order = Window.partitionBy(*_FIT).orderBy("slot_end")
    off = keyed.join(cells, [*_FIT, "cell"]).withColumn("off", F.col("value") - F.col("usual"))
    ahead = off.select(*_FIT, "off", *[F.lead("off", k).over(order).alias(f"ahead_{k}") for k in steps])
    both = lambda k: F.when(F.col(f"ahead_{k}").isNotNull(), F.col("off"))
    sums = [F.struct(F.lit(k).alias("step"), F.sum(both(k) * F.col(f"ahead_{k}")).alias("xy"), F.sum(both(k) * F.col("off")).alias("xx")) for k in steps]
    fitted = ahead.groupBy(*_FIT).agg(F.array(*sums).alias("s")).select(*_FIT, F.explode("s").alias("s")).select(*_FIT, "s.*")
    beta = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide("xy", "xx"), F.lit(0.0))))
    return cells, fitted.select(*_FIT, "step", beta.alias("beta"))


def _asked(grid: DataFrame, start: int, end: int, policy: Forecast, delay_slots: int) -> DataFrame:
    """(facility, fit, origin, available, horizon_minutes, target, step, current) of every origin and horizon of a phase."""
    cadence = policy.cadence_seconds
    spine = grid.select("facility").distinct().withColumn("origin", F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(max(start, end - 1)).cast("bigint"), F.lit(policy.origin_seconds).cast("bigint"))))
    rows = spine.withColumn("horizon_minutes", F.explode(F.array(*[F.lit(h) for h in policy.horizons_minutes])))
    rows = rows.withColumns({"target": F.col("origin") + 60 * F.col("horizon_minutes"), "available": F.col("origin") - delay_slots * cadence, "fit": F.floor((F.col("origin") - start) / DAY).cast("bigint") * DAY + start})
    rows = rows.where(F.col("target") < end).withColumn("step", (F.col("horizon_minutes") * 60 / cadence).cast("int") + delay_slots)
    now = grid.select("facility", F.col("slot_end").alias("available"), F.col("value").cast("double").alias("current"))
    return rows.join(now, ["facility", "available"], "left")


def steps_of(policy: Forecast, delay_slots: int) -> list[int]:
    return sorted({h * 60 // policy.cadence_seconds + delay_slots for h in policy.horizons_minutes})


def replay_profile(grid: DataFrame, start: int, end: int, policy: Forecast, delay_slots: int = 0) -> DataFrame:
    """(facility, model, origin, target, horizon_minutes, prediction) of the profile; nothing is predicted without a current slot or support."""
    rows, support = trimmed(windows(grid, start, end, policy, delay_slots), policy)
    fits = support.where("supported").select(*_FIT)
    cells, betas = profile(rows.join(fits, _FIT), steps_of(policy, delay_slots), policy)
    usual = lambda at: cells.select(*_FIT, F.col("cell").alias(f"{at}_cell"), F.col("usual").alias(f"{at}_usual"))
    asked = _asked(grid, start, end, policy, delay_slots).withColumns({"now_cell": cell_of(F.col("available"), policy), "then_cell": cell_of(F.col("target"), policy)})
    met = asked.join(usual("now"), [*_FIT, "now_cell"], "left").join(usual("then"), [*_FIT, "then_cell"], "left").join(betas, [*_FIT, "step"], "left")
    guess = F.greatest(F.lit(0.0), F.col("then_usual") + F.col("beta") * (F.col("current") - F.col("now_usual")))
    known = F.col("current").isNotNull() & F.col("then_usual").isNotNull() & F.col("beta").isNotNull()
    return met.select("facility", F.lit("profile_ar").alias("model"), "origin", "target", "horizon_minutes", F.when(known, guess).alias("prediction"))


# ---------------------------------------------------------------- likelihoods


def design(hours: np.ndarray, seasonal: bool) -> np.ndarray:
    """A constant and, if asked, two daily harmonics of the local hour."""
    columns = [np.ones(len(hours))]
    if seasonal:
        columns += [wave(2 * np.pi * k * hours / 24) for k in (1, 2) for wave in (np.sin, np.cos)]
    return np.stack(columns, 1)


def _refined(loss: Callable[[np.ndarray], np.ndarray]) -> float:
    """The phi in (-1, 1) of least loss; ``loss`` takes a grid at once."""
    grid, half = np.linspace(-0.98, 0.98, 50), 0.04
    for _ in range(3):
        best = float(grid[int(np.argmin(loss(grid)))])
        grid, half = np.clip(np.linspace(best - half, best + half, 41), -0.999, 0.999), half / 20
    return float(grid[int(np.argmin(loss(grid)))])


def fit_mean_reverting(values: np.ndarray, terms: np.ndarray) -> tuple[float, np.ndarray]:
    """(phi, coefficients of the mean) of an AR(1) about ``terms @ coefficients``, with missing values as NaN."""
    seen = np.flatnonzero(np.isfinite(values))
    x, z, gap = values[seen], terms[seen], np.diff(seen).astype(float)
    if len(x) < terms.shape[1] + 2 or np.ptp(x) == 0:
        raise ValueError("the values do not vary")

    def solved(phi: float) -> tuple[float, np.ndarray]:
        keep = np.sign(phi) ** gap * abs(phi) ** gap
        scale = np.sqrt(np.maximum(1 - keep**2, 1e-12))
        y = np.append(x[:1], (x[1:] - keep * x[:-1]) / scale)
        a = np.vstack([z[:1], (z[1:] - keep[:, None] * z[:-1]) / scale[:, None]])
        coefficient = np.linalg.lstsq(a, y, rcond=None)[0]
        spread = max(float(((y - a @ coefficient) ** 2).mean()), 1e-300)
        return len(x) * np.log(spread) + 2 * np.log(scale).sum(), coefficient

    phi = _refined(lambda grid: np.array([solved(p)[0] for p in grid]))
    return phi, solved(phi)[1]


def filter_differences(values: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss, expected difference at every slot) of an AR(1) of first differences, for each phi of an array.

    The state is the level and its last difference; the level is known where a slot is observed. The filter
    starts at the first observed slot with the difference's stationary variance.
    """
    phi = np.asarray(phi, float)
    seen = np.flatnonzero(np.isfinite(values))
    expected = np.zeros((len(values), len(phi)))
    if not len(seen):
        return np.full(len(phi), np.inf), expected
    level, slope = np.full(len(phi), values[seen[0]]), np.zeros(len(phi))
    vll, vls, vss = np.zeros(len(phi)), np.zeros(len(phi)), 1 / (1 - phi**2)
    logs, squares, n = np.zeros(len(phi)), np.zeros(len(phi)), 0
    for t in range(seen[0] + 1, len(values)):
        slope = phi * slope
        level = level + slope
        carried = phi * vls
        vss = phi**2 * vss + 1
        vll, vls = vll + 2 * carried + vss, carried + vss
        if np.isfinite(values[t]):
            miss, ratio = values[t] - level, vls / vll
            logs, squares, n = logs + np.log(vll), squares + miss**2 / vll, n + 1
            slope, vss = slope + ratio * miss, vss - ratio * vls
            level, vll, vls = np.full(len(phi), values[t]), np.zeros(len(phi)), np.zeros(len(phi))
        expected[t] = slope
    return (n * np.log(np.maximum(squares / max(n, 1), 1e-300)) + logs if n else np.full(len(phi), np.inf)), expected


def fit_differences(values: np.ndarray) -> float:
    if np.isfinite(values).sum() < 3 or np.nanmax(values) == np.nanmin(values):
        raise ValueError("the values do not vary")
    return _refined(lambda grid: filter_differences(values, grid)[0])


def predict(kind: str, train: np.ndarray, later: np.ndarray, hours: np.ndarray, steps: list[int]) -> np.ndarray:
    """Forecasts (slot x step) from every slot of a window and the slots that arrived after it; parameters from ``train`` alone.

    ``hours`` are the local hours of all those slots and of the longest step beyond; NaN where the slot is missing.
    """
    values = np.concatenate([train, later])
    out = np.full((len(values), len(steps)), np.nan)
    if kind == "arima_110":
        phi = fit_differences(train)
        slope = filter_differences(values, np.array([phi]))[1][:, 0]
        for j, step in enumerate(steps):
            out[:, j] = values + slope * (phi ** np.arange(1, step + 1)).sum()
    else:
        terms = design(hours, kind == "arima_100_fourier")
        phi, coefficient = fit_mean_reverting(train, terms[: len(train)])
        mean = terms @ coefficient
        for j, step in enumerate(steps):
            ahead = mean[step : step + len(values)]
            out[: len(ahead), j] = ahead + phi**step * (values - mean[: len(values)])[: len(ahead)]
    return np.maximum(out, 0)


#: Slots up to an origin of which one must have a reading.
RECENT = 4


def outage(there: set[int], fit: int, policy: Forecast, delay_slots: int = 0) -> float:
    """The slot from which on a fit of a day no longer counts: that of its first origin without a reading in the last four slots; infinite if there is none.

    A state that was carried over so long an outage is given up until the next fit.
    """
    cadence = policy.cadence_seconds
    for origin in range(fit, fit + DAY, policy.origin_seconds):
        available = origin - delay_slots * cadence
        if not any(available - k * cadence in there for k in range(RECENT)):
            return available
    return math.inf


def replay_autoregressions(grid: DataFrame, start: int, end: int, policy: Forecast, delay_slots: int = 0, kinds: tuple[str, ...] = KINDS, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """(facility, fit, model, status, seconds, guesses) of every daily fit; guesses are (available, step, prediction).

    A fit sees slots up to its midnight, less the delay; its state is carried over the slots that arrive until
    each origin, its parameters are not. After an outage within the day it abstains until the next fit (``outage``).
    """
    cadence, steps = policy.cadence_seconds, steps_of(policy, delay_slots)
    rows, support = trimmed(windows(grid, start, end, policy, delay_slots), policy)
    there = grid.select("facility", F.col("slot_end").alias("available"), F.col("value").cast("double").alias("value"))
    arrived = support.select(*_FIT, F.explode(F.sequence(F.col("fit") - delay_slots * cadence + cadence, F.col("fit") + DAY - cadence, F.lit(cadence).cast("bigint"))).alias("available"))
    arrived = arrived.join(there, ["facility", "available"], "left").select(*_FIT, F.col("available").alias("slot_end"), "value", F.lit(False).alias("training"))
    hour = lambda at: F.hour(at) + F.minute(at) / F.lit(60.0)
    part = rows.select(*_FIT, "slot_end", "value", F.lit(True).alias("training")).unionByName(arrived)
    ahead = support.select(*_FIT, F.explode(F.sequence(F.col("fit") + DAY, F.col("fit") + DAY + max(steps) * cadence, F.lit(cadence).cast("bigint"))).alias("slot_end"))
    part = part.unionByName(ahead.select(*_FIT, "slot_end", F.lit(None).cast("double").alias("value"), F.lit(None).cast("boolean").alias("training")))
    part = part.withColumn("hour", hour(local(F.timestamp_seconds(F.col("slot_end") - cadence // 2), policy.zone))).join(support, _FIT)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slot_end")
        known = frame[frame["training"].notna()]
        train = known.loc[known["training"].astype(bool), "value"].to_numpy(float)
        values, ends = known["value"].to_numpy(float), known["slot_end"].to_numpy()
        lost = outage(set(ends[~np.isnan(values)].tolist()), key[1], policy, delay_slots)
        out = []
        for kind in kinds:
            began, status, guesses = clock(), "ok", []
            if not frame["supported"].iloc[0]:
                status = "insufficient_history"
            else:
                try:
                    found = predict(kind, train, values[len(train) :], frame["hour"].to_numpy(float), steps)
                    at = np.flatnonzero((ends >= key[1] - delay_slots * cadence) & (ends < lost))
                    guesses = [{"available": int(ends[i]), "step": s, "prediction": float(found[i, j])} for i in at for j, s in enumerate(steps) if np.isfinite(found[i, j])]
                except (ValueError, np.linalg.LinAlgError):
                    status = "fit_failed"
            out.append((*key, kind, status, clock() - began, guesses))
        return pd.DataFrame(out, columns=["facility", "fit", "model", "status", "seconds", "guesses"])

    return part.groupBy(*_FIT).applyInPandas(run, "facility string, fit bigint, model string, status string, seconds double, guesses array<struct<available:bigint,step:int,prediction:double>>")


def replay_candidates(grid: DataFrame, start: int, end: int, policy: Forecast, delay_slots: int = 0, kinds: tuple[str, ...] = KINDS, clock: Callable[[], float] = time.perf_counter) -> tuple[DataFrame, DataFrame]:
    """Predictions (facility, model, origin, target, horizon_minutes, prediction) of all candidates, and their fits (facility, model, fit, status, seconds).

    A profile's fit is a plan over all windows at once and has no time of its own.
    """
    from slotwise.session import cut

    fits = cut(replay_autoregressions(grid, start, end, policy, delay_slots, kinds, clock))
    guesses = fits.select("facility", "fit", "model", F.explode("guesses").alias("g")).select("facility", "fit", "model", "g.*")
    asked = _asked(grid, start, end, policy, delay_slots).withColumn("model", F.explode(F.array(*[F.lit(k) for k in kinds])))
    made = asked.join(guesses, ["facility", "fit", "model", "available", "step"], "left")
    made = made.select("facility", "model", "origin", "target", "horizon_minutes", F.when(F.col("current").isNotNull(), F.col("prediction")).alias("prediction"))
    support = trimmed(windows(grid, start, end, policy, delay_slots), policy)[1]
    own = support.select("facility", F.lit("profile_ar").alias("model"), "fit", F.when(F.col("supported"), "ok").otherwise("insufficient_history").alias("status"), F.lit(0.0).alias("seconds"))
    return made.unionByName(replay_profile(grid, start, end, policy, delay_slots)), fits.select("facility", "model", "fit", "status", "seconds").unionByName(own)
