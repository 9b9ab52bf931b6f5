"""Forecast models and replays on series whose answers are known."""

from __future__ import annotations

import hashlib
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.functions.resampling import picks, ratio_intervals
from slotwise.functions.time import calendar
from slotwise.operators import association, benefit, dedup, forecast, models
from slotwise.plans import studies
from slotwise.policy import ZONE, Association, Baseline, Benefit, Forecast

POLICY = Forecast(cadence_seconds=3600, horizons_minutes=(60, 120), origin_seconds=3600 * 6, daily_slots=24, weekly_slots=168, training_days=5, minimum_training_slots=48, minimum_training_coverage=0.5, spike_minimum=24, minimum_errors=4, resamples=200)
START = 1704067200
DAY = 86400


def grid_of(spark, rows):
    return spark.createDataFrame(rows, "facility string, slot_end bigint, value int")


def test_windows_after_a_long_outage(spark):
    fit, missing = START + 10 * DAY, set(range(60, 66))  # hours before the fit
    short = {10, 11, 12, 13}
    rows = [(f, fit - 3600 * k, k) for f, gone in (("long", missing), ("short", short), ("end", {0})) for k in range(200) if k not in gone]
    kept, support = models.trimmed(models.windows(grid_of(spark, rows), fit, fit + 1, POLICY), POLICY)
    found = {r.facility: (r.whole, r.supported) for r in support.collect()}
    assert found == {"long": (False, True), "short": (True, True), "end": (True, False)}
    assert kept.where("facility = 'long'").count() == 60 and kept.where("facility = 'short'").count() == 120


def test_mean_reversion_is_found_with_missing_values():
    rng = np.random.default_rng(5)
    x = np.zeros(3000)
    for t in range(1, len(x)):
        x[t] = 0.7 * x[t - 1] + rng.normal()
    x[rng.random(len(x)) < 0.1] = np.nan
    phi, coefficient = models.fit_mean_reverting(x + 20, models.design(np.arange(3000) % 24, False))
    assert abs(phi - 0.7) < 0.04 and abs(coefficient[0] - 20) < 0.3


def dense_likelihood(values: np.ndarray, phi: float) -> float:
    """The same likelihood of an AR(1) of differences from the covariance matrix of the observed levels, given the first."""
    seen = np.flatnonzero(np.isfinite(values))
    n = len(values)
    gamma = np.array([[phi ** abs(i - j) / (1 - phi**2) for j in range(n)] for i in range(n)])
    sums = np.tril(np.ones((n, n)))[:, 1:] if False else np.array([[1.0 if seen[0] < k <= t else 0.0 for k in range(n)] for t in seen[1:]])
    cov = sums @ gamma @ sums.T
    y = values[seen[1:]] - values[seen[0]]
    m = len(y)
    return m * math.log(y @ np.linalg.solve(cov, y) / m) + np.linalg.slogdet(cov)[1]


def test_the_filter_gives_the_exact_likelihood():
    rng = np.random.default_rng(2)
    values = np.cumsum(rng.normal(size=40))
    values[[0, 5, 6, 20, 21, 22, 33]] = np.nan
    phis = np.array([-0.6, 0.0, 0.3, 0.8])
    loss, slope = models.filter_differences(values, phis)
    assert np.allclose(loss, [dense_likelihood(values, p) for p in phis])
    whole = np.cumsum(rng.normal(size=10))
    assert np.allclose(models.filter_differences(whole, np.array([0.5]))[1][1:, 0], np.diff(whole))


def test_integrated_series():
    rng = np.random.default_rng(7)
    d = np.zeros(4000)
    for t in range(1, len(d)):
        d[t] = 0.5 * d[t - 1] + rng.normal()
    assert abs(models.fit_differences(np.cumsum(d)) - 0.5) < 0.05
    out = models.predict("arima_110", np.cumsum(d)[:200], np.array([]), np.zeros(202), [1, 2])
    x = np.cumsum(d)[:200]
    phi = models.fit_differences(x)
    assert np.allclose(out[199], np.maximum(0, [x[199] + phi * d[199], x[199] + (phi + phi**2) * d[199]]))


def test_values_that_do_not_vary_cannot_be_fitted(spark):
    for fit in (lambda v: models.fit_mean_reverting(v, models.design(np.zeros(100), False)), models.fit_differences):
        with pytest.raises(ValueError, match="vary"):
            fit(np.full(100, 3.0))
    rows = [("flat", START + 3600 * k, 3) for k in range(240)] + [("few", START + 3600 * k, k % 9) for k in range(220, 240)]
    _, fits = models.replay_candidates(grid_of(spark, rows), START + 9 * DAY, START + 10 * DAY, POLICY)
    found = {(r.facility, r.model): r.status for r in fits.collect()}
    assert {found["flat", k] for k in models.KINDS} == {"fit_failed"} and found["flat", "profile_ar"] == "ok"
    assert {v for (f, _), v in found.items() if f == "few"} == {"insufficient_history"}


def plain_profile(known: dict, fit: int, origin: int, step: int) -> float | None:
    """The profile's forecast in plain Python: hours of a constant offset of -6 from UTC."""
    ends = [fit - 3600 * k for k in range(5 * 24)][::-1]
    cell = lambda s: ((s - 1800 - 6 * 3600) // 3600 % 24) + 24 * (((s - 1800 - 6 * 3600) // DAY + 3) % 7 >= 5)
    values = [known.get(s) for s in ends]
    overall = float(np.median([v for v in values if v is not None]))
    cells = {}
    for s, v in zip(ends, values, strict=True):
        if v is not None:
            cells.setdefault(cell(s), []).append(v)
    usual = lambda s: float(np.median(cells[cell(s)])) if len(cells.get(cell(s), ())) >= 8 else overall
    off = [None if v is None else v - usual(s) for s, v in zip(ends, values, strict=True)]
    pairs = [(a, c) for a, c in zip(off, off[step:], strict=False) if a is not None and c is not None]
    power = sum(a * a for a, _ in pairs)
    beta = min(1.0, max(0.0, sum(a * c for a, c in pairs) / power)) if power else 0.0
    now = known.get(origin)
    return None if now is None else max(0.0, usual(origin + 3600 * step) + beta * (now - usual(origin)))


@pytest.mark.parametrize("delay", [0, 1])
def test_profile_against_plain_python(spark, delay):
    rng = random.Random(1)
    known = {START + 3600 * k: int(30 + 20 * math.sin(k / 24 * 6.28) + rng.random() * 10) for k in range(24 * 9) if rng.random() > 0.05}
    first, end = START + 7 * DAY, START + 9 * DAY
    rows = models.replay_profile(grid_of(spark, [("a", s, v) for s, v in known.items()]), first, end, POLICY, delay).collect()
    assert len(rows) == 2 * 2 * 4
    for r in rows:
        fit = first + (r.origin - first) // DAY * DAY
        last = known.get(fit - delay * 3600)
        expected = plain_profile(known, fit - delay * 3600, r.origin - delay * 3600, r.horizon_minutes // 60 + delay) if last is not None else None
        assert (r.prediction is None) == (expected is None) and (expected is None or math.isclose(r.prediction, expected, abs_tol=1e-9))


@pytest.mark.parametrize("delay", [0, 1])
def test_candidates_see_no_future(spark, delay):
    rng = random.Random(2)
    rows = [("a", START + 3600 * k, int(30 + 9 * math.sin(k) + rng.random() * 9)) for k in range(24 * 9)]
    first, end = START + 7 * DAY, START + 9 * DAY
    cut = first + DAY + 6 * 3600
    run = lambda g: {(r.model, r.origin, r.horizon_minutes): r.prediction for r in models.replay_candidates(grid_of(spark, g), first, end, POLICY, delay, clock=lambda: 0.0)[0].collect()}
    honest = run(rows)
    changed = run([(f, s, v if s <= cut - delay * 3600 else 9000) for f, s, v in rows])
    early = {k for k in honest if k[1] <= cut}
    assert all(honest[k] == changed[k] for k in early) and any(honest[k] != changed[k] for k in honest if k not in early)
    assert all(o + 60 * h < end for _, o, h in honest) and {m for m, _, _ in honest} == set(models.CANDIDATES)
    assert all(v is not None for v in honest.values())


@pytest.mark.parametrize("delay", [0, 1])
def test_candidates_abstain_after_an_outage_until_the_next_fit(spark, delay):
    policy = replace(POLICY, origin_seconds=3600)
    first, end = START + 7 * DAY, START + 9 * DAY
    rng = random.Random(8)
    gone = range(24 * 7 + 6, 24 * 7 + 11)  # five hours within the first day; three hours within the second, which are no outage
    rows = [("a", START + 3600 * k, int(30 + 9 * math.sin(k) + rng.random() * 9)) for k in range(24 * 9) if k not in gone and k not in range(24 * 8 + 6, 24 * 8 + 9)]
    there = {s for _, s, _ in rows}
    made, fits = (df.collect() for df in models.replay_candidates(grid_of(spark, rows), first, end, policy, delay, clock=lambda: 0.0))
    fitted = {(r.model, r.fit) for r in fits if r.status == "ok"}
    lost: set[int] = set()
    for day in (first, first + DAY):
        state = True
        for origin in range(day, day + DAY, policy.origin_seconds):
            available = origin - delay * 3600
            state = state and any(available - k * 3600 in there for k in range(4))
            if not state:
                lost.add(origin)
    assert lost and max(lost) < first + DAY
    for r in made:
        given = r.origin - delay * 3600 in there and (r.model == "profile_ar" or r.origin not in lost)
        assert given or r.prediction is None, r
        day = first if r.origin < first + DAY else first + DAY
        assert r.model == "profile_ar" or (r.prediction is not None) == (given and (r.model, day) in fitted), r
    assert {d for _, d in fitted} >= {first} and any(r.prediction is not None for r in made if r.model != "profile_ar")
    assert models.outage({START}, START, policy) == START + 4 * 3600 and models.outage(set(range(START, START + 2 * DAY, 3600)), START, policy) == math.inf


def test_forecasts_over_midnight_use_what_their_origin_knew(spark):
    rows = [(f"{f}", START + 3600 * k + 60, 20 if k < 24 * 30 + 6 else 500) for f in "a" for k in range(24 * 32)]
    from datetime import datetime, timezone

    df = spark.createDataFrame([(f, datetime.fromtimestamp(t, timezone.utc), datetime.fromtimestamp(t, timezone.utc), v) for f, t, v in rows], "facility string, at timestamp, batch timestamp, value int")
    base = Baseline(cadence_seconds=3600, minimum_samples=24)
    slots, cal = dedup.slot_winners(df, 3600, ZONE), calendar(spark, "2023-11-20", "2024-02-05", ZONE, 3600)
    origin = START + 31 * DAY + 5 * 3600  # 23:00 local; the target is 01:00 of the next local day
    asked = spark.createDataFrame([("a", origin, origin + 7200), ("a", origin, origin + 1800)], "facility string, origin bigint, target bigint")
    found = {r.target: r.m1_median for r in forecast.usual_medians(slots, cal, asked, POLICY, base).collect()}
    assert found == {origin + 7200: 20.0, origin + 1800: 20.0}


def test_replay_scores_and_gates(spark):
    rng = random.Random(4)
    rows = [("a", START + 3600 * k, int(50 + 30 * math.sin(k / 24 * 2 * math.pi)) + rng.randrange(3)) for k in range(24 * 20) if k not in (300, 301)]
    grid = grid_of(spark, rows)
    begin, end = START + 12 * DAY, START + 20 * DAY
    none = spark.createDataFrame([], "facility string, origin bigint, target bigint, m1_median double")
    known = {s: v for _, s, v in rows}
    wide = forecast.replay(grid, none, begin, end, POLICY).collect()
    for r in wide:
        now = known.get(r.origin)
        assert r.carry_forward == now and r.actual == known.get(r.target) and r.m1_median is None
        assert r.daily_naive == (known.get(r.target - DAY) if now is not None else None)
        past = [v for s, v in known.items() if r.origin - 28 * DAY < s <= r.origin]
        assert r.spike == (r.actual is not None and len(past) >= 24 and r.actual > np.quantile(past, 0.9))
    rows_long = forecast.intervals(forecast.long_form(forecast.replay(grid, none, begin, end, POLICY), ("carry_forward", "daily_naive")), POLICY).cache()
    chosen = spark.createDataFrame([("a", h, "carry_forward", "daily_naive") for h in POLICY.horizons_minutes], "facility string, horizon_minutes int, benchmark string, candidate string")
    gain = forecast.bootstrap_gain(forecast.paired(rows_long, chosen), POLICY)
    fits = spark.createDataFrame([("a", "daily_naive", 0.0, 1.0)], "facility string, candidate string, fit_failure double, update_seconds double")
    found = {r.horizon_minutes: r for r in forecast.gates(forecast.gate_scores(rows_long, chosen, POLICY), gain, fits, POLICY).collect()}
    pairs = [(abs(r.carry_forward - r.actual), abs(r.daily_naive - r.actual)) for r in wide if r.horizon_minutes == 120 and r.actual is not None and r.carry_forward is not None and r.daily_naive is not None]
    assert found[120].matched == len(pairs) and math.isclose(found[120].gain, np.mean([a - c for a, c in pairs]), abs_tol=1e-8)
    assert found[120].gain_check and found[120].rmse and found[120].bootstrap and found[120].runtime and not found[120].support
    late = forecast.gates(forecast.gate_scores(rows_long, chosen, POLICY), gain, fits.withColumn("update_seconds", F.lit(601.0)), POLICY)
    assert not any(r.runtime or r.passes for r in late.collect())


def test_phases_are_guarded(spark, tmp_path):
    phase = studies.Phase("calibration", START, START, START + DAY)
    other = studies.Freeze("something else", [])
    for freeze in (None, other):
        with pytest.raises(ValueError, match="specification"):
            studies.run_phase(phase, None, None, POLICY, "snapshot", freeze=freeze)
    right = studies.Freeze(studies.specification(POLICY, "snapshot"), [{"facility": "a", "horizon_minutes": 60, "benchmark": "carry_forward", "candidate": "profile_ar", "shortlisted": True}])
    with pytest.raises(ValueError, match="calibration"):
        studies.run_phase(phase._replace(name="holdout"), None, None, POLICY, "snapshot", freeze=right)
    studies.write_freeze(right, str(tmp_path / "freeze.json"))
    with pytest.raises(FileExistsError):
        studies.write_freeze(right, str(tmp_path / "freeze.json"))
    assert studies.shortlist(right) == ["a@60"]
    rows = [("a", START + 3600 * k, 20 + k % 7) for k in range(24 * 12)]
    none = lambda asked, delay: asked.select("facility", "origin", "target", F.lit(21.0).alias("m1_median")).distinct()
    decisions, _, counts = studies.run_phase(studies.Phase("calibration", START + 8 * DAY, START + 9 * DAY, START + 11 * DAY), grid_of(spark, rows), none, POLICY, "snapshot", freeze=right)
    assert [(r.benchmark, r.candidate) for r in decisions.collect()] == [("carry_forward", "profile_ar")]
    assert {r.model for r in counts.collect()} == set(models.CANDIDATES)


# ---------------------------------------------------------------- resampling


def hashed(seed: int, resample: int, size: int) -> list[int]:
    return [int(hashlib.md5(f"{seed}:{resample}:{j}".encode()).hexdigest()[:8], 16) % size for j in range(size)]


def test_precision_intervals_against_plain_python(spark):
    policy = Benefit(draws=300)
    rng = random.Random(8)
    rows = [(f"2026-09-{1 + k % 12:02d}", "F0", k % 3 != 0 and k % 12 != 5, rng.uniform(-5, 10)) for k in range(200)]
    claimed = spark.createDataFrame(rows, "day string, rule string, claimed boolean, A double")
    found = benefit.precision_intervals(claimed, [], policy).first()
    days = sorted({r[0] for r in rows})
    per = {d: (sum(r[2] for r in rows if r[0] == d), sum(r[2] and r[3] > 0 for r in rows if r[0] == d)) for d in days}
    values = []
    for resample in range(policy.draws):
        total = [per[days[k]] for k in hashed(policy.seed, resample, len(days))]
        if sum(n for n, _ in total):
            values.append(sum(h for _, h in total) / sum(n for n, _ in total))
    assert math.isclose(found.low, np.quantile(values, 0.025)) and math.isclose(found.high, np.quantile(values, 0.975))


def test_ratio_intervals_of_counted_draws(spark):
    """Like those of a seeded generator within its own error; blocks without a row are zeros; tests without a count have no interval."""
    rng = np.random.default_rng(3)
    top, bottom = rng.normal(3, 2, 30), rng.integers(5, 20, 30)
    rows = [("x", k, 30, float(top[k]), float(bottom[k])) for k in range(30) if k != 7] + [("y", 1, 2, 4.0, 2.0), ("z", 0, 3, 0.0, 0.0)]
    top[7] = bottom[7] = 0
    found = {r.t: r for r in ratio_intervals(spark.createDataFrame(rows, "t string, k int, size int, top double, bottom double"), ["t"], 2000, 5).collect()}
    ends = np.array([np.quantile(top[p].sum(1) / bottom[p].sum(1), [0.025, 0.975]) for p in (np.random.default_rng(s).integers(0, 30, (2000, 30)) for s in range(12))])
    assert np.all(np.abs([found["x"].low, found["x"].high] - ends.mean(0)) < 4 * ends.std(0, ddof=1))
    assert (found["y"].low, found["y"].high) == (2.0, 2.0) and set(found) == {"x", "y"}
    drawn = {(r["size"], r.resample): r.picks for r in picks(spark.createDataFrame([(5,), (1,)], "size int"), 40, 9).collect()}
    assert len(drawn) == 80 and all(p == hashed(9, r, n) for (n, r), p in drawn.items())


def test_rule_selection_and_outcome(spark):
    policy = Benefit()
    rows = [("F10", "fixed", 10.0, 60, 6, 0.95, 0.85), ("F20", "fixed", 20.0, 60, 6, 0.95, 0.85), ("S1", "screen", 1.0, 60, 6, 0.99, 0.9), ("F0", "fixed", 0.0, 500, 9, 0.5, 0.4), ("F30", "fixed", 30.0, 49, 9, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "rule string, kind string, value double, claims long, claim_days long, precision double, low double")
    assert benefit.select_rule(df, policy).first().rule == "F20" and benefit.select_rule(df.where("rule = 'F0'"), policy).isEmpty()
    later = spark.createDataFrame([("a", 19, 9, 1.0), ("b", 20, 3, 0.9), ("c", 20, 3, 0.89), ("d", 99, 2, 1.0)], "rule string, claims int, claim_days int, precision double")
    assert {r.rule: r.outcome for r in benefit.outcome(later, policy).collect()} == {"a": "inconclusive", "b": "confirmed", "c": "failed", "d": "inconclusive"}


def plain_ranks(values: list[float]) -> list[float]:
    return [sum(v < x for v in values) + (values.count(x) - 1) / 2 for x in values]


def test_ranks_and_the_interval_of_a_correlation(spark):
    assert association._ranks(np.array([0, 0, 5, 3]), np.ones((1, 4)))[0].tolist() == [0.5, 0.5, 3, 2] == plain_ranks([0, 0, 5, 3])
    rng = random.Random(6)
    rows = [("co_deviation", "a", "b", 0, 3600 * k, x := rng.randrange(-9, 9) / 4, x + rng.randrange(-6, 7) / 4) for k in range(24 * 9)]
    df = spark.createDataFrame(rows, "family string, leader string, follower string, lag_hours int, bin long, x double, y double")
    policy = Association(resamples=60)
    found = association.bootstrap(df, policy).first()
    values = []
    for r in range(policy.resamples):
        days = [int(hashlib.md5(f"{policy.seed}:co_deviation|a|b|0:{r}:{j}".encode()).hexdigest()[:8], 16) % 9 for j in range(9)]
        some = [row for d in days for row in rows[24 * d : 24 * d + 24]]
        values.append(np.corrcoef(plain_ranks([row[5] for row in some]), plain_ranks([row[6] for row in some]))[0, 1])
    values.sort()
    assert math.isclose(found.low, values[int(0.025 * 59)]) and math.isclose(found.high, values[int(0.975 * 59)])
    assert association.bootstrap(df, Association(resamples=10)).first().low is None
    flat = association.bootstrap(df.withColumn("x", F.lit(1.0)), policy).collect()
    assert len(flat) == 1 and flat[0].low is None


def test_medians_without_two_members(spark):
    rng = random.Random(12)
    series = [(f, k, float(rng.randrange(8)), level) for level in (True, False) for k in range(60) for f in "abcdefgh"[: 1 + k % 8] if rng.random() < 0.8]
    asked = [(a, b, k, level) for level in (True, False) for k in range(60) for a in "abcdefgh" for b in "abcdefgh" if a != b]
    rows = spark.createDataFrame(asked, "leader string, follower string, y_bin bigint, is_level boolean")
    found = association.with_swing(rows, spark.createDataFrame(series, "facility string, bin bigint, deviation double, is_level boolean"), Association(minimum_others=3)).collect()
    assert len(found) == len(asked) and sum(r.swing is not None for r in found) > 1000
    for r in found:
        others = [v for f, k, v, level in series if k == r.y_bin and level == r.is_level and f not in (r.leader, r.follower)]
        assert r.swing == (np.median(others) if len(others) >= 3 else None)


def test_zero_heavy_in_either_period(spark):
    rows = [("a", k, 0 if k < 3 else 5) for k in range(20)] + [("b", k, 0 if k == 19 else 5) for k in range(20)] + [("c", k, 0) for k in range(20, 25)] + [("c", 1, 5)]
    df = spark.createDataFrame(rows, "facility string, s int, value int").selectExpr("facility", "timestamp_seconds(s) at", "value")
    found = {r.facility: r.zero_heavy for r in association.zero_heavy(df, 0, 10, 20, 0.1).collect()}
    assert found == {"a": True, "b": False, "c": False}  # 3 of 10 in the first, 1 of 10 in the second, none of those inside


def test_a_freeze_is_bound_to_the_content(spark):
    from slotwise.sources import history

    one = spark.createDataFrame([("a", 1), ("b", 2)], "facility string, value int")
    assert history.identity(one) == history.identity(one.orderBy(F.desc("value")).repartition(3)) != history.identity(one.withColumn("value", F.col("value") + 1))
    frozen = studies.Freeze(studies.specification(POLICY, history.identity(one)), [])
    with pytest.raises(ValueError, match="specification"):
        studies.run_phase(studies.Phase("calibration", START, START, START + DAY), None, None, POLICY, history.identity(one.where("value = 1")), freeze=frozen)


def test_relationship_study(spark):
    rng = random.Random(9)
    def series(seed):
        rng = random.Random(seed)
        wave = [rng.gauss(0, 20) for _ in range(24 * 30)]
        rows = []
        for k in range(24 * 30):
            rows += [("a", 3600 * k, wave[k] + rng.gauss(0, 5)), ("b", 3600 * k, wave[k] + rng.gauss(0, 5)), ("c", 3600 * k, rng.gauss(0, 20)), ("d", 3600 * k, rng.gauss(0, 20)), ("e", 3600 * k, rng.gauss(0, 20)), ("f", 3600 * k, rng.gauss(0, 20)), ("g", 3600 * k, rng.gauss(0, 20))]
        return spark.createDataFrame(rows, "facility string, bin bigint, deviation double")

    registry = spark.createDataFrame([(f, k) for k, f in enumerate("abcdefg")], "facility string, pos int")
    km = registry.alias("x").join(registry.alias("y"), F.col("x.pos") < F.col("y.pos")).select(F.col("x.facility").alias("a"), F.col("y.facility").alias("b"), F.lit(10.0).alias("km"), F.lit("neighbor").alias("band"))
    zeros = registry.select("facility", (F.col("facility") == "g").alias("zero_heavy"))
    found, runs, tests = association.study(series(1), series(2), registry, km, zeros, Association(lags=(1,), resamples=50))
    rows = {(r.family, r.leader, r.follower): r for r in found.collect()}
    strong = rows["co_deviation", "a", "b"]
    assert strong.label == "confirmed" and strong.discovery_low > 0.5 and strong.confirmation_high > strong.confirmation_low
    assert runs.where("a = 'a' AND b = 'b'").count() == 5 and tests.select("period").distinct().count() == 2
    only = association.study(series(1), series(3).where("facility <> 'b'").unionByName(series(4).where("facility = 'b'")), registry, km, zeros.withColumn("zero_heavy", F.lit(True)), Association(lags=(1,), resamples=30))[0]
    assert {r.label for r in only.collect()} == {"exploratory"}
