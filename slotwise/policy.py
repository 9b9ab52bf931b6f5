"""Policies: every threshold of the engine is data, passed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

ZONE = "America/Chicago"


@dataclass(frozen=True)
class Baseline:
    """Usual values, comparison and trend."""

    zone: str = ZONE
    lookback_days: int = 28
    hour_radius: int = 1
    fallback_hour_radius: int = 2
    minimum_days: int = 8
    minimum_samples: int = 64
    minimum_coverage: float = 0.75
    minimum_day_coverage: float = 0.75
    band_low: float = 0.25
    band_high: float = 0.75
    unusual_low: float = 10
    unusual_high: float = 90
    meaningful_minutes: float = 10
    trend_minutes: int = 60
    trend_tolerance_minutes: int = 20
    trend_minimum_samples: int = 2
    cadence_seconds: int = 900
    gap_seconds: int = 1200

    def but(self, **changes) -> Baseline:
        return replace(self, **changes)


@dataclass(frozen=True)
class Movement:
    """Changes over fixed horizons."""

    zone: str = ZONE
    horizons_minutes: tuple[int, ...] = (15, 30, 60, 120)
    cadence_seconds: int = 900
    minimum_days: int = 8
    minimum_pairs: int = 64
    minimum_day_coverage: float = 0.75
    gap_seconds: int = 1200
    tolerance_seconds: int = 450
    meaningful_minutes: float = 10
    lookback_days: int = 28


@dataclass(frozen=True)
class Association:
    """Pair tests."""

    zone: str = ZONE
    bin_seconds: int = 3600
    minimum_slots: int = 2
    neighbor_km: float = 50
    far_km: float = 150
    lags: tuple[int, ...] = (1, 2, 3)
    minimum_bins: int = 168
    minimum_days: int = 7
    minimum_day_bins: int = 12
    minimum_others: int = 5
    fdr_q: float = 0.10
    discovery_effect: float = 0.20
    confirmation_effect: float = 0.10
    robust_p: float = 0.05
    zero_heavy_share: float = 0.10
    episode_minutes: float = 10
    resamples: int = 1000
    seed: int = 20260924


@dataclass(frozen=True)
class Forecast:
    """Replay, intervals, gates."""

    zone: str = ZONE
    cadence_seconds: int = 900
    horizons_minutes: tuple[int, ...] = (15, 30, 60, 120)
    origin_seconds: int = 3600
    daily_slots: int = 96
    weekly_slots: int = 672
    spike_days: int = 28
    spike_minimum: int = 64
    interval_days: int = 7
    minimum_errors: int = 72
    levels: tuple[int, ...] = (80, 95)
    training_days: int = 28
    minimum_training_slots: int = 14 * 96
    minimum_training_coverage: float = 0.95
    maximum_missing_run: int = 4
    minimum_matched: int = 150
    minimum_days: int = 6
    minimum_gain: float = 1.0
    minimum_gain_fraction: float = 0.05
    minimum_availability: float = 0.95
    maximum_fit_failure: float = 0.01
    interval_tolerance: float = 0.05
    maximum_update_seconds: float = 600
    resamples: int = 2000
    seed: int = 20260924


@dataclass(frozen=True)
class Benefit:
    """Drive-plus-wait rules: (name, kind, value)."""

    zone: str = ZONE
    slot_seconds: int = 900
    evaluation_every_slots: int = 4
    max_drive_minutes: float = 120
    later_minutes: int = 60
    stress_ratio: float = 1.2
    rules: tuple[tuple[str, str, float], ...] = (
        ("F0", "fixed", 0), ("F10", "fixed", 10), ("F20", "fixed", 20), ("F30", "fixed", 30),
        ("F45", "fixed", 45), ("F60", "fixed", 60), ("S1", "screen", 1), ("S0.5", "screen", 0.5),
    )
    minimum_claims: int = 50
    minimum_days: int = 5
    minimum_precision: float = 0.9
    minimum_lower_bound: float = 0.8
    confirmation_claims: int = 20
    confirmation_days: int = 3
    confirmation_precision: float = 0.9
    draws: int = 2000
    seed: int = 20260926


@dataclass(frozen=True)
class Freshness:
    """Seconds after which a latest reading is no longer current."""

    expected_collection_seconds: int = 900
    stale_after_seconds: int = 1800
    refresh_seconds: int = 60
    request_timeout_seconds: int = 10
