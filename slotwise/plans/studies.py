"""Studies end to end: the benefit rules over two periods, and the forecast phases with their frozen selection."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.operators import benefit, forecast, models
from slotwise.policy import Benefit, Forecast
from slotwise.session import cut

# ---------------------------------------------------------------- benefit rules


def benefit_periods(opportunities: dict[str, DataFrame], policy: Benefit) -> DataFrame:
    """(period, origin, rule, ..., low, high): every rule in every period, over all origins (origin "all") and for each."""
    parts = None
    for name, rows in opportunities.items():
        claimed = cut(benefit.claims(rows, policy))
        whole = benefit.rule_summary(claimed, []).join(benefit.precision_intervals(claimed, [], policy), "rule", "left").withColumn("origin", F.lit("all"))
        each = benefit.rule_summary(claimed, ["origin"])
        both = whole.unionByName(each, allowMissingColumns=True).withColumn("period", F.lit(name))
        parts = both if parts is None else parts.unionByName(both)
    return parts


def benefit_decision(results: DataFrame, policy: Benefit) -> DataFrame:
    """The rule that discovery selects over all origins, with its outcome in confirmation; no row if none is eligible."""
    whole = results.where("origin = 'all'")
    chosen = benefit.select_rule(whole.where("period = 'discovery'"), policy).select("rule", F.col("claims").alias("discovery_claims"), F.col("precision").alias("discovery_precision"))
    later = benefit.outcome(whole.where("period = 'confirmation'"), policy)
    return chosen.join(later.select("rule", "claims", "claim_days", "precision", "low", "high", "outcome"), "rule", "left").withColumn("outcome", F.coalesce("outcome", F.lit("inconclusive")))


# ---------------------------------------------------------------- forecast phases


class Phase(NamedTuple):
    """A replay begins early, at ``warm``, so that intervals have errors to look back on; origins from ``begin`` on are scored."""

    name: str
    warm: int
    begin: int
    end: int


class Freeze(NamedTuple):
    """The selection of a development phase: for each facility and horizon its benchmark, candidate and whether it passed."""

    spec: str
    selections: list[dict]


def specification(policy: Forecast, snapshot: str) -> str:
    """Digest of the thresholds, models and the snapshot that a study stands on."""
    return hashlib.sha256(json.dumps({"policy": asdict(policy), "models": [*forecast.MODELS, *models.CANDIDATES], "snapshot": snapshot}, sort_keys=True).encode()).hexdigest()


def run_phase(
    phase: Phase, grid: DataFrame, usual: Callable[[DataFrame, int], DataFrame], policy: Forecast, snapshot: str, *,
    freeze: Freeze | None = None, calibrated: bool = False, delay_slots: int = 0, kinds: tuple[str, ...] = models.KINDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, scores, fit counts) of a phase.

    ``usual`` gives the usual medians of asked targets for a delay. Development selects by matched error; later phases
    need the freeze of the same specification and use its selection, and the holdout needs a scored calibration.
    """
    if phase.name != "development":
        if freeze is None or freeze.spec != specification(policy, snapshot):
            raise ValueError("the frozen selection does not belong to this specification")
        if phase.name == "holdout" and not calibrated:
            raise ValueError("the holdout needs a scored calibration")
    candidates = (*kinds, "profile_ar")
    asked = forecast.origins(grid, phase.warm, phase.end, policy)
    replayed = forecast.replay(grid, usual(asked, delay_slots), phase.warm, phase.end, policy, delay_slots)
    predictions, fits = models.replay_candidates(grid, phase.warm, phase.end, policy, delay_slots, kinds)
    rows = forecast.intervals(cut(forecast.with_candidates(replayed, predictions, candidates)), policy)
    scored = cut(rows.where(F.col("origin") >= phase.begin))
    scores = cut(forecast.score_models(scored))
    if freeze is None:
        chosen = forecast.chosen_models(scores, forecast.MODELS, candidates)
    else:
        chosen = grid.sparkSession.createDataFrame([(x["facility"], x["horizon_minutes"], x["benchmark"], x["candidate"]) for x in freeze.selections], "facility string, horizon_minutes int, benchmark string, candidate string")
    chosen = cut(chosen)
    gain = forecast.bootstrap_gain(forecast.paired(scored, chosen), policy)
    decisions = forecast.gates(forecast.gate_scores(scored, chosen, policy), gain, forecast.fit_failures(fits, phase.begin), policy)
    counts = fits.where(F.col("fit") >= phase.begin).groupBy("model", "status").agg(F.count(F.lit(1)).alias("fits"))
    return decisions, scores, counts


def frozen(decisions: DataFrame, policy: Forecast, snapshot: str) -> Freeze:
    """The selection to freeze: one row a facility and horizon, a small result."""
    rows = decisions.select("facility", "horizon_minutes", "benchmark", "candidate", F.col("passes").alias("shortlisted")).orderBy("facility", "horizon_minutes").collect()
    return Freeze(specification(policy, snapshot), [r.asDict() for r in rows])


def write_freeze(freeze: Freeze, path: str) -> None:
    """Write a freeze once; one that exists is never written again."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(freeze._asdict(), f, indent=2)


def shortlist(freeze: Freeze) -> list[str]:
    return [f"{x['facility']}@{x['horizon_minutes']}" for x in freeze.selections if x["shortlisted"]]
