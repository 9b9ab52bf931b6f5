"""Signatures made many arrivals at once."""

from __future__ import annotations

import numpy as np

from slotwise.llm import dartminhash


def sets(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    owner = np.repeat(np.arange(40), rng.integers(0, 60, 40))
    return owner, rng.integers(0, 1 << 63, len(owner)).astype(np.uint64)


def test_arrivals_at_once_give_the_same_signatures(monkeypatch):
    owner, cell = sets()
    share = np.linspace(0.1, 1, len(owner))
    together = [dartminhash.signatures(owner, cell, 40, 144, s) for s in (None, share)]
    monkeypatch.setattr(dartminhash, "AT_ONCE", 1)
    for some, s in zip(together, (None, share), strict=True):
        assert (some == dartminhash.signatures(owner, cell, 40, 144, s)).all()


def test_a_set_of_one_cell_takes_few_rounds(monkeypatch):
    calls = []
    mix = dartminhash.mix
    monkeypatch.setattr(dartminhash, "mix", lambda x: calls.append(1) or mix(x))
    assert dartminhash.signatures(np.zeros(1, np.int64), np.array([7], np.uint64), 1, 144).all()
    assert len(calls) < 50
