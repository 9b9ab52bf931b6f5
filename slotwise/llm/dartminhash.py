"""DartMinHash: sparse weighted MinHash signatures, for many sets at once.

Every element owns the region [0, weight) x [0, oo) of a weight axis and a rank axis. Hashing throws
the same darts into that region wherever the element occurs: in each unit of the weight axis they
arrive along the rank axis as a Poisson process of rate one. A dart also hashes to one of ``k``
coordinates; a set keeps, for each coordinate, its dart of the lowest rank. Two sets keep the same
dart with a probability equal to their weighted Jaccard similarity.

A set of total weight W needs only darts of rank up to about k (ln k + 3) / W; a set that leaves a
coordinate empty throws again with twice the limit. The work for a set is its number of elements
plus k ln k, not elements times k.
"""

from __future__ import annotations

import numpy as np

from slotwise.llm.words import _CELL, mix

_ARRIVAL, _DART, _BAND = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_HALF = np.uint64(32)
#: Arrivals that are made at once.
AT_ONCE = 1 << 15


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    out = (x >> np.uint64(11)).astype(np.float64)
    out += 1.0
    out *= 2.0**-53
    return out


def signatures(owner: np.ndarray, cell: np.ndarray, n_sets: int, k: int, share: np.ndarray | None = None) -> np.ndarray:
    """An ``n_sets`` x ``k`` array of dart numbers; rows of sets without cells are 0.

    ``owner`` gives each cell's set, ``cell`` its 64-bit number: a unit of an element's weight, so that
    an element of weight w has the cells 0 to w - 1 (``words.numbered`` makes them from repeats,
    ``unit_cells`` from weights). A repeated cell changes nothing. ``share`` is the part of a cell, up
    to one, that the weight covers; without it cells are whole.
    """
    signature = np.zeros((n_sets, k), np.uint64)
    if not len(owner):
        return signature
    total = np.bincount(owner, weights=share, minlength=n_sets).astype(np.float64)
    limit = np.zeros(n_sets)
    limit[total > 0] = k * (np.log(k) + 3) / total[total > 0]
    while len(owner):
        lowest = np.full(n_sets * k, np.inf)
        number = np.zeros(n_sets * k, np.uint64)
        slots, ranks, darts = [], [], []
        own, now, part, most = owner.astype(np.int64) * k, cell, share, limit[owner]
        rank, arrival = np.zeros(len(own)), 1
        while len(own):
            # Of few cells many arrivals are made at once: a set of few cells needs hundreds.
            nth = np.arange(arrival, arrival + max(1, AT_ONCE // len(own)), dtype=np.uint64)
            times = -np.log(_unit(mix(now[:, None] + nth * _ARRIVAL)))
            times[:, 0] += rank
            np.cumsum(times, axis=1, out=times)
            hit = times <= most[:, None]
            of, turn = np.nonzero(hit)
            dart = mix((now[of] ^ _DART) + (nth * _CELL)[turn])
            slot = own[of] + ((dart >> _HALF) * np.uint64(k) >> _HALF).astype(np.int64)
            if part is None:
                slots.append(slot), ranks.append(times[hit]), darts.append(dart)
            else:
                inside = _unit(mix(dart + _BAND)) <= part[of]
                slots.append(slot[inside]), ranks.append(times[hit][inside]), darts.append(dart[inside])
            near = np.flatnonzero(hit[:, -1])
            own, now, most, rank = own[near], now[near], most[near], times[near, -1]
            part = None if part is None else part[near]
            arrival += len(nth)
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        np.minimum.at(lowest, slot, rank)
        first = rank == lowest[slot]
        number[slot[first]] = dart[first]
        filled = np.isfinite(lowest).reshape(n_sets, k).all(1)
        signature[filled] = number.reshape(n_sets, k)[filled]
        limit[~filled] *= 2
        rest = ~filled[owner]
        owner, cell, share = owner[rest], cell[rest], None if share is None else share[rest]
    return signature


def unit_cells(owner: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, cell, share) of elements with real weights; an element occurs at most once in a set."""
    cells = np.maximum(np.ceil(weight), 1).astype(np.int64)
    nth = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    share = np.minimum(np.repeat(weight, cells) - nth, 1.0)
    return np.repeat(owner, cells), np.repeat(element, cells) + nth.astype(np.uint64) * _CELL, share


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _BAND, (len(signature), bands)).copy()
    part = signature[:, : bands * rows].reshape(-1, bands, rows)
    for r in range(rows):
        key = mix(key + part[:, :, r])
    return key
