"""Words and word shingles of whole texts, as numpy arrays over UTF-8 bytes.

A word is a maximal run of digits, of letters a-z after lower-casing A-Z, or of characters beyond
ASCII. All functions take one Arrow string array and work on all its texts at once; callers feed
them slices of bounded size (``slices``). A text larger than a slice is a slice of its own, of which
words take about 6 bytes of memory for each byte and shingles 10 more; nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SPACE = 32


def _fold() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for low, high in ((0x30, 0x39), (0x61, 0x7A)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


FOLD = _fold()


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """The normalised texts of a slice in one buffer: each text is " w1 w2 ... wn "."""

    def __init__(self, texts: pa.Array) -> None:
        n = len(texts)
        edge = pa.scalar("", pa.large_string())
        framed = pc.binary_join_element_wise(edge, pc.fill_null(texts.cast(pa.large_string()), ""), edge, pa.scalar("\n", pa.large_string()))
        buffers = framed.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[framed.offset : framed.offset + n + 1]
        raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if n else np.empty(0, np.uint8)
        starts = offsets[:-1] - offsets[0] if n else np.empty(0, np.int64)
        folded = FOLD[raw]
        is_word = folded != 0
        keep = is_word.copy()
        keep[1:] |= is_word[:-1]
        keep[starts] = True
        self.buffer = folded[keep]
        self.buffer[self.buffer == 0] = SPACE
        lengths = np.add.reduceat(keep.view(np.uint8), starts, dtype=np.int64) if n else starts
        #: Where each text begins in the buffer; the last entry is its length.
        self.start = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        #: Positions of all spaces; a text of n words has n + 1.
        self.space = np.flatnonzero(self.buffer == SPACE)
        #: Index of each text's first space.
        self.first = np.searchsorted(self.space, self.start)
        self.n_words = np.diff(self.first) - 1

    def text(self, k: int) -> bytes:
        return self.buffer[self.start[k] : self.start[k + 1]].tobytes()


# ---------------------------------------------------------------- hashing

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SHIFT = np.uint64(33)
#: What tells the unit cells of one element's weight apart.
_CELL = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    half = x >> _SHIFT
    out = half ^ x
    for factor in (_M1, _M2):
        out *= factor
        np.right_shift(out, _SHIFT, out=half)
        out ^= half
    return out


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 8 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hash of every word; the entry of a space that no word follows means nothing.

    Spaces and the words after them have one index. Long buffers are hashed in pieces cut at spaces.
    """
    buffer, space = words.buffer, words.space
    out = np.zeros(len(space), np.uint64)
    edge = np.append(space, len(buffer))
    at = 0
    while at < len(space):
        stop = max(at + 1, int(np.searchsorted(edge, edge[at] + SLICE_BYTES)) - 1)
        low, high = edge[at], edge[min(stop, len(space))]
        part = buffer[low:high]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _power(_BASE, len(part)), out=prefix[1:])
        a, b = edge[at:stop] + 1 - low, edge[at + 1 : stop + 1] - low
        out[at:stop] = (prefix[np.maximum(b, a)] - prefix[a]) * _power(_BASE_INVERSE, len(part) + 1)[a]
        at = stop
    return out


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every run of ``size`` words, repeats included.

    A text of fewer words, but not none, is one shingle.
    """
    first, n = words.first[:-1], words.n_words
    word = mix(word_hashes(words) + _ODD)
    run = np.zeros(max(len(word) - size + 1, 0), np.uint64)
    for k in range(size):
        run = run * _M1 + word[k : k + len(run)]
    runs = np.maximum(n - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), runs)
    left = np.arange(len(owner)) + np.repeat(first - (np.cumsum(runs) - runs), runs)
    short = np.flatnonzero((n > 0) & (n < size))
    few = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        there = k < n[short]
        few[there] = few[there] * _M1 + word[first[short[there]] + k]
    return np.concatenate([owner, short]), mix(np.concatenate([run[left], few * _M2 + n[short].astype(np.uint64)]))


def numbered(owner: np.ndarray, element: np.ndarray) -> np.ndarray:
    """The elements, with the second and later occurrence in a set told apart by its number."""
    tag = mix(element ^ (owner.astype(np.uint64) * _ODD))
    ordered = np.sort(tag)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return element
    again = np.flatnonzero(np.isin(tag, twice))
    order = again[np.lexsort((element[again], owner[again]))]
    new = np.append(True, (owner[order[1:]] != owner[order[:-1]]) | (element[order[1:]] != element[order[:-1]]))
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = element.copy()
    out[order] += nth.astype(np.uint64) * _CELL
    return out
