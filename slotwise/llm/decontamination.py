"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are windows of 13 consecutive item words (an item of fewer words, but not none, is one
window), written as " w1 ... w13 ". Patterns of similar length share a table. A block shift table
tells from the last block of the current window how far no pattern can end; where the shift is 0,
a suffix-hash bucket selects the patterns to test, and a direct comparison confirms each. Texts are
cut in segments whose cursors move in lockstep as numpy arrays.

The search is a pass over each partition, and the pattern tables are broadcast. They come from at most
``block_bytes`` of item text. That is one pass for most benchmarks, and no document is shuffled. More items are
searched in passes one after another: the documents are stored with a row number, each pass writes the hits of
its block by row and gives its tables back before the next one begins, and at the end the hits, not the texts' words,
are merged by row. So memory holds the tables of one block, whatever the benchmark's size.

Defined cases: a text of any length is searched whole, at about 10 bytes of memory for each of its bytes; null and wordless texts have no words and are never contaminated; rows that repeat
are judged each on its own; items that share an id count once; a null item id prints as "null"; an
empty benchmark hits nothing; other columns, whatever their names, are passed through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import col, fresh, stored
from slotwise.llm.words import Words, mix, slices

WINDOW = 13
BLOCK_BYTES = 2 << 20
_BITS = 20
_CLASSES = (2, 8, 16, 32, 1 << 40)
_SEGMENT = 2048
_PAD = 64


class WuManber:
    """Shift tables and suffix buckets for byte patterns of at least two bytes."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        sizes = np.array([len(p) for p in patterns], np.int64)
        self.tables = []
        for low, high in zip(_CLASSES, _CLASSES[1:], strict=False):
            members = np.flatnonzero((sizes >= low) & (sizes < high))
            if len(members):
                self.tables.append(self._table(members, int(sizes[members].min())))

    def _table(self, members: np.ndarray, m: int) -> tuple:
        block = 8 if m >= 24 else 4 if m >= 8 else 2
        heads = np.frombuffer(b"".join(self.patterns[i][:m] for i in members), np.uint8).reshape(len(members), m)
        shift = np.full(1 << _BITS, min(m - block + 1, 255), np.uint8)
        for j in range(m - block + 1):
            np.minimum.at(shift, _block_hash(heads[:, j : j + block]), min(m - block - j, 255))
        suffix = _block_hash(heads[:, m - block :])
        order = np.argsort(suffix, kind="stable")
        begins = np.searchsorted(suffix[order], np.arange((1 << _BITS) + 1)).astype(np.int32)
        check = min(m, 8)
        prefix = _number(heads[:, :check])
        return m, block, shift, begins, members[order], prefix[order], check

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern number) of every occurrence in the bytes ``text``."""
        padded = np.concatenate([text, np.zeros(_PAD, np.uint8)])
        raw = padded.tobytes()
        found: list[tuple[int, int]] = []
        for m, block, shift, begins, members, prefix, check in self.tables:
            last = len(text) - m
            if last < 0:
                continue
            blocks = np.lib.stride_tricks.sliding_window_view(padded, block)
            at = np.arange(0, last + 1, _SEGMENT)
            end = np.minimum(at + _SEGMENT, last + 1)
            hits, keys = [], []
            while len(at):
                key = _block_hash(blocks[at + (m - block)])
                step = shift[key].astype(np.int64)
                stop = step == 0
                if stop.any():
                    hits.append(at[stop])
                    keys.append(key[stop])
                    step[stop] = 1
                at = at + step
                go = at < end
                at, end = at[go], end[go]
            if not hits:
                continue
            hit, key = np.concatenate(hits), np.concatenate(keys)
            n = begins[key + 1] - begins[key]
            place = np.repeat(hit, n)
            slot = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[key], n)
            heads = _number(np.lib.stride_tricks.sliding_window_view(padded, check)[hit])
            same = np.flatnonzero(np.repeat(heads, n) == prefix[slot])
            for p, i in zip(place[same].tolist(), members[slot[same]].tolist(), strict=True):
                if raw.startswith(self.patterns[i], p):
                    found.append((p, i))
        both = np.array(sorted(found), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _number(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(np.uint64).ravel()


def _block_hash(rows: np.ndarray) -> np.ndarray:
    return (mix(_number(rows)) >> np.uint64(64 - _BITS)).astype(np.int64)


class Patterns:
    """The windows of a block of items, and which items hold each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        words = Words(pa.array([t for _, t in items], pa.large_string()))
        raw = words.buffer.tobytes()
        ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(ids)}
        holders: dict[bytes, set[int]] = {}
        for k, (item, _) in enumerate(items):
            n, first = int(words.n_words[k]), int(words.first[k])
            size = min(n, window)
            for j in range(n - size + 1) if n else ():
                pattern = raw[words.space[first + j] : words.space[first + j + size] + 1]
                holders.setdefault(pattern, set()).add(number[item])
        self.ids = ids
        self.search = WuManber(list(holders))
        self.size = np.array([p.count(b" ") - 1 for p in holders], np.int64)
        self.count = np.array([len(x) for x in holders.values()], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.items = np.array([i for x in holders.values() for i in sorted(x)], np.int64)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit flag of every space slot (a word has the slot of the space before it), and (text, item) pairs."""
        flag = np.zeros(len(words.space) + 1, np.int64)
        if not len(words.buffer) or not len(self.size):
            return flag[:-1] > 0, np.empty(0, np.int64), np.empty(0, np.int64)
        place, pattern = self.search.search(words.buffer)
        slot = np.searchsorted(words.space, place)
        np.add.at(flag, slot, 1)
        np.add.at(flag, slot + self.size[pattern], -1)
        doc = np.searchsorted(words.start, place, side="right") - 1
        n = self.count[pattern]
        index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[pattern], n)
        pairs = np.unique(np.stack([np.repeat(doc, n), self.items[index]], 1), axis=0) if len(index) else np.empty((0, 2), np.int64)
        return np.cumsum(flag[:-1]) > 0, pairs[:, 0], pairs[:, 1]


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of bounded size; a larger single item is a block of its own."""
    rows = items.select(F.coalesce(col(id_col).cast("string"), F.lit("null")).alias("i"), col(text_col).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = math.ceil(total / block_bytes)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def flag_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part: int = 20, block_bytes: int = BLOCK_BYTES, drop: bool = False) -> DataFrame:
    """``docs`` with a struct column ``contamination`` (n_words, n_hit, n_items, items_sha256, contaminated).

    A document is contaminated if at least one word in ``part`` is hit. With ``drop`` the contaminated
    documents go instead, and the columns stay as they are.
    """
    spark = docs.sparkSession
    out = fresh(docs, "contamination")
    verdict = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
    final = docs.schema if drop else T.StructType([*docs.schema.fields, T.StructField(out, verdict)])
    place, width = docs.columns.index(text_col), len(docs.columns)
    found = blocks(items, item_id, item_text, block_bytes)
    first = next(found, [])
    second = next(found, None)
    if second is None:
        return docs.mapInArrow(_pass(spark.sparkContext.broadcast(Patterns(first, window)), place, width, part, drop), final)
    row, state, seen = (fresh(docs, n) for n in ("row_so_far", "hits_so_far", "items_so_far"))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    texts, hits = rows.select(row, col(text_col)), None
    for block in chain([first, second], found):
        tables = spark.sparkContext.broadcast(Patterns(block, window))
        new = stored(texts.mapInArrow(_hits(tables), "row bigint, hits array<int>, items array<string>"), "hits")
        tables.destroy()
        hits = new if hits is None else hits.unionByName(new)
    merged = hits.groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("hits")).alias(state), F.flatten(F.collect_list("items")).alias(seen))
    none = spark.sparkContext.broadcast(Patterns([], window))
    return rows.join(merged, row, "left").select(*docs.columns, state, seen).mapInArrow(_pass(none, place, width, part, drop), final)


def _hits(tables):
    """(row, hits, items) of the texts that a block of items hits; hits are bounds of runs of hit words."""

    def run(batches):
        patterns = tables.value
        for whole in batches:
            for batch in slices(whole, 1):
                words = Words(batch.column(1))
                hit, doc, item = patterns.hits(words)
                found: dict[int, set[str]] = {}
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    found.setdefault(d, set()).add(patterns.ids[i])
                some = sorted(found)
                ranges = [_ranges(hit[words.first[d] : words.first[d + 1]]) for d in some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some, pa.int64())), pa.array(ranges, pa.list_(pa.int32())), pa.array([sorted(found[d]) for d in some], pa.list_(pa.string()))], names=["row", "hits", "items"]
                )

    return run


def _pass(tables, place: int, width: int, part: int, drop: bool):
    """The verdicts of texts by a block of items and, in two further columns, by what other blocks hit."""

    def run(batches):
        patterns = tables.value
        for whole in batches:
            for batch in slices(whole, place):
                words = Words(batch.column(place))
                hit, doc, item = patterns.hits(words)
                found: dict[int, set[str]] = {}
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    found.setdefault(d, set()).add(patterns.ids[i])
                if batch.num_columns > width:
                    for d, (ranges, items) in enumerate(zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True)):
                        if ranges:
                            for a, b in zip(ranges[::2], ranges[1::2], strict=True):
                                hit[words.first[d] + a : words.first[d] + b] = True
                            found.setdefault(d, set()).update(items)
                columns = batch.columns[:width]
                n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), words.first[:-1])[: batch.num_rows]
                bad = (n_hit > 0) & (part * n_hit >= words.n_words)
                if drop:
                    yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(width)]).filter(pa.array(~bad))
                    continue
                names = [sorted(found.get(d, ())) for d in range(batch.num_rows)]
                result = pa.StructArray.from_arrays(
                    [pa.array(words.n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([_sha(x) for x in names], pa.string()), pa.array(bad)],
                    names=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )
                yield pa.RecordBatch.from_arrays([*columns, result], names=[str(k) for k in range(width + 1)])

    return run


_NONE = hashlib.sha256(b"").hexdigest()


def _sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest() if items else _NONE


def _ranges(flags: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).tolist() if flags.any() else []
