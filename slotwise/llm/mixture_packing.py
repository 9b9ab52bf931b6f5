"""Mixture-controlled packing: deficit round-robin over source queues.

Every document becomes token ids, closed by an end id, and stands in the queue of its source; windows of a fixed
length are filled from the queues so that each holds the sources in their target proportions. In every
window a queue earns its share of the window; it is served when that covers what is left of its first document, or
``LEAST`` tokens of it; what it has earned and not got is its deficit and goes on to the next window, and so does
what it got ahead, when the room left in a window is given to the queue that is owed most. Documents are
cut where a window or a queue's earnings end, and no token is left out.

Windows are filled in partitions of ``WINDOWS``. In the fluid limit queue s has given min(T_s, w_s v) tokens at
the virtual time v, T_s being its tokens and w_s its weight; this gives, in closed form, what each queue has
given when a partition begins, and the fraction of a token it is owed by then: the deficit that crosses the
boundary. So partitions are independent, and hold the proportions of one round-robin over all. Without
targets the weights are the tokens themselves, and all queues end together; with targets a queue that runs dry
leaves its share to the others.

Sources with at least one in ``QUEUES`` of all tokens, and those that have a target, have queues of their own, the others share one;
so there are never more than twice that many. A document's place in its queue is a running total over
buckets (``common.running_totals``), so that no task sees a whole queue. Only row numbers and
lengths travel to the partitions; ids are stored once, as 16-bit numbers where the vocabulary allows, and meet their
pieces in one join by row number.

The last window of a partition is padded if at most an eighth of it is empty; else it is cut into sequences whose lengths are powers of two.

Defined cases: a null or empty text is its end id alone; a null source is a queue name like others; rows that repeat
are packed each; texts of any length are encoded whole, and their pieces lie in as many partitions as they need; an empty
table gives an empty result; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import deque
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import col, running_totals, stored
from slotwise.llm.encoding import BytePairs, shared
from slotwise.llm.token_counts import tokenizer_file
from slotwise.llm.words import slices

CAPACITY, WINDOWS, LEAST, QUEUES, END_ID = 1024, 1024, 256, 512, 0
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 1 << 20


class Fluid:
    """What each queue has given when a partition of ``room`` tokens begins."""

    def __init__(self, tokens: list[int], weights: list[float], room: int) -> None:
        self.tokens, self.weights, self.room = np.array(tokens, np.int64), np.array(weights, float), room
        ends = np.unique(self.tokens / self.weights)
        self._times = np.concatenate([[0.0], ends])
        self._given = np.minimum(self.tokens, self.weights * self._times[:, None]).sum(1)
        self.partitions = max(1, -(-int(self.tokens.sum()) // room))

    def exact(self, queue: np.ndarray, partition: np.ndarray) -> np.ndarray:
        """Tokens that a queue has given, with their fraction, as a partition begins."""
        time = np.interp(np.asarray(partition, float) * self.room, self._given, self._times)
        return np.where(np.asarray(partition) >= self.partitions, self.tokens[queue], np.minimum(self.tokens[queue], self.weights[queue] * time))

    def given(self, queue: np.ndarray, partition: np.ndarray) -> np.ndarray:
        return np.floor(self.exact(queue, partition)).astype(np.int64)

    def partition_of(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The partition that takes a queue's token at a place."""
        at = np.floor(np.interp(place / self.weights[queue], self._times, self._given) / self.room).astype(np.int64)
        at = np.clip(at, 0, self.partitions - 1)
        while (late := self.given(queue, at) > place).any():
            at = at - late
        while (early := self.given(queue, at + 1) <= place).any():
            at = at + early
        return at


def fill(queues: list[list[tuple[int, int, int]]], owed: np.ndarray, capacity: int, least: int) -> list[tuple[int, int, int, int, int]]:
    """(row, start, length, sequence, offset) of the pieces of queues of (row, start, length), in windows of ``capacity``."""
    waiting = [deque(q) for q in queues]
    supply = np.array([sum(x[2] for x in q) for q in queues], np.int64)
    rate = supply / max(1, supply.sum())
    deficit, left, total = owed.astype(float).copy(), supply.copy(), int(supply.sum())
    need = np.array([min(q[0][2], least) if q else np.inf for q in waiting], float)
    out: list[tuple[int, int, int, int, int]] = []
    window = 0

    def serve(s: int, most: int, offset: int) -> int:
        row, start, rest = waiting[s][0]
        take = min(rest, most)
        out.append((row, start, take, window, offset))
        if take == rest:
            waiting[s].popleft()
        else:
            waiting[s][0] = row, start + take, rest - take
        left[s] -= take
        deficit[s] -= take
        need[s] = min(waiting[s][0][2], least) if waiting[s] else np.inf
        return take

    while total:
        size = capacity if total >= capacity - capacity // 8 else 1 << total.bit_length() - 1
        size = min(size, total)
        deficit += rate * size
        room = size
        ready = np.flatnonzero(deficit >= need)
        for s in np.roll(ready, -(window % max(1, len(ready)))).tolist():
            while room and deficit[s] >= need[s]:
                room -= serve(s, min(room, int(deficit[s])), size - room)
        while room:
            s = int(np.where(left > 0, deficit, -np.inf).argmax())
            room -= serve(s, min(room, max(least, int(deficit[s]))), size - room)
        total -= size
        window += 1
    return out


def tokenised(docs: DataFrame, tokenizer_path: str, *, id_col: str, text_col: str, source_col: str, end_id: int) -> DataFrame:
    """(row, id, source, n_tokens, ids) of every document, stored; ids are little-endian 16- or 32-bit numbers."""
    content = tokenizer_file(tokenizer_path)
    name = hashlib.sha256(content).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(content)

    def encode(batches):
        tokenizer = shared(name, lambda: BytePairs(shipped.value))
        kind = np.dtype("<u2" if max(tokenizer.bytes_of, default=0) < 1 << 16 else "<u4")
        for whole in batches:
            for batch in slices(whole, 3, SLICE_BYTES):
                found = tokenizer.whole([t or "" for t in batch.column(3).to_pylist()])
                n = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(chain.from_iterable(found), kind, int(n.sum()))
                stops = np.cumsum(n + 1)
                closed = np.full(int(stops[-1]), end_id, kind)
                inside = np.ones(len(closed), bool)
                inside[stops - 1] = False
                closed[inside] = ids
                edges = np.concatenate([[0], stops * kind.itemsize]).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(closed)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n + 1), lists], names=["row", "id", "source", "n_tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("bigint").alias("id"), F.coalesce(col(source_col).cast("string"), F.lit("")).alias("source"), col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(encode, "row bigint, id bigint, source string, n_tokens bigint, ids binary"), "token-ids", "zstd")


def queue_table(lengths: DataFrame, targets: dict[str, float] | None, queues: int) -> tuple[DataFrame, list[int], list[float]]:
    """(source, queue) of the sources with queues of their own, and tokens and weights by queue; the last one is that of all others."""
    totals = stored(lengths.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "source-tokens")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    own = totals.where((F.col("tokens") * queues >= total) | F.col("source").isin(*(targets or {}))).orderBy("source").collect()
    others = total - sum(r.tokens for r in own)
    names, tokens = [r.source for r in own], [*[r.tokens for r in own], *([others] if others else [])]
    weights = [float(t) for t in tokens]
    if targets:
        spare = max(0.0, 1.0 - sum(targets.values()))
        rest = sum(t for name, t in zip([*names, None], tokens) if name not in targets)
        weights = [targets.get(name) or max(spare, 1e-3) * t / rest for name, t in zip([*names, None], tokens)]
    table = lengths.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "source string, queue int")
    return table, tokens, weights


def pack_mixture(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    targets: dict[str, float] | None = None,
    capacity: int = CAPACITY,
    windows: int = WINDOWS,
    least: int = LEAST,
    queues: int = QUEUES,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    ``targets`` are shares of the tokens by source (default: those of the documents); what they leave is shared by
    the other sources. ``ids`` are the piece's tokens as little-endian unsigned 32-bit numbers.
    """
    tokens = tokenised(docs, tokenizer_path, id_col=id_col, text_col=text_col, source_col=source_col, end_id=end_id)
    lengths = tokens.select("row", "source", "n_tokens")
    table, totals, weights = queue_table(lengths, targets, queues)
    fluid = Fluid(totals or [1], weights or [1.0], capacity * windows)
    placed = lengths.join(F.broadcast(table), "source", "left").select("row", "n_tokens", F.coalesce("queue", F.lit(len(totals) - 1)).alias("queue"))
    placed = running_totals(placed, "queue", "n_tokens", "row", "place")

    @F.pandas_udf("first bigint, last bigint")
    def spread(queue: pd.Series, place: pd.Series, n: pd.Series) -> pd.DataFrame:
        q, p = queue.to_numpy(np.int64), place.to_numpy(np.int64)
        return pd.DataFrame({"first": fluid.partition_of(q, p), "last": fluid.partition_of(q, p + n.to_numpy(np.int64) - 1)})

    dealt = placed.withColumn("among", spread("queue", "place", "n_tokens")).select("row", "queue", "place", "n_tokens", F.explode(F.sequence("among.first", "among.last")).alias("partition"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["queue", "place"])
        queue, place, n = rows["queue"].to_numpy(np.int64), rows["place"].to_numpy(np.int64), rows["n_tokens"].to_numpy(np.int64)
        low = np.maximum(place, fluid.given(queue, np.full(len(rows), key[0])))
        high = np.minimum(place + n, fluid.given(queue, np.full(len(rows), key[0] + 1)))
        waiting: list[list[tuple[int, int, int]]] = [[] for _ in fluid.tokens]
        for s, row, start, length in zip(queue.tolist(), rows["row"].tolist(), (low - place).tolist(), (high - low).tolist(), strict=True):
            if length > 0:  # a queue may give nothing in a partition within a long document
                waiting[s].append((row, start, length))
        exact = fluid.exact(np.arange(len(waiting)), np.full(len(waiting), key[0]))
        found = pd.DataFrame(fill(waiting, exact - np.floor(exact), capacity, least), columns=["row", "start", "length", "sequence_id", "offset"])
        # A partition has no more sequences than windows, one for the fractions and the powers of two of the last one.
        found["sequence_id"] += key[0] * (windows + 64)
        return found

    pieces = dealt.groupBy("partition").applyInPandas(run, "row bigint, start bigint, length bigint, sequence_id bigint, offset bigint")
    by_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    kind = "row bigint, id bigint, source string, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def cut_ids(batches):
        for whole in batches:
            for batch in slices(whole, 4, 1 << 20):
                out: list[tuple] = []
                for row, id_, source, n, ids, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                    for c in cuts:
                        part = raw[4 * c["start"] : 4 * (c["start"] + c["length"])]
                        out.append((row, id_, source, c["start"], c["length"], part, zlib.crc32(part), n, c["sequence_id"], c["offset"]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _KINDS, strict=True)], names=_NAMES)

    joined = tokens.join(by_row, "row").select("row", "id", "source", "n_tokens", "ids", "pieces")
    return joined.mapInArrow(cut_ids, kind).withColumnRenamed("id", id_col).drop("row")


_NAMES = ["row", "id", "source", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths, sources) of packed pieces: the sequences as they are trained on, at most one window each."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids", "length", "source")))
    one = pieces.groupBy("sequence_id").agg(ordered.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return one.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"), F.transform("p", lambda x: x["source"]).alias("sources"))
