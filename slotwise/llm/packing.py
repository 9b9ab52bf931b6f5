"""Conflict-constrained best-fit packing of documents into token windows.

Documents are dealt by id, digest and source to groups of about ``rows_a_group`` rows, a number that
follows the table; rows that repeat are counted and dealt each by the number of the copy, so that no
group grows with them. Each group is packed by itself, longest first. Only ids, lengths, sources and clusters travel,
no texts.

Within a group the bins stand in order of their residual space. A bin carries a bitmap of its sources
and one of its duplicate clusters. A piece takes the bin with the least residual that is large enough
and whose bitmaps hold neither its source nor its cluster: successor search goes from residual to
residual, and on past bins in conflict, until the tightest compatible bin is found; if there is none,
a bin is opened. For each residual the bins are kept by source bitmap, and a count for each source
tells whether a residual has any bin without it, so that whole residuals in conflict are skipped.

A document longer than a bin fills bins of its own and its rest is packed; no text is cut off.

Defined cases: documents of length 0 (null or wordless texts) take a place of length 0; a null source
or cluster conflicts with nothing; ties are ordered by id and digest; repeated rows are packed each;
words of texts of any length are counted in slices; an empty table gives an empty result; further columns, whatever their
names, are left out.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import col, digest, stored
from slotwise.llm.near_dedup import NODE, node_of
from slotwise.llm.words import slices

CAPACITY, ROWS_A_GROUP = 2048, 8192


class BestFit:
    """Bins of one group, ordered by residual space."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.levels: dict[int, dict[int, list[int]]] = {}  # residual -> source bitmap -> bins
        self.present = 0  # bit r: some bin has residual r
        self.count: dict[int, int] = {}  # residual -> bins
        self.holding: dict[int, dict[int, int]] = {}  # source -> residual -> bins that hold it
        self.clusters: list[int] = []
        self.sources: list[int] = []

    def _put(self, bin_: int, residual: int) -> None:
        mask = self.sources[bin_]
        insort(self.levels.setdefault(residual, {}).setdefault(mask, []), bin_)
        self.count[residual] = self.count.get(residual, 0) + 1
        self.present |= 1 << residual
        self._tally(mask, residual, 1)

    def _tally(self, mask: int, residual: int, by: int) -> None:
        while mask:
            low = mask & -mask
            held = self.holding.setdefault(low.bit_length() - 1, {})
            held[residual] = held.get(residual, 0) + by
            mask ^= low

    def _take(self, residual: int, mask: int, index: int) -> int:
        level = self.levels[residual]
        bins = level[mask]
        bin_ = bins.pop(index)
        if not bins:
            del level[mask]
        self.count[residual] -= 1
        if not self.count[residual]:
            self.present &= ~(1 << residual)
        self._tally(mask, residual, -1)
        return bin_

    def _tightest(self, size: int, source: int, cluster: int) -> tuple[int, int, int] | None:
        """(residual, bitmap, index) of the compatible bin of least residual; of equals the oldest."""
        held = self.holding.get(source, {})
        above = self.present >> size
        residual = size
        while above:
            step = (above & -above).bit_length() - 1
            residual += step
            above >>= step
            if held.get(residual, 0) < self.count[residual]:
                best = None
                for mask, bins in self.levels[residual].items():
                    if source >= 0 and mask >> source & 1:
                        continue
                    index = next((i for i, b in enumerate(bins) if cluster < 0 or not self.clusters[b] >> cluster & 1), -1)
                    if index >= 0 and (best is None or bins[index] < best[0]):
                        best = bins[index], mask, index
                if best:
                    return residual, best[1], best[2]
            above >>= 1
            residual += 1
        return None

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece of at most the capacity; source and cluster are -1 for none."""
        found = self._tightest(size, source, cluster)
        if found:
            residual, mask, index = found
            bin_ = self._take(residual, mask, index)
        else:
            residual, bin_ = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        if source >= 0:
            self.sources[bin_] |= 1 << source
        if cluster >= 0:
            self.clusters[bin_] |= 1 << cluster
        self._put(bin_, residual - size)
        return bin_, self.capacity - residual


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of a group's documents with bin and offset. Columns: id, node, size, source, cluster."""
    rows = rows.sort_values(["size", "id", "node"], ascending=[False, True, True], kind="stable", na_position="first")
    sources = pd.factorize(rows["source"])[0].tolist()
    repeated = rows["cluster"].where(rows["cluster"].duplicated(keep=False))
    clusters = pd.factorize(repeated)[0].tolist()
    ids, sizes = rows["id"].tolist(), rows["size"].tolist()
    full: list[tuple] = []
    rest: list[tuple] = []
    for k, size in enumerate(sizes):
        whole, left = divmod(size, capacity)
        full += [(k, p, p * capacity, capacity) for p in range(whole)]
        if left or not whole:
            rest.append((k, whole, whole * capacity, left))
    rest.sort(key=lambda x: -x[3])
    bins = BestFit(capacity)
    out = []
    for k, piece, start, length in full + rest:
        bin_, offset = bins.add(length, sources[k], clusters[k])
        out.append((ids[k], piece, start, length, bin_, offset))
    made = pd.DataFrame(out, columns=["id", "piece", "start", "length", "bin", "bin_offset"])
    made["id"] = made["id"].astype("Int64")
    return made


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def count_words(texts: pa.Array) -> np.ndarray:
    """The number of runs of visible characters of each text; 0 for null."""
    data = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(data) and data.buffers()[2] else np.empty(0, np.uint8)
    visible = ~_BLANK[raw]
    begins = visible.copy()
    begins[1:] &= ~visible[:-1]
    out = np.zeros(len(data), np.int64)
    some = np.flatnonzero(np.diff(offsets)) if len(data) else np.empty(0, np.int64)
    if len(some):
        edge = offsets[some] - offsets[0]
        begins[edge] = visible[edge]
        out[some] = np.add.reduceat(begins.view(np.uint8), edge, dtype=np.int64)
    return out


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Words of a text, in Arrow batches, counted in slices of bounded size."""
    whole = pa.RecordBatch.from_arrays([texts], names=["text"])
    return pa.array(np.concatenate([np.empty(0, np.int64), *[count_words(part.column(0)) for part in slices(whole, 0)]]), pa.int64())


def pack(
    docs: DataFrame,
    *,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    source_col: str | None = "source",
    cluster: Column | None = None,
    classes: DataFrame | None = None,
    rows_a_group: int = ROWS_A_GROUP,
) -> DataFrame:
    """(id, piece, start, length, bin_group, bin, bin_offset) of every piece of every document.

    ``length`` counts tokens (default: words of the text), ``cluster`` names the duplicate cluster
    (default: equal texts). ``classes`` has rows (hi, lo, label) for the hashes (``near_dedup.node_of``) of texts
    that belong to a class of several texts; their cluster is the label. With ``source_col=None`` sources do not conflict.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    node = F.hex(digest(text))
    rows = docs.select(
        col(id_col).cast("bigint").alias("id"),
        node.alias("node"),
        F.coalesce((word_count(text) if length is None else length).cast("bigint"), F.lit(0)).alias("size"),
        (F.lit(None).cast("string") if source_col is None else col(source_col).cast("string")).alias("source"),
        (F.when(col(text_col).isNotNull(), node) if cluster is None else cluster.cast("string")).alias("cluster"),
        *([] if classes is None else node_of(col(text_col).cast("string"))),
    )
    if classes is not None:
        named = F.concat(F.lit("class "), F.col("label").cast("string"))
        rows = rows.join(classes, NODE, "left").withColumn("cluster", F.coalesce(named, "cluster")).drop("label", *NODE)
    rows = stored(rows.groupBy("id", "node", "size", "source", "cluster").count(), "lengths")
    groups = max(1, -(-(rows.agg(F.sum("count")).first()[0] or 0) // rows_a_group))
    rows = rows.select("id", "node", "size", "source", "cluster", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"))).alias("copy"))
    rows = rows.withColumn("bin_group", F.pmod(F.xxhash64("id", "node", "source", "copy"), F.lit(groups)).cast("int")).drop("copy")
    # Dealt by range, groups spread evenly over tasks, several in one where there are more groups than tasks; only the stored lengths are sampled for it.
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(min(groups, tasks), "bin_group")

    def run(key, batch: pd.DataFrame) -> pd.DataFrame:
        batch["id"] = batch["id"].astype("Int64")
        return pack_group(batch, capacity).assign(bin_group=key[0])

    packed = rows.groupBy("bin_group").applyInPandas(run, "id bigint, piece int, start bigint, length bigint, bin int, bin_offset int, bin_group int")
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "bin_group", "bin", "bin_offset")

