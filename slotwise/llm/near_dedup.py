"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification.

Similarity is the weighted Jaccard similarity of the five-word shingles of two texts, a shingle's
weight being the number of its occurrences (``weights="set"``: one); texts of 0.8 or more are linked,
and classes are the connected components of the links. Equal texts are always one class.

1. One pass over the texts gives each distinct text (identity: 128 bits of two hashes) its band keys.
   With 24 bands of 6 coordinates a pair at exactly 0.8 shares a band with probability 0.9993, and one
   at 0.15 with 0.0003, so that texts that merely share a passage seldom meet. Distinct texts are
   numbered as they are stored; from then on only these 64-bit numbers travel, with band keys or
   shingles.
2. A band key that several texts share is a bucket. In two rounds each member is compared with a pivot
   of its bucket: the lowest member, then one that is not linked to it. Pairs whose exact similarity
   reaches the threshold are links. Their components are found; buckets whose members are one class are
   finished. In the rest, the members outside a bucket's largest class meet the members of other
   classes in a join whose condition is the link itself, after three exact bounds: the sizes of the sets, bitmaps of them
   (a bit that the other lacks is a cell that it lacks), and the triangle inequality of the Jaccard distance (two members whose distances to a pivot differ by
   more than 0.2 cannot reach 0.8); two members that share several such buckets meet in that of the lowest key. So no link between classes of a bucket is lost, a group of copies costs two
   comparisons a member, only links leave the join, large buckets are split in parts of about 512 members, which meet the pivot and
   each other part by part, and none is gathered in a task.
3. Class numbers go back to the documents by the hashes.

Of the texts only those that share a band key are read again and travel (``marked``). Equal texts meet before the shuffle (partial aggregation), so that a group of exact copies sends one
text from each task. Shingles are those of whole texts, whatever their length: a text over a slice of 2 MB is a
slice by itself, at about 16 bytes of memory for each of its bytes.

Defined cases: a null text is a class of its own; texts without words are grouped only if equal;
a text of one to four words is one shingle; the class number is the lowest id of its documents (null
if all are null); rows that repeat are in one class, and ``near_dedup`` keeps one of them; an empty
table gives an empty result; other columns, whatever their names, are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import col, stored, whole_row
from slotwise.llm.components import components
from slotwise.llm.dartminhash import band_keys, signatures
from slotwise.llm.words import Words, numbered, shingles, slices

SHINGLE, THRESHOLD, BANDS, ROWS, PIVOTS, PART, WEIGHTS, BITMAP, SKETCH = 5, 0.8, 24, 6, 2, 512, "count", 24, 16
NODE = ["hi", "lo"]


def node_of(text: Column) -> list[Column]:
    """The identity of a text as columns hi and lo: two 64-bit hashes; null for null."""
    some = text.isNotNull()
    return [F.when(some, F.xxhash64(F.lit(k), text)).alias(n) for k, n in enumerate(NODE, 1)]


def _cells(words: Words, size: int, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """(text number, unit cell) of the weighted shingles: an element of weight w has w cells."""
    doc, element = shingles(words, size)
    return (doc, numbered(doc, element)) if weights == "count" else (doc, element)


def band_table(texts: DataFrame, *, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weights: str = WEIGHTS) -> DataFrame:
    """(hi, lo, keys) of every row of (hi, lo, text); keys is null for texts without words."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 2):
                words = Words(batch.column(2))
                doc, cell = _cells(words, size, weights)
                keys = band_keys(signatures(doc, cell, batch.num_rows, bands * rows), bands, rows)
                some = words.n_words > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~some, False)), pa.array(keys[some].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=[*NODE, "keys"])

    return texts.select(*NODE, "text").mapInArrow(run, "hi bigint, lo bigint, keys array<bigint>")


def shingle_sets(texts: DataFrame, *, size: int = SHINGLE, weights: str = WEIGHTS) -> DataFrame:
    """(n, shingles, sketch) of rows (n, text): the distinct unit cells of the weighted shingles, and a bitmap of them in ``SKETCH`` words of 64 bits."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                doc, cell = _cells(Words(batch.column(1)), size, weights)
                order = np.lexsort((cell, doc))
                doc, cell = doc[order], cell[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])) if len(doc) else np.empty(0, bool)
                doc, cell = doc[new], cell[new]
                offsets = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
                sketch = np.zeros((batch.num_rows, SKETCH), np.uint64)
                np.bitwise_or.at(sketch, (doc, ((cell >> np.uint64(6)) % np.uint64(SKETCH)).astype(np.int64)), np.uint64(1) << (cell & np.uint64(63)))
                bits = np.arange(batch.num_rows + 1, dtype=np.int32) * SKETCH
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64).ravel())) for at, values in ((offsets, cell), (bits, sketch))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["n", "shingles", "sketch"])

    return texts.select("n", "text").mapInArrow(run, "n bigint, shingles array<bigint>, sketch array<bigint>")


def marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` that may be ``wanted``: all that are, and some others.

    A bitmap of the wanted hashes, in words of 64 bits, is broadcast; it has at most 2 ** (BITMAP - 6) rows, however
    many are wanted. So texts that nobody asks for stay where they are read; when so many are wanted that the bitmap is full, all travel.
    """
    slot = F.pmod("lo", F.lit(1 << BITMAP))
    at = lambda df: df.withColumns({"word": F.shiftright(slot, 6).cast("int"), "bit": F.pmod(slot, F.lit(64)).cast("int")})
    bitmap = stored(at(wanted).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "bitmap")
    met = at(texts).join(F.broadcast(bitmap), "word")
    return met.where(F.expr("(shiftrightunsigned(bits, bit) & 1L) = 1L")).select(*texts.columns)


def similarity(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two arrays of distinct cells: weighted, as an element of weight w has w cells."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def _only(a: str, b: str) -> Column:
    """How many cells the first set has, at least, that the second lacks: the bits of its sketch that are not in the other's.

    Written out as a sum over the words it would make the join's generated loop too long for the JVM's compiler.
    """
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)


def link_labels(docs: DataFrame, *, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weights: str = WEIGHTS) -> DataFrame:
    """(hi, lo, label) of the texts that have a link to a different text, from (hi, lo, text)."""
    texts = docs.select(*NODE, "text").where("text IS NOT NULL")
    keys = band_table(texts, size=size, bands=bands, rows=rows, weights=weights).where("keys IS NOT NULL").groupBy(*NODE).agg(F.first("keys").alias("keys"))
    nodes = stored(keys.withColumn("n", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("n", F.explode("keys").alias("key"))
    buckets = stored(keyed.groupBy("key").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).where("low <> high"), "buckets")
    state = stored(keyed.join(buckets.select("key", F.col("low").alias("pivot"), "parts"), "key"), "members")
    wanted = stored(nodes.join(state.select("n").distinct(), "n").select(*NODE, "n"), "wanted")
    bodies = marked(texts, wanted).groupBy(*NODE).agg(F.first("text").alias("text")).join(wanted, NODE)
    sets = stored(shingle_sets(bodies, size=size, weights=weights), "sets")
    # Kept dealt by number, the sets are shuffled once for all rounds; a lost block is made again from the stored table.
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(parts, "n").persist(StorageLevel.DISK_ONLY)

    def tested(pairs: DataFrame) -> DataFrame:
        """(a, b, j) of distinct pairs (a, b) of a pivot and a member n. A pivot of many members has its set in several parts."""
        split = pairs.withColumn("part", F.pmod(F.xxhash64("n"), "parts").cast("int"))
        heads = split.select("pivot", "part").distinct().join(dealt.select(F.col("n").alias("pivot"), F.col("shingles").alias("x")), "pivot")
        # Sets of pivots travel to the members, whose numbers deal them evenly.
        sides = split.join(heads, ["pivot", "part"]).select("a", "b", "n", "x").join(dealt.select("n", F.col("shingles").alias("y")), "n")
        return stored(sides.select("a", "b", similarity(F.col("x"), F.col("y")).alias("j")), "tested")

    far, least = 1 - threshold + 1e-9, threshold - 1e-9
    ends = [F.least("n", "pivot").alias("a"), F.greatest("n", "pivot").alias("b")]
    state = state.select("key", "n", "pivot", "parts", F.lit(False).alias("linked"))
    distances = [f"d{turn}" for turn in range(PIVOTS)]
    known = None
    for turn in range(PIVOTS):
        met = state.where("n <> pivot").select(*ends, "n", "pivot", "parts").groupBy("a", "b").agg(F.max(F.struct("parts", "pivot", "n")).alias("p")).select("a", "b", "p.*")
        new = tested(met if known is None else met.join(known, ["a", "b"], "left_anti"))
        known = new if known is None else known.union(new)
        state = state.select("key", "n", "pivot", "parts", *distances[:turn], "linked", *ends).join(known, ["a", "b"], "left")
        j = F.coalesce("j", F.lit(1.0))
        state = stored(state.select("key", "n", "parts", *distances[:turn], (1 - j).alias(distances[turn]), (F.col("linked") | (j >= least)).alias("linked")), "state")
        if turn == PIVOTS - 1:
            break
        # The next pivot is a member that the first is not linked to; a bucket without one is a class.
        open_ = stored(state.where("NOT linked").groupBy("key").agg(F.min("n").alias("pivot")), "pivots")
        state = state.join(open_, "key")
    links = known.where(F.col("j") >= least).select("a", "b")
    labels = components(links)

    state = state.drop("linked", "parts").join(labels.withColumnRenamed("node", "n"), "n", "left").withColumn("label", F.coalesce("label", "n"))
    sizes = state.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    majors = sizes.groupBy("key").agg(F.max(F.struct("size", "label"))["label"].alias("major"), F.count(F.lit(1)).alias("labels"), F.ceil(F.sum("size") / PART).cast("int").alias("parts"))
    earlier = F.collect_list("key").over(Window.partitionBy("n").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    members = state.join(majors.where("labels > 1").drop("labels"), "key").withColumn("earlier", earlier).join(dealt, "n")
    members = stored(members.withColumn("part", F.pmod(F.xxhash64("n"), "parts").cast("int")), "open")
    # A large bucket is split in parts; its minor members meet each of them.
    minor = members.where("label <> major").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}_x") for c in ("n", "label", *distances, "earlier", "sketch", "shingles")])
    once = (F.col("label") == F.col("major")) | (F.col("n_x") < F.col("n"))
    mine, other = F.size("shingles"), F.size("shingles_x")
    # The similarity of two sets is the threshold or more if so many cells are shared; said so that they are intersected once.
    enough = lambda shared: shared * (1 + least) >= least * (mine + other)
    close = F.least(mine, other) >= least * F.greatest(mine, other)
    for d in distances:
        close &= F.abs(F.col(d) - F.col(f"{d}_x")) <= far
    close &= enough(mine - _only("sketch", "sketch_x")) & enough(other - _only("sketch_x", "sketch"))
    here = ~F.arrays_overlap("earlier", "earlier_x")
    linked = once & (F.col("label") != F.col("label_x")) & close & here & enough(F.size(F.array_intersect("shingles", "shingles_x")))
    last = stored(minor.join(members, (minor["key"] == members["key"]) & (minor["part"] == members["part"]) & linked).select(F.least("n_x", "n").alias("a"), F.greatest("n_x", "n").alias("b")), "links")
    dealt.unpersist()
    labels = labels if last.isEmpty() else components(links.union(last))
    return labels.join(wanted.withColumnRenamed("n", "node"), "node").select(*NODE, "label")


def _classes(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(hi, lo, ties, class_id, class_size, keeper) of every text; keeper is true for the text of the kept document."""
    text = col(text_col).cast("string")
    labels = link_labels(docs.select(*node_of(text), text.alias("text")), **options)
    ids = docs.select(*node_of(text), col(id_col).alias("id")).where("hi IS NOT NULL")
    nodes = ids.groupBy(*NODE, "id").count().groupBy(*NODE).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "count")).alias("low"), F.sum("count").alias("size"))
    nodes = stored(nodes.join(labels, NODE, "left").select(*NODE, "size", F.col("low.none"), F.col("low.id").alias("id"), F.col("low.count").alias("ties"), "label"), "texts")
    linked = nodes.where("label IS NOT NULL")
    classes = linked.groupBy("label").agg(F.min(F.struct("none", "id", *NODE)).alias("low"), F.sum("size").alias("class_size"))
    keeper = (F.col("low.hi") == F.col("hi")) & (F.col("low.lo") == F.col("lo"))
    found = linked.join(classes, "label").select(*NODE, "ties", F.col("low.id").alias("class_id"), "class_size", keeper.alias("keeper"))
    alone = nodes.where("label IS NULL").select(*NODE, "ties", F.col("id").alias("class_id"), F.col("size").alias("class_size"), F.lit(True).alias("keeper"))
    return stored(found.unionByName(alone), "classes")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: id, class_id, class_size, and whether it is the document that represents its class."""
    found = _classes(docs, id_col, text_col, **options)
    rows = docs.select(col(id_col).alias("id"), *node_of(col(text_col).cast("string")))
    return rows.join(found, NODE, "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("keeper").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.coalesce(F.col("keeper") & F.col("id").eqNullSafe(F.col("class_id")), F.lit(True)).alias("representative"),
    )


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the one of lowest id; of equal rows, any."""
    found = _classes(docs, id_col, text_col, **options)
    keepers = found.where("keeper").select(F.col("hi").alias("k_hi"), F.col("lo").alias("k_lo"), F.col("class_id").alias("k_id"), "ties")
    rows = docs.select(whole_row(docs).alias("d"), *node_of(col(text_col).cast("string")))
    alone = rows.where("hi IS NULL").select("d.*")
    kept = rows.join(keepers, (F.col("hi") == F.col("k_hi")) & (F.col("lo") == F.col("k_lo")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col("k_id")))
    tied = kept.where("ties > 1").groupBy(*NODE).agg(F.first("d").alias("d")).select("d.*")
    return kept.where("ties = 1").select("d.*").unionByName(alone).unionByName(tied)
