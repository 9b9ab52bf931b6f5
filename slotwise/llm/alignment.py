"""Alignment of two tokenizers over the bytes of each text.

Python only tokenises: it gives the ids of both tokenizers and the byte offset at which each token ends. All
else is array functions. ``array_intersect`` of the two arrays of ends gives the offsets that cut the text into
groups. The ends of both, each with its tokenizer and number, are sorted into one array; in it, the place of an
end less its own number is the number of the other tokenizer's tokens that end before. So one ``transform``
finds for every distinct end the two tokens that cover the bytes before it: these are the links, each once,
as two tokens overlap in one range and that ends where the first of them does. The links at the cuts bound the groups, whose
tokens ``sequence`` and ``transform`` list; ``aggregate`` finds the tokens they cover. All of it is linear in the tokens,
and a step that others use is a column of its own, so that it is computed once a text.

``tokenised``, ``aligned``, ``group_ids`` and ``links`` give the groups and links of every document. ``align``, which needs
digests and counts only, uses that both tokenizers cut a text before its words, so that every word ends a group and its tokens
are the same wherever it stands: tokenising gives, for a slice of the table, its distinct words one after another as if they
were one text, and the documents as numbers of words. The words are aligned once a slice (``words_aligned``), by functions that
Spark compiles where there are some: lambdas, and what is inside their arguments, are evaluated element by element. Words that are frequent at the beginning of the
partitions (``often_met``) are aligned once for all slices; they only save work, all others are aligned with their slice. Then a document's groups and links are those of its words in
their order. Where a tokenizer does not cut texts at words, whole texts are the words.

The documents that hold an id pair are counted from the distinct pairs of each document; counts meet the links
by ``common.looked_up``: pairs that are frequent are broadcast, of a bounded number, and the rest are joined by a shuffle
in which no pair has many rows. Sums are taken by document before they travel.

Defined cases: a text that is null, empty, or whose tokens of either tokenizer are not the bytes of space+text has
no tokens and zeros; rows that repeat count each as a document; texts of any length are aligned whole, in a memory of about
100 bytes for each token of their distinct words and 40 for each word; an empty table gives an empty result; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import col, looked_up, stored
from slotwise.llm.encoding import BytePairs, Pieces, Vocabulary, plain, shared, words_of
from slotwise.llm.token_counts import tokenizer_file
from slotwise.llm.words import slices

#: Bytes of text that are tokenised at a time, as texts and as distinct words, and pairs that are broadcast at most.
SLICE_BYTES = 1 << 20
WORDS_BYTES = 1 << 20
#: Words of documents that take theirs at a time.
PART_WORDS = 1 << 17
#: Frequent words that are aligned once for all slices, and texts of the table in which they are looked for, at most.
OFTEN, OFTEN_ROWS = 1 << 16, 1 << 12
HOT_PAIRS = 1_000_000
TOKENS = ["a_ids", "a_ends", "b_ids", "b_ends"]
SLICE = ["a_stops", "b_stops", "a", "b", "marks", "codes", "w_stops", "w_tokens"]
#: Bits of an id beside an end, and the numbers above all ids that stand for the end of a group and of a word.
_ID = 24
_GROUP, _WORD = (1 << _ID) - 2, (1 << _ID) - 1


def _lists(n: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Ids and ends of tokens as list columns."""
    offsets = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([[0], np.cumsum(lengths[ids], dtype=np.int64)])
    ends = total[1:] - np.repeat(total[offsets[:-1]], n)
    rows = pa.array(offsets.astype(np.int32))
    return pa.ListArray.from_arrays(rows, pa.array(ids)), pa.ListArray.from_arrays(rows, pa.array(ends))


def _broadcast(spark: SparkSession, a_path: str, b_path: str, often: Sequence[str] = ()) -> Callable[[], Vocabulary]:
    """What gives a worker its vocabulary of both tokenizers.

    A is a byte-level BPE tokenizer, which gets space+text; B one of pieces, which puts the space before by itself.
    """
    contents = [tokenizer_file(a_path), tokenizer_file(b_path)]
    name = hashlib.sha256(b"".join(hashlib.sha256(c).digest() for c in contents)).hexdigest()
    a_file, b_file, words = (spark.sparkContext.broadcast(c) for c in [*contents, list(often)])

    def vocabulary() -> Vocabulary:
        """The worker's tokenizers, which are made once, with the words of this call."""
        found = shared(name, lambda: Vocabulary([BytePairs(a_file.value, plain=True), Pieces(b_file.value)], spell=True))
        found.keep(words.value)
        return found

    return vocabulary


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text"))


def tokenised(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, a_ids, a_ends, b_ids, b_ends) of every document; empty arrays where a text has no tokens."""
    vocabulary = _broadcast(docs.sparkSession, a_path, b_path)

    def encode(batches):
        words = vocabulary()
        for whole in batches:
            for batch in slices(whole, 2, SLICE_BYTES):
                found = words.encode([t or "" for t in batch.column(2).to_pylist()], spaced=True)
                owners = [np.repeat(np.arange(batch.num_rows), n) for n, _ in found]
                bad = np.zeros(batch.num_rows, bool)
                for owner, (_, ids) in zip(owners, found, strict=True):
                    bad[owner[ids < 0]] = True
                columns = []
                for owner, (n, ids), lengths in zip(owners, found, words.lengths, strict=True):
                    columns += _lists(np.where(bad, 0, n), ids[~bad[owner]], lengths)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["row", "id", *TOKENS])

    return _rows(docs, id_col, text_col).mapInArrow(encode, "row bigint, id bigint, a_ids array<int>, a_ends array<bigint>, b_ids array<int>, b_ends array<bigint>")


def sliced(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = WORDS_BYTES, often: Sequence[str] = (), known: int = 0) -> DataFrame:
    """Slices of the table: (docs, parts, n_a, a_stops, b_stops, a, b, marks, codes, w_stops, w_tokens).

    The tokens are those of the slice's distinct words one after another, which end at ``w_ends``, where ``w_tokens`` tokens of both have ended. ``a``
    and ``b`` have each token's end and id in one long, ``marks`` its end and number, where those of B follow those of A, and ``codes`` its id, moved up by 32 bits for A; ``docs`` has a struct (row, id, n_a, n_b, words) for every document, with the places of its words, none where a text has no tokens.
    """
    vocabulary = _broadcast(docs.sparkSession, a_path, b_path, often)

    def distinct(number: np.ndarray, words: Vocabulary) -> np.ndarray:
        met = np.zeros(len(words.start[0]), bool)
        met[number] = True
        return known + np.flatnonzero(met[known:])

    def encode(batches):
        for whole in batches:
            words = vocabulary()
            for batch in slices(whole, 2, slice_bytes):
                n_words, number = words.numbers([t or "" for t in batch.column(2).to_pylist()], spaced=True)
                owner, own = np.repeat(np.arange(batch.num_rows), n_words), distinct(number, words)
                wrong = np.zeros(len(words.start[0]), bool)
                for n, ids in words.tokens(own):
                    wrong[np.repeat(own, n)[ids < 0]] = True
                if wrong.any():
                    bad = np.zeros(batch.num_rows, bool)
                    bad[owner[wrong[number]]] = True
                    n_words, number, owner = np.where(bad, 0, n_words), number[~bad[owner]], owner[~bad[owner]]
                    own = distinct(number, words)
                place = np.arange(len(words.start[0]))
                place[own] = np.arange(known, known + len(own))
                place = place[number]
                found = words.tokens(own)
                n_tokens = [pa.array(np.bincount(owner, n[number], batch.num_rows).astype(np.int64)) for n in words.counts()]
                both = [ids.astype(np.int64) for _, ids in found]
                ends = [np.cumsum(lengths[ids], dtype=np.int64) for ids, lengths in zip(both, words.lengths, strict=True)]
                marks = (np.concatenate(ends) << 32) + np.arange(sum(map(len, both)))
                w_stops = (np.concatenate([[0], ends[0]])[np.cumsum(found[0][0])] << _ID) | _WORD
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_words)]).astype(np.int32)), pa.array(place.astype(np.int32)))
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values, type=pa.list_(pa.field("element", values.type, False)))
                rows = one(pa.StructArray.from_arrays([*batch.columns[:2], *n_tokens, places], names=["row", "id", "n_a", "n_b", "words"]))
                firsts = np.flatnonzero(np.diff(np.cumsum(n_words) // PART_WORDS, prepend=-1)).astype(np.int32)
                parts = one(pa.StructArray.from_arrays([pa.array(firsts + 1), pa.array(np.diff(firsts, append=np.int32(batch.num_rows)))], names=["first", "n"]))
                w_tokens = np.cumsum(found[0][0] + found[1][0]).astype(np.int32)
                lists = [*((e << _ID) | _GROUP for e in ends), *((e << _ID) | i for e, i in zip(ends, both, strict=True)), marks, np.concatenate([both[0] << 32, both[1]]), w_stops, w_tokens]
                yield pa.RecordBatch.from_arrays([rows, parts, pa.array([len(both[0])], pa.int32()), *(one(pa.array(x)) for x in lists)], names=["docs", "parts", "n_a", *SLICE])

    # Arrays that can hold no null are sorted as plain longs; others as objects, one by one compared.
    whole = lambda of: T.ArrayType(of, containsNull=False)
    doc = T.StructType([*(T.StructField(c, T.LongType()) for c in ("row", "id", "n_a", "n_b")), T.StructField("words", T.ArrayType(T.IntegerType()))])
    part = T.StructType([T.StructField(c, T.IntegerType()) for c in ("first", "n")])
    lists = [T.StructField(c, whole(T.IntegerType() if c == "w_tokens" else T.LongType())) for c in SLICE]
    return _rows(docs, id_col, text_col).mapInArrow(encode, T.StructType([T.StructField("docs", whole(doc)), T.StructField("parts", whole(part)), T.StructField("n_a", T.IntegerType()), *lists]))


# A mark is a token's end, tokenizer (0 or 1) and number in one long; marks of A and B with the same end are neighbours.
_SIDE, _END = 1 << 32, 1 << 33


def _marks(ends: str, side: int) -> Column:
    return F.transform(ends, lambda e, i: F.shiftleft(e, 33).bitwiseOR(i.cast("bigint") if side == 0 else i + F.lit(_SIDE)))


def _number(mark: Column) -> Column:
    return mark.bitwiseAND(_SIDE - 1).cast("int")


def aligned(tokens: DataFrame) -> DataFrame:
    """``tokens`` without ends, with ``marks`` in order, ``stops`` (the place of the A mark at every cut), ``a_stops`` and ``b_stops`` (-1, then
    the A and the B token there), ``n_a``, ``n_b``, ``n_groups`` and ``n_links``."""
    kept = [c for c in tokens.columns if c not in ("a_ends", "b_ends")]
    marks = F.sort_array(F.concat(_marks("a_ends", 0), _marks("b_ends", 1)))
    number = lambda name: F.size(name).cast("bigint")
    marked = tokens.select(*kept, marks.alias("marks"), number(F.array_intersect("a_ends", "b_ends")).alias("n_groups"), number("a_ids").alias("n_a"), number("b_ids").alias("n_b"))
    n = F.size("marks")
    stopped = marked.withColumn("stops", F.when(n > 1, F.filter(F.sequence(F.lit(0), n - 2), lambda i: F.get("marks", i).bitwiseXOR(F.get("marks", i + 1)) < _END)).otherwise(F.array().cast("array<int>")))
    after_none = lambda stops: F.concat(F.array(F.lit(-1)), stops)
    a_stop = lambda i: _number(F.get("marks", i))
    covered = F.aggregate("stops", F.lit(0), lambda so_far, stop: F.greatest(so_far, stop + 2))
    return stopped.withColumns({"a_stops": after_none(F.transform("stops", a_stop)), "b_stops": after_none(F.transform("stops", lambda i: i - a_stop(i))), "n_links": covered - F.col("n_groups")})


def groups(of: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``of`` (first and last A, first and last B token) of every group."""
    side = lambda stops, g: (F.get(stops, g) + 1, F.get(stops, g + 1))
    return F.transform("stops", lambda stop, g: of(*side("a_stops", g), *side("b_stops", g)))


def _listed(ids: str, first: Column, last: Column) -> Column:
    return F.transform(F.sequence(first, last), lambda k: F.get(ids, k))


def group_ids() -> Column:
    """The groups as structs of A and B ids."""
    return groups(lambda a, a_last, b, b_last: F.struct(_listed("a_ids", a, a_last).alias("a"), _listed("b_ids", b, b_last).alias("b")))


def links(of: Callable[[Column, Column], Column]) -> Column:
    """``of`` (an A and a B token's number) of every link, by its end; null for the B mark of a cut, whose link its A mark has given."""

    def one(mark: Column, i: Column) -> Column:
        number = _number(mark)
        return F.when(mark.bitwiseAND(_SIDE) == 0, of(number, i - number)).when((i == 0) | (F.get("marks", i - 1).bitwiseXOR(mark) >= _END), of(i - number, number))

    return F.transform("marks", one)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n_docs, best) from rows with an array of ``pairs``: documents that hold it, and whether its A id has none in more."""
    counted = pairs.select(F.explode(F.array_distinct("pairs")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counted.select("pair", "n_docs", (F.col("n_docs") == most).cast("int").alias("best"))


def kept_apart(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of its one row, so that its columns are computed once and not anew for each element of a lambda that reads them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def words_aligned(slices: DataFrame) -> DataFrame:
    """``sliced`` tokens as (docs, w_texts, w_pairs): the text of the groups and the id pairs of the links of every word.

    The text of a side is its ids with the ends of groups among them, sorted by end and written as one array; cut at the ends of groups, those of
    both sides are put together. For the links the number of a B token follows those of A; then in the sorted ends the other token at
    place ``i`` of number ``m`` is ``n_a + i - m`` on either side, and the codes of two tokens add up to their pair.
    """
    keep = ("docs", "parts", "w_tokens")
    side = lambda *x: F.sort_array(F.concat(*x)).alias(x[0])
    steps = slices.withColumn("stops", F.array_intersect("a_stops", "b_stops"))
    steps = kept_apart(steps.select(*keep, "n_a", side("a", "stops", "w_stops"), side("b", "stops"), F.sort_array("marks").alias("marks"), "codes"))

    def parts(x: str) -> Column:
        """The ids of each group, and what follows the last; the end of a word stands before the first of the next."""
        text = F.transform(x, lambda v: v.bitwiseAND((1 << _ID) - 1).cast("int")).cast("string")
        return F.split(F.ltrim(text, F.lit("[")), f", {_GROUP}(?:, |])")

    def pair(mark: Column, i: Column) -> Column:
        number = mark.bitwiseAND((1 << 32) - 1).cast("int")
        both = F.get("codes", number) + F.get("codes", F.col("n_a") + i - number)
        return F.when(F.get("marks", i - 1).bitwiseXOR(mark) < (1 << 32), F.lit(None)).otherwise(both)  # the B token's end at a cut, whose link its A token has given

    texts = F.array_join(F.zip_with(parts("a"), parts("b"), lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    texts = F.slice(F.split(F.replace(texts, F.lit(", "), F.lit(",")), f";{_WORD}[],|]"), F.lit(1), F.size("w_tokens"))
    steps = kept_apart(steps.select(*keep, texts.alias("w_texts"), F.transform("marks", pair).alias("pairs")))
    own = lambda last, w: F.transform(F.sequence(F.coalesce(F.get("w_tokens", w - 1), F.lit(0)), last - 1), lambda k: F.get("pairs", k))
    pairs = F.transform("w_tokens", lambda last, w: F.filter(own(last, w), lambda p: p.isNotNull()))
    return kept_apart(steps.select("docs", "parts", "w_texts", pairs.alias("w_pairs")))


def often_met(docs: DataFrame, *, text_col: str = "text", rows: int = OFTEN_ROWS, most: int = OFTEN) -> list[str]:
    """Words that texts at the beginning of each partition hold twice or more, the most frequent of them, of at most 40 characters.

    They only save work: whatever other words a text holds are aligned with its slice.
    """
    few = max(1, rows // max(1, docs.rdd.getNumPartitions()))
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    first = docs.select(col(text_col).cast("string").alias("text"), row.alias("row")).where(F.col("row") < few)

    def count(batches):
        for whole in batches:
            for batch in slices(whole, 0, SLICE_BYTES):
                found = Counter(chain.from_iterable(words_of(t) for t in batch.column(0).to_pylist() if t))
                found = {w: n for w, n in found.items() if len(w) <= 40 and plain(w)}
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    counted = first.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counted.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()]


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS, slice_bytes: int = WORDS_BYTES, often_rows: int = OFTEN_ROWS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    often = often_met(docs, text_col=text_col, rows=often_rows)
    theirs = spark.createDataFrame([(0, " ".join(often))], "id bigint, text string")
    theirs = stored(words_aligned(sliced(theirs, a_path, b_path, id_col="id", often=often)).select(F.col("w_texts").alias("o_texts"), F.col("w_pairs").alias("o_pairs")), "often")
    if theirs.where(F.size("o_texts") == len(often)).isEmpty():  # a word that a tokenizer does not spell
        often, theirs = [], theirs.select(F.slice("o_texts", 1, 0).alias("o_texts"), F.slice("o_pairs", 1, 0).alias("o_pairs"))
    found = words_aligned(sliced(docs, a_path, b_path, id_col=id_col, text_col=text_col, slice_bytes=slice_bytes, often=often, known=len(often)))
    found = found.crossJoin(F.broadcast(theirs)).select("docs", "parts", F.concat("o_texts", "w_texts").alias("w_texts"), F.concat("o_pairs", "w_pairs").alias("w_pairs"))

    def one(d: Column) -> Column:
        of_words = lambda name: F.transform(d["words"], lambda w: F.get(name, w))
        sha = F.when(F.size(d["words"]) == 0, F.lit("")).otherwise(F.sha2(F.array_join(of_words("w_texts"), ";").cast("binary"), 256))
        return F.struct(*[d[c].alias(c) for c in ("row", "id", "n_a", "n_b")], sha.alias("groups_sha256"), F.flatten(of_words("w_pairs")).alias("pairs"))

    parts = kept_apart(found).select("docs", "w_texts", "w_pairs", F.explode("parts").alias("part"))
    parts = parts.select("w_texts", "w_pairs", F.slice("docs", F.col("part.first"), F.col("part.n")).alias("docs"))
    done = stored(kept_apart(parts).select(F.inline(F.transform("docs", one))), "aligned", "zstd")
    met = looked_up(done.select("row", F.explode("pairs").alias("pair")), pair_counts(done), "pair", "n_docs", hot_pairs)
    sums = met.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n_docs").alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    n_links = F.size("pairs").cast("bigint")
    counted = done.select("row", "id", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - n_links).alias("n_groups"), n_links.alias("n_links"), "groups_sha256")  # a group of a and b tokens has a + b - 1 links
    return counted.join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
