"""Token counts through a digest cache.

A stored table holds counts by (tokenizer digest, content digest). Contents are joined to it by their
digests; only distinct contents it lacks are encoded, each once, and appended. Then every row takes
its count from the cache. The missing digests are counted: up to ``BROADCAST_ROWS`` of them select their
texts where these are read, and only those travel; of more, equal texts meet in each task first, and one of
each is dealt by its digest and meets them there.

Normalised content is the text as the tokenizer sees it: null becomes the empty text, and the
tokenizer's own normalizer, where it has one, acts inside the encoding; nothing else is changed, so
that counts are exact. The tokenizer digest is that of its file, so another version never shares
counts.

Encoding is by the library. Byte-level BPE splits a text before every single space between two
visible characters, and between a Latin letter and an ASCII mark or line break that follows it,
whatever stands around, so counts add up over these units; bounded memos in each worker keep the
counts of units, and only units they lack go through the library (a plain word, which is one unit of the
pre-tokenizer, straight to its model). Tokenizers of other kinds, and those
whose special tokens have odd flags, get whole texts.

The tokenizer's file is read by the driver and broadcast; it is a vocabulary of a few megabytes, and one above
``FILE_BYTES`` is refused.

Defined cases: a null or empty text has 0 tokens; special strings inside texts are what the library
takes them for by default; rows that repeat share one cache row; texts of any length are encoded whole (the
library needs about 60 bytes of memory for each of theirs); an empty table gives an empty result; further
columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import col, digest, shared_dir, stored
from slotwise.llm.words import slices

LIMIT, MEMO, BROADCAST_ROWS, FILE_BYTES = 512, 400_000, 100_000, 64 << 20
_RUN = re.compile(r"\s\s")
_UNIT = re.compile(r"(?<=\S) (?=\S)")
_LATIN = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]"
_PART = re.compile(rf"(?<={_LATIN})(?=[!-/:-@\[-`{{-~\n])")
_WORD = re.compile(rf" ?{_LATIN}+")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def tokenizer_file(path: str) -> bytes:
    if os.path.getsize(path) > FILE_BYTES:
        raise ValueError(f"a tokenizer file of more than {FILE_BYTES} bytes is not broadcast")
    with open(path, "rb") as f:
        return f.read()


class Counter:
    """Counts the tokens of texts with one tokenizer, from the bytes of its file (JSON: tokenizers, else: sentencepiece)."""

    def __init__(self, content: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.splits = False
        if content[:1] != b"{":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self._encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(content)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._model = tokenizer.model
        self._encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        said = json.loads(content)
        before = said.get("pre_tokenizer") or {}
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in said.get("added_tokens", []))
        self.splits = said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and plain
        self.marks = [t["content"] for t in said.get("added_tokens", [])]
        self.memo: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self._encode(texts)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        units = [self._units(t) for t in texts]
        missing = {u for x in units for u in x if u not in memo}
        cut = {u: [u] if any(m in u for m in self.marks) else _PART.split(u) for u in missing}
        if len(self.parts) > MEMO:
            self.parts.clear()
        parts = self.parts
        new = {p for x in cut.values() for p in x if p not in parts}
        words = [p for p in new if _WORD.fullmatch(p)]
        tokenize = self._model.tokenize
        parts.update((p, len(tokenize(p.encode().decode("latin-1").translate(_LETTERS)))) for p in words)
        other = list(new.difference(words))
        parts.update(zip(other, self._encode(other), strict=True))
        memo.update((u, sum(map(parts.__getitem__, x))) for u, x in cut.items())
        return [sum(map(memo.__getitem__, x)) for x in units]

    def _units(self, text: str) -> list[str]:
        """The text cut before single spaces; a unit that follows a cut is kept without its space, marked."""
        if not text:
            return []
        parts = _UNIT.split(text) if _RUN.search(text) or text[0].isspace() or text[-1].isspace() else text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]


_counters: dict[str, Counter] = {}


def counter(tokenizer: str, content) -> Counter:
    """The counter of a tokenizer digest, one a worker; ``content`` is the broadcast file."""
    if tokenizer not in _counters:
        _counters[tokenizer] = Counter(content.value)
    return _counters[tokenizer]


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) that the cache holds for a tokenizer digest."""
    schema = "content binary, n_tokens bigint, tokenizer string"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema).select("content", "n_tokens")
    return spark.read.schema(schema).parquet(path).where(F.col("tokenizer") == tokenizer).select("content", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer_path: str, *, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row.

    Counts are kept in the Parquet table ``cache_path``; without it, in a new table in the shared folder.
    """
    spark = docs.sparkSession
    content = tokenizer_file(tokenizer_path)
    tokenizer = hashlib.sha256(content).hexdigest()
    shipped = spark.sparkContext.broadcast(content)
    cache_path = cache_path or f"{shared_dir(spark)}/slotwise/token-counts-{uuid.uuid4().hex}"
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), digest(text).alias("content"))
    missing = stored(rows.select("content").distinct().join(read_cache(spark, cache_path, tokenizer), "content", "left_anti"), "missing")
    if missing.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(missing), "content", "left_semi")
    texts = rows.groupBy("content").agg(F.first("text").alias("text")).join(missing, "content", "left_semi")

    def encode(batches):
        count = counter(tokenizer, shipped).count
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], names=["content", "n_tokens"])

    texts.mapInArrow(encode, "content binary, n_tokens bigint").withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    known = read_cache(spark, cache_path, tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counted = docs.select(col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), digest(text).alias("content"))
    return counted.join(known, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
