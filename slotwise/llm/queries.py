"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import alignment, filter_audit, line_dedup, mixture_packing, near_dedup, packing, pii, quality, secret_scan, sharding, token_counts, warc
from slotwise.llm.common import read
from slotwise.llm.decontamination import flag_contaminated
from slotwise.llm.oracles import ORACLES

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack(docs, classes=near_dedup.link_labels(docs.select(*near_dedup.node_of(F.col("text")), "text")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = secret_scan.dictionary(docs)
    return secret_scan.find_secrets(docs, secret_scan.train(spark, words=words), words=words)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flag_contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contamination.*")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[number(k) for k in pii.BASE], F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("pii")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return done.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.clean_text").cast("binary"), 256).alias("clean_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = mixture_packing.pack_mixture(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_best_fit_packing, op2_secret_scan, op3_decontamination, op4_minhash_dedup, op5_pii, op6_line_dedup, op7_sharding, op8_quality_rules, op9_token_counts, op10_warc, op11_alignment, op12_mixture_packing, op13_filter_audit, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
