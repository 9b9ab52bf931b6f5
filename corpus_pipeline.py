"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written and read again as the next one's ``docs``. All but the last return the
columns of documents; the last returns the pieces of the packed documents. Nulls, empty texts, ties,
repeated rows, empty tables and further columns are treated as the operators' own docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import line_dedup, near_dedup, packing, quality
from slotwise.llm.common import fresh, read, stored
from slotwise.llm.decontamination import flag_contaminated


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and its length where the table carries that."""
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else changed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines.

    The row number keeps the filter above the rules: pushed into them, it would have the optimizer put the
    splitting of a text into the lambdas that walk over its words, once for each word.
    """
    done = quality.quality(docs)
    verdict, row = done.columns[-1], fresh(done, "row")
    kept = done.withColumn(row, F.monotonically_increasing_id()).where(F.col(f"{verdict}.kept") & (F.col(row) >= 0))
    return _with_text(kept, F.col(f"{verdict}.clean_text")).drop(verdict, row)


def line_frequency(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate on their source."""
    done = line_dedup.drop_boilerplate(docs)
    found = done.columns[-1]
    return _with_text(done, F.col(f"{found}.clean_text")).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return flag_contaminated(docs, read(spark, sf_dir, "benchmark"), drop=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their bins."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_frequency),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express best-fit packing; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
