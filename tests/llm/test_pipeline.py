"""The corpus pipeline against the plain versions of its stages."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from slotwise.llm import packing
from slotwise.llm.common import digest
import brute


@pytest.fixture(scope="session")
def folder(docs, benchmark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, docs, folder, benchmark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    columns, now, steps = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        steps[name] = now
        assert name == "best_fit_packing" or now.columns == columns
    key = lambda df: Counter((r.doc_id, r.text, r.source, r.n_chars) for r in df.collect())

    kept = [(r.doc_id, q[-1], r.source, len(q[-1])) for r in docs.collect() if (q := brute.quality(r.text))[-2]]
    assert key(steps["quality_rules"]) == Counter(kept)

    clean = brute.without_boilerplate([(r[2], r[1]) for r in kept])
    lined = [(r[0], t, r[2], len(t)) for r, t in zip(kept, clean, strict=True)]
    assert key(steps["line_dedup"]) == Counter(lined)

    groups = brute.classes([r[1] for r in lined])
    lowest = Counter(min((lined[i][0] for i in g if lined[i][0] is not None), default=None) for g in groups)
    assert Counter(r.doc_id for r in steps["near_dedup"].collect()) == lowest

    left = steps["near_dedup"].collect()
    items = [("null" if r.item_id is None else str(r.item_id), r.text) for r in benchmark.collect()]
    flags = brute.contamination([r.text for r in left], items)
    assert any(f[4] for f in flags)
    assert key(steps["decontamination"]) == Counter((r.doc_id, r.text, r.source, r.n_chars) for r, f in zip(left, flags, strict=True) if not f[4])

    text = F.coalesce("text", F.lit(""))
    rows = [tuple(r) for r in steps["decontamination"].select("doc_id", F.hex(digest(text)), packing.word_count(text), "source", F.hex(digest(text))).collect()]
    found = Counter((r.doc_id, r.piece, r.start, r.length, r.bin, r.bin_offset) for r in steps["best_fit_packing"].collect())
    assert found == Counter(brute.packed(rows, packing.CAPACITY))


def test_run(spark, folder):
    done = corpus_pipeline.run(spark, folder)
    assert done.columns == ["doc_id", "piece", "start", "length", "bin_group", "bin", "bin_offset"] and done.count() > 0


def test_empty_documents(spark, docs, folder):
    now = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        assert now.count() == 0
