"""Each operator against its plain version, over a corpus with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotwise.llm import dartminhash, line_dedup, near_dedup, packing, pii, quality, queries, secret_scan, sharding, token_counts, warc
from slotwise.llm.common import digest
from slotwise.llm.components import components
from slotwise.llm.decontamination import flag_contaminated
from slotwise.llm.words import SLICE_BYTES, Words, shingles
import brute


def bag(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


# ---------------------------------------------------------------- packing


def test_packing_is_best_fit(spark, docs):
    found = packing.pack(docs, capacity=300, rows_a_group=1 << 20)
    text = F.coalesce("text", F.lit(""))
    rows = [(r.doc_id, r.node, r.size, r.source, r.cluster) for r in docs.select("doc_id", F.hex(digest(text)).alias("node"), packing.word_count(text).alias("size"), "source", F.when(F.col("text").isNotNull(), F.hex(digest(text))).alias("cluster")).collect()]
    assert bag(found.select("doc_id", "piece", "start", "length", "bin", "bin_offset").collect()) == bag(brute.packed(rows, 300))


def test_packing_groups_keep_their_constraints(docs):
    found = packing.pack(docs, capacity=100, rows_a_group=40).toPandas()
    assert found.groupby(["bin_group", "bin"])["length"].sum().max() <= 100
    assert len(found.groupby(["bin_group"])) > 1
    rows = docs.select("doc_id", packing.word_count(F.coalesce("text", F.lit(""))).alias("n")).collect()
    assert found["length"].sum() == sum(r.n for r in rows)
    met = found[found["doc_id"].notna()].merge(docs.select("doc_id", "source").distinct().dropna().toPandas(), on="doc_id")
    whole = met[met["length"] < 100].drop_duplicates(["doc_id", "piece", "bin_group", "bin"])
    assert not whole.duplicated(["bin_group", "bin", "source"]).any()


def test_packing_keeps_near_copies_apart(spark, tmp_path):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words[:k], "changed", *words[k + 1 :]]) if k else " ".join(words), f"s{k}") for k in (0, 59)] + [(9, "other words", "s9"), (10, None, "s10")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.bin_group, r.bin) for r in queries.op1_best_fit_packing(spark, str(tmp_path)).collect()}
    assert len(found) == 4 and found[0] != found[59]


def test_packing_groups_of_repeated_rows_are_bounded(spark):
    rows = [(None, "same words", f"s{k % 50}") for k in range(1000)] + [(1, "same words", "s")] * 1000
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), rows_a_group=100)
    sizes = [r["count"] for r in found.groupBy("bin_group").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 200


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(docs, benchmark, block_bytes):
    items = [("null" if r.item_id is None else str(r.item_id), r.text) for r in benchmark.collect()]
    done = flag_contaminated(docs, benchmark, block_bytes=block_bytes)
    out = done.columns[-1]
    rows = done.select("text", F.col(f"{out}.*")).collect()
    expected = brute.contamination([r.text for r in rows], items)
    assert [tuple(r)[1:] for r in rows] == expected
    assert any(e[4] for e in expected) and not all(e[4] for e in expected)
    kept = flag_contaminated(docs, benchmark, block_bytes=block_bytes, drop=True)
    assert kept.columns == docs.columns and kept.count() == sum(not e[4] for e in expected)


def test_decontamination_without_items(docs, benchmark):
    done = flag_contaminated(docs, benchmark.where("false"))
    assert done.select(F.max(f"{done.columns[-1]}.n_hit")).first()[0] == 0


# ---------------------------------------------------------------- near-duplicates


@pytest.mark.parametrize("weights", ["count", "set"])
def test_near_duplicate_classes(docs, texts, weights):
    expected = brute.classes([t for _, t in texts], weights=weights)
    found = near_dedup.near_duplicate_classes(docs, weights=weights).collect()
    size = Counter()
    for group in expected:
        ids = [texts[i][0] for i in group]
        known = [i for i in ids if i is not None]
        size[min(known) if known else None, len(ids)] += len(ids)
    assert Counter((r.class_id, r.class_size) for r in found) == size
    assert any(r.class_size > 3 for r in found)
    kept = near_dedup.near_dedup(docs, weights=weights)
    assert kept.columns == docs.columns and kept.count() == len(expected)


def test_weights_decide(spark):
    one = " ".join(f"w{k}" for k in range(30))
    rows = [(1, one), (2, f"{one} {one} {one}"), (3, f"{one} {one} {one} {one[:11]}"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {w: {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(df, weights=w).collect()} for w in ("set", "count")}
    assert found == {"set": {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}, "count": {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}}


def test_shingles_of_long_texts_are_those_of_the_words():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdé漢") for _ in range(rng.randrange(1, 9))) for _ in range(600_000))
    found = Words(pa.array([text, "a b", "a b", "b a", ""]))
    doc, element = shingles(found, 5)
    assert len(text.encode()) > SLICE_BYTES and (doc == 0).sum() == 599_996
    words = text.split(" ")
    for k in (0, 1, 250_000, 599_995):
        piece = shingles(Words(pa.array([" ".join(words[k : k + 5])])), 5)[1][0]
        assert element[k] == piece
    assert element[-3] == element[-2] != element[-1]


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(999)}" for _ in range(150)]
    rows = []
    for k in range(150):
        words = base.copy()
        words[rng.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = {frozenset(g) for g in brute.classes([t for _, t in rows])}
    found = near_dedup.near_duplicate_classes(df).groupBy("class_id").agg(F.collect_set("doc_id").alias("ids")).collect()
    assert {frozenset(r.ids) for r in found} == expected


def test_pairs_of_a_large_group_are_linked_once(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(999)}" for _ in range(150)]
    rows = []
    for k in range(200):
        words = base.copy()
        for _ in range(3):  # most pairs stand just below the threshold
            words[rng.randrange(150)] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept, store = {}, near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: kept.update({name: store(df, name)}) or kept[name])
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    expected = {frozenset(g) for g in brute.classes([t for _, t in rows])}
    found = near_dedup.near_duplicate_classes(df).groupBy("class_id").agg(F.collect_set("doc_id").alias("ids")).collect()
    assert {frozenset(r.ids) for r in found} == expected
    links, sets = kept["links"], kept["sets"]
    assert links.count() == links.distinct().count() > 0
    pairs = sets.crossJoin(sets.select(F.col("shingles").alias("y"), F.col("sketch").alias("y_sketch")))
    fewer = F.size("shingles") - F.size(F.array_intersect("shingles", "y"))
    low, most = pairs.select((fewer - near_dedup._only("sketch", "y_sketch")).alias("gap")).agg(F.min("gap"), F.max("gap")).first()
    assert low >= 0 and most < 20


def test_components_of_few_edges_take_few_tasks(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60) if k % 7], "a bigint, b bigint")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components(edges)
        assert {r.node: r.label for r in found.collect()} == {k: k - (k - 1) % 7 for k in range(1, 61)}
        assert len(found.inputFiles()) == 1
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_darts_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    common, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (60, 20, 20))
    a, b = np.concatenate([common, one]), np.concatenate([common, two])
    weight = np.concatenate([np.full(60, 2.5), np.full(20, 0.5)])
    owner, cell, share = dartminhash.unit_cells(np.repeat([0, 1], 80), np.concatenate([a, b]), np.concatenate([weight, weight]))
    s = dartminhash.signatures(owner, cell, 2, 4096, share)
    assert abs((s[0] == s[1]).mean() - 150 / 170) < 0.03
    assert not dartminhash.signatures(np.empty(0, np.int64), np.empty(0, np.uint64), 1, 8).any()


# ---------------------------------------------------------------- lines and quality


def test_line_dedup(docs):
    done = line_dedup.drop_boilerplate(docs)
    out = done.columns[-1]
    rows = done.select("source", "text", F.col(f"{out}.*")).collect()
    assert [r.clean_text for r in rows] == brute.without_boilerplate([(r.source, r.text) for r in rows])
    assert any(r.n_dropped for r in rows)


def test_line_dedup_by_host(spark):
    pages = [(f"https://a.org/{k}", f"Top\nline {k}\n") for k in range(20)] + [("https://b.org/1", "Top\nother"), (None, "Top"), ("bad", None)]
    df = spark.createDataFrame(pages, "url string, text string")
    done = line_dedup.drop_boilerplate(df, host=F.try_parse_url("url", F.lit("HOST")))
    found = {r.url: r.lines.clean_text for r in done.collect()}
    assert found["https://a.org/3"] == "line 3\n" and found["https://b.org/1"] == "Top\nother" and found[None] == "Top" and found["bad"] is None


def test_quality(docs):
    done = quality.quality(docs)
    out = done.columns[-1]
    rows = done.select("text", F.col(f"{out}.*")).collect()
    for r in rows:
        assert tuple(r)[1:] == brute.quality(r.text), r.text and r.text[:200]
    assert {r.kept for r in rows} == {True, False}


def test_line_rules_by_hand(spark):
    lines = {
        "This is a proper sentence.": None, "„Das ist ein Satz.“": None, "Home | Menu | Login": "navigation", "home about contact": "navigation", "Startseite Kontakt Impressum": "navigation", "accueil contact aide": "navigation",
        "inicio buscar ayuda": "navigation", "All rights reserved.": "boilerplate", "Alle Rechte vorbehalten.": "boilerplate", "Tous droits réservés.": "boilerplate", "Todos los derechos reservados.": "boilerplate",
        "a line of words without an end": "punctuation", "buy!! now!! here.": "punctuation", "Prices rose by 5% in May, she said.": None, "What a day!": None, "The home of the people is open today.": None,
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.why for r in df.select("line", quality.line_fails(F.col("line")).alias("why")).collect()} == lines


# ---------------------------------------------------------------- personal data


PERSONAL = [
    "mail a.b+c@ex-ample.co.uk, also x@y and @z.com and a@b.c@d.e", "host 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 and 4111111111111112, 4111-1111-1111-1111-",
    "call +1 (212) 555-0187 or +49 30 1234567 or +1", "iban DE89 3704 0044 0532 0130 00 and DE00370400440532013000, bank", "ssn 123-45-6789 and 000-45-6789, social security", "é😀 a@b.cd 漢 +44 20 7946 0958", None, "", "1" * 3000, "a" * 5000 + "@" + "b." * 50 + "c",
]


def test_personal_data(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id int, text string")
    for r in pii.find_pii(df).collect():
        assert [(x.kind, x.start, x.end) for x in r.pii if x.kind in pii.BASE] == brute.personal(r.text)
    own = {r.doc_id: [r.text[x.start : x.end] for x in r.pii if x.kind not in pii.BASE] for r in pii.find_pii(df).collect()}
    assert own[4] == ["DE89 3704 0044 0532 0130 00"] and own[5] == ["123-45-6789"]
    assert pii.redact(df).where("doc_id = 0").first().text.startswith("mail <EMAIL>, also x@y")
    assert pii.find_pii(df).select(F.max(F.size("pii"))).first()[0] > 0


def test_dense_spans_of_a_long_text(spark):
    texts = ["mail a@b.co and 1.2.3.4 " * 100_000, "é漢🙂 x@y.co, " * 3000 + "tel +49 170 1234567", "host 1.2.3.4" + " " * 300_000 + "4.3.2.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    began = time.time()
    rows = {r.doc_id: r.pii for r in pii.find_pii(df).collect()}
    assert time.time() - began < 60
    for k, text in enumerate(texts):
        assert [(x.kind, x.start, x.end) for x in rows[k]] == brute.personal(text)
    assert {(x.kind, x.score) for x in rows[0]} == {("email", 1.0), ("ip", 0.6)}
    assert [round(x.score, 6) for x in rows[2]] == [0.9, 0.6]


def test_personal_data_of_the_tables(spark, sf_dir):
    rows = queries.op5_pii(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        spans = brute.personal(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in spans) for n in pii.BASE]


# ---------------------------------------------------------------- sharding


def test_sharding(docs):
    rows = sharding.assign_shards(docs, rows_a_bucket=20).collect()
    assert len(rows) == docs.count()
    sizes = Counter(r.shard for r in rows)
    assert {(r.shard, r.slot) for r in rows} == {(s, k) for s, n in sizes.items() for k in range(n)}
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and any(r.grown_shard == 8 for r in rows)
    known = {r.doc_id: (r.shard, r.grown_shard) for r in rows}
    assert all(known[r.doc_id] == (r.shard, r.grown_shard) for r in rows)
    def jumped(key: int, n: int) -> int:
        state, shard, jump = key % 2**64, -1, 0
        while jump < n:
            shard = jump
            state = (state * 2862933555777941757 + 1) % 2**64
            jump = int((shard + 1) * (2**31 / ((state >> 33) + 1)))
        return shard

    assert all((r.shard, r.grown_shard) == (jumped(r.doc_id or 0, 8), jumped(r.doc_id or 0, 9)) for r in rows)
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected


def test_shards_of_hot_keys_and_rows(spark):
    rows = [(None, f"text {k}") for k in range(300)] + [(5, "same")] * 300 + [(None, None)] * 100
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), rows_a_bucket=50).collect()
    sizes = Counter(r.shard for r in found)
    assert len(found) == 700 and {(r.shard, r.slot) for r in found} == {(s, k) for s, n in sizes.items() for k in range(n)}
    same = sorted(r.slot for r in found if r.doc_id == 5)
    assert same == list(range(same[0], same[0] + 300))


def test_jump_hash_is_balanced():
    keys = np.arange(40_000, dtype=np.uint64)
    share = np.bincount(sharding.jump_hash(keys, 8), minlength=8) / len(keys)
    moved = sharding.jump_hash(keys, 8) != sharding.jump_hash(keys, 9)
    assert abs(share - 1 / 8).max() < 0.01 and abs(moved.mean() - 1 / 9) < 0.01


# ---------------------------------------------------------------- token counts


ODD = ["a  b", " lead", "trail ", "a\n\nb", "it's we'll I'm", "x<|endoftext|>y <|endoftext|> z", "naïve café—ok", "漢字 かな", "1234567 8.9", "\t tab\u00a0nbsp", "a!b c?d e\nf", "ÀÉ'd", "Ǆword", "don't.stop", "😀 emoji", "x" * 3000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, name, tmp_path):
    path = queries.tokenizer_path(name)
    more = spark.createDataFrame([(5000 + k, t) for k, t in enumerate(ODD)], "doc_id bigint, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    expected = bag((r.doc_id, len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > 512) for r in df.collect())
    assert bag(token_counts.count_tokens(df, path).collect()) == expected


def test_cache_encodes_only_what_is_missing(spark, docs, tmp_path):
    path, cache = queries.tokenizer_path(), str(tmp_path / "cache")
    token_counts.count_tokens(docs.where("doc_id < 20"), path, cache_path=cache).collect()
    first = spark.read.parquet(cache).count()
    again = token_counts.count_tokens(docs, path, cache_path=cache).count()
    table = spark.read.parquet(cache)
    assert first < table.count() == table.select("content").distinct().count() and again == docs.count()


# ---------------------------------------------------------------- archives


def test_archives_round_trip(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("ab é漢\n\r") for _ in range(40_000))
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n0\r\n\r\n"
    pages = [(1, "u", "x"), (2, "u", "x"), (3, None, "x"), (4, "a\r\nb", long), (5, "u", long), (6, "u", ""), (7, "u", None), (8, "u", fake), (9, "u", fake * 2000), (10, "u", "y")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    last = {(p[2] or ""): p[0] for p in pages}
    found = {r.page_id: r for r in warc.archive_and_read(df, segment_bytes=4096, records_a_file=3).collect()}
    assert len(found) == len(pages)
    for page, _, html in pages:
        payload, r = (html or "").encode(), found[page]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[html or ""] == page else ("revisit", last[html or ""]))
        assert r.record_type == "revisit" or bytes(r.payload) == payload


def test_archives_of_repeated_rows_and_null_ids(spark, tmp_path):
    long, other = "abc é " * 3000, "xyz " * 4000
    pages = [(1, "u", long)] * 3 + [(1, "v", long), (0, "u", long), (0, "u", long)] + [(None, None, other)] * 2 + [(None, "w", other), (None, "u", long)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    path = str(tmp_path / "archives")
    rows = warc.archive_and_read(df, path=path, segment_bytes=4096, records_a_file=3).collect()
    sizes = {x: len(x.encode()) for x in (long, other)}
    expected = [(1, sizes[long], "response", None)] * 4 + [(0, sizes[long], "revisit", 1)] * 2 + [(None, sizes[other], "response", None)] * 3 + [(None, sizes[long], "revisit", 1)]
    assert bag((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows) == bag(expected)
    assert all(bytes(r.payload).decode() == (other if r.page_id is None else long) for r in rows if r.record_type == "response")
    heads = [f for r in spark.read.format("binaryFile").load(path).where("path LIKE '%part-%'").collect() for f, _ in warc.records(warc.unpacked(bytes(r.content)))]
    ids = {f["WARC-Record-ID"] for f in heads}
    assert len(ids) == len(heads) and {f["WARC-Refers-To"] for f in heads if f["WARC-Type"] == "revisit"} <= ids


def test_archives_come_in_any_pieces():
    made = b"".join(r for k in range(5) for r in warc.page_records(k, "u", b"abc" * 3000 * k, k, True, 4096))
    whole = list(warc.records([made]))
    assert len(whole) == 25
    for size in (1, 7, 1000, 5000):
        assert list(warc.records(made[i : i + size] for i in range(0, len(made), size))) == whole
    packed = gzip.compress(made[:9000]) + gzip.compress(made[9000:])
    assert list(warc.records(warc.unpacked(packed))) == whole
    for broken in (made[:-1], made[:50], made + b"x", made + b"\r\n\r\n"):
        with pytest.raises(ValueError, match="record"):
            list(warc.records([broken]))
    with pytest.raises(ValueError, match="gzip|record"):
        list(warc.records(warc.unpacked(packed[:-9])))


def test_archives_of_clashing_columns(spark):
    long = "é" * 30_000
    df = spark.createDataFrame([(1, "u", long, 5, "x", 7), (1, "u", long, 6, "y", 8), (None, "u", None, 5, "x", 7)], "page_id bigint, url string, html string, id int, sha string, n int").selectExpr("*", "id AS key", "id AS k", "url AS text", "url AS keeper", "id AS copy")
    rows = warc.archive_and_read(df).collect()
    assert bag((r.page_id, r.payload_bytes, r.record_type) for r in rows) == {(1, 60_000, "response"): 2, (None, 0, "response"): 1}


def test_archives_with_missing_segments_fail(spark, tmp_path):
    block = warc._HTTP + warc.chunked(b"abc" * 5000)
    made = warc.page_records(1, "u", b"abc" * 5000, 1, True, 4096)
    assert len(made) > 3 and len(block) > 12_000
    whole, broken = tmp_path / "whole", tmp_path / "broken"
    for place, parts in ((whole, made[::-1]), (broken, made[:1] + made[2:])):
        place.mkdir()
        (place / "part-0.warc").write_bytes(b"".join(parts))
    assert bytes(warc.read_archives(spark, str(whole)).first().payload) == b"abc" * 5000
    with pytest.raises(Exception, match="not whole"):
        warc.read_archives(spark, str(broken)).collect()


# ---------------------------------------------------------------- secrets


def test_secrets_on_held_out_findings(spark):
    model = secret_scan.train(spark)
    held = secret_scan.labelled_findings(600, seed=99)
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(held)], "doc_id bigint, text string")
    found = {(r.doc_id, r.start): r.secret for r in secret_scan.find_secrets(df, model).collect()}
    right = sum(found[k, start] == bool(label) for k, (_, start, _, label) in enumerate(held))
    assert right / len(held) >= 0.95


def test_secret_candidates(spark):
    model = secret_scan.train(spark, trees=5)
    text = "é api_key = \"Zx81kQpL0aRt5vBn77YwEc3D\" then nothing"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text), (4, text + "\n" + text)], "doc_id bigint, text string")
    rows = secret_scan.find_secrets(df, model).collect()
    assert Counter(r.doc_id for r in rows) == {1: 1, None: 1, 4: 2}
    assert all(text[r.start : r.end] == "Zx81kQpL0aRt5vBn77YwEc3D" and r.secret for r in rows if r.doc_id != 4)


def test_secrets_of_any_visible_characters(spark):
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    values = ["Tr0ub4dor&3", "a.b!c@d:e$f9", "qzxkvwjpqzxkvwjp", "correct horse battery", jwt, "s3cr!t$Pw9", "Zx81kQpL0aRt5vBn77YwEc3D"]
    leads = ['password = "{}"', "db_password: {}", "password={}", "passphrase: '{}'", "see {} there", "postgres://user:{}@host/db", "Server=h;Password={};User=me"]
    df = spark.createDataFrame([(k, "é text\n" + lead.format(v) + " more\nend") for k, (v, lead) in enumerate(zip(values, leads, strict=True))], "doc_id bigint, text string")
    rows = secret_scan.find_secrets(df, secret_scan.train(spark)).collect()
    texts = dict(df.collect())
    found = {(r.doc_id, texts[r.doc_id][r.start : r.end]): r.secret for r in rows}
    assert all((k, v) in found for k, v in enumerate(values))
    assert [t for d, t in found if d == 4] == [jwt] and found[0, values[0]] and found[1, values[1]] and found[5, values[5]]


def test_secrets_of_shapes_that_training_does_not_make(spark, sf_dir):
    rng = random.Random(77)
    some = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both = upper + lower + digits
    secret = lambda: rng.choice((
        f"aws_access_key_id = AKIA{some(upper + digits, 16)}", f"export GH_TOKEN=ghp_{some(both, 36)}", f"slack: xoxb-{some(digits, 12)}-{some(both, 24)}", f"stripe.api_key = sk_live_{some(both, 24)}",
        f"client_secret={some('0123456789abcdef', 8)}-{some('0123456789abcdef', 4)}-4{some('0123456789abcdef', 3)}-{some('0123456789abcdef', 12)}", f"mongodb+srv://svc:{some(both, 14)}@db.internal/app",
    ))
    harmless = lambda: rng.choice((
        f"see https://example.org/articles/{'-'.join(rng.choice(('winter', 'garden', 'people', 'history')) for _ in range(4))}", "call getElementsByClassNameFromDocument here", "password: required", f"order {some(digits, 18)} shipped",
        "the file src/main/resources/templates/message_default_view", "token = request.headers.get_value", "key: <your-key-here>",
    ))
    rows = [(k, secret() if k % 2 else harmless(), k % 2) for k in range(240)]
    words = secret_scan.dictionary(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert 100 < len(words) <= 100_000
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    found = {r.doc_id for r in secret_scan.find_secrets(df, secret_scan.train(spark, words=words), words=words).where("secret").collect()}
    caught, wrong = sum(k in found for k, _, y in rows if y), sum(k in found for k, _, y in rows if not y)
    assert caught >= 0.8 * 120 and wrong <= 0.1 * 120, (caught, wrong)


def test_secrets_in_long_texts_and_clashing_columns(spark):
    text = "plain words here. " * 60_000 + '\napi_key = "Zx81kQpL0aRt5vBn77YwEc3D"\n' + "more words. " * 1000
    df = spark.createDataFrame([(1, text, 5, "x", 0.5)], "doc_id bigint, text string, start int, id string, score double").selectExpr("*", "id AS line", "start AS secret")
    rows = secret_scan.find_secrets(df, secret_scan.train(spark, trees=5)).where("secret").collect()
    assert [(r.doc_id, text[r.start : r.end]) for r in rows] == [(1, "Zx81kQpL0aRt5vBn77YwEc3D")]


def test_coverage_by_words():
    assert secret_scan.coverage("wxyzGardenPath12", frozenset({"garden"})) == 10 / 16 and secret_scan.coverage("QzkXwv") == 0


def test_candidates_of_nested_assignments_are_few():
    assert secret_scan.candidates("key=" * 50_000 + "Tr0ub4dor&3") == [(0, 200_009), (4, 200_011), (200_000, 200_011)]
    assert secret_scan.candidates('auth_url = "https://h/?token=hunter22&x=1"') == [(12, 41), (29, 37)]


def test_training_rows_are_no_prefix(spark):
    rows = [(f"a{k:03d} value", 0, 4, 0) for k in range(300)] + [(f"z{k:03d} value", 0, 4, 1) for k in range(30)]
    df = spark.createDataFrame(rows * 2, "line string, start int, end int, secret int")
    taken = secret_scan._sample(df, 100)
    assert Counter(r[3] for r in taken) == {0: 70, 1: 30} and len(set(taken)) == 100
    assert max(r[0] for r in taken if not r[3]) > "a200"
    secret_scan.train(spark, df, trees=2, most=100)


def test_training_needs_both_classes(spark):
    with pytest.raises(ValueError, match="both"):
        secret_scan.train(spark, spark.createDataFrame([("a", 0, 1, 1)], "line string, start int, end int, secret int"))


# ---------------------------------------------------------------- tables without rows, and SQL


def test_empty_tables(spark, empty, benchmark):
    assert packing.pack(empty).count() == 0
    assert secret_scan.find_secrets(empty, secret_scan.train(spark, trees=2)).count() == 0
    assert flag_contaminated(empty, benchmark).count() == 0
    assert near_dedup.near_duplicate_classes(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0
    assert pii.find_pii(empty).count() == 0 and quality.quality(empty).count() == 0
    assert line_dedup.drop_boilerplate(empty).count() == 0
    assert sharding.assign_shards(empty).count() == 0
    assert token_counts.count_tokens(empty, queries.tokenizer_path()).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_and_read(pages).count() == 0


def test_columns_pass_through(docs):
    for done in (pii.find_pii(docs), quality.quality(docs), line_dedup.drop_boilerplate(docs)):
        assert done.columns[:-1] == docs.columns and done.count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, sf_dir, duck, same):
    same(queries.queries()[name](spark, sf_dir), duck.execute(queries.oracle_sql()[name]))
