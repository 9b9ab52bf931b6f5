"""The alignment of two tokenizers and the encoder of both against the libraries and a plain two-pointer walk."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slotwise.llm import alignment, queries
from slotwise.llm.encoding import BytePairs, Pieces, Vocabulary

A_PATH, B_PATH = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
ODD = ["a  b", "  x", "x ", "\n\na \t b", "a▁ b", "a ▁b", "<s> x </s>", "<|endoftext|>", "a <|endoftext|> b", "é漢字 漢字 x", "　a  b", "a'll 'll we're", "🙂 👩‍👩‍👧 ok", "\x00 a\x00", "   a", "1234 ５６ ⅷ", "don't  stop", "", " ", "<unk> <0x41>", "x" * 3000, "= " * 400]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(3)
    letters = "ab ' ▁　\n\t é漢🙂<>|1 ٣s\x1c"
    return [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(n))]


@pytest.fixture(scope="module")
def files():
    return open(A_PATH, "rb").read(), open(B_PATH, "rb").read()


def per_text(found, which: int) -> list[list[int]]:
    n, ids = found[which]
    edges = np.concatenate([[0], np.cumsum(n)])
    return [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)]


def test_words_together_have_the_ids_of_the_library(files, docs):
    some = [*odd_texts(1500), *(r.text or "" for r in docs.limit(120).collect())]
    tokenizer, pieces = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    alone = per_text(Vocabulary([BytePairs(files[0])], spell=False).encode(some, spaced=False), 0)
    assert alone == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert BytePairs(files[0]).whole(some) == alone
    both = Vocabulary([BytePairs(files[0], plain=True), Pieces(files[1])], spell=True)
    found = both.encode(some, spaced=True)
    tokenizer.encode_special_tokens = True
    of = both.tokenizers[1].bytes_of
    for text, a, b in zip(some, per_text(found, 0), per_text(found, 1), strict=True):
        if text:
            assert a == tokenizer.encode(" " + text, add_special_tokens=False).ids
            ids = pieces.encode(text)
            spelled = b"".join(of[i] for i in ids) == (" " + text).encode()
            assert spelled == (-1 not in b) and (not spelled or b == ids)
    assert both.tokenizers[0].splits and both.tokenizers[1].splits


def test_vocabulary_that_is_full_begins_again(files, monkeypatch):
    monkeypatch.setattr("slotwise.llm.encoding.MEMO", 5)
    words = Vocabulary([BytePairs(files[0])], spell=False)
    tokenizer = Tokenizer.from_file(A_PATH)
    for k in range(5):
        texts = [f"some {k} words {k + 1} of text", "again and again", f"{k}"]
        assert per_text(words.encode(texts, spaced=False), 0) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(words.later) < 20


def plain(rows: list[tuple], files) -> tuple[Counter, dict]:
    """Digest rows and the links of every document, by two pointers."""
    tokenizer, pieces = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    tokenizer.encode_special_tokens = True
    a_bytes, b_bytes = BytePairs(files[0], plain=True).bytes_of, Pieces(files[1]).bytes_of
    found, counts = [], Counter()
    for id_, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            found.append((id_, 0, 0, 0, [], ""))
            continue
        a_ends, b_ends = (np.cumsum([len(of[i]) for i in ids]).tolist() for of, ids in ((a_bytes, a), (b_bytes, b)))
        links, groups, i, j, first = [], [], 0, 0, (0, 0)
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = a_ends[i], b_ends[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
                first = i, j
        counts.update(set(links))
        found.append((id_, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best: dict[int, int] = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return Counter((i, na, nb, g, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), sha) for i, na, nb, g, ls, sha in found), counts


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 40])
def test_alignment(spark, docs, files, hot_pairs, tmp_path):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + list(enumerate(odd_texts(60), 5000))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    found = alignment.align(spark.read.parquet(str(tmp_path / "d")), A_PATH, B_PATH, hot_pairs=hot_pairs).collect()
    expected, _ = plain(rows, files)
    assert Counter(tuple(r) for r in found) == expected
    assert sum(r.n_a == 0 for r in found) > 5 and max(r.n_a for r in found) > 30_000


def test_groups_as_arrays_and_empty_tables(spark, empty):
    docs = spark.createDataFrame([(1, "some ordinary words 12345"), (2, "a▁b"), (3, None)], "doc_id bigint, text string")
    found = alignment.aligned(alignment.tokenised(docs, A_PATH, B_PATH)).select("id", "a_ids", "b_ids", "n_groups", "n_links", alignment.group_ids().alias("groups"), alignment.links(lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("links"))
    by = {r.id: r for r in found.collect()}
    assert [i for g in by[1].groups for i in g.a] == by[1].a_ids and [i for g in by[1].groups for i in g.b] == by[1].b_ids
    assert len(by[1].groups) == by[1].n_groups and len([x for x in by[1].links if x]) == by[1].n_links == len(by[1].a_ids) + len(by[1].b_ids) - by[1].n_groups
    assert by[2].groups == [] == by[3].groups and by[2].n_links == 0
    assert alignment.align(empty, A_PATH, B_PATH).count() == 0


def test_words_of_slices_give_the_rows_of_whole_texts(spark, files):
    rows = [(k, t) for k, t in enumerate([*odd_texts(40), "over and over again", "again and over", None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    expected, _ = plain(rows, files)
    for size in (1, 200, alignment.WORDS_BYTES):
        assert Counter(tuple(r) for r in alignment.align(docs, A_PATH, B_PATH, slice_bytes=size).collect()) == expected


def test_a_word_is_aligned_once_a_slice(spark):
    docs = spark.createDataFrame([(k, "over and over again, over 12345") for k in range(50)], "doc_id bigint, text string").coalesce(1)
    found = alignment.words_aligned(alignment.sliced(docs, A_PATH, B_PATH)).collect()
    assert [len(r.w_texts) for r in found] == [len(r.w_pairs) for r in found] == [4] and len(found[0].docs) == 50


def test_arrays_of_slices_hold_no_null(spark, empty):
    """So that sort_array sorts plain longs and no objects."""
    slices = alignment.sliced(empty, A_PATH, B_PATH)
    assert not any(slices.schema[c].dataType.containsNull for c in alignment.SLICE)
    docs = spark.createDataFrame([(1, "[ some ] words, 0 [0"), (2, ""), (3, None)], "doc_id bigint, text string")
    assert [len(r.w_texts) for r in alignment.words_aligned(alignment.sliced(docs.coalesce(1), A_PATH, B_PATH)).collect()] == [6]


def test_frequent_words_are_aligned_once_for_all_slices(spark, files):
    rows = [*((k, f"over and over again, over {k}") for k in range(40)), *((k, t) for k, t in enumerate(odd_texts(20), 100))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    often = alignment.often_met(docs)
    assert {"over", "and", "again,"} <= set(often) and not any(w.split() != [w] for w in often)
    slices = alignment.sliced(docs.where("doc_id < 40"), A_PATH, B_PATH, slice_bytes=200, often=often, known=len(often)).collect()
    assert len(slices) > 3 and sum(len(r.w_tokens) for r in slices) == sum(str(k) not in often for k in range(40))
    expected, _ = plain(rows, files)
    for few in (1, alignment.OFTEN_ROWS):
        assert Counter(tuple(r) for r in alignment.align(docs, A_PATH, B_PATH, slice_bytes=200, often_rows=few).collect()) == expected


def test_frequent_words_that_are_not_spelled_are_left_to_the_slices(spark, files, monkeypatch):
    monkeypatch.setattr(alignment, "often_met", lambda *_, **__: ["x", "a▁b"])
    rows = [(1, "x y"), (2, "x a▁b"), (3, "x")]
    found = alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string"), A_PATH, B_PATH).collect()
    assert Counter(tuple(r) for r in found) == plain(rows, files)[0]


def test_documents_of_a_slice_take_their_words_in_parts(spark, files, monkeypatch):
    monkeypatch.setattr(alignment, "PART_WORDS", 3)
    rows = [(k, t) for k, t in enumerate([*odd_texts(30), "one two three four five", "", None, "six"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert max(len(r.parts) for r in alignment.sliced(docs, A_PATH, B_PATH).collect()) > 3
    assert Counter(tuple(r) for r in alignment.align(docs, A_PATH, B_PATH).collect()) == plain(rows, files)[0]
