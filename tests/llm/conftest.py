"""A small corpus with the cases that every operator must bear."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string, lines string, contamination string, pii string, d int, t int, node string, key string, id int, label string, hits_so_far int, words string, k_node int"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    out = []
    for k in range(n):
        out.append(f"w{rng.randrange(vocabulary)}")
        if k % 12 == 11:
            out[-1] += rng.choice([".\n", ". ", ".\n"])
    return " ".join(out).replace("\n ", "\n") + "."


def corpus() -> list[tuple]:
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(20, 200)) for _ in range(60)]
    texts = [*base]
    for text in base[:15]:  # near copies: one word in a long text changed, or a tail cut off
        words = text.split(" ")
        words[len(words) // 2] = "changed"
        texts += [" ".join(words), " ".join(words[: len(words) - 2])]
    texts += base[:5] * 3
    texts += [t.upper() for t in base[5:8]]
    texts += ["", "   ", "\n\n", "one", "two words", "!!! ???", "é ü ß 漢字 漢字", "home | menu | login", "a\u00a0b c", "x" * 5000]
    texts += [" ".join(["same"] * 50), "Home\nMenu\nLogin\n" + base[0], "Share this page.\n" + base[1], "Share this page.\n" + base[2], prose(rng, 30_000)]
    rows = [(k, t, "en", f"s{k % 4}" if k % 3 else "hot", len(t)) for k, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, None, "en", "hot", None), (None, base[3], "en", None, 5), (None, "loose text of a row without an id, long enough to be kept by rules.", None, "hot", 5), (3, base[3], "en", "hot", 7), (3, base[3], "en", "hot", 7)]
    return [(*r, "q", "l", "c", "p", 1, 2, "n", "k", 3, "lab", 4, "w", 5) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def benchmark(spark, docs):
    rng = random.Random(12)
    long = next(r.text for r in docs.where("doc_id = 20").collect())
    rows = [(1, " ".join(long.split()[3:40])), (2, long[:20]), (3, None), (4, ""), (5, prose(rng, 40)), (None, "two words"), (5, "one"), (7, "漢字 漢字"), (8, long.upper())]
    return spark.createDataFrame(rows, "item_id bigint, text string")
