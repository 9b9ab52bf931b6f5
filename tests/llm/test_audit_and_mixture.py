"""Mixture-controlled packing and the filter audit against plain versions."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from slotwise.llm import filter_audit, mixture_packing, queries

# ---------------------------------------------------------------- mixture packing


def whole_ids(texts: list[str | None]) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def held(rows, docs, capacity: int) -> dict[int, list]:
    """The sequences of packed rows, after all that the contract asks of them has been checked."""
    want, got = Counter(), Counter()
    by_doc: dict = defaultdict(list)
    for id_, ids in zip([d.doc_id for d in docs], whole_ids([d.text for d in docs]), strict=True):
        want[id_, tuple(ids)] += 1
        by_doc[id_].append(ids)
    whole: dict = defaultdict(list)
    sequences: dict = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        whole[r.doc_id, r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length, r.source, r.doc_id))
    for (id_, n), parts in whole.items():
        same = [x for x in by_doc[id_] if len(x) == n]
        assert sum(len(x) for _, x in parts) == n * len(same)
        if len(same) == 1:
            at = 0
            for start, ids in sorted(parts):
                assert start == at and same[0][at : at + len(ids)] == ids
                at += len(ids)
        got.update({(id_, tuple(x)): 1 for x in same} if len(same) == 1 else Counter((id_, tuple(x)) for x in same))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length, *_ in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def padding(sequences: dict[int, list], capacity: int) -> int:
    sizes = [sum(p[1] for p in parts) for parts in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes)


@pytest.mark.parametrize(("capacity", "windows", "least"), [(1024, 1024, 256), (256, 4, 16), (64, 1, 8)])
def test_mixture_packing_holds_every_id_once(docs, capacity, windows, least):
    rows = mixture_packing.pack_mixture(docs, queries.tokenizer_path(), capacity=capacity, windows=windows, least=least).collect()
    sequences = held(rows, docs.select("doc_id", "text").collect(), capacity)
    total = sum(r.length for r in rows)
    assert padding(sequences, capacity) <= total / 8 / windows + capacity / 8


def test_windows_hold_the_target_proportions(spark):
    rows = [(k, " ".join(f"w{k * j % 97}" for j in range(20 + k % 200)), f"s{0 if k % 3 else k % 4}") for k in range(600)] + [(1000 + k, None, None) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    packed = mixture_packing.pack_mixture(docs, queries.tokenizer_path(), capacity=512, windows=8, least=64).toPandas()
    share = packed.groupby("source")["length"].sum() / packed["length"].sum()
    by_window = packed.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    full = by_window[by_window.sum(axis=1) == 512]
    assert len(full) > 100
    drift = (full.cumsum() - np.outer(np.arange(1, len(full) + 1) * 512, share[full.columns])).abs().max().max()
    assert drift < 2 * 512
    one = (full[full.columns[full.mean() > 64]] / 512 - share).abs().max().max()
    assert one < 0.75


def test_targets_hold_until_a_queue_runs_dry(spark):
    rows = [(k, " ".join(["word"] * 99), "large" if k % 10 else "small") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    packed = mixture_packing.pack_mixture(docs, queries.tokenizer_path(), targets={"small": 0.5, "large": 0.5}, capacity=256, windows=4, least=32).toPandas()
    assert packed["length"].sum() == 400 * 100
    by_window = packed.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    early = by_window.iloc[:24].sum()
    assert abs(early["small"] / early.sum() - 0.5) < 0.05
    assert by_window.iloc[-10:]["small"].sum() == 0


def test_fluid_boundaries_tile_every_queue():
    fluid = mixture_packing.Fluid([10_000, 1, 777, 50_000], [0.7, 0.001, 0.1, 0.199], 997)
    for s, tokens in enumerate(fluid.tokens.tolist()):
        edges = fluid.given(np.full(fluid.partitions + 1, s), np.arange(fluid.partitions + 1))
        assert edges[0] == 0 and edges[-1] == tokens and (np.diff(edges) >= 0).all()
        places = np.arange(tokens)
        at = fluid.partition_of(np.full(tokens, s), places)
        assert (edges[at] <= places).all() and (places < edges[at + 1]).all()


def test_mixture_packing_of_nothing_and_of_many_sources(spark, empty):
    assert mixture_packing.pack_mixture(empty, queries.tokenizer_path()).count() == 0
    docs = spark.createDataFrame([(k, "a b c", f"s{k}") for k in range(300)] + [(k, "d", "hot") for k in range(300)], "doc_id bigint, text string, source string")
    rows = mixture_packing.pack_mixture(docs, queries.tokenizer_path(), queues=8, capacity=32, windows=2, least=8).collect()
    assert sum(r.length for r in rows) == 300 * 4 + 300 * 2


def test_assembled_sequences(docs):
    packed = mixture_packing.pack_mixture(docs, queries.tokenizer_path(), capacity=128, windows=16)
    made = mixture_packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in made) == 4 * packed.agg({"length": "sum"}).first()[0]
    assert all(sum(r.lengths) * 4 == len(r.ids) and len(r.sources) == len(r.lengths) for r in made)


# ---------------------------------------------------------------- filter audit


def audited(docs, labels) -> Counter:
    """All orders one by one, with every document walked through each."""
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    said = defaultdict(lambda: [False, False])
    for id_, quality, toxic in labels:
        said[id_][0] |= quality == 1
        said[id_][1] |= toxic == 1
    texts = [(i, t or "", p or "") for i, t, p in docs]
    first: dict[str, int] = {}
    for i, t, _ in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    failed = []
    for i, t, p in texts:
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        failed.append((p, {k for k, v in fails.items() if v}, *(said[i] if i is not None and i in said else (False, False))))
    out, removed_by = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for p, fails, good, toxic in failed:
            gone = False
            for k, f in enumerate(order, 1):
                row = out.setdefault((p, order, k), [0] * 6)
                if not gone and f in fails:
                    row[1] += 1
                    row[4] += good
                    row[5] += toxic
                    removed_by[p, f] += 1
                    gone = True
                elif f in fails:
                    row[2] += 1
                row[0] += not gone
                row[3] += fails == {f}
    return Counter((p, order, k, *row, removed_by[p, order[k - 1]]) for (p, order, k), row in out.items())


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 80)] + [(3, 1, 1), (None, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("hot_keys", [200_000, 3])
def test_filter_audit(docs, labels, hot_keys):
    expected = audited([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    found = filter_audit.audit(docs, labels, hot_keys=hot_keys).collect()
    assert Counter(tuple(r) for r in found) == expected
    assert len(found) == 600 * len({r.part for r in found}) and {r.part for r in found} == {"", "hot", "s1", "s2", "s0", "s3"} & {r.part for r in found}
    assert any(r.toxic_lost for r in found) and any(r.redundant for r in found)


def test_filter_audit_of_nothing(empty, labels):
    assert filter_audit.audit(empty, labels).count() == 0


def test_swaps_lead_through_all_orders():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filter_audit.transpositions(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_a_step_is_summed_again_only_where_a_swap_touches_it():
    class Counted(filter_audit.Walk):
        sums = 0

        def _sum_again(self, k):
            self.sums += 1
            super()._sum_again(k)

    walk = Counted("ABCDE", np.random.default_rng(1).integers(0, 9, (3, 2, 32)))
    orders, steps = walk.run()
    assert len(orders) == 120 and steps.shape == (120, 2, 5, 6) and walk.sums == 5 + 2 * 119
    assert (walk.shapley.sum(1) == steps[:, :, :, 1].sum((0, 2))).all()
