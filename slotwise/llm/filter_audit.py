"""Filter interaction audit: what each of several filters removes in every order of applying them.

One pass over the texts gives each document the set of filters it fails, as a mask; copies of a text that
stands under a smaller id fail the repeat filter. Masks are counted by part (the source) and label: 2 ** n cells
a part, which are all that the orders need. The orders are then visited from those cells by adjacent
transpositions (Steinhaus-Johnson-Trotter): each follows from the one before by one swap of neighbours,
which changes the two steps it touches and no other, so only these two are summed again from the cells. What a
filter removes is added up along the walk; the sum over all orders is its Shapley value times their number.

Texts stay where they are read: a digest, the id, the part and the mask travel. Digests that several rows
share are joined to the rows by ``common.looked_up``, which broadcasts the frequent ones, so that no group of copies
meets in one task; rows are counted by id, part and mask before they meet the labels, so that neither rows of
one id nor those without one do. The walk runs on one row a part, many parts at once.

Defined cases: a null text is the empty text, a null part the empty string; a row without an id has no
label, is never a repeat and has none; rows that repeat an id are counted each, and none is a repeat of the
other; of several labels of an id any that says 1 counts; texts of any length are split whole, in the memory of their
words; an empty table gives an empty result; further columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import col, digest, looked_up, stored
from slotwise.llm.quality import let, words_of

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, MARKS, REPEAT = 50, 65, 5, "#$%&*|", "E"


def _few_distinct(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words)


def _capitals(text: Column, words: Column) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]++", "")) > MAX_CAPITAL_PERCENT * F.length(text)


#: Failure conditions by letter, as functions of the text and its words.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < MIN_WORDS,
    "B": _few_distinct,
    "C": _capitals,
    "D": lambda text, words: text.rlike(f"[{MARKS}]"),
}


def transpositions(n: int) -> Iterator[int]:
    """Places k whose swaps with k + 1, one after another, lead through all orders of n things."""
    if n < 2:
        return
    inner, falling = transpositions(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if falling else range(n - 1)
        k = next(inner, None)
        if k is None:
            return
        yield k + falling
        falling = not falling


class Walk:
    """All orders of the filters over the cells of many parts. ``cells``: (3, parts, 2 ** n) counts of rows, good rows and toxic rows by mask."""

    #: kept, removed, redundant, unique_fails, good_lost, toxic_lost
    COUNTS = 6

    def __init__(self, letters: str, cells: np.ndarray) -> None:
        self.letters, self.cells, n = letters, cells, len(letters)
        self.masks = np.arange(1 << n)
        self.order, self.before = list(range(n)), [0] * n
        self.steps = np.zeros((cells.shape[1], n, self.COUNTS), np.int64)
        self.removed = np.zeros((cells.shape[1], n), np.int64)
        self.shapley = np.zeros_like(self.removed)

    def _sum_again(self, k: int) -> None:
        """Step k from the cells: what its filter does after those before it."""
        bit, gone = 1 << self.order[k], (self.masks & self.before[k]) != 0
        fails = (self.masks & bit) != 0
        here = fails & ~gone
        rows, good, toxic = self.cells
        step = self.steps[:, k]
        step[:, 0] = rows[:, ~fails & ~gone].sum(1)
        step[:, 1] = rows[:, here].sum(1)
        step[:, 2] = rows[:, fails & gone].sum(1)
        step[:, 3] = rows[:, bit]
        step[:, 4] = good[:, here].sum(1)
        step[:, 5] = toxic[:, here].sum(1)
        self.removed[:, self.order[k]] = step[:, 1]

    def run(self) -> tuple[list[list[int]], np.ndarray]:
        """The orders as they are visited, and their steps: (orders, parts, filters, counts)."""
        n, orders, out = len(self.letters), [], []
        for k in range(n):
            self.before[k] = (1 << k) - 1
            self._sum_again(k)
        swaps = transpositions(n)
        while True:
            orders.append(list(self.order))
            out.append(self.steps.copy())
            self.shapley += self.removed
            k = next(swaps, None)
            if k is None:
                return orders, np.stack(out)
            self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
            self.before[k + 1] = self.before[k] | 1 << self.order[k]
            self._sum_again(k)
            self._sum_again(k + 1)


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, order and step, from rows (part, mask, n, good, toxic)."""
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    size = 1 << len(letters)

    def walk(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                parts = batch.slice(at, 256)
                table = np.zeros((3, parts.num_rows, size), np.int64)
                for p, found in enumerate(parts.column(1).to_pylist()):
                    for c in found:
                        table[:, p, c["mask"]] += c["n"], c["good"], c["toxic"]
                walked = Walk(letters, table)
                orders, steps = walked.run()
                for p, part in enumerate(parts.column(0).to_pylist()):
                    flat = steps[:, p].reshape(-1, Walk.COUNTS)
                    shapley = walked.shapley[p][np.array(orders).ravel()]
                    text = ["".join(letters[f] for f in order) for order in orders for _ in order]
                    step = np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(repeat(part, len(text))), pa.string()), pa.array(text), pa.array(step), *[pa.array(flat[:, c]) for c in range(Walk.COUNTS)], pa.array(shapley)],
                        names=["part", "filter_order", "step", *names],
                    )

    gathered = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return gathered.mapInArrow(walk, "part string, filter_order string, step int, " + ", ".join(f"{n} bigint" for n in names))


def failure_cells(docs: DataFrame, labels: DataFrame, *, rules: dict[str, Callable[[Column, Column], Column]] = RULES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hot_keys: int | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters they fail; the repeat filter has the highest bit."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    mask = let(words_of(text), lambda words: sum((F.when(rule(text, words), 1 << k).otherwise(0) for k, rule in enumerate(rules.values())), F.lit(0)))
    rows = stored(docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), digest(text).alias("content")), "failures")
    first = rows.groupBy("content").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    met = looked_up(rows, first, "content", "n_rows", **({} if hot_keys is None else {"hot_keys": hot_keys}))
    repeats = F.when(F.col("id") > F.col("first"), 1 << len(rules)).otherwise(0)
    counted = met.groupBy("id", "part", (F.col("mask") + repeats).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("bigint")).alias("quality"), F.max((F.col("toxic") == 1).cast("bigint")).alias("toxic"))
    some = counted.where("id IS NOT NULL").join(said, "id", "left").select("part", "mask", "n", "quality", "toxic")
    none = counted.where("id IS NULL").select("part", "mask", "n", F.lit(None).cast("bigint").alias("quality"), F.lit(None).cast("bigint").alias("toxic"))
    lost = lambda label: F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0))
    return some.unionByName(none).groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("quality").alias("good"), lost("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every order and step."""
    return interactions(failure_cells(docs, labels, **options), "".join(options.get("rules", RULES)) + REPEAT)
