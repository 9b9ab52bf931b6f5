"""Line removal by site-relative frequency.

Pages are grouped by host. A line is boilerplate on a host if it occurs on at least ``min_pages`` of
its pages and on more than ``ratio`` of them; such lines are dropped from every page of the host. All
pages count, and a line counts once a page. Lines are compared without surrounding blanks, by
128-bit digest; lines without a visible character are never dropped.

A host's boilerplate lines number fewer than its mean lines a page divided by ``ratio``, whatever its
size, so they fit in one array beside the host. The array table is broadcast only if it is counted to
be small; otherwise pages meet it in a join on the host, whose hot partitions Spark splits.

Host totals are broadcast to the counted lines where there are few hosts, so that a hot host's lines are
not dealt by their host; of more hosts they meet in a join that Spark splits where it is skewed.

Defined cases: pages without a host form one host; a null text stays null and has no lines; repeated
rows count as pages of their own; texts of any length are split whole; a line on exactly ``ratio`` of the pages stays; an empty table gives
an empty result; other columns, whatever their names, are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import col, cut, digest, fresh, whole_row

RATIO, MIN_PAGES, BROADCAST_LINES = 0.1, 3, 100_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """Digest of a line without surrounding blanks; null if nothing is left."""
    bare = F.trim(F.translate(line, "\t\x0b\f\r", "    "))
    return F.when(bare != "", digest(bare))


def boilerplate(pages: DataFrame, *, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drop): the keys of each host's boilerplate lines, for hosts that have some."""
    rows = pages.select(host.alias("host"), text.alias("t"))
    totals = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("total")))
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_LINES else totals
    keys = rows.select("host", F.explode(F.array_distinct(F.transform(lines_of(F.col("t")), line_key))).alias("key")).where("key IS NOT NULL")
    counts = keys.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    over = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("n") > ratio * F.col("total")).select(counts["host"], "key")
    return over.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("drop"))


def drop_boilerplate(pages: DataFrame, *, host: Column | None = None, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with a struct column ``lines`` (n_lines, n_dropped, clean_text).

    ``host`` is an expression such as ``F.parse_url("url", F.lit("HOST"))``; without it, ``host_col``.
    """
    host = col(host_col) if host is None else host
    found = cut(boilerplate(pages, host=host, text=col(text_col), ratio=ratio, min_pages=min_pages))
    size = found.agg(F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum(F.size("drop")), F.lit(0)).alias("keys")).first()
    found = found.select(F.col("host").alias("b_host"), "drop")
    if size.hosts + size.keys <= BROADCAST_LINES:
        found = F.broadcast(found)
    out = fresh(pages, "lines")
    rows = pages.select(whole_row(pages).alias("d"), host.alias("host"), col(text_col).alias("t"))
    rows = rows.join(found, F.col("host").eqNullSafe(F.col("b_host")), "left")
    lines = lines_of(F.col("t"))
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("drop"), line_key(x)), F.lit(False))))
    rows = rows.select("d", F.size(lines).alias("n"), kept.alias("kept"), "t")
    n = F.when(F.col("t").isNull(), 0).otherwise(F.col("n")).cast("bigint")
    left = F.when(F.col("t").isNull(), 0).otherwise(F.size("kept")).cast("bigint")
    clean = F.when(F.col("t").isNotNull(), F.concat_ws("\n", "kept"))
    return rows.select("d.*", F.struct(n.alias("n_lines"), (n - left).alias("n_dropped"), clean.alias("clean_text")).alias(out))
