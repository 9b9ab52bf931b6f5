"""The page scanner against the standard library's parser, and on pages that leave things open."""

from __future__ import annotations

import html as entities
import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from slotwise.sources import pages


class Plain(HTMLParser):
    """What a page shows, by the standard library."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.shown: list[str] = []
        self.heads: list[list[str]] = []
        self.hidden: dict[str, str] = {}
        self.silent = self.inside = False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        have = dict(attrs)
        self.silent |= tag in ("script", "style")
        if tag == "h4":
            self.inside = "wait-time-menu" in (have.get("class") or "").split()
            if self.inside:
                self.heads.append([])
        if tag == "input" and (have.get("type") or "").lower() == "hidden" and have.get("name"):
            self.hidden[have["name"]] = have.get("value") or ""

    def handle_endtag(self, tag):
        self.silent &= tag not in ("script", "style")
        self.inside &= tag != "h4"

    def handle_data(self, data):
        if not self.silent:
            self.shown.append(data)
            if self.inside:
                self.heads[-1].append(data)


def one(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def test_pages_as_the_standard_library_reads_them(spark):
    html = [
        "<p>a &amp; b</p><h4 class='x wait-time-menu'>North <b>5</b></h4><input type=hidden name=k value=v>",
        "<h4 class=wait-time-menu>one</h4> x <H4 id=3 CLASS=\"a wait-time-menu\">two &lt;3</H4><h4 class=none>three</h4>",
        "<a title='x > y' href=\"a>b\">link</a><a title=it's>isn't</a> 1 < 2 <br/>end<!-- gone <b> --><style>b > i</style>",
        "<script>if (a < b) document.write('</p>')</script>left<input name=a type=HIDDEN value=1><input name=a type=hidden value='2 3'><input type=text name=b value=4><input type=hidden value=5>",
        "caf&eacute;&nbsp;au&#160;lait　<i>x</i>y\x1cz", "", "plain", "<!DOCTYPE html><?php x ?><p data-x=1 data-x=2 name = \"a b\"/>t",
    ]
    rows = spark.createDataFrame(list(enumerate(html)), "k int, h string").select("k", pages.page_parts(F.col("h")).alias("p")).orderBy("k").collect()
    for text, row in zip(html, rows, strict=True):
        plain = Plain(text)
        assert (row.p.text, row.p.headings, row.p.hidden) == (one(plain.shown), [one(h) for h in plain.heads], plain.hidden)


def test_attributes(spark):
    tag = "<input type=hidden disabled NAME='a b' value=\"x=y > z\" value=3 data-name=q title= 'class=no' last=\"open"
    found = spark.createDataFrame([(tag,)], "t string").select(pages.attributes(F.col("t")).alias("a"), pages.attribute(F.col("t"), "name").alias("n"), pages.attribute(F.col("t"), "value").alias("v"), pages.attribute(F.col("t"), "class").alias("c")).first()
    assert [tuple(x) for x in found.a] == [("type", "hidden"), ("disabled", None), ("name", "a b"), ("value", "x=y > z"), ("value", "3"), ("data-name", "q"), ("title", "class=no"), ("last", "open")]
    assert (found.n, found.v, found.c) == ("a b", "3", None)


@pytest.mark.parametrize(
    ("name", "make"),
    [
        ("a tag without an end", lambda n: "<p>if a <b and then " + "word " * (n // 5)),
        ("many tags without an end", lambda n: "<b <i <a href=" * (n // 14)),
        ("a quotation mark without an end", lambda n: '<a href="' + "x" * n),
        ("many quotation marks without an end", lambda n: "<a b='" * (n // 6)),
        ("a long attribute", lambda n: "<p title=" + "y" * n + ">text</p>"),
        ("a long quoted attribute", lambda n: "<p title='" + "<>" * (n // 2) + "'>text</p>"),
        ("many comments without an end", lambda n: "<!-- <!-" * (n // 8)),
        ("many scripts without an end", lambda n: "<script <style x=" * (n // 17)),
        ("many headings without an end", lambda n: "<h4 class=wait-time-menu>" * (n // 25)),
        ("many short tags", lambda n: "<b>x</b> " * (n // 9)),
        ("a million blanks", lambda n: "<p " + " " * n + "= " + " " * n),
    ],
)
def test_whatever_is_left_open_is_read_in_linear_time(spark, name, make):
    html = make(2_000_000)
    began = time.time()
    row = spark.createDataFrame([(html,)], "h string").select(pages.page_parts(F.col("h")).alias("p")).first()
    assert row.p is not None and time.time() - began < 20, name


def test_a_page_of_ten_million_characters(spark):
    html = "<p>" + "<b class='x'>word</b> and " * 400_000 + "<input type=hidden name=k value=v>"
    row = spark.createDataFrame([(html,)], "h string").select(pages.page_parts(F.col("h")).alias("p")).first()
    assert row.p.hidden == {"k": "v"} and row.p.text.count("word") == 400_000


def test_an_open_tag_hides_the_rest(spark):
    row = spark.createDataFrame([("<p>shown</p> a <b and more",)], "h string").select(pages.page_parts(F.col("h")).alias("p")).first()
    assert row.p.text == "shown a"


def test_pages_of_the_tables(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", pages.page_parts(F.col("html")).alias("p")).collect()
    assert len(rows) > 20
    for r in rows:
        plain = Plain(r.html)
        assert re.sub(r"\s+", " ", r.p.text) == one(plain.shown) and r.p.hidden == plain.hidden


def test_references_are_those_of_the_library_and_travel_alone(spark, monkeypatch):
    rng = random.Random(5)
    parts = ["&", "&amp", "&amp;", "&lt;b", "&notit;", "&notin;", "&#0;", "&#x1F642;", "&#128;", "&#xD800;", "&#99999999;", "&#x;", "&#;", ";", "#", " ", "a", "é", "🙂", "&🙂;", "&CounterClockwiseContourIntegral;", "&eacute", "x" * 40, "\n", "<"]
    texts = [None, "", "&", "&amp;", "&&amp;amp;", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", pages.unescaped(F.col("t")).alias("u")).collect()
    for r in rows:
        assert r.u == (None if texts[r.k] is None else entities.unescape(texts[r.k])), texts[r.k]
    monkeypatch.setattr(pages, "meant", lambda found: F.transform(found, lambda r: F.concat(F.lit("["), r, F.lit("]"))))
    row = spark.createDataFrame([("long text &amp; more &lt",)], "t string").select(pages.unescaped(F.col("t")).alias("u")).first()
    assert row.u == "long text [&amp;] more [&lt]"
