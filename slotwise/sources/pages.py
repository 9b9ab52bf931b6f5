"""A linear scanner of HTML pages, in column expressions.

A page is a sequence of comments, silent elements (scripts and styles with what they hold), tags and text. Each pattern
below takes whole pieces of these without going back: quantifiers are possessive, so that nothing is kept for another try
and no call is nested, and whatever a page leaves open (a tag, a quotation mark, a comment, a script) ends with the
page, so that a piece that has begun always ends. So every character is looked at a bounded number of times, however
long a page, a tag or an attribute is, and however many are left open.
"""

from __future__ import annotations

import html as entities

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rest of a tag behind its name: quotation marks count after an equals sign only, where a value is expected.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+)*+(?:>|\z)"""
_SILENT = rf"(?is)<!--.*?(?:--!?>|\z)|<(script|style)(?=[\s/>]){_REST}.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)"
_TAG = rf"(?s)<(?:/?[A-Za-z]{_REST}|[!?/][^>]*+(?:>|\z))"
_NAME_AND_VALUE = r"""(?s)([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\z)|'([^']*+)(?:'|\z)|([^\s>]*+)))?+"""
_MARK = "\x01"
#: Every kind of blank.
_BLANKS = r"[\s \u0085  -     　\x1c-\x1f]++"


#: What the standard library takes for a character reference.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(T.ArrayType(T.StringType()))
def meant(references: pd.Series) -> pd.Series:
    """Character references as characters; the one step that has no built-in function."""
    return pd.Series([None if some is None else [entities.unescape(r) for r in some] for some in references], dtype=object)


def unescaped(text: Column) -> Column:
    """The text with characters in place of references. Only these go to Python; the text between them stays."""
    between = F.split(text, _REFERENCE)
    found = meant(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)))
    return F.array_join(F.flatten(F.zip_with(between, found, lambda x, r: F.array(x, F.coalesce(r, F.lit(""))))), "")


def collapsed(text: Column) -> Column:
    """Runs of blanks, of any kind, as one; none at the ends."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def heard(html: Column) -> Column:
    """The page with a blank in place of comments, scripts and styles."""
    return F.regexp_replace(html, _SILENT, " ")


def untagged(html: Column) -> Column:
    """The page with a blank in place of every tag: text on two sides of a tag is two texts."""
    return F.regexp_replace(html, _TAG, " ")


def attributes(tag: Column) -> Column:
    """Names, in lower case, and values of a tag's attributes, in order; a name without a value has null."""
    inside = F.regexp_replace(tag, r"(?s)^<[^\s/>]*+", "")
    part = lambda k: F.regexp_extract_all(inside, F.lit(_NAME_AND_VALUE), F.lit(k))
    pairs = F.arrays_zip(part(0).alias("whole"), part(1).alias("name"), part(2).alias("a"), part(3).alias("b"), part(4).alias("c"))
    value = lambda x: F.when(F.contains(x["whole"], F.lit("=")), F.concat(x["a"], x["b"], x["c"]))
    return F.transform(pairs, lambda x: F.struct(F.lower(x["name"]).alias("name"), value(x).alias("value")))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's last attribute of a name; null if it has none."""
    found = F.filter(attributes(tag), lambda x: x["name"] == name)
    return F.get(F.transform(found, lambda x: F.coalesce(x["value"], F.lit(""))), F.size(found) - 1)


def tags(html: Column, name: str) -> Column:
    """All start tags of a name."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/>]|\z){_REST}"), F.lit(0))


def elements(html: Column, name: str) -> Column:
    """All elements of a name that hold none of their own, each as struct(tag, content)."""
    whole = rf"(?is)(<{name}(?=[\s/>]|\z){_REST})(.*?)(?:(?=</{name}[\s/>])|\z)"
    part = lambda k: F.regexp_extract_all(html, F.lit(whole), F.lit(k))
    return F.arrays_zip(part(1).alias("tag"), part(2).alias("content"))


def page_parts(html: Column, heading: str = "wait-time-menu") -> Column:
    """struct(text, headings, hidden) of an HTML page; null for null.

    ``text`` is what is visible, ``headings`` the texts of the h4 elements of a class, ``hidden`` the hidden inputs (of
    a repeated name the last). What stands in scripts, styles and comments is left out, and so is a tag that the page
    leaves open, to its end.
    """
    bare = heard(html)
    of_class = lambda tag: F.array_contains(F.split(F.coalesce(attribute(tag, "class"), F.lit("")), _BLANKS), heading)
    h4 = F.filter(elements(bare, "h4"), lambda x: of_class(x["tag"]))
    joined = unescaped(F.array_join(F.transform(h4, lambda x: untagged(x["content"])), _MARK))
    headings = F.when(F.size(h4) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.split(joined, _MARK), collapsed))
    inputs = F.filter(tags(bare, "input"), lambda x: F.coalesce((F.lower(attribute(x, "type")) == "hidden") & (attribute(x, "name") != ""), F.lit(False)))
    pairs = F.transform(inputs, lambda x, i: F.struct(attribute(x, "name").alias("name"), i.alias("i"), F.coalesce(attribute(x, "value"), F.lit("")).alias("value")))
    ordered = F.sort_array(pairs)
    last = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1)["name"] != x["name"], F.lit(True)))
    hidden = F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"], x["value"])))
    return F.when(html.isNotNull(), F.struct(collapsed(unescaped(untagged(bare))).alias("text"), headings.alias("headings"), hidden.alias("hidden")))
