"""Personal data in texts: patterns propose spans, checksums confirm them, context adjusts a score.

DataFrame functions only. For each kind a regular expression proposes leftmost non-overlapping
matches. Their places follow from the gaps between them: splitting by the pattern gives the gaps, and
gap and match lengths add up to starts, in running sums over blocks. Surroundings are looked up in pieces of 64
characters, so that the work is nearly linear in a text and its spans, however dense they are. Validators then drop matches, without retries: parts of an
address up to 255, the Luhn checksum of card numbers, digit counts of phone numbers, the mod-97
checksum of account numbers. The base kinds (email, ip, card, phone) stay whatever their score; the
method's own kinds (iban, ssn) need a score of 0.5, which a checksum or a context word gives.

The patterns are written so that a regular-expression engine scans in linear time: possessive
quantifiers, and a look-behind that starts matches only at the beginning of a run (or at the end of
the match before).

Defined cases: a null text counts as empty; spans of different kinds may overlap; equal starts are
ordered by kind; repeated rows are judged each on its own; texts of any length are searched whole, in the memory of
their matches, gaps and pieces; an empty table gives an empty result; other columns, whatever their names, are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import col, fresh, whole_row
from slotwise.llm.quality import let

# Kinds in their order, patterns, and the words that raise a score nearby.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+", "iban": "", "ssn": "-"}
BYTE_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|fax|mobile|cell",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security|insurance",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.3}
CONFIRMED = {"card": 0.4, "iban": 0.4}
NEARBY, CONTEXT_GAIN, LEAST = 40, 0.3, 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(digits)
    values = F.transform(_characters(digits), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 1, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    return F.pmod(F.aggregate(values, F.lit(0), lambda a, v: a + v), F.lit(10)) == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks leaves 1 by the mod-97 rule, letters counting 10 to 35."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    values = F.transform(_characters(turned), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: F.pmod(F.when(v < 10, a * 10 + v).otherwise(a * 100 + v), F.lit(97))) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE_PART}\.{BYTE_PART}\.{BYTE_PART}\.{BYTE_PART}$")
    if kind == "card":
        n = F.length(_digits(match))
        return F.when((n >= 14) & (n <= 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(F.translate(match, " ", ""))
    return F.lit(True)


def _span_type(score: bool) -> str:
    return "array<struct<start:bigint,rank:int,end:bigint,kind:string" + (",score:double>>" if score else ">>")


def _sums(lengths: Column) -> Column:
    """Running sums of an array, each with its own element, in blocks of the root of its size, so that no long array is copied for every element."""
    empty = F.expr("cast(array() as array<bigint>)")

    def within(block: Column, start: Column) -> Column:
        fold = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"] + x)).alias("all"))
        return F.aggregate(block, F.struct(start.cast("bigint").alias("at"), empty.alias("all")), fold, lambda a: a["all"])

    def blocks(values: Column) -> Column:
        n = F.size(values)
        most = F.greatest(F.lit(64), F.ceil(F.sqrt(n)).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.ceil(n / most).cast("int") - 1), lambda k: F.transform(F.sequence(k * most, F.least(n, (k + 1) * most) - 1), lambda i: F.get(values, i)))
        sums = lambda parts: within(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))
        return let(cut, lambda parts: let(sums(parts), lambda ends: F.flatten(F.transform(parts, lambda p, k: within(p, F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, k - 1)))))))

    return let(lengths, lambda values: F.when(F.size(values) == 0, empty).otherwise(blocks(values)))


#: Characters of the pieces in which the surroundings of spans are looked up.
_PIECE = 64


def _surroundings(pieces: Column, start: Column, n: int) -> Column:
    """The ``n`` characters from a place on, at most a piece; ``pieces`` are the text's, of 64 characters each."""
    at = F.floor(start / _PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, at), F.lit("")), F.coalesce(F.get(pieces, at + 1), F.lit("")))
    return two.substr((start - at * _PIECE + 1).cast("int"), F.lit(n) if isinstance(n, int) else n.cast("int"))


def spans_of(kind: str, text: Column) -> Column:
    """Array of (start, rank, end, kind, score) of a kind's confirmed spans; code points, end exclusive."""
    none = F.expr(f"cast(array() as {_span_type(True)})")

    def placed(found: Column) -> Column:
        """(start, end, match) of the confirmed matches."""
        ahead = F.transform(found["gaps"], lambda g, i: (F.length(g) + F.coalesce(F.length(F.get(found["matches"], i - 1)), F.lit(0))).cast("bigint"))
        spans = lambda starts: F.transform(found["matches"], lambda m, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(m)).alias("end"), m.alias("match")))
        return F.filter(let(_sums(ahead), spans), lambda x: F.coalesce(_valid(kind, x["match"]), F.lit(False)))

    def scored(spans: Column) -> Column:
        def score(pieces: Column, x: Column) -> Column:
            first = F.greatest(x["start"] - NEARBY, F.lit(0))
            before, after = F.lower(_surroundings(pieces, first, x["start"] - first)), F.lower(_surroundings(pieces, x["end"], NEARBY))
            near = before.rlike(rf"\b(?:{CONTEXT[kind]})") | after.rlike(rf"\b(?:{CONTEXT[kind]})")
            return F.least(F.lit(1.0), F.lit(PRIOR[kind] + CONFIRMED.get(kind, 0.0)) + F.when(near, CONTEXT_GAIN).otherwise(0.0))

        def made(pieces: Column) -> Column:
            return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), score(pieces, x).alias("score"))).cast(_span_type(True))

        pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))
        return F.when(F.size(spans) == 0, none).otherwise(let(pieces, made))

    pattern = PATTERNS[kind]
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    found = F.when(text.contains(HINTS[kind]) & text.rlike(pattern), let(let(both, placed), scored)).otherwise(none)
    return found if kind in BASE else F.filter(found, lambda x: x["score"] >= LEAST)


def written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def find_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``pii``: all spans, ordered by start and kind."""
    out = fresh(docs, "pii")
    rows = docs.select(whole_row(docs).alias("d"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("t"))
    some = rows.select("d", "t", F.col("t").rlike("[0-9@]").alias("some"))
    none = F.expr(f"cast(array() as {_span_type(True)})")
    every = F.sort_array(F.concat(*[spans_of(k, F.col("t")) for k in KINDS]))
    return some.select("d.*", F.when(F.col("some"), every).otherwise(none).alias(out))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of the text replaced by <KIND>; of overlapping spans the first counts."""
    found = find_pii(docs, text_col=text_col)
    spans, text = F.col(f"`{found.columns[-1]}`"), col(text_col)
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(
            F.struct(
                F.concat(a["out"], text.substr((a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"),
                x["end"].alias("at"),
            )
        ),
        lambda a: F.concat(a["out"], text.substr((a["at"] + 1).cast("int"), F.length(text))),
    )
    return found.withColumn(text_col, F.when(text.isNotNull(), done)).drop(found.columns[-1])
