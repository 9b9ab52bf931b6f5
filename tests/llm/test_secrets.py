"""The secret scan's proposals against a plain scanner, without limits of length, and its verdicts on the tables' own secrets."""

from __future__ import annotations

import os
import random
import re
import time

import pytest

from slotwise.llm import secret_scan

TELLING = ("api", "auth", "bearer", "credential", "key", "pass", "private", "pwd", "secret", "token")
BLANK, QUOTES = " \t", "\"'`"


def word(c: str) -> bool:
    return c == "-" or c == "_" or c.isalnum()


def skip(text: str, at: int, of: str) -> int:
    while at < len(text) and text[at] in of:
        at += 1
    return at


def sign_after(text: str, at: int) -> int | None:
    """Where the value begins, if a sign stands at a place."""
    ends = []
    if text[at : at + 1] == ":":  # a type between the colon and the equals sign, before a quotation mark
        k = skip(text, at + 1, BLANK)
        for end in range(k + 1, len(text) + 1):
            if not (text[end - 1].isalnum() or text[end - 1] in "_.[], |"):
                break
            if text[end : end + 2] in (" =", "\t="):
                value = skip(text, end + 2, BLANK)
                if text[value : value + 1] in set(QUOTES):
                    ends.append(value)
                    break
    if not ends:
        for sign in ("=>", ":=", "===", "==", "=", ":"):
            if text.startswith(sign, at):
                ends.append(at + len(sign))
                break
    if not ends:
        return None
    at = skip(text, ends[0], BLANK)
    for scheme in ("basic", "bearer", "digest", "token"):
        if text[at : at + len(scheme)].lower() == scheme and text[at + len(scheme) : at + len(scheme) + 1] in set(BLANK):
            return skip(text, at + len(scheme), BLANK)
    return at


def quoted(text: str, at: int) -> int | None:
    """Where a quoted value ends, its mark not counted."""
    mark, k = text[at : at + 1], at + 1
    if not mark or mark not in QUOTES:
        return None
    while k < len(text) and text[k] != "\n":
        if text[k] == mark:
            return k
        if text[k] == "\\":
            if text[k + 1 : k + 2] in ("", "\n"):
                return None
            k += 1
        k += 1
    return None


def unquoted(text: str, at: int) -> int:
    """Where a value without marks ends: at a blank, a closing mark or the next assignment."""
    while at < len(text) and not text[at].isspace():
        if text[at] in ";,&":
            k = skip(text, at + 1, BLANK)
            m = k
            while m < len(text) and (word(text[m]) or text[m] == "."):
                m += 1
            if m > k and text[skip(text, m, BLANK) : skip(text, m, BLANK) + 1] in set("=:"):
                break
        if text[at] in QUOTES and (text[at + 1 : at + 2] == "" or text[at + 1].isspace() or text[at + 1] in ",;)]}>"):
            break
        at += 1
    return at


def plain_candidates(text: str) -> list[tuple[int, int]]:
    values, found, last, nested, at = set(), [], 0, False, 0
    while at < len(text):
        if not word(text[at]):
            at += 1
            continue
        end = at
        while end < len(text) and word(text[end]):
            end += 1
        run, at = text[at:end].lower(), end
        if not any(t in run for t in TELLING):
            continue
        k = end + (text[end : end + 1] in set(QUOTES))
        k += text[k : k + 1] == "]"
        value = sign_after(text, skip(text, k, BLANK))
        if value is None:
            continue
        at = value
        close = quoted(text, value)
        if close is not None:
            found.append((value + 1, close, True))
            continue
        value += text[value : value + 1] in set(QUOTES)
        if value < last:
            if nested:
                found.pop()
            nested = True
            found.append((value, last, False))
        elif (stop := unquoted(text, value)) > value:
            nested, last = False, stop
            found.append((value, stop, False))
    for start, end, marked in found:
        while not marked and end > start and text[end - 1] in ".,;":
            end -= 1
        if end - start >= secret_scan.LEAST and not text[start:end].isspace():
            values.add((start, end))
    values.update(m.span(1) for m in secret_scan.ADDRESS.finditer(text))
    dotted = [m.span() for m in secret_scan.DOTTED.finditer(text) if sum(len(p) >= 16 for p in m.group().split(".")) >= 2 and (m.group().count(".") > 1 or m.group().startswith("eyJ"))]
    runs = []
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{16,}", text):
        a, b = m.span()
        inside = any(x < b and a < y for x, y in dotted)
        named = any(y == b and x > a for x, y in values) and min(x for x, y in values if y == b) > a
        if not inside and not named and (any(c.isdigit() for c in m.group()) or m.group() not in (m.group().lower(), m.group().upper())):
            runs.append((a, b))
    return sorted({*values, *dotted, *runs})


PIECES = ["key", "Token", "api_", "db-password", " ", "  ", "\t", "\n", "=", "==", ":", ":=", "=>", "'", '"', "`", "\\", ",", ";", "&", ".", "abc", "Zx81kQ", "0123456789abcdefX", "bearer ", "str", "]", "[", "é", "x1", "= ", ": str = ", "a.b"]


def test_candidates_are_those_of_a_plain_scanner():
    rng = random.Random(5)
    some = 0
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(2, 16)))
        found = secret_scan.candidates(text)
        assert found == plain_candidates(text), repr(text)
        some += bool(found)
    assert some > 5000


def test_candidates_of_the_tables(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert secret_scan.candidates(r.text or "") == plain_candidates(r.text or "")


@pytest.mark.parametrize("n", [10, 100, 5000])
def test_nothing_is_too_long_to_be_proposed(n):
    value = "Qw3r$y9!" + "k7" * n
    for lead in (f"api_key_{'x' * n} = ", f"token{' ' * n}= {' ' * n}", f"secret: {'dict[str, ' * n}int] = \"", f"https{'+tls' * n}://{'user' * n}:"):
        close = '"' if lead.endswith('"') else "@host" if "://" in lead else ""
        text = f"words {lead}{value}{close} more"
        at = text.index(value)
        assert (at, at + len(value)) in secret_scan.candidates(text), lead[:20]


@pytest.mark.parametrize("text", ["key" * 500_000, "key: " + "a, " * 300_000, "key= " + " " * 1_000_000, "a://" * 300_000, ";a" * 500_000, "pass" + "-" * 1_000_000 + "=x1y2z3w4", 'key="' + "\\a" * 400_000, "password = " + ",b" * 400_000, "x://u:" + "@a" * 400_000, "key=" * 200_000])
def test_long_texts_are_scanned_in_linear_time(text):
    began = time.time()
    secret_scan.candidates(text)
    assert time.time() - began < 15


def test_secrets_planted_in_the_tables(spark, sf_dir):
    """Assigned tokens are caught, and nothing else in the tables' prose is called a secret."""
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.01")  # the smallest table holds none
    docs = spark.read.parquet(f"{larger if os.path.isdir(larger) else sf_dir}/documents.parquet").select("doc_id", "text")
    words = secret_scan.dictionary(docs)
    flagged = {(r.doc_id, r.start, r.end) for r in secret_scan.find_secrets(docs, secret_scan.train(spark, words=words), words=words).where("secret").collect()}
    planted = {(r.doc_id, m.start(2), m.end(2)) for r in docs.collect() for m in re.finditer(r"\b(key|secret|token|password) = \"(\w{16,})\"", r.text or "", re.I)}
    assert planted and len(planted & flagged) >= 0.98 * len(planted) and len(flagged - planted) <= 0.05 * max(20, len(flagged)), (len(planted), len(flagged), len(planted & flagged))
