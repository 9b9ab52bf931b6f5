"""Secret scanning: patterns propose candidates, a random forest removes false positives.

Candidates stand within one line and are of four kinds. Runs of 16 characters or more of the alphabets
of keys (letters, digits, + / = _ -); a run needs a digit, or both cases. Tokens of parts joined by dots,
as one candidate. Values of 6 characters or more, of any visible characters, that are assigned to a telling
name, however long the name, the blanks around the sign or the value are; quoted ones may hold spaces, others end at a space or at the next assignment. Passwords of addresses
(scheme://user:password@host) of 6 characters or more. Equal spans are one candidate, a run of name and value is given as
the value, and a run within a longer value is a candidate beside it. Of assignments nested in an unquoted
value the outermost and the innermost are given. The forest sees, for each: its length, the share
of character transitions (neighbouring characters of different classes, and pairs that are rare in
words), entropy, the share covered by words of a dictionary (``dictionary``: the words that are common in the
corpus itself) or by common word parts, other symbols, forms of code, whether it stands in a path or address or as its password, and
the neighbouring words (assignment to a telling name, quotes, placeholder words). It is trained here,
with Spark ML, from labelled findings: rows (line, start, end, secret). Without a table of them,
``labelled_findings`` makes a documented, bounded number of them from fixed rules and a fixed seed. Of a
larger table distinct rows are taken in the order of a hash, half of them from each class as far as it goes.

Candidates are found and described in one pass over the texts; only candidates travel.

Defined cases: a null text has no candidates; a run over 4,096 characters is one candidate like any
other; texts of any length are scanned whole; further columns, whatever their names, are left out; equal candidates are scored each; repeated rows are judged each on its own; an empty table gives an empty result; without labelled findings of both classes training fails
with an error.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import col, stored
from slotwise.llm.words import slices

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")
#: A telling name, as part of a word or alone, and what stands between it and its value. A word is looked at once, from its beginning.
ASSIGNMENT = re.compile(
    r"""(?<![\w-])(?=[\w-]*?(?:api|auth|bearer|credential|key|pass|private|pwd|secret|token))[\w-]++["'`]?\]?[ \t]*+"""
    r"""(?::[ \t]*+[\w.\[\], |]+?[ \t]=[ \t]*+(?=["'`])|=>|:=|={1,3}|:)[ \t]*+(?:(?:basic|bearer|digest|token)[ \t]++)?+""",
    re.I,
)
QUOTED = re.compile(r"""(["'`])((?:(?!\1)[^\\\n]|\\[^\n])*+)\1""")
PLAIN = re.compile(r"""(?:(?![;,&][ \t]*+[\w.-]++[ \t]*+[=:])(?!["'`](?:[\s,;)\]}>]|$))\S)++""", re.M)
ADDRESS = re.compile(r"""(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]++://[^\s:/@"'`]*+:([^\s/"'`]{6,})@""", re.I)
LEAST = 6
FINDINGS, SEED, TREES, DEPTH, THRESHOLD, NEARBY = 2000, 7, 30, 8, 0.5, 48

# Names that go with secrets, words that mark placeholders, and common word parts.
NAMES = ("api", "apikey", "auth", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token")
PLACEHOLDERS = ("changeme", "dummy", "example", "foo", "placeholder", "redacted", "sample", "test", "xxxx", "your")
WORD_PARTS = (
    "able", "account", "action", "after", "agent", "and", "are", "article", "back", "base", "block", "build", "class", "client", "code", "com", "config", "content",
    "count", "data", "default", "description", "design", "detail", "document", "edit", "element", "error", "event", "example", "file", "first", "form", "from", "function",
    "group", "handler", "have", "head", "home", "html", "image", "index", "info", "ing", "input", "item", "key", "language", "last", "level", "library", "light", "line", "link",
    "list", "local", "main", "management", "ment", "message", "method", "model", "module", "name", "network", "next", "node", "number", "object", "option", "order", "page",
    "parse", "part", "path", "point", "process", "product", "project", "query", "read", "request", "resource", "response", "result", "return", "schema", "script", "search",
    "select", "server", "service", "session", "setting", "short", "simple", "size", "source", "start", "state", "static", "status", "string", "style", "system", "table",
    "target", "text", "that", "the", "this", "time", "tion", "title", "type", "update", "url", "user", "value", "version", "view", "web", "width", "window", "with", "word", "work",
)
_CODE = re.compile(r"[A-Za-z_]\w*\(|\$\{|\{\{|^[$%]|^<.*>$|^[A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)+$|^[A-Za-z_]\w*\[")
_PARTS = re.compile("|".join(sorted(WORD_PARTS, key=len, reverse=True)))
FEATURES = ("length", "transitions", "digit_runs", "entropy", "hex", "dictionary", "vowels", "path", "named", "quoted", "placeholder", "near_words", "symbols", "code", "credential")


_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A word is in the dictionary if it makes up this share of all words, so that there are at most 100,000.
SHARE, SHORTEST = 1e-5, 4


def dictionary(docs: DataFrame, *, text_col: str = "text", share: float = SHARE) -> frozenset[str]:
    """The words of a-z that make up at least ``share`` of the words of all texts, which bounds their number by its inverse."""
    words = docs.select(F.explode(F.split(F.lower(col(text_col).cast("string")), "[^a-z]+")).alias("w")).where(F.length("w").between(SHORTEST, 24))
    counts = stored(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.w for r in counts.where(F.col("n") >= share * total).select("w").collect()) if total else frozenset()


def coverage(text: str, words: frozenset[str] = frozenset()) -> float:
    """The share of a text's characters in words: of the dictionary, as pieces between changes of case, or common word parts."""
    covered = 0
    for m in _PIECE.finditer(text):
        piece = m.group().lower()
        covered += len(piece) if piece in words else sum(p.end() - p.start() for p in _PARTS.finditer(piece))
    return covered / len(text)


def describe(line: str, start: int, end: int, words: frozenset[str] = frozenset()) -> list[float]:
    """The features of a candidate in its line, with the corpus's dictionary."""
    text = line[start:end]
    n = len(text)
    low = text.lower()
    before, after = line[max(0, start - NEARBY) : start], line[end : end + NEARBY]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in text]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    runs = sum(k == "d" and (i == 0 or kinds[i - 1] != "d") for i, k in enumerate(kinds)) / n
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    covered = coverage(text, words)
    letters = sum(c.isalpha() for c in low)
    near = re.findall(r"[a-z]+", before.lower())[-3:]
    around = " ".join(near) + " " + after.lower()[:16]
    return [
        float(min(n, 4096)),
        changes,
        runs,
        entropy,
        float(bool(re.fullmatch(r"[0-9a-f]+", low))),
        covered,
        sum(c in "aeiou" for c in low) / max(1, letters),
        float(bool(re.search(r"(?:https?:|www\.|[\w.]+/)[^\s\"']*$", before)) or text.count("/") >= 2 or after[:1] == "/"),
        float(any(w.rstrip("s") in NAMES or w.endswith(("key", "token", "secret", "password", "passwd", "passphrase", "pwd")) for w in near) and bool(re.search(r"[=:>]\s*[\"'`]?$", before))),
        float(before[-1:] in "\"'`" and before[-1:] != "" and after[:1] == before[-1:]),
        float(any(p in low or p in around for p in PLACEHOLDERS)),
        float(sum(w in NAMES for w in near)),
        sum(not c.isalnum() and c not in "+/=_-" for c in text) / n,
        float(bool(_CODE.search(text))),
        float(bool(re.search(r"://[^\s:/@]*:$", before)) and after[:1] == "@"),
    ]


def _assigned(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, quoted) of the values assigned to telling names, in order."""
    found: list[tuple[int, int, bool]] = []
    last = 0  # the end of the last unquoted value
    nested = False
    for m in ASSIGNMENT.finditer(text):
        at = m.end()
        if q := QUOTED.match(text, at):
            found.append((*q.span(2), True))
            continue
        at += text[at : at + 1] in ("\"", "'", "`")
        if at < last:
            if nested:
                found.pop()
            nested = True
            found.append((at, last, False))
        elif v := PLAIN.match(text, at):
            nested, last = False, v.end()
            found.append((at, last, False))
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """The spans of all candidates in order, each within one line."""
    values = set()
    for start, end, quoted in _assigned(text):
        while not quoted and end > start and text[end - 1] in ".,;":
            end -= 1
        if end - start >= LEAST and not text[start:end].isspace():
            values.add((start, end))
    values.update(m.span(1) for m in ADDRESS.finditer(text))
    whole = []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        if sum(len(p) >= 16 for p in parts) >= 2 and (len(parts) > 2 or m.group().startswith("eyJ")):
            whole.append(m.span())
    ends = {end: start for start, end in sorted(values, reverse=True)}  # the longest value of each end
    runs, k = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(whole) and whole[k][1] <= start:
            k += 1
        if k < len(whole) and whole[k][0] < end:
            continue
        if end in ends and ends[end] > start:
            continue
        run = m.group()
        if any(c.isdigit() for c in run) or (run.lower() != run and run.upper() != run):
            runs.append((start, end))
    return sorted({*values, *whole, *runs})


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(line, start, end, secret): half of them secrets in assignments and headers, half false positives."""
    rng = random.Random(seed)
    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    words = lambda k: [rng.choice(WORD_PARTS) for _ in range(k)]
    rows = []
    while len(rows) < n:
        secret = len(rows) % 2
        kind = rng.randrange(10)
        prose = " ".join(words(rng.randrange(2, 7)))
        if secret:
            value = some(hexa, rng.choice((32, 40, 64))) if kind < 3 else some(base, rng.randrange(20, 45)) if kind < 5 else some(base + "+/", rng.randrange(38, 60)) + "="
            name = rng.choice(NAMES)
            if kind == 6:
                value = some(base + "!@#$%&*.?^", rng.randrange(7, 18)) + rng.choice("!@#$%&*?^")
            elif kind == 7:
                value = rng.choice(words(1)).title().translate(str.maketrans("aeio", rng.choice(("4310", "@31o", "a3i0")))) + rng.choice("!@#$%&*_-") + some("0123456789", rng.randrange(2, 5))
            elif kind == 8:
                value = f"eyJ{some(base, rng.randrange(17, 34))}.{some(base + '_-', rng.randrange(20, 90))}.{some(base + '_-', 43)}" if rng.random() < 0.5 else some(base[26:52], rng.randrange(8, 24))
            lead = rng.choice((f'{name} = "', f"{name}: ", f"{name}='", f'"{name}": "', f"Authorization: {name} ", f"{rng.choice(words(1))}_{name}="))
            if kind == 9:
                value, lead = some(base + "!$%&*^", rng.randrange(8, 20)), f"{rng.choice(('postgres', 'https', 'amqp', 'redis'))}://{rng.choice(words(1))}:"
        elif kind == 0:
            value, lead = some(hexa, rng.choice((32, 40, 64))), rng.choice((f"https://{rng.choice(words(1))}.example.com/", "commit ", "sha1 of the file ", f"/{'/'.join(words(2))}/", "checksum "))
        elif kind == 1:
            value, lead = "_".join(words(4)) + str(rng.randrange(100)), rng.choice((f"{rng.choice(words(1))} = ", "call ", ""))
        elif kind == 2:
            value, lead = "".join(w.title() for w in words(5)), rng.choice(("class ", "new ", f"{rng.choice(NAMES)} = "))
        elif kind == 3:
            value, lead = "/".join([*words(4), some("0123456789", 4)]), rng.choice(("see ", "https://example.com/", "path: "))
        elif kind == 4:
            value, lead = rng.choice(("YOUR_API_KEY_GOES_HERE1", "xxxxxxxxxxxxxxxxxxxx0000", "example-token-1234567890", "changeme-password-0001", "test_secret_key_123456")), f'{rng.choice(NAMES)} = "'
        elif kind == 6:
            a, b = words(2)
            value = rng.choice((a + b, f"{a}.{b}_value", f"get_{a}({b})", f"{a}[{b}]", f"${{{a.upper()}_{b.upper()}}}", f"<{a}-{b}>", f"{a}_{b}", "undefined", "required", "optional", "string"))
            lead = rng.choice((f"{rng.choice(NAMES)} = ", f"{rng.choice(NAMES)}: "))
        elif kind == 7:
            value, lead = " ".join(words(rng.randrange(2, 7))), f'{rng.choice(NAMES)}: "'
        elif kind == 8:
            value, lead = ".".join("_".join(words(4)) for _ in range(3)), rng.choice(("import ", f"{rng.choice(NAMES)} = "))
        elif kind == 9:
            value, lead = rng.choice(("changeme", "your-password", "example1", "xxxxxxxx", "password", "test1234")), rng.choice((f'{rng.choice(NAMES)} = "', f"{rng.choice(NAMES)}: "))
        else:
            value, lead = rng.choice((some("0123456789", rng.randrange(16, 22)), "-".join(words(5)) + "-" + str(rng.randrange(2030)), "=" * rng.randrange(16, 40) + "1")), rng.choice(("", "order ", "number "))
        quote = lead[-1:] if lead[-1:] in "\"'" else ""
        host = f"@{rng.choice(words(1))}.example.com" if secret and kind == 9 else ""
        line = f"{prose} {lead}{value}{quote}{host} {' '.join(words(3))}"
        at = len(prose) + 1 + len(lead)
        spans = [s for s in candidates(line) if s[0] <= at < s[1] or at <= s[0] < at + len(value)]
        if spans:
            rows.append((line, *((at, at + len(value)) if (at, at + len(value)) in spans else spans[0]), secret))
    return rows


def _sample(findings: DataFrame, most: int) -> list[tuple[str, int, int, int]]:
    """At most ``most`` distinct rows in the order of a hash, half of each class or what it has."""
    rows = findings.select("line", "start", "end", F.col("secret").cast("int").alias("secret")).where("line IS NOT NULL").distinct()
    no, yes = ([tuple(r) for r in rows.where(F.col("secret") == c).orderBy(F.xxhash64("line", "start", "end"), "line", "start", "end").limit(most).collect()] for c in (0, 1))
    n = min(len(yes), max(most // 2, most - len(no)))
    return no[: most - n] + yes[:n]


def train(spark: SparkSession, findings: DataFrame | None = None, *, words: frozenset[str] = frozenset(), trees: int = TREES, depth: int = DEPTH, seed: int = SEED, most: int = FINDINGS) -> RandomForestClassificationModel:
    """A forest from labelled findings (line, start, end, secret), from at most ``most`` rows of them."""
    rows = labelled_findings(most, seed) if findings is None else _sample(findings, most)
    if {r[3] for r in rows} != {0, 1}:
        raise ValueError("labelled findings of both classes are needed")
    data = spark.createDataFrame([(*describe(*r[:3], words), float(r[3])) for r in rows], ", ".join(f"{f} double" for f in FEATURES) + ", secret double")
    forest = RandomForestClassifier(featuresCol="features", labelCol="secret", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data))


def find_secrets(docs: DataFrame, model: RandomForestClassificationModel, *, words: frozenset[str] = frozenset(), id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, start, end, score, secret) of every candidate of every text; code points, end exclusive. ``words`` is that of the training."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                ids, starts, ends, features = [], [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    for start, end in candidates(text):
                        left = text.rfind("\n", max(0, start - 256), start) + 1 or max(0, start - 256)
                        line = text[left : end + 256].split("\n", 1)[0]
                        ids.append(row)
                        starts.append(start)
                        ends.append(end)
                        features.append(describe(line, start - left, end - left, known.value))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), *[pa.array([f[k] for f in features], pa.float64()) for k in range(len(FEATURES))]],
                    names=["id", "start", "end", *FEATURES],
                )

    rows = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    found = rows.mapInArrow(run, "id bigint, start bigint, end bigint, " + ", ".join(f"{f} double" for f in FEATURES))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    score = vector_to_array("probability")[1]
    return scored.select(F.col("id").alias(id_col), "start", "end", F.round(score, 6).alias("score"), (score >= threshold).alias("secret"))
