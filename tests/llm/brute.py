"""Plain Python versions of the operators, quadratic where that is the plainest."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def contamination(texts: list[str | None], items: list[tuple[str, str | None]], window: int = 13) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        ws = words(text)
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1) if ws else ():
            windows[tuple(ws[i : i + size])].add(item)
    out = []
    for text in texts:
        ws = words(text)
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(ws) - size + 1):
                if (w := tuple(ws[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[w]
        out.append((len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def classes(texts: list[str | None], size: int = 5, least: float = 0.8, weights: str = "count") -> list[frozenset[int]]:
    """Row numbers of each class, by the weighted Jaccard similarity of shingles ("set": each weighs one)."""
    sets = []
    for t in texts:
        ws = words(t)
        found = Counter(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))) if ws else Counter()
        sets.append(found if weights == "count" else Counter(dict.fromkeys(found, 1)))
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            if texts[i] == texts[j]:
                parent[root(i)] = root(j)
            elif sets[i].keys() & sets[j].keys() and (sets[i] & sets[j]).total() / (sets[i] | sets[j]).total() >= least - 1e-9:
                parent[root(i)] = root(j)
    groups = defaultdict(set)
    for i in range(len(texts)):
        groups[root(i)].add(i)
    return [frozenset(g) for g in groups.values()]


def without_boilerplate(rows: list[tuple[str | None, str | None]], ratio: float = 0.1, least: int = 3) -> list[str | None]:
    """Texts of (host, text) without the lines that are boilerplate on the host."""
    bare = lambda x: x.translate({9: 32, 11: 32, 12: 32, 13: 32}).strip(" ")
    total = Counter(h for h, _ in rows)
    seen = Counter((h, x) for h, t in rows if t is not None for x in {bare(x) for x in t.split("\n")} if x)
    drop = {k for k, n in seen.items() if n >= least and n > ratio * total[k[0]]}
    return [t if t is None else "\n".join(x for x in t.split("\n") if (h, bare(x)) not in drop) for h, t in rows]


def split(text: str) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def quality(text: str | None) -> tuple:
    """The base figures, base_failed, kept, clean_text."""
    from slotwise.llm import quality as q

    text = text or ""
    ws, lines = split(text), [x for x in text.split("\n") if split(x)]
    places = defaultdict(list)
    for i in range(len(ws) - 4):
        places[tuple(ws[i : i + 5])].append(i)
    repeated = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    java = lambda p: re.compile(p.replace(r"\z", r"\Z"))

    def fails(line: str) -> bool:
        lw, ends = split(line), bool(java(q._SENTENCE_END).search(line))
        separators, noisy = (sum(bool(java(p).search(w)) for w in lw) for p in (q._SEPARATOR, q._NOISY))
        menu = sum(bool(java(q._MENU).search(w)) for w in re.split("[^a-zà-ÿ]+", line.lower()))
        return (separators >= 2 and 4 * separators >= len(lw)) or (len(lw) <= 12 and not ends and 2 * menu >= len(lw)) or (len(line) <= q.SHORT and bool(re.search(q.PHRASES, line.lower()))) or not ends or 3 * noisy >= len(lw)

    chars, bad = sum(map(len, ws)), [x for x in lines if fails(x)]
    failed = len(ws) < 10 or 100 * len(repeated) > 20 * len(ws)
    kept = not failed and chars - sum(len("".join(split(x))) for x in bad) >= 0.5 * chars
    clean = "\n".join(x for x in text.split("\n") if not split(x) or not fails(x))
    return (len(ws), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed, kept, clean)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the base kinds."""
    text, out = text or "", []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def packed(rows: list[tuple], capacity: int) -> list[tuple]:
    """(id, piece, start, length, bin, offset) of (id, node, size, source, cluster), by looking at every bin."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0] is not None, r[0] or 0, r[1]))
    full, rest = [], []
    for r in rows:
        whole, left = divmod(r[2], capacity)
        full += [(r, p, p * capacity, capacity) for p in range(whole)]
        if left or not whole:
            rest.append((r, whole, whole * capacity, left))
    rest.sort(key=lambda x: -x[3])
    copies = Counter(r[4] for r in rows)
    bins, out = [], []
    for r, piece, start, length in full + rest:
        source, cluster = r[3], r[4] if copies[r[4]] > 1 else None
        fits = [(b[0], n) for n, b in enumerate(bins) if b[0] >= length and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        out.append((r[0], piece, start, length, n, capacity - bins[n][0]))
        bins[n][0] -= length
        bins[n][1].add(source)
        bins[n][2].add(cluster)
    return out
