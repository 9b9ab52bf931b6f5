"""The same results in DuckDB's SQL, for the operators that SQL can express on whole tables."""

from __future__ import annotations

from slotwise.llm import line_dedup, quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{WORD}')"


OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_words("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, l, array_to_string(ws[i:i + l - 1], ' ') AS win
      FROM (SELECT item, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM (SELECT item, ws, least(13, len(ws)) AS l FROM b) WHERE l > 0)),
w AS (SELECT r, l, i, array_to_string(ws[i:i + l - 1], ' ') AS win
      FROM (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM p))),
h AS (SELECT r, l, i, item FROM w JOIN p USING (l, win)),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS k FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""

OP4 = f"""
WITH RECURSIVE t AS (SELECT text, row_number() OVER () AS id, {_words("text")} AS ws FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
g AS (SELECT id, array_to_string(ws[i:i + 4], ' ') AS s, count(*) AS w FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t WHERE len(ws) > 0) GROUP BY ALL),
z AS (SELECT id, sum(w) AS n FROM g GROUP BY id),
e AS (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, sum(least(x.w, y.w)) AS n FROM g x JOIN g y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id) x
      JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE x.n >= 0.8 * (za.n + zb.n - x.n) - 1e-9),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(id, other) AS (SELECT id, id FROM t UNION SELECT c.id, u.b FROM c JOIN u ON u.a = c.other),
l AS (SELECT id, min(other) AS label FROM c GROUP BY id),
r AS (SELECT doc_id, label FROM documents LEFT JOIN t USING (text) LEFT JOIN l USING (id)),
k AS (SELECT label, min(doc_id) AS class_id, count(*) AS class_size FROM r WHERE label IS NOT NULL GROUP BY label)
SELECT doc_id, CASE WHEN label IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(class_size, 1)::BIGINT AS class_size,
       label IS NULL OR doc_id IS NOT DISTINCT FROM class_id AS representative
FROM r LEFT JOIN k USING (label)
"""

_BARE = "trim(translate({}, chr(9) || chr(11) || chr(12) || chr(13), '    '))"

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, doc_id, source, i, xs[i] AS line, {_BARE.format("xs[i]")} AS bare
      FROM (SELECT r, doc_id, source, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT r, doc_id, source, string_split(text, chr(10)) AS xs FROM d WHERE text IS NOT NULL))),
t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
o AS (SELECT n.source, bare FROM (SELECT source, bare, count(DISTINCT r) AS n FROM l WHERE bare <> '' GROUP BY source, bare) n
      JOIN t ON t.source IS NOT DISTINCT FROM n.source WHERE n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.RATIO} * total),
k AS (SELECT l.r, l.i, l.line, o.bare IS NOT NULL AS drop FROM l LEFT JOIN o ON o.source IS NOT DISTINCT FROM l.source AND o.bare = l.bare),
s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT drop), '') AS clean FROM k GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(clean) AS clean_sha256
FROM d LEFT JOIN s USING (r)
"""

def _crc_table() -> str:
    """Eight hex digits for each byte: its remainder by the CRC-32 polynomial."""
    rows = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        rows.append(f"{byte:08x}")
    return "".join(rows)


OP7 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 0) AS key, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, key, strlen(text)::BIGINT + 1 AS size,
             xor(list_reduce(list_transform(range(1, strlen(text) + 1), lambda k: ('0x' || hx[2 * k - 1:2 * k])::BIGINT),
                 lambda a, b: xor(a >> 8, ('0x' || substr('{_crc_table()}', (8 * (xor(a, b) & 255) + 1)::INTEGER, 8))::BIGINT), 4294967295), 4294967295)::BIGINT AS text_crc32
      FROM (SELECT r, doc_id, key, text, hex(encode(text)) AS hx FROM d)),
j(r, n, state, b, jump) AS (
  SELECT r, n, key::UBIGINT::UHUGEINT, -1::BIGINT, 0::BIGINT FROM d, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT r, n, after, jump, floor((jump + 1) * (2147483648.0::DOUBLE / (after // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, n, jump, (state * 2862933555777941757 + 1) % 18446744073709551616 AS after FROM j WHERE jump < n)),
h AS (SELECT r, max(b) FILTER (WHERE n = 8)::INTEGER AS shard, max(b) FILTER (WHERE n = 9)::INTEGER AS grown_shard FROM j GROUP BY r),
k AS (SELECT s.*, shard, grown_shard, ('0x' || md5(key || ':' || text_crc32 || ':' || size)[1:8])::BIGINT % (SELECT greatest(1, ceil(count(*) / 20000.0)::BIGINT) FROM documents) AS bucket FROM s JOIN h USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM k
"""

_SPLIT = r"regexp_split_to_array({}, '[\x20\x09-\x0D]+')"
_LINE_WORDS = f"list_filter({_SPLIT.format('line')}, lambda w: w <> '')"
_VISIBLE = f"length(translate({{}}, {BLANKS}, ''))"

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter({_SPLIT.format("text")}, lambda w: w <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: translate(x, {BLANKS}, '') <> '') AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
m AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT g.r, unnest(range(g.i, g.i + 5)) AS k FROM g JOIN (SELECT r, s FROM g GROUP BY r, s HAVING count(*) > 1) x USING (r, s)) GROUP BY r),
l AS (SELECT r, line, {_LINE_WORDS} AS lw, regexp_matches(line, {_quoted(quality._SENTENCE_END)}) AS ends FROM (SELECT r, unnest(ls) AS line FROM w)),
f AS (SELECT r, line, len(lw) AS n, ends, len(list_filter(lw, lambda x: regexp_matches(x, {_quoted(quality._SEPARATOR)}))) AS separators,
             len(list_filter(lw, lambda x: regexp_matches(x, {_quoted(quality._NOISY)}))) AS noisy,
             len(list_filter(regexp_split_to_array(lower(line), '[^a-zà-ÿ]+'), lambda x: regexp_matches(x, {_quoted(quality._MENU)}))) AS menu,
             regexp_matches(lower(line), {_quoted(quality.PHRASES)}) AS phrase FROM l),
c AS (SELECT r, sum({_VISIBLE.format("line")}) AS kept_chars FROM f
      WHERE NOT ((separators >= 2 AND 4 * separators >= n) OR (n <= 12 AND NOT ends AND 2 * menu >= n) OR (length(line) <= {quality.SHORT} AND phrase) OR NOT ends OR 3 * noisy >= n) GROUP BY r),
o AS (SELECT doc_id, len(ws)::BIGINT AS n_words, {_VISIBLE.format("text")}::BIGINT AS word_chars, (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(m.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
      FROM w LEFT JOIN m USING (r) LEFT JOIN c USING (r)),
q AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_chars >= {1 - quality.MAX_LOST} * word_chars AS kept FROM q
"""

OP10 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_transform(range(1, 41), lambda k: ('0x' || h[k:k])::INTEGER) AS x FROM p),
q AS (SELECT *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([
        x[5 * g + 1] * 2 + (x[5 * g + 2] >> 3), (x[5 * g + 2] & 7) * 4 + (x[5 * g + 3] >> 2), (x[5 * g + 3] & 3) * 8 + (x[5 * g + 4] >> 1), (x[5 * g + 4] & 1) * 16 + x[5 * g + 5]],
        lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::INTEGER + 1, 1)), '')), '') AS payload_digest FROM b),
k AS (SELECT h, max(page_id) AS keeper, count(*) AS n FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n = 1 OR page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM q JOIN k USING (h)
"""

OP13 = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter({_SPLIT.format("text")}, lambda w: w <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, part, (len(ws) < 50)::INTEGER + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INTEGER
             + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INTEGER
             + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > first, false)::INTEGER AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS quality, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bit, coalesce((SELECT sum(g.bit) FROM f g WHERE instr(filter_order, g.letter) < step), 0) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step), f WHERE letter = filter_order[step]),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before::INTEGER | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit > 0 AND mask & before::INTEGER = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & before::INTEGER > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before::INTEGER = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit > 0 AND mask & before::INTEGER = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

ORACLES = {"op3_decontamination": OP3, "op4_minhash_dedup": OP4, "op6_line_dedup": OP6, "op7_sharding": OP7, "op8_quality_rules": OP8, "op10_warc": OP10, "op13_filter_audit": OP13}
