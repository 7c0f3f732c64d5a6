"""DuckDB SQL for the rows of queries that SQL can express over whole tables."""

from __future__ import annotations

from helixframe.llm import exact_dedup, line_dedup, mixing, ranked_search, secret_scan, substring_dedup, suffix_dedup
from helixframe.llm.decontaminate import WINDOW

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM win) l ON len(w) >= n)),
h AS (SELECT DISTINCT doc_id, p.n, i, item FROM p JOIN win ON win.n = p.n AND win.s = p.s),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _either_case(pattern: str) -> str:
    """Letters outside of classes in either case, spelled out: case folding beyond ASCII is not meant."""
    out, inside = "", False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out, i = out + pattern[i : i + (4 if pattern[i + 1] == "x" else 2)], i + (4 if pattern[i + 1] == "x" else 2)
            continue
        inside = c == "[" or (inside and c != "]")
        out, i = out + (f"[{c.upper()}{c.lower()}]" if c.isalpha() and not inside else c), i + 1
    return out


def _secrets() -> str:
    kinds = []
    for k, r in enumerate(secret_scan.RULES):
        p = (_either_case(r.pattern) if r.ignore_case else r.pattern).replace("'", "''")
        size = f"length(regexp_extract(m, '{p}', {r.group}))"
        kinds.append(f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, a, a + length(m) AS z FROM (SELECT doc_id, ms[i] AS m, list_sum(list_transform(ps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0) AS a
FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d), range(1, len(ms) + 1) r(i)) WHERE {size} >= {r.least}""")
    base = len(secret_scan.BASE_RULES)
    each = ", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(secret_scan.BASE_RULES))
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    shown = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(kinds)}),
g AS (SELECT doc_id, {each}, string_agg({shown}, ',' ORDER BY a, k) FILTER (k < {base}) AS base, string_agg({shown}, ',' ORDER BY a, k) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


SECRETS = _secrets()

LINES = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS o, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT o, i, ls[i] AS line, length(ls[i]) AS n FROM d, range(1, len(ls) + 1) r(i) WHERE regexp_matches(ls[i], '[^ \\t\\n\\x0B\\f\\r]')),
f AS MATERIALIZED (SELECT line, max(n) AS n, min((o, i)) AS first FROM l GROUP BY 1),
k AS (SELECT line, first, n, n - dd AS kn, half, CASE half WHEN 0 THEN substr(line, (n - dd) // 2 + dd + 1) ELSE substr(line, 1, (n - dd) // 2) END AS part FROM f, (VALUES (0), (1)) x(dd), (VALUES (0), (1)) y(half) WHERE n >= {line_dedup.LEAST}),
c AS (SELECT DISTINCT a.line AS x, a.n AS nx, b.line AS y, b.n AS ny FROM k a JOIN k b ON a.kn = b.kn AND a.half = b.half AND a.part = b.part AND b.first < a.first WHERE a.line <> b.line AND abs(a.n - b.n) <= 1),
late AS (SELECT DISTINCT x AS line FROM c WHERE CASE WHEN nx = ny THEN len(list_filter(list_zip(string_split(x, ''), string_split(y, '')), lambda p: p[1] <> p[2])) <= 1
ELSE len(list_filter(range(1, greatest(nx, ny) + 1), lambda p: CASE WHEN nx > ny THEN substr(x, 1, p - 1) || substr(x, p + 1) = y ELSE substr(y, 1, p - 1) || substr(y, p + 1) = x END)) > 0 END),
gone AS (SELECT l.o, list(l.i) AS gone FROM l JOIN f USING (line) LEFT JOIN late ON late.line = l.line WHERE late.line IS NOT NULL OR (l.o, l.i) <> f.first GROUP BY 1)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped, sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (o)
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT o, i, array_to_string(w[i : i + {substring_dedup.WINDOW - 1}], ' ') AS s FROM d, range(1, len(w) - {substring_dedup.WINDOW - 2}) r(i)),
f AS (SELECT s, min(o) AS first FROM p GROUP BY 1 HAVING min(o) < max(o)),
g AS (SELECT o, list(DISTINCT k) AS gone FROM (SELECT o, unnest(range(i, i + {substring_dedup.WINDOW})) AS k FROM p JOIN f USING (s) WHERE first < o) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (o)
"""

#: Strings are compared by their MD5; bytes are written in hexadecimal, two letters each.
SUFFIXES = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, b, substr(x, {2 * suffix_dedup.WINDOW} * b + 1, {4 * suffix_dedup.WINDOW - 2}) AS c FROM d, range(0, length(x) // {2 * suffix_dedup.WINDOW} + 1) r(b)),
p AS (SELECT doc_id, {suffix_dedup.WINDOW} * b + j AS i, md5(substr(c, 2 * j + 1, {2 * suffix_dedup.WINDOW})) AS s FROM c, range(0, length(c) // 2 - {suffix_dedup.WINDOW - 1}) r(j)),
h AS (SELECT doc_id, i FROM p WHERE s IN (SELECT s FROM p GROUP BY 1 HAVING count(*) > 1)),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffix_dedup.WINDOW}, true) AS new FROM h),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + {suffix_dedup.WINDOW} AS z FROM (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b) GROUP BY 1, 2),
g AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
k AS (SELECT d.doc_id, max(length(x) // 2) AS n_bytes, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(max(x), 2 * max(z) + 1) AS kept FROM d JOIN g USING (doc_id) GROUP BY 1)
SELECT d.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES = {"op3_decontaminate": DECONTAMINATE, "op4_secrets": SECRETS, "op5_line_dedup": LINES, "op7_substring_dedup": SUBSTRINGS, "op8_suffix_dedup": SUFFIXES, "op10_exact_dedup": exact_dedup.ORACLE_SQL, "op12_ranked_search": ranked_search.ORACLE_SQL, "op13_mixing": mixing.ORACLE_SQL}
