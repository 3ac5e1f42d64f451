"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from . import decontamination, jaccard, pii, secret_scan, substrings, warc

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
#: A code point that stands for a match while the text between matches is measured; it isn't a character.
_MARK = 0x10FFFE


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def decontamination_sql() -> str:
    n = decontamination.WINDOW
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_low("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {n}, 0) + 2)) AS i FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
wanted AS (SELECT DISTINCT item_id, least(len(w), {n}) AS n, array_to_string(w[i:i + {n - 1}], ' ') AS k FROM starts),
lengths AS (SELECT DISTINCT n FROM wanted),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT r, i, p.n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM places) p JOIN wanted USING (n, k)),
inside AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN inside USING (r) LEFT JOIN items USING (r)"""


def substrings_sql() -> str:
    n = substrings.WINDOW
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
places AS (SELECT r, doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n}),
windows AS (SELECT r, doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS k FROM places),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {n})) AS i FROM windows JOIN (SELECT k, min(doc_id) AS low FROM windows GROUP BY k) USING (k) WHERE doc_id > low),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


def _matches(kind: str, rank: int, pattern: str) -> str:
    """Leftmost non-overlapping matches of a pattern, with the text before each."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, {rank} AS rank, generate_subscripts(m, 1) AS i, unnest(m) AS t, unnest(g[:-2]) AS gap
FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split(regexp_replace(text, '{pattern}', chr({_MARK}), 'g'), chr({_MARK})) AS g FROM d)"""


def _spans(patterns: list[tuple[str, str]]) -> str:
    """d: rows with text and a number; placed: their matches with start and stop."""
    each = "\nUNION ALL ".join(_matches(kind, rank, pattern) for rank, (kind, pattern) in enumerate(patterns))
    return f"""
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
matched AS ({each}),
ends AS (SELECT *, CAST(sum(length(gap) + length(t)) OVER (PARTITION BY r, rank ORDER BY i) AS BIGINT) AS stop FROM matched),
placed AS (SELECT *, stop - length(t) AS start, concat_ws(':', kind, stop - length(t), stop) AS name FROM ends)"""


def secrets_sql() -> str:
    rules = secret_scan.RULES
    patterns = [(kind, rule[1].replace("++", "+").replace("}+", "}").replace("(?<![0-9a-f])", "")) for kind, rule in rules.items()]
    test = " ".join(f"WHEN '{kind}' THEN length({'regexp_extract(t, ' + repr_sql(pattern) + ', 1)' if rules[kind][2] else 't'}) >= {rules[kind][3]}" for kind, pattern in patterns)
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE)
    counts = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in secret_scan.BASE)
    each = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret_scan.BASE)
    return f"""
WITH {_spans(patterns)},
found AS (SELECT * FROM placed WHERE CASE kind {test} END),
of_row AS (SELECT r, {each}, string_agg(name, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base, string_agg(name, ',' ORDER BY start, rank) AS spans FROM found GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN of_row USING (r)"""


def repr_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def personal_data_sql() -> str:
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ("iban", pii.IBAN),
    ]
    base = ", ".join(f"'{k}'" for k in pii.BASE)
    counts = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in pii.BASE)
    each = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    near = " ".join(f"WHEN '{k}' THEN {pii.SCORES[k]} + CASE WHEN regexp_matches(before, '(?:^|[^a-z])(?:{pii.WORDS[k]})') THEN {pii.NEAR} ELSE 0 END" for k in pii.KINDS)
    off = " ".join(f"WHEN '{k}' THEN CASE WHEN regexp_matches(before, '(?:^|[^a-z])(?:{words})') THEN {pii.OFF} ELSE 0 END" for k, words in pii.AGAINST.items())
    return f"""
WITH {_spans(patterns)},
digits AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS x, replace(t, ' ', '') AS account FROM placed),
moved AS (SELECT *, account[5:] || account[:4] AS turned, CASE WHEN start = 0 THEN '' ELSE substring(text, start, 1) END AS last, substring(text, stop + 1, 1) AS next
          FROM digits JOIN (SELECT r, text FROM d) USING (r)),
found AS (SELECT *, lower(right(gap, {pii.CONTEXT})) AS before FROM moved WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(t, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (ltrim(p, '0') <> '' AND TRY_CAST(right(ltrim(p, '0'), 4) AS INTEGER) > 255))) = 0
  WHEN 'card' THEN length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN CAST(x[i] AS INTEGER)
       WHEN CAST(x[i] AS INTEGER) > 4 THEN 2 * CAST(x[i] AS INTEGER) - 9 ELSE 2 * CAST(x[i] AS INTEGER) END)) % 10 = 0
  WHEN 'phone' THEN length(x) BETWEEN 9 AND 15
  ELSE NOT regexp_matches(last, '[A-Za-z0-9]') AND NOT regexp_matches(next, '[A-Za-z0-9]') AND list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(turned) + 1), lambda i: CAST(ascii(turned[i]) AS BIGINT))),
       lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1 END),
scored AS (SELECT *, name || ':' || CAST(CASE kind {near} END - CASE kind {off} ELSE 0 END AS VARCHAR) AS told FROM found),
of_row AS (SELECT r, {each}, string_agg(name, ',' ORDER BY rank, start) FILTER (kind IN ({base})) AS base, string_agg(name, ',' ORDER BY rank, start) AS spans,
           string_agg(told, ',' ORDER BY rank, start) AS scores FROM scored GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN of_row USING (r)"""


def near_duplicates_sql() -> str:
    n = jaccard.SHINGLE
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n}, 0) + 2)) AS i FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS k FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= {jaccard.LEAST} * (x.n + y.n - common.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, c.component_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a) l USING (doc_id)"""


def archives_sql() -> str:
    n = warc.SHARED_BYTES
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE bytes >= {n} GROUP BY digest)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)"""
