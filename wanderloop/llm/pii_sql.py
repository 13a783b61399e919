"""The result of the personal-data query in SQL, words that disclose included."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LUHN = (
    "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INTEGER) "
    "WHEN CAST(reverse(digits)[i] AS INTEGER) > 4 THEN 2 * CAST(reverse(digits)[i] AS INTEGER) - 9 "
    "ELSE 2 * CAST(reverse(digits)[i] AS INTEGER) END))"
)
# Kind, pattern and what a match must satisfy.
KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(hit, '.'), lambda x: CAST(x AS DOUBLE))) <= 255"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length(digits) BETWEEN 12 AND 19 AND {LUHN} % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def located(i: str) -> str:
    """Start of the i-th match: all gaps up to it and all matches before it."""
    return f"CAST(coalesce(list_sum(list_transform(gaps[1:{i}], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:{i} - 1], lambda x: length(x))), 0) AS BIGINT)"


found = " UNION ALL ".join(f"SELECT rid, {r} AS rank, '{k}' AS kind, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM docs" for r, (k, p, _) in enumerate(KINDS))
ok = "CASE kind " + " ".join(f"WHEN '{k}' THEN {c}" for k, _, c in KINDS) + " END"
PII_SQL = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
each AS (SELECT rid, rank, kind, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM found WHERE len(hits) > 0),
placed AS (SELECT rid, rank, kind, hits[i] AS hit, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits, {located('i')} AS start FROM each),
base AS MATERIALIZED (SELECT rid, rank, kind, hit, start, start + length(hit) AS stop FROM placed WHERE {ok}),
cut AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS p FROM docs),
pieces AS (SELECT rid, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM cut),
ended AS (SELECT rid, piece, CAST(sum(length(piece)) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM pieces),
words AS MATERIALIZED (
  SELECT rid, translate(piece, '{UPPER}', '{LOWER}') AS term, stop - length(piece) AS start, stop
  FROM ended e WHERE regexp_matches(piece, '{WORD}')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = e.rid AND b.start < e.stop AND e.stop - length(e.piece) < b.stop)),
keyed AS (SELECT rid, md5(text) AS text_key FROM docs),
held AS (SELECT DISTINCT rid, text_key, kind || ':' || translate(hit, '{UPPER}', '{LOWER}') AS entity FROM base JOIN keyed USING (rid)),
by_text AS (SELECT entity, text_key, count(*) AS n FROM held GROUP BY ALL),
n_e AS (SELECT entity, sum(n) AS n_e FROM by_text GROUP BY entity HAVING count(*) >= 3),
beside AS (SELECT DISTINCT text_key, term FROM words JOIN keyed USING (rid) WHERE rid IN (SELECT rid FROM held)),
together AS (
  SELECT entity, term, sum(n) AS n_te FROM beside JOIN by_text USING (text_key) JOIN n_e USING (entity) GROUP BY ALL HAVING count(*) >= 3),
df AS (SELECT term, count(DISTINCT rid) AS n_t FROM words WHERE term IN (SELECT term FROM together) GROUP BY term),
judged AS (
  SELECT entity, term, ln(CAST((SELECT count(*) FROM docs) AS DOUBLE) / n_e) AS information, n_te = n_t AS sure, n_te / CAST(n_t AS DOUBLE) AS share
  FROM together JOIN df USING (term) JOIN n_e USING (entity)),
disclosing AS (
  SELECT term, max(CASE WHEN sure THEN 'remove' ELSE 'generalise' END) AS action FROM judged
  WHERE information > 0 AND information + ln(share) >= 0.9 * information GROUP BY term),
terms AS MATERIALIZED (SELECT rid, start, stop, action FROM words JOIN disclosing USING (term)),
spans AS (
  SELECT rid, start, rank, kind, stop FROM base UNION ALL SELECT rid, start, 4, 'term', stop FROM terms),
lines AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS base_text,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY rid),
acts AS (SELECT rid, string_agg(action || ':' || start || ':' || stop, ',' ORDER BY start) AS actions FROM terms GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(actions, '') AS term_actions
FROM docs LEFT JOIN lines USING (rid) LEFT JOIN acts USING (rid)"""
