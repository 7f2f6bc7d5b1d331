"""The registered queries in SQL that DuckDB runs. Its patterns know no look-around, so borders are matched and cut off."""

from __future__ import annotations

from ombra import cases, planted
from ombra.functions.lexicons import ENGLISH_HINTS, ITALIAN_ACCENTS, ITALIAN_HINTS, MONTHS, TECHNICAL
from ombra.functions.text import FILE_EXTENSIONS

EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9_.%+\-]*[A-Za-z0-9_%+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IP = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
#: Blanks are doubled, so that one ends a number and the other comes before the next.
CARD = r"(?:^|[^0-9.,\-/])([0-9](?:(?:  |-)?[0-9]){11,18})(?:$|[^0-9])"
URL = r"""(?:https?://|www\.)[^\s<>"'']+"""


def each(pattern: str, group: int = 0, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"SELECT {key}, unnest(regexp_extract_all({text}, '{pattern}', {group})) AS value FROM {source}"


def listed(rows: str, key: str = "doc_id") -> str:
    return f"SELECT {key}, count(*) AS n, string_agg(value, '|' ORDER BY value) AS found FROM ({rows}) GROUP BY {key}"


def luhn(digits: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    d = f"CAST({digits}[len({digits}) - i] AS INTEGER)"
    return f"list_sum(list_transform(range(len({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)) % 10 = 0"


def hint(words: list[str]) -> str:
    union = "|".join(w.replace(".", r"\.") for w in words)
    # a word stands between characters that are no letters, digits or underscores of any alphabet
    return rf"(?i)(?:^|[^\pL\pN_])(?:{union})(?:$|[^\pL\pN_])"


FIRST = f"""
WITH v AS (
  SELECT source AS session_id, doc_id, 'EMAIL' AS type, unnest(regexp_extract_all(text, '{EMAIL}')) AS value, text FROM documents
  UNION ALL
  SELECT source, doc_id, 'IP', unnest(regexp_extract_all(text, '{IP}')), text FROM documents
), f AS (
  SELECT session_id, type, value, min((doc_id, strpos(text, value))) AS first FROM v GROUP BY ALL
)
"""
NUMBERED = "row_number() OVER (PARTITION BY session_id, type ORDER BY first)"
CUSTOMERS = "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS session_id, c_name AS value, c_mktsegment AS type, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS idx FROM customer"
EXTENSIONS = "|".join(FILE_EXTENSIONS)
SHAPES = rf"(?:[A-Z]\s+){{2,}}[A-Z]|(?i:[a-z0-9_.\-/\\]+\.(?:{EXTENSIONS}))|[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[a-zA-Z][a-zA-Z0-9]*[a-z][A-Z][a-zA-Z0-9]*|[A-Z]{{2,}}[a-z][A-Za-z0-9]*|[A-Z][A-Z0-9]{{0,3}}(?:[-_.][A-Z0-9]{{1,4}})?"
TECHNICAL_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(TECHNICAL))
MONTH_LIST = ", ".join(f"'{m}'" for m in list(MONTHS)[:12])

SQL: dict[str, str] = {
    "detect_email": listed(each(EMAIL)),
    "detect_ip": listed(each(IP)),
    "detect_card_luhn": listed(f"SELECT doc_id, value FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM (SELECT doc_id, replace(value, '  ', ' ') AS value FROM ({each(CARD, 1, text="replace(text, ' ', '  ')")}))) WHERE {luhn('digits')}"),
    "detect_url_pages": listed(each(URL, 0, "pages", "page_id", "html"), "page_id"),
    "span_offsets": f"SELECT doc_id, value, CAST(min(strpos(text, value)) - 1 AS BIGINT) AS start FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents) GROUP BY doc_id, value",
    "html_to_text_simple": r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n]+', ' ', 'g')) AS text FROM pages",
    "language_route": f"SELECT doc_id, CASE WHEN regexp_matches(text, '[{ITALIAN_ACCENTS}]') OR regexp_matches(text, '{hint(ITALIAN_HINTS)}') THEN 'it' WHEN regexp_matches(text, '{hint(ENGLISH_HINTS)}') THEN 'en' ELSE 'it' END AS language FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "lowercase_ratio": "SELECT doc_id, CAST(len(w) AS BIGINT) AS words, len(w) >= 3 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-ZÀ-ÖØ-Þ]'))) < 0.3 * len(w) AS mostly_lower FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'']*') AS w FROM documents)",
    "binary_ratio": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]')) > 0.05 * length(coalesce(text, '')) AS is_binary FROM documents",
    "block_split_lossless": "SELECT doc_id, coalesce(text, '') AS text, true AS bounded FROM documents",
    "noise_filter": rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \n]+')) AS word FROM documents), t AS (SELECT word, trim(word, ' ') AS v, regexp_replace(word, '[^\pL]', '', 'g') AS letters FROM w WHERE word <> '')
SELECT noise, count(*) AS words FROM (SELECT CASE WHEN lower(v) IN ({TECHNICAL_LIST}) THEN true WHEN length(letters) >= 4 AND upper(letters) = letters THEN true
  ELSE regexp_full_match(v, '{SHAPES}') OR length(regexp_replace(v, '[.\-]', '', 'g')) <= 2 END AS noise FROM t) GROUP BY noise""",
    "date_keys": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS key0, strftime(o_orderdate, '%Y-%m-%d') AS key1, strftime(o_orderdate, '%Y-%m-%d') AS key2, strftime(o_orderdate, '%Y-%m-??') AS key3, strftime(o_orderdate, '????-%m-%d') AS key4 FROM orders",
    "check_digits": f"SELECT o_orderkey, {luhn('n')} AS luhn, {luhn('n')} AS vat, CAST(replace('0542811' || lpad(CAST(o_orderkey AS VARCHAR), 12, '1'), ' ', '') AS HUGEINT) IS NOT NULL AND CAST('33' || '0542811' || lpad(CAST(o_orderkey AS VARCHAR), 12, '1') || '182960' AS HUGEINT) % 97 = 1 AS iban FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 11, '3') AS n FROM orders)",
    "allocate_placeholders": f"{FIRST} SELECT session_id, type, value, '«' || type || '_' || {NUMBERED} || '»' AS placeholder, sha256(value) AS value_hash FROM f",
    "reserved_numbers": """
WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS session_id, c_mktsegment AS type, c_name AS value, c_custkey, (c_custkey * 7) % 50 AS taken FROM customer
), k AS (SELECT session_id, type, value, row_number() OVER (PARTITION BY session_id, type ORDER BY c_custkey) AS k FROM c
), n AS (SELECT DISTINCT session_id, type FROM c
), free AS (SELECT n.session_id, n.type, i.i, row_number() OVER (PARTITION BY n.session_id, n.type ORDER BY i.i) AS k
  FROM n, (SELECT unnest(range(1, (SELECT count(*) + 100 FROM customer))) AS i) i ANTI JOIN c ON c.session_id = n.session_id AND c.type = n.type AND c.taken = i.i)
SELECT k.session_id, k.type, k.value, CAST(free.i AS BIGINT) AS idx FROM k JOIN free USING (session_id, type, k)""",
    "entity_table": f"{FIRST} SELECT session_id, doc_id, type, value, count(*) AS occurrences FROM v GROUP BY ALL",
    "roundtrip_identity": "SELECT doc_id, text FROM documents",
    "guarantee_violations": "SELECT unnest(['leaks', 'two_placeholders', 'shared_placeholders', 'over_lines', 'unlisted']) AS guarantee, CAST(0 AS BIGINT) AS violations",
    "reanonymise_edits": "SELECT c_custkey AS doc_id, 'CLIENTE «CLIENTE_1» of «SETTORE_1» writes.' AS text FROM customer",
    "session_summary": "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(DISTINCT text) AS entries FROM conversations GROUP BY conv_id",
    "vault_lookup": f"WITH v AS ({CUSTOMERS}) SELECT c.c_custkey, CAST(c.c_nationkey + x.d AS VARCHAR) AS session_id, '«' || v.type || '_' || v.idx || '»' AS placeholder FROM customer c CROSS JOIN (SELECT unnest([0, 1]) AS d) x LEFT JOIN v ON v.value = c.c_name AND v.session_id = CAST(c.c_nationkey + x.d AS VARCHAR)",
    "vault_second_call": f"""
WITH v AS ({CUSTOMERS}), s AS (SELECT CAST(s_nationkey AS VARCHAR) AS session_id, 'BUILDING' AS type, s_name AS value, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
SELECT session_id, type, value, CAST(idx AS BIGINT) AS idx FROM v
UNION ALL SELECT s.session_id, s.type, s.value, CAST(s.k + coalesce(m.top, 0) AS BIGINT) FROM s LEFT JOIN (SELECT session_id, max(idx) AS top FROM v WHERE type = 'BUILDING' GROUP BY session_id) m ON s.session_id = m.session_id""",
    "vault_encrypted_lookup": f"SELECT session_id, '«' || type || '_' || idx || '»' AS placeholder, value, true AS sealed FROM ({CUSTOMERS})",
    "vault_upsert_latest": "SELECT p_brand AS term, arg_max(p_type, p_partkey) AS type, max(p_partkey) AS n FROM part GROUP BY p_brand",
    "related_entities": """
WITH e AS (SELECT DISTINCT p_brand, value FROM (SELECT p_brand, p_name AS value FROM part UNION ALL SELECT p_brand, split_part(p_name, ' ', 1) FROM part)), t AS (SELECT *, string_split(lower(value), ' ') AS w FROM e
), p AS (SELECT a.p_brand, a.value, b.value AS other FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.w <> b.w AND (list_has_all(a.w, b.w) OR list_has_all(b.w, a.w)))
SELECT p_brand, value, min(other) AS related_to FROM p GROUP BY p_brand, value HAVING count(*) = 1""",
    "rubrica_match": r"SELECT replace(lower(m), '  ', ' ') AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '([^\pL\pN])', '\1\1', 'g'), '(?i)(?:^|[^\pL\pN])(password|license|credit  card|phone|the  ou)(?:$|[^\pL\pN])', 1)) AS m FROM documents) GROUP BY 1",
    "recall_by_type": """
WITH t AS (SELECT row_number() OVER () AS id, l_orderkey AS d, l_linenumber * 100 AS s, l_linenumber * 100 + 10 AS e, l_returnflag AS type, l_partkey AS p, l_linestatus AS ls, l_discount AS x FROM lineitem
), g AS (SELECT id, d, s + (p % 4) * 5 AS s, e + (p % 4) * 5 AS e, CASE WHEN p % 7 = 0 THEN ls ELSE type END AS type FROM t WHERE x < 0.085
), b AS (SELECT t.id, max((CAST(g.s = t.s AND g.e = t.e AS INTEGER), CAST(g.type = t.type AS INTEGER))) AS best FROM t JOIN g ON t.d = g.d AND t.s < g.e AND g.s < t.e GROUP BY t.id
), o AS (SELECT t.type, CASE WHEN best IS NULL THEN 'missing' WHEN best = (1, 1) THEN 'exact' WHEN best[2] = 1 THEN 'partial' ELSE 'wrong_type' END AS outcome FROM t LEFT JOIN b ON t.id = b.id
  UNION ALL SELECT g.type, 'spurious' FROM g ANTI JOIN t ON t.d = g.d AND t.s < g.e AND g.s < t.e)
SELECT coalesce(type, 'all') AS type, count(*) FILTER (outcome = 'exact') AS exact, count(*) FILTER (outcome = 'wrong_type') AS wrong_type, count(*) FILTER (outcome = 'partial') AS partial,
  count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'spurious') AS spurious FROM o GROUP BY ROLLUP (type)""",
    "residual_scan": " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, count(*) AS n FROM ({each(pattern)}) HAVING count(*) > 0"
        for kind, pattern in (
            ("email", r"[A-Za-z0-9._%+\-]{2,}\s{0,3}@\s{0,3}\.?[A-Za-z0-9.\-]{2,}\.[A-Za-z]{2,}"),
            ("codice_fiscale", r"\b[A-Z]{6}[0-9O]{2}[A-Z][0-9O]{2}[A-Z][0-9O]{3}[A-Z]\b"),
            ("telefono_mobile", r"(?:\+\s?39\s?)?\b3[0-9]{2}[\s.\-/]?[0-9]{3}[\s.\-/]?[0-9]{3,4}\b"),
            ("targa", r"\b[A-Z]{2}\s?[0-9]{3}\s?[A-Z]{2}\b"),
            ("data_nascita", r"\b[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-](?:19|20)[0-9]{2}\b"),
        )
    ),
    "dictionary_ambiguity": """
WITH t AS (SELECT DISTINCT lower(p_name) AS token FROM part), w AS (SELECT token, list_reduce(string_split(token, ' '), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS word FROM t
) SELECT token, word IN (SELECT split_part(p_name, ' ', 2) FROM part WHERE p_size < 10) AND token NOT IN (SELECT p_name FROM part WHERE p_size = 1) AS ambiguous FROM w""",
}
SQL["recall_rates"] = f"""
SELECT type, round((exact + wrong_type + partial) / (exact + wrong_type + partial + missing), 6) AS wide, round(exact / (exact + wrong_type + partial + missing), 6) AS strict
FROM ({SQL["recall_by_type"]}) WHERE exact + wrong_type + partial + missing > 0"""
SQL |= planted.oracles() | cases.oracles()
