"""Registered queries of this package, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import re

from . import rule_ledger, url_vocabulary
from .feistel_pii import op5_feistel_pii
from .grace_dedup import op7_grace_dedup
from .merge_replay import op10_merge_replay
from .packing import op2_best_two_fit
from .parity_join import op8_parity_join
from .rule_ledger import op4_rule_ledger
from .secret_battery import op3_secret_battery
from .token_planes import op1_token_planes
from .url_vocabulary import op6_url_vocabulary
from .warc_writer import op9_warc_shards

QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_best_two_fit": op2_best_two_fit,
    "op3_secret_battery": op3_secret_battery,
    "op4_rule_ledger": op4_rule_ledger,
    "op5_feistel_pii": op5_feistel_pii,
    "op6_url_vocabulary": op6_url_vocabulary,
    "op7_grace_dedup": op7_grace_dedup,
    "op8_parity_join": op8_parity_join,
    "op9_warc_shards": op9_warc_shards,
    "op10_merge_replay": op10_merge_replay,
}

_WORDS = r"[^\x20\x09-\x0D]+"
_EDGE = r"""[.,;:!?"''()\[\]]"""


def _rules_sql() -> str:
    return " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(rule_ledger.RULES))


def _rule_sql(n: int = 0) -> str:
    """The longest fitting rule's text, or its verdict, as nested conditions."""
    whens = []
    for r in sorted(url_vocabulary.RULES, key=lambda r: -len(r.text)):
        whens.append(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{(r.text, r.verdict)[n]}'")
    return f"CASE {' '.join(whens)} END"


def _apart(term: str) -> str:
    """A term as it stands in a URL whose separators have spaces about them."""
    return "' " + re.sub(r"([^\w])", r" \1 ", term) + " '"


def _hits_sql(terms) -> str:
    """The terms that a URL has between boundaries, as a list."""
    return f"[x FOR x IN [{', '.join(map(_apart, terms))}] IF contains(low, x)]"


def _weights_sql() -> str:
    """The sum of the weights of soft terms found."""
    by: dict[int, list[str]] = {}
    for term, weight in url_vocabulary.SOFT.items():
        by.setdefault(weight, []).append(_apart(term))
    return " + ".join(f"{w} * len([x FOR x IN w IF x IN ({', '.join(ts)})])" for w, ts in by.items())


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op4_rule_ledger": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
        grams AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
        twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
        l AS (SELECT *, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_WORDS}')] AS ls FROM t),
        m AS (
            SELECT l.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                   coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len([x FOR x IN w IF regexp_matches(regexp_replace(x, '^{_EDGE}+|{_EDGE}+$', '', 'g'), '^\p{{L}}+$')]) AS n_alpha_words,
                   len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]]) AS n_echo_words
            FROM l LEFT JOIN rep USING (doc_id)
        ),
        f AS (SELECT *, ({_rules_sql()})::BIGINT AS failed_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f
    """,
    "op6_url_vocabulary": rf"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                          CASE WHEN contains(url, '://') THEN ' ' || regexp_replace(translate(url, '{_UPPER}', '{_LOWER}'), '([^\p{{L}}\p{{N}}])', ' \1 ', 'g') || ' ' ELSE '' END AS low FROM pages),
        h AS (SELECT *, {_rule_sql()} AS rule, {_rule_sql(1)} AS told, {_hits_sql(url_vocabulary.STRICT)} AS s, {_hits_sql(url_vocabulary.SOFT)} AS w FROM u)
        SELECT page_id, host, path, rule, coalesce(told, CASE WHEN len(s) >= 1 OR len(w) >= {url_vocabulary.SOFT_DISTINCT} AND {_weights_sql()} >= {url_vocabulary.SOFT_WEIGHT} THEN 'block' ELSE 'allow' END) AS verdict FROM h
    """,
    "op7_grace_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
        g AS (SELECT bare, count(*) AS group_size FROM t GROUP BY bare),
        b AS (SELECT bare, doc_id AS keep_id FROM t QUALIFY row_number() OVER (PARTITION BY bare ORDER BY length(text) DESC, doc_id) = 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256
        FROM t JOIN g USING (bare) JOIN b USING (bare)
    """,
    "op8_parity_join": rf"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS g FROM t),
        x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c WHERE 100 * k >= 80 * (na + nb - k)),
        r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.d)
        SELECT s.doc_id, len(s.g) AS n_shingles, (SELECT count(*) FROM e WHERE e.a = s.doc_id) AS n_similar, (SELECT min(o) FROM r WHERE r.d = s.doc_id) AS component_id FROM s
    """,
    "op9_warc_shards": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
        v AS (SELECT *, [('0x' || substr(x, 5 * i + 1, 5))::INT FOR i IN range(8)] AS q, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, strlen(h) AS payload_bytes, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> k) & 31)::INT + 1, 1) FOR k IN [15, 10, 5, 0]], '') FOR n IN q], '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM v
    """,
}
