"""DuckDB SQL that states the operators' results, where SQL can express them."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, THRESHOLD, WORD, need
from .secrets import BASE_RULES, EXTRA_RULES, Rule

LOWER_AZ = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH n AS (SELECT doc_id, {LOWER_AZ.format("text")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""

OP7 = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path,
       (SELECT arg_max(u.host || u.path, length(u.host || u.path)) FROM rules u WHERE (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)) AS rule,
       coalesce((SELECT arg_max(u.verdict, length(u.host || u.path)) FROM rules u WHERE (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)), 'allow') AS verdict
FROM p
"""


def _any_case(pattern: str) -> str:
    """``(?i:...)`` spelt out for A-Z, since DuckDB's own folding also takes other letters."""
    head, _, rest = pattern.partition("(?i:")
    if not rest:
        return pattern
    depth, at = 1, 0
    while depth:
        depth += {"(": 1, ")": -1}.get(rest[at], 0)
        at += 1
    inner = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in rest[: at - 1])
    return f"{head}(?:{inner}){rest[at:]}"


def _spans(n: int, rule: Rule) -> str:
    pattern = _any_case(rule.pattern).replace("'", "''")
    return f"""SELECT doc_id, {n} AS n, '{rule.kind}' AS kind, regexp_split_to_array(x, '{pattern}') AS gaps, regexp_extract_all(x, '{pattern}', 0) AS hits,
  regexp_extract_all(x, '{pattern}', {rule.group}) AS kept, {rule.least} AS least FROM t"""


OP4 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS ({" UNION ALL ".join(_spans(n, r) for n, r in enumerate(BASE_RULES + EXTRA_RULES))}),
e AS (SELECT doc_id, n, kind, hits[i] AS hit, kept[i] AS kept, least,
  CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS start FROM m, unnest(range(1, len(hits) + 1)) u(i)),
f AS (SELECT doc_id, n, kind, start, kind || ':' || start || ':' || start + length(hit) AS said FROM e WHERE length(kept) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(said, ',' ORDER BY start, n) FILTER (n < {len(BASE_RULES)}) AS base, string_agg(said, ',' ORDER BY start, n) AS spans FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON a.doc_id = t.doc_id
"""

_QUOTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_PLACES = " UNION ALL ".join(
    f"SELECT r, '{label}' AS label, i FROM w, unnest(range(len(ws))) u(i) WHERE ws[i + 1] = '{p.split()[0]}' AND ws[i + 1:i + {len(p.split())}] = {_QUOTED(p.split())}" for p, label in PHRASES
)
_TEMPLATES = ", ".join(f"('{label}', {_QUOTED(sorted(set(text.split())))}, {need(len(set(text.split())), THRESHOLD)}, {2 * len(text.split())})" for label, text in TEMPLATES)

#: Blocks are the lines, and every run of words (or the whole, if shorter) of twice a template's length.
OP9 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {LOWER_AZ.format("text")} AS x FROM documents), w AS (SELECT r, doc_id, x, regexp_extract_all(x, '{WORD}') AS ws FROM t),
p AS ({_PLACES}), b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM p GROUP BY r), v(label, tw, least, width) AS (VALUES {_TEMPLATES}),
l AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(x, chr(10))), '{WORD}')) AS block FROM t),
open AS (SELECT r, ws, label, tw, least, width FROM w, v WHERE len(list_intersect(list_distinct(ws), tw)) >= least),
c AS (SELECT r, label, len(list_intersect(block, tw)) / len(tw) AS share FROM l, v WHERE len(list_intersect(block, tw)) >= least
  UNION ALL SELECT r, label, share FROM (SELECT r, label, least, len(tw) AS size, len(list_intersect(list_distinct(ws[i:i + width - 1]), tw)) AS common, common / size AS share
    FROM open, unnest(range(1, 2 + greatest(0, len(ws) - width))) u(i)) WHERE common >= least),
y AS (SELECT r, label FROM p UNION SELECT r, label FROM c),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM p) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM y GROUP BY r), best AS (SELECT r, max(share) AS best FROM c GROUP BY r)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b ON b.r = w.r LEFT JOIN bl ON bl.r = w.r LEFT JOIN al ON al.r = w.r LEFT JOIN best ON best.r = w.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": OP4, "op7_urls": OP7, "op8_exact_dedup": OP8, "op9_licenses": OP9}
