"""DuckDB SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

from revtables.llm import mixing

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '{pattern}') AS ws FROM {table}"


OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS begins,
         length(text) + len(regexp_extract_all(text, '<\\*\|')) AS escaped
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       -- a block has its marks, role and two line ends; a further turn in it one separator
       CAST(sum(escaped + CASE WHEN begins THEN 12 + length(role) + 1 + 10 + 1 ELSE 10 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP6 = rf"""
WITH RECURSIVE words AS ({_words("documents", "doc_id", r"[^\x20\x09-\x0D]+")}),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k : k + least(3, len(ws)) - 1], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) AS k FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


def _op7() -> str:
    """The rounds written out one after another, over the cells."""
    topic = "CASE " + " ".join(f"WHEN contains(text, '{sign}') THEN '{name}'" for name, sign in mixing.TOPICS)
    topic += " WHEN length(coalesce(text, '')) < 500 THEN 'note' ELSE 'prose' END"
    m = ", ".join(mixing.MARGINS)
    parts = [
        f"""docs AS (SELECT doc_id, source, lang, {topic} AS topic,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)""",
        f"cells AS (SELECT {m}, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS weight FROM docs GROUP BY {m})",
    ]
    for name, power in mixing.POWERS.items():
        parts.append(
            f"""t_{name} AS (SELECT {name}, pow(t, {power}) / sum(pow(t, {power})) OVER () AS target
                FROM (SELECT {name}, CAST(sum(tokens) AS DOUBLE) AS t FROM cells GROUP BY {name}) WHERE t > 0)"""
        )
    last = "cells"
    for i in range(mixing.ROUNDS):
        for name in mixing.POWERS:
            parts.append(
                f"""r{i}_{name} AS (SELECT {m}, tokens, CASE WHEN sum(weight) OVER (PARTITION BY {name}) > 0
                    THEN weight / sum(weight) OVER (PARTITION BY {name}) * target ELSE 0 END AS weight
                    FROM {last} LEFT JOIN t_{name} USING ({name}))"""
            )
            last = f"r{i}_{name}"
    parts.append(
        f"""ratios AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio FROM {last}),
        steps AS (SELECT ratio, ({mixing.RATE} * all_t - whole) / open AS scale FROM (
          SELECT ratio, sum(t) OVER () AS all_t, coalesce(sum(t) OVER (ORDER BY ratio DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole,
                 sum(w) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open
          FROM (SELECT ratio, sum(tokens) AS t, sum(weight) AS w FROM ratios GROUP BY ratio)) WHERE open > 0),
        -- the first group that need not be taken whole sets the scale
        chosen AS (SELECT arg_max(scale, ratio) AS scale FROM steps WHERE scale * ratio < 1)"""
    )
    return f"""WITH {", ".join(parts)}
    SELECT doc_id, {m}, n_tokens, round(weight, 9) AS weight, round(least(1.0, ratio * scale), 9) AS probability,
           n_tokens > 0 AND CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / {float(1 << 48)} < least(1.0, ratio * scale) AS sampled
    FROM docs JOIN ratios USING ({m}), chosen"""


OP7 = _op7()

# Base32 of a digest: five bits each, from three hexadecimal digits that hold them.
OP8 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) || '00' AS h FROM pages),
d AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(h, CAST((5 * i) // 4 + 1 AS INTEGER), 3) AS BIGINT) >> CAST(7 - (5 * i) % 4 AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY 1) USING (payload_digest)
"""

_PHRASE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP10 = rf"""
WITH d AS ({_words("documents", "doc_id", _PHRASE)}), i AS ({_words("benchmark", "item_id", _PHRASE)}),
phrases AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[k : k + n - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
places AS (
  SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(ws) >= n)),
found AS (SELECT doc_id, n, k, item_id FROM places JOIN phrases USING (n, phrase)),
hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS w FROM found) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""

_SHARE = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"
_APART = "(({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q}))"
OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
langs AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN langs USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM langs GROUP BY lang),
groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(sizes.total, 0) AS of_lang, coalesce(c.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN sizes USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) c USING (lang, source)),
shares AS (
  SELECT lang, source, term, coalesce(counts.n, 0) AS n, {_SHARE.format(n="coalesce(counts.n, 0)", total="groups.total")} AS p, {_SHARE.format(n="langs.n", total="of_lang")} AS q
  FROM groups JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS one, y.source AS other, sum({_APART.format(p="x.p", q="y.p")}) AS value
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND one = a.source AND other = b.source),
terms AS (SELECT lang, source, term AS item, {_APART.format(p="p", q="q")} AS value FROM shares WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""

OP13 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 10
"""

ORACLES = {"op4_chat": OP4, "op6_near_duplicates": OP6, "op7_mixing": OP7, "op8_warc": OP8, "op10_decontamination": OP10, "op12_source_audit": OP12, "op13_exact_top_k": OP13}
