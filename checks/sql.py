"""Shared pieces of the SQL the queries are compared with."""

from __future__ import annotations

STAR = """
base AS (
  SELECT l_orderkey AS commit_id, CAST(epoch(o_orderdate) AS BIGINT) AS seconds_since_epoch, p_type AS kind,
         p_name || '#' || CAST(p_partkey AS VARCHAR) AS qualifiers, p_brand AS file_path,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS novel_lhs,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS novel_rhs,
         max(CAST(p_size AS BIGINT)) AS size_after
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3, 4, 5),
changes AS (
  SELECT * FROM base
  UNION ALL
  SELECT commit_id, seconds_since_epoch, 'file', '', file_path, CAST(sum(novel_lhs) AS BIGINT),
         CAST(sum(novel_rhs) AS BIGINT), CAST(sum(size_after) AS BIGINT)
  FROM base GROUP BY 1, 2, 5)
"""

# The symbol of checks.fixtures.star_symbol.
ONE = """
one AS (
  SELECT p_type AS kind, p_name || '#' || CAST(p_partkey AS VARCHAR) AS qualifiers, p_brand AS file_path
  FROM part WHERE p_partkey = (SELECT min(l_partkey) FROM lineitem))
"""

COMMITS = """
commits AS (
  SELECT o_orderkey AS commit_id, CAST(epoch(o_orderdate) AS BIGINT) AS author_seconds,
         (o_custkey % 25 - 12) * 3600 AS author_offset, o_orderpriority || chr(10) || chr(10) || o_orderstatus AS message
  FROM orders)
"""

LOG = """
log AS (
  SELECT c.*, strftime(make_timestamp((author_seconds + author_offset) * 1000000), '%d.%m.%Y') AS date,
         split_part(message, chr(10) || chr(10), 1) AS title,
         CASE WHEN contains(message, chr(10) || chr(10))
              THEN substr(message, instr(message, chr(10) || chr(10)) + 2) END AS body
  FROM changes c SEMI JOIN one USING (kind, qualifiers, file_path) JOIN commits m ON c.commit_id = m.commit_id)
"""

CHAIN = """
chain AS (
  SELECT o_orderkey AS commit_id, CAST(epoch(o_orderdate) AS BIGINT) AS seconds_since_epoch,
         lag(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) AS parent_id,
         row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS position
  FROM orders)
"""


def with_(*parts: str, body: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + body


def version(name: str, keep: str, change: str) -> str:
    """One version of the documents; see checks.fixtures.document_versions."""
    edited = (
        "array_to_string(list_filter(list_transform(string_split(text, chr(10)),"
        " lambda x, i: CASE WHEN (i - 1) % 11 = 6 THEN x || ' *' ELSE x END),"
        " lambda x, i: (i - 1) % 5 <> 3), chr(10))"
    )
    content = f"CASE WHEN {change} THEN {edited} ELSE text END"
    return f"""
{name} AS (
  SELECT doc_id, path, content, sha1('blob ' || strlen(content) || chr(0) || content) AS oid FROM (
    SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang AS path, {content} AS content
    FROM documents WHERE {keep}))
"""


BEFORE = version("before", "doc_id % 10 <> 0", "false")
AFTER = version("after", "doc_id % 10 <> 1", "doc_id % 7 = 0")
INDEX = version("idx", "doc_id % 13 <> 0", "doc_id % 13 = 5")

NEWLINES = "CAST(length({0}) - length(replace({0}, chr(10), '')) AS BIGINT)"


def newlines(column: str) -> str:
    return NEWLINES.format(column)


def line_count(column: str) -> str:
    return f"{newlines(column)} + CASE WHEN {column} <> '' AND NOT ends_with({column}, chr(10)) THEN 1 ELSE 0 END"


def diff(prefix: str, before: str, after: str) -> str:
    """Symbol diff of two versions with the prose list, as CTEs ending in ``{prefix}diff``.

    Symbols are the lines that start with the same word. Lines are matched copy by
    copy, which is what an ordered diff comes to when lines are only dropped or
    changed in place.
    """
    return f"""
{prefix}files AS (
  SELECT coalesce(b.path, a.path) AS path, b.content AS bc, a.content AS ac,
         CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
  FROM {before} b FULL JOIN {after} a ON b.path = a.path
  WHERE b.oid IS DISTINCT FROM a.oid),
{prefix}lines AS (
  SELECT path, change, 'lhs' AS side, unnest(string_split(bc, chr(10))) AS line FROM {prefix}files WHERE bc IS NOT NULL
  UNION ALL
  SELECT path, change, 'rhs', unnest(string_split(ac, chr(10))) FROM {prefix}files WHERE ac IS NOT NULL),
{prefix}counts AS (
  SELECT path, change, line, regexp_extract(line, '^(\\S+)', 1) AS word,
         count(*) FILTER (side = 'lhs') AS l, count(*) FILTER (side = 'rhs') AS r
  FROM {prefix}lines GROUP BY 1, 2, 3, 4),
{prefix}words AS (
  SELECT path, change, word AS qualifiers, sum(l) AS l, sum(r) AS r,
         CAST(sum(greatest(l - r, 0)) AS BIGINT) AS nl, CAST(sum(greatest(r - l, 0)) AS BIGINT) AS nr
  FROM {prefix}counts WHERE word <> '' GROUP BY 1, 2, 3),
{prefix}whole AS (
  SELECT path, change, CAST(sum(greatest(l - r, 0)) AS BIGINT) AS nl, CAST(sum(greatest(r - l, 0)) AS BIGINT) AS nr
  FROM {prefix}counts WHERE change = 'modified' GROUP BY 1, 2),
{prefix}diff AS (
  SELECT CASE WHEN l = 0 THEN 'added' WHEN r = 0 THEN 'deleted' ELSE 'modified' END AS change, 'line' AS kind,
         qualifiers, path AS file_path, CASE WHEN l > 0 THEN nl END AS novel_lhs, CASE WHEN r > 0 THEN nr END AS novel_rhs
  FROM {prefix}words WHERE nl + nr > 0
  UNION ALL
  SELECT change, 'file', '', path, nl, nr FROM {prefix}whole
  UNION ALL
  SELECT change, 'file', '', path, CASE WHEN change = 'deleted' THEN {newlines('bc')} END,
         CASE WHEN change = 'added' THEN {newlines('ac')} END
  FROM {prefix}files WHERE change <> 'modified')
"""


# Novel lines of the modified documents, copy by copy.
PAIRS = """
pairs AS (
  SELECT b.doc_id, b.content AS bc, a.content AS ac FROM before b JOIN after a ON b.doc_id = a.doc_id WHERE b.oid <> a.oid),
sides AS (
  SELECT doc_id, 'lhs' AS side, unnest(string_split(bc, chr(10))) AS line,
         generate_subscripts(string_split(bc, chr(10)), 1) - 1 AS row FROM pairs
  UNION ALL
  SELECT doc_id, 'rhs', unnest(string_split(ac, chr(10))), generate_subscripts(string_split(ac, chr(10)), 1) - 1 FROM pairs),
copies AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, side, line ORDER BY row) AS k FROM sides),
novel AS (
  SELECT c.doc_id, c.side, CAST(c.row AS BIGINT) AS row, c.line FROM copies c
  WHERE NOT EXISTS (FROM copies o WHERE o.doc_id = c.doc_id AND o.side <> c.side AND o.line = c.line AND o.k = c.k))
"""

TAGS = "nav|article|div|ul|li|h1|p|a"
PAGES = f"""
masked AS (
  SELECT page_id, html, array_to_string(list_transform(
    regexp_extract_all(html, '(?s)(<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|[^<]+|<)'),
    lambda t: CASE WHEN starts_with(t, '<!--') OR starts_with(t, '<script') OR starts_with(t, '<style')
                   THEN regexp_replace(t, '[^\\n]', ' ', 'g') ELSE t END), '') AS text
  FROM pages),
pieces AS (
  SELECT page_id, html, unnest(regexp_extract_all(text, '(<[^>]*>|[^<]+|<)')) AS token,
         generate_subscripts(regexp_extract_all(text, '(<[^>]*>|[^<]+|<)'), 1) AS pos
  FROM masked),
placed AS (
  SELECT page_id, html, pos, token,
         CAST(sum(length(token)) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS c_end
  FROM pieces),
tags AS (
  SELECT page_id, pos, token, lower(regexp_extract(token, '^</?([a-zA-Z0-9]+)', 1)) AS tag,
         CASE WHEN starts_with(token, '</') THEN -1 ELSE 1 END AS delta,
         strlen(substr(html, 1, c_end - length(token))) AS start_byte, strlen(substr(html, 1, c_end)) AS end_byte,
         {newlines("substr(html, 1, c_end - length(token))")} AS start_row,
         {newlines("substr(html, 1, c_end)")} AS end_row
  FROM placed WHERE regexp_matches(token, '^(<({TAGS})\\b[^>]*>|</({TAGS})\\s*>)$')),
depths AS (
  SELECT *, sum(delta) OVER (PARTITION BY page_id, tag ORDER BY pos) AS depth FROM tags),
levels AS (
  SELECT *, CASE WHEN delta = -1 THEN depth + 1 ELSE depth END AS level FROM depths),
closed AS (
  SELECT *, lead(delta) OVER w AS next_delta, lead(end_byte) OVER w AS close_byte, lead(end_row) OVER w AS close_row
  FROM levels WINDOW w AS (PARTITION BY page_id, tag, level ORDER BY pos)),
found AS (
  SELECT page_id, CASE WHEN tag = 'a' THEN 'link' ELSE tag END AS kind,
         CASE WHEN tag = 'a' THEN regexp_extract(token, 'href="([^"]*)"', 1) ELSE tag END AS name,
         start_byte, close_byte AS end_byte, start_row, close_row AS end_row,
         row_number() OVER (PARTITION BY page_id ORDER BY start_byte, close_byte DESC) AS seq
  FROM closed WHERE delta = 1 AND next_delta = -1 AND (tag <> 'a' OR regexp_matches(token, 'href="[^"]*"'))),
named AS (
  SELECT f.page_id, f.seq, f.kind, f.name, f.start_byte, f.end_byte, f.start_row, f.end_row,
         string_agg(o.name, ' > ' ORDER BY o.seq) AS qualifiers,
         max(o.seq) FILTER (o.seq < f.seq) AS parent_seq
  FROM found f JOIN found o ON f.page_id = o.page_id AND o.seq <= f.seq
       AND o.start_byte <= f.start_byte AND o.end_byte >= f.end_byte
  GROUP BY ALL),
regions AS (
  SELECT page_id, kind, qualifiers, count(*) AS ranges, min(start_byte) AS first_byte,
         CAST(sum(end_row - start_row + 1) AS BIGINT) AS line_size,
         CAST(sum(end_byte - start_byte + 1) AS BIGINT) AS byte_size, min(seq) AS first_seq
  FROM named GROUP BY 1, 2, 3)
"""
