"""Queries over regions: extraction, nesting, sizes, filters and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.sql import AFTER, BEFORE, PAGES, PAIRS, with_
from revtables.functions import ranges as rg
from revtables.operators import attribution, regions, rules
from revtables.operators.interval_join import interval_join
from revtables.operators.line_diff import line_diff, novel_lines
from revtables.plans import reports
from revtables.plans.symbols import symbols_of_paths
from revtables.session import cut_lineage


def _page():
    return F.col("oid").alias("page_id")


def _doc():
    return F.col("oid").alias("doc_id")



def _page_regions(spark: SparkSession, sf: str) -> DataFrame:
    return regions.extract_regions(fx.page_files(spark, sf), [fx.HTML])


def _line_regions(spark: SparkSession, sf: str) -> DataFrame:
    return regions.extract_regions(fx.document_files(spark, sf), [fx.PROSE])


def page_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps and tokens of a page add up to its bytes."""
    pieces = regions.tokens(fx.page_files(spark, sf), [fx.HTML])
    return pieces.groupBy(_page()).agg(F.sum(F.length("gap") + F.length("token")).alias("bytes"))


def page_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = regions.rule_matches(fx.page_files(spark, sf), [fx.HTML])
    return found.select(
        _page(), "kind", F.element_at("qualifiers", 1).alias("name"), "start_byte", "end_byte", "start_row", "end_row"
    )


def page_region_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every region with its place in the nest of regions."""
    named = regions.with_full_names(cut_lineage(regions.rule_matches(fx.page_files(spark, sf), [fx.HTML])))
    return named.select(
        _page(), "seq", "parent_seq", "kind", F.array_join("full_qualifiers", " > ").alias("qualifiers"), "start_byte"
    )


def page_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of one name merged, with their sizes."""
    return _page_regions(spark, sf).select(
        _page(),
        "kind",
        "qualifiers",
        F.size("ranges").alias("ranges"),
        rg.first_byte(F.col("ranges")).alias("first_byte"),
        "line_size",
        "byte_size",
    )


def page_region_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """First and last byte over all ranges of a region."""
    return _page_regions(spark, sf).select(
        _page(),
        "kind",
        "qualifiers",
        F.array_min(F.transform("ranges", lambda r: r["start_byte"])).alias("start_byte"),
        F.array_max(F.transform("ranges", lambda r: r["end_byte"])).alias("end_byte"),
    )


def page_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _page_regions(spark, sf).groupBy("kind").agg(F.count("*").alias("regions"), F.sum("byte_size").alias("bytes"))


def page_containment(spark: SparkSession, sf: str) -> DataFrame:
    """How many matches each match contains."""
    found = cut_lineage(regions.rule_matches(fx.page_files(spark, sf), [fx.HTML]))
    inner = found.select("oid", F.col("seq").alias("inner"), F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    outer = found.select("oid", "seq", "kind", "start_byte", "end_byte")
    held = interval_join(inner, outer, ["oid"], "s", "start_byte", "end_byte", regions.BYTE_BUCKET).where(
        rg.contains_range(F.col("start_byte"), F.col("end_byte"), F.col("s"), F.col("e")) & (F.col("inner") != F.col("seq"))
    )
    return held.groupBy(_page(), "seq", "kind").agg(F.count("*").alias("inside"))


def _page_symbols(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.page_files(spark, sf)
    paths = files.select(F.concat(F.col("oid").cast("string"), F.lit(".html")).alias("file_path"), "oid", "list")
    return symbols_of_paths(paths, files, [fx.HTML])


def _bytes_json(symbols: DataFrame) -> DataFrame:
    short = symbols.withColumn(
        "ranges", F.transform("ranges", lambda r: F.struct(r["start_byte"].alias("start_byte"), r["end_byte"].alias("end_byte")))
    )
    return reports.symbol_json(short)


def page_symbols_json(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of one range."""
    return _bytes_json(_page_symbols(spark, sf).where(F.size("ranges") == 1))


def page_symbols_json_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """All symbols, with every range of each."""
    return _bytes_json(_page_symbols(spark, sf))


def page_symbol_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.symbol_lines(_page_symbols(spark, sf))


def page_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Capture filters of three operators over the links of each page."""
    pages = fx.table(spark, sf, "pages")

    def passes(*filters: tuple[str, str]):
        kept = tuple(rules.CaptureFilter("href", o, v) for o, v in filters)
        rule = rules.Rule("page", "file", "", captures=(("href", 'href="([^"]*)"'),), filters=kept)
        return regions.passes_filters(F.col("html"), rule)

    return pages.select(
        "page_id",
        passes(("contains", "/The")).alias("has"),
        passes(("not-contains", "/The")).alias("lacks"),
        passes(("contains", "/to"), ("not-contains", "/The")).alias("both"),
        passes(("matches", "/The")).alias("unknown"),
    )


def line_regions(spark: SparkSession, sf: str) -> DataFrame:
    return _line_regions(spark, sf).select(
        _doc(),
        "kind",
        "qualifiers",
        F.array_join(F.transform("ranges", lambda r: r["start_row"].cast("string")), ",").alias("rows"),
        F.array_join(F.transform("ranges", lambda r: r["start_byte"].cast("string")), ",").alias("starts"),
        "line_size",
        "byte_size",
    )


def line_region_checksums(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.document_files(spark, sf)
    found = regions.with_checksums(regions.extract_regions(files, [fx.PROSE]), files)
    return found.select(_doc(), "qualifiers", "checksum")


def lines_in_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Lines 0, 4 and 8 of a document, and points past an end, tested against each region."""
    found = _line_regions(spark, sf)
    return found.select(
        _doc(),
        "qualifiers",
        *[rg.contains_line(F.col("ranges"), F.lit(n)).alias(f"line_{n}") for n in (0, 4, 8)],
        rg.contains_point(F.col("ranges"), F.lit(0), F.lit(3)).alias("point"),
        rg.contains_point(F.col("ranges"), F.lit(1), F.lit(10000)).alias("beyond"),
    )


def every_fourth_line_in_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth line of a document up to one past its end, with the regions that hold it."""
    n_lines = F.size(F.split(F.decode("content", "ISO-8859-1"), "\n", -1))
    counts = fx.document_files(spark, sf).select("oid", F.explode(F.sequence(F.lit(0), n_lines + 3, F.lit(4))).alias("line"))
    counts = counts.withColumn("line", F.col("line").cast("long"))
    held = _line_regions(spark, sf).join(counts, "oid").where(rg.contains_line(F.col("ranges"), F.col("line")))
    return held.select(_doc(), "qualifiers", "line")


def regions_at_points(spark: SparkSession, sf: str) -> DataFrame:
    """Innermost region at points spread over the first line of every page."""
    files = fx.page_files(spark, sf)
    first_line = F.substring_index(F.decode("content", "ISO-8859-1"), "\n", 1)
    points = files.select(
        "oid",
        F.posexplode(F.array(*[F.floor(F.length(first_line) * k / 23) for k in range(23)])).alias("point_id", "col"),
        F.lit(0).cast("long").alias("row"),
    )
    found = regions.regions_at(points, _page_regions(spark, sf), ["oid"])
    return found.select(_page(), "point_id", "col", "kind", "qualifiers")


def regions_at_points_of_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Innermost region at 23 points of every line of every page."""
    lines = fx.page_files(spark, sf).select("oid", F.posexplode(F.split(F.decode("content", "ISO-8859-1"), "\n", -1)).alias("row", "_line"))
    points = lines.select(
        "oid",
        F.col("row").cast("long").alias("row"),
        F.posexplode(F.array(*[F.floor(F.length("_line") * k / 23) for k in range(23)])).alias("point_id", "col"),
    )
    found = regions.regions_at(points, _page_regions(spark, sf), ["oid"])
    return found.select(_page(), "row", "point_id", "col", "kind", "qualifiers")


def _nested(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every fourth line of each page, the ranges of its nested regions, and their names."""
    found = cut_lineage(_page_regions(spark, sf))
    n_lines = F.size(F.split(F.decode("content", "ISO-8859-1"), "\n", -1)).cast("long")
    lines = fx.page_files(spark, sf).select("oid", F.explode(F.sequence(F.lit(0).cast("long"), n_lines - 1, F.lit(4).cast("long"))).alias("line"))
    return lines, attribution.region_rows(found, ["oid"]), found.select("oid", "kind", "full_qualifiers", "qualifiers")


def lines_per_nested_region(spark: SparkSession, sf: str) -> DataFrame:
    """Lines count for every region around them."""
    lines, ranges, names = _nested(spark, sf)
    counts = attribution.count_in_all(lines, ranges, ["oid"])
    return counts.join(names, ["oid", "kind", "full_qualifiers"]).select(_page(), "kind", "qualifiers", "novel")


def lines_per_innermost_region(spark: SparkSession, sf: str) -> DataFrame:
    """Lines count for the smallest region around them alone, the earlier one of two equally large."""
    lines, ranges, names = _nested(spark, sf)
    counts = attribution.count_in_innermost(lines, ranges, ["oid"])
    return counts.join(names, ["oid", "kind", "full_qualifiers"]).select(_page(), "kind", "qualifiers", "novel")


def _novel(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Novel lines of changed documents and the regions of both of their versions."""
    pairs = cut_lineage(fx.document_pairs(spark, sf))
    lines = novel_lines(line_diff(pairs), ["doc_id"])
    sides = pairs.select("doc_id", F.explode(F.create_map(F.lit("lhs"), "before", F.lit("rhs"), "after")).alias("side", "content"))
    files = sides.select(
        F.struct("doc_id", "side").alias("oid"), F.lit(fx.PROSE.name).alias("list"), "content"
    )
    found = cut_lineage(regions.extract_regions(files, [fx.PROSE])).select("oid.doc_id", "oid.side", "*")
    return lines, attribution.region_rows(found, ["doc_id", "side"])


def novel_lines_per_region(spark: SparkSession, sf: str) -> DataFrame:
    counted = attribution.count_in_all(*_novel(spark, sf), ["doc_id", "side"])
    return counted.select("doc_id", "side", F.element_at("full_qualifiers", -1).alias("qualifiers"), "novel")


def novel_lines_per_innermost(spark: SparkSession, sf: str) -> DataFrame:
    counted = attribution.count_in_innermost(*_novel(spark, sf), ["doc_id", "side"])
    return counted.select("doc_id", "side", F.element_at("full_qualifiers", -1).alias("qualifiers"), "novel")


def _part_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as rules of lists named by brand, some of them with mistakes."""
    key = F.col("p_partkey")
    return fx.table(spark, sf, "part").select(
        F.col("p_brand").alias("list"),
        key.cast("int").alias("rule_no"),
        F.when(key % 11 == 0, "tree").otherwise("block").alias("family"),
        F.col("p_type").alias("kind"),
        F.when(key % 13 == 0, "").otherwise(F.concat(F.lit("("), "p_name", F.lit(r") \(x\) (?:y)"))).alias("header_regex"),
        F.when(key % 7 == 0, F.array().cast("array<int>"))
        .when(key % 7 == 1, F.array(F.lit(1), F.lit(2)))
        .otherwise(F.array(F.lit(1)))
        .alias("identifier_groups"),
        F.array(F.lit("attr")).alias("captures"),
        F.array(
            F.struct(
                F.when(key % 5 == 0, "other").otherwise("attr").alias("capture"),
                F.when(key % 3 == 0, "equals").otherwise("contains").alias("operator"),
                F.lit("x").alias("value"),
            )
        ).alias("filters"),
    )


def rules_per_list(spark: SparkSession, sf: str) -> DataFrame:
    return rules.rule_counts(_part_rules(spark, sf))


def rule_problems(spark: SparkSession, sf: str) -> DataFrame:
    return rules.verify_rules(_part_rules(spark, sf))


def user_rules_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A list written as a user would write it, with a filter and two names."""
    text = r"""
[file]
file_types = ["html"]
[qualifier]
separator = "/"
[tokens]
mask = "<!--.*?-->|<script\\b.*?</script>"
opener = "<article\\b[^>]*>"
closer = "</article>"
[[pattern]]
kind = "article"
family = "nested"
header = "<(article)\\b[^>]*>"
names = [1]
[[pattern]]
kind = "link"
family = "match"
header = "<(a) href=\"/([a-z]+)\">"
names = [2, 1]
[pattern.captures]
target = "href=\"/([^\"]*)\""
[[pattern.filters]]
capture = "target"
operator = "not-contains"
value = "to"
"""
    mine = rules.parse_rule_list("html", text)
    return regions.extract_regions(fx.page_files(spark, sf), [mine]).select(
        _page(), "kind", "qualifiers", F.size("ranges").alias("ranges")
    )


QUERIES = {
    f.__name__: f
    for f in (
        page_tokens,
        page_matches,
        page_region_names,
        page_regions,
        page_region_bounds,
        page_kinds,
        page_containment,
        page_symbols_json,
        page_symbols_json_of_all,
        page_symbol_lines,
        page_filters,
        line_regions,
        line_region_checksums,
        lines_in_regions,
        every_fourth_line_in_regions,
        regions_at_points,
        regions_at_points_of_all_rows,
        novel_lines_per_region,
        novel_lines_per_innermost,
        lines_per_nested_region,
        lines_per_innermost_region,
        rules_per_list,
        rule_problems,
        user_rules_on_pages,
    )
}

LINES = """
lines AS (
  SELECT doc_id, row, line, regexp_extract(line, '^(\\S+)', 1) AS word,
         coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY row
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents)),
words AS (SELECT * FROM lines WHERE word <> '')
"""
HAS = "len(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: x = '{0}')) > 0"
NOVEL_WORDS = """
SELECT doc_id, side, regexp_extract(line, '^(\\S+)', 1) AS qualifiers, count(*) AS novel FROM novel
WHERE regexp_matches(line, '^\\S') GROUP BY ALL
"""
PART_RULES = r"""
rules AS (
  SELECT p_brand AS list, CAST(p_partkey AS INTEGER) AS rule_no, p_type AS kind, p_partkey AS k FROM part)
"""

HELD_LINES = """
page_lines AS (
  SELECT page_id, unnest(range(0, len(string_split(html, chr(10))), 4)) AS line FROM pages),
held AS (
  SELECT l.page_id, l.line, r.kind, r.qualifiers, r.byte_size, r.first_seq FROM page_lines l
  JOIN named n ON l.page_id = n.page_id AND start_row <= line AND end_row >= line
  JOIN regions r ON r.page_id = n.page_id AND r.kind = n.kind AND r.qualifiers = n.qualifiers)"""

ORACLES = {
    "page_tokens": "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes FROM pages",
    "page_matches": with_(PAGES, body="SELECT page_id, kind, name, start_byte, end_byte, start_row, end_row FROM found"),
    "page_region_names": with_(
        PAGES,
        body="""SELECT page_id, CAST(seq AS INTEGER) AS seq, CAST(parent_seq AS INTEGER) AS parent_seq, kind, qualifiers, start_byte
FROM named""",
    ),
    "page_regions": with_(
        PAGES,
        body="""SELECT page_id, kind, qualifiers, CAST(ranges AS INTEGER) AS ranges, first_byte, line_size, byte_size
FROM regions""",
    ),
    "page_region_bounds": with_(
        PAGES,
        body="""SELECT page_id, kind, qualifiers, min(start_byte) AS start_byte, max(end_byte) AS end_byte
FROM named GROUP BY ALL""",
    ),
    "page_kinds": with_(
        PAGES, body="SELECT kind, count(*) AS regions, CAST(sum(byte_size) AS BIGINT) AS bytes FROM regions GROUP BY 1"
    ),
    "page_containment": with_(
        PAGES,
        body="""SELECT o.page_id, CAST(o.seq AS INTEGER) AS seq, o.kind, count(*) AS inside FROM found o JOIN found i
ON o.page_id = i.page_id AND o.seq <> i.seq AND o.start_byte <= i.start_byte AND o.end_byte >= i.end_byte GROUP BY ALL""",
    ),
    "page_symbols_json": with_(
        PAGES,
        body="""SELECT CAST(json_object('kind', kind, 'qualifiers', qualifiers, 'file_path', page_id || '.html', 'ranges',
[{'start_byte': any_value(start_byte), 'end_byte': any_value(end_byte)}]) AS VARCHAR) AS json
FROM named GROUP BY page_id, kind, qualifiers HAVING count(*) = 1""",
    ),
    "page_symbols_json_of_all": with_(
        PAGES,
        body="""SELECT CAST(json_object('kind', kind, 'qualifiers', qualifiers, 'file_path', page_id || '.html', 'ranges',
list({'start_byte': start_byte, 'end_byte': end_byte} ORDER BY seq)) AS VARCHAR) AS json
FROM named GROUP BY page_id, kind, qualifiers""",
    ),
    "page_symbol_lines": with_(
        PAGES, body="SELECT kind || ' ' || qualifiers || ' ' || page_id || '.html' AS line FROM regions"
    ),
    "page_filters": f"""SELECT page_id, {HAS.format("/The")} AS has, NOT ({HAS.format("/The")}) AS lacks,
({HAS.format("/to")}) AND NOT ({HAS.format("/The")}) AS both, false AS unknown FROM pages""",
    "line_regions": with_(
        LINES,
        body="""SELECT doc_id, 'line' AS kind, word AS qualifiers, string_agg(CAST(row AS VARCHAR), ',' ORDER BY row) AS rows,
string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR), ',' ORDER BY row) AS starts, count(*) AS line_size,
CAST(sum(strlen(line) + 1) AS BIGINT) AS byte_size FROM words GROUP BY ALL""",
    ),
    "line_region_checksums": with_(
        LINES,
        body="""SELECT doc_id, word AS qualifiers, sha256(string_agg(line, '' ORDER BY row)) AS checksum
FROM words GROUP BY ALL""",
    ),
    "lines_in_regions": with_(
        LINES,
        body="""SELECT doc_id, word AS qualifiers, bool_or(row = 0) AS line_0, bool_or(row = 4) AS line_4,
bool_or(row = 8) AS line_8, bool_or(row = 0 AND strlen(line) >= 3) AS point,
bool_or(row = 1 AND strlen(line) >= 10000) AS beyond FROM words GROUP BY ALL""",
    ),
    "regions_at_points": with_(
        PAGES,
        """points AS (
  SELECT page_id, k AS point_id, CAST(floor(strlen(split_part(html, chr(10), 1)) * k / 23) AS BIGINT) AS col
  FROM pages, range(23) t(k)),
held AS (
  SELECT p.page_id, point_id, col, r.kind, r.qualifiers, r.byte_size, r.first_seq FROM points p
  JOIN named n ON p.page_id = n.page_id AND start_row = 0 AND start_byte <= col AND (end_row > 0 OR end_byte >= col)
  JOIN regions r ON r.page_id = n.page_id AND r.kind = n.kind AND r.qualifiers = n.qualifiers)""",
        body="""SELECT page_id, CAST(point_id AS INTEGER) AS point_id, col, kind, qualifiers FROM held
QUALIFY row_number() OVER (PARTITION BY page_id, point_id ORDER BY byte_size, first_seq) = 1""",
    ),
    "every_fourth_line_in_regions": with_(
        LINES, body="SELECT doc_id, word AS qualifiers, CAST(row AS BIGINT) AS line FROM words WHERE row % 4 = 0"
    ),
    "regions_at_points_of_all_rows": with_(
        PAGES,
        """page_lines AS (
  SELECT page_id, row, strlen(line) AS n, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY page_id ORDER BY row
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line,
               generate_subscripts(string_split(html, chr(10)), 1) - 1 AS row FROM pages)),
points AS (
  SELECT page_id, row, k AS point_id, CAST(floor(n * k / 23) AS BIGINT) AS col, start + CAST(floor(n * k / 23) AS BIGINT) AS byte
  FROM page_lines, range(23) t(k)),
held AS (
  SELECT p.page_id, p.row, point_id, col, r.kind, r.qualifiers, r.byte_size, r.first_seq FROM points p
  JOIN named n ON p.page_id = n.page_id AND start_byte <= byte AND end_byte >= byte
  JOIN regions r ON r.page_id = n.page_id AND r.kind = n.kind AND r.qualifiers = n.qualifiers)""",
        body="""SELECT page_id, CAST(row AS BIGINT) AS row, CAST(point_id AS INTEGER) AS point_id, col, kind, qualifiers FROM held
QUALIFY row_number() OVER (PARTITION BY page_id, row, point_id ORDER BY byte_size, first_seq) = 1""",
    ),
    "lines_per_nested_region": with_(
        PAGES, HELD_LINES, body="SELECT page_id, kind, qualifiers, count(DISTINCT line) AS novel FROM held GROUP BY ALL"
    ),
    "lines_per_innermost_region": with_(
        PAGES,
        HELD_LINES,
        """
first AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY page_id, line ORDER BY byte_size, first_seq) = 1)""",
        body="SELECT page_id, kind, qualifiers, count(*) AS novel FROM first GROUP BY ALL",
    ),
    "novel_lines_per_region": with_(BEFORE, AFTER, PAIRS, body=NOVEL_WORDS),
    "novel_lines_per_innermost": with_(BEFORE, AFTER, PAIRS, body=NOVEL_WORDS),
    "rules_per_list": with_(
        PART_RULES, body="SELECT list, count(*) AS rules, arg_min(kind, rule_no) AS first_kind FROM rules GROUP BY 1"
    ),
    "rule_problems": with_(
        PART_RULES,
        body="""SELECT list, rule_no, unnest(list_filter([
CASE WHEN k % 13 = 0 THEN 'empty header' END, CASE WHEN k % 11 = 0 THEN 'unknown family' END,
CASE WHEN k % 7 = 0 THEN 'no identifier' END,
CASE WHEN k % 7 = 1 OR (k % 13 = 0 AND k % 7 <> 0) THEN 'unknown identifier group' END,
CASE WHEN k % 5 = 0 THEN 'unknown capture' END, CASE WHEN k % 3 = 0 THEN 'unknown operator' END],
lambda x: x IS NOT NULL)) AS problem FROM rules""",
    ),
    "user_rules_on_pages": r"""
WITH masked AS (
  SELECT page_id, array_to_string(list_filter(
    regexp_extract_all(html, '(?s)(<!--.*?-->|<script\b.*?</script>|[^<]+|<)'),
    lambda t: NOT (starts_with(t, '<!--') OR starts_with(t, '<script'))), '') AS text FROM pages),
articles AS (
  SELECT page_id, text, instr(text, '<article') AS s, instr(text, '</article>') AS e FROM masked),
links AS (
  SELECT page_id, unnest(regexp_extract_all(substr(text, 1, s - 1), '<a href="/([a-z]+)">', 1)) AS name, false AS inside FROM articles
  UNION ALL
  SELECT page_id, unnest(regexp_extract_all(substr(text, s, e - s), '<a href="/([a-z]+)">', 1)), true FROM articles
  UNION ALL
  SELECT page_id, unnest(regexp_extract_all(substr(text, e), '<a href="/([a-z]+)">', 1)), false FROM articles)
SELECT page_id, 'article' AS kind, 'article' AS qualifiers, CAST(1 AS INTEGER) AS ranges FROM articles WHERE s > 0 AND e > s
UNION ALL
SELECT page_id, 'link', CASE WHEN inside THEN 'article/' ELSE '' END || name || '/a', CAST(count(*) AS INTEGER) FROM links
WHERE name <> 'to' GROUP BY ALL""",
}
