"""Named regions of files, found with rule lists.

One lossless tokenisation per content, on byte-wide text so that string positions
are byte positions; then running sums over the tokens of a file give offsets, rows,
columns and block levels. A file is one row to begin with, so its tokens are bounded
by that row; everything past the tokeniser works on short tokens, not on contents.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtables.functions.ranges import byte_size, checksum, contains_value, join_names, lacks_value, line_size
from revtables.functions.text import byte_text, newline_count, utf8_text
from revtables.operators.interval_join import interval_join
from revtables.operators.rules import Rule, RuleList, separator_of
from revtables.session import cut_lineage

FILE = ["oid", "list"]
# Regions reach over many tokens, so their buckets are wide.
BYTE_BUCKET = 4096


def _per_list(lists: Iterable[RuleList], value) -> Column:
    """CASE over the list name; each file pays only for its own list."""
    chosen = F
    for rule_list in lists:
        chosen = chosen.when(F.col("list") == rule_list.name, value(rule_list))
    return chosen


def _masked(text: Column, rule_list: RuleList) -> Column:
    """Blank out the pieces matched by ``mask``, keeping length and newlines."""
    if rule_list.mask is None:
        return text
    mask = f"(?sd)(?:{rule_list.mask})"
    blank = F.transform(F.regexp_extract_all(text, F.lit(mask), F.lit(0)), lambda hit: F.regexp_replace(hit, r"[^\n]", " "))
    # One more piece than hits: the last one stands alone.
    pieces = F.zip_with(
        F.split(text, mask, -1), blank, lambda plain, hit: F.concat(plain, F.coalesce(hit, F.lit("")))
    )
    return F.array_join(pieces, "")


def _ungrouped(regex: str) -> str:
    """The same regex with its capturing groups made non-capturing."""
    out, escaped, in_class = [], False, False
    for n, char in enumerate(regex):
        out.append(char)
        if escaped:
            escaped = False
        elif char == "\\":
            escaped = True
        elif char == "[":
            in_class = True
        elif char == "]":
            in_class = False
        elif char == "(" and not in_class and regex[n + 1 : n + 2] != "?":
            out.append("?:")
    return "".join(out)


def _token_regex(rule_list: RuleList) -> str:
    parts = [f"(?:{rule.header})(?={rule.before})" if rule.before else rule.header for rule in rule_list.rules]
    parts += [p for p in (rule_list.opener, rule_list.closer, rule_list.end, rule_list.boundary, rule_list.extra) if p]
    # Rules may share a header; each alternative is tried once.
    unique = list(dict.fromkeys(_ungrouped(p) for p in parts))
    start = f"(?={rule_list.start})" if rule_list.start else ""
    return f"(?sd){start}(?:" + "|".join(unique) + ")"


def tokens(files: DataFrame, lists: list[RuleList]) -> DataFrame:
    """(oid, list, pos, gap, token) over ``files`` (oid, list, content), one row per (oid, list).

    ``gap`` is the text between the previous token and this one; gaps and tokens in
    order rebuild the (masked) text exactly.
    """
    text = files.select(*FILE, byte_text(F.col("content")).alias("_text"))
    masked = text.select(*FILE, _per_list(lists, lambda r: _masked(F.col("_text"), r)).alias("_text"))

    gaps = _per_list(lists, lambda r: F.split(F.col("_text"), _token_regex(r), -1))
    found = _per_list(lists, lambda r: F.regexp_extract_all(F.col("_text"), F.lit(_token_regex(r)), F.lit(0)))
    # One more gap than tokens: the rest of the file, with an empty token.
    return (
        masked.select(*FILE, F.arrays_zip(gaps.alias("gap"), found.alias("token")).alias("_pairs"))
        # The outer form, or the planner would split every text twice: first to look for empty results, before any shuffle.
        .select(*FILE, F.posexplode_outer("_pairs").alias("pos", "_pair"))
        .where("_pair is not null")
        .select(*FILE, "pos", "_pair.gap", F.coalesce("_pair.token", F.lit("")).alias("token"))
    )


def _after_last_newline(text: Column) -> Column:
    return F.length(F.substring_index(text, "\n", -1)).cast("long")


def _has_blocks(lists: Iterable[RuleList]) -> bool:
    return any(r.opener or any(rule.family == "nested" for rule in r.rules) for r in lists)


def located_tokens(files: DataFrame, lists: list[RuleList]) -> DataFrame:
    """Tokens with start and end as byte, row and column, block level and block end."""
    gap, token = F.col("gap"), F.col("token")
    order = Window.partitionBy(*FILE).orderBy("pos")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(token).cast("long")
    none = F.lit(0).cast("long")
    after_gap_newline = F.when(newline_count(gap) > 0, F.col("start_byte") - _after_last_newline(gap))
    after_token_newline = F.when(newline_count(token) > 0, F.col("end_byte") - _after_last_newline(token))
    line_start = F.greatest(
        F.coalesce(F.max(after_gap_newline).over(order), none), F.coalesce(F.max(after_token_newline).over(earlier), none)
    )
    offsets = tokens(files, lists).withColumns(
        {
            "end_byte": F.sum(F.length(gap) + size).over(order).cast("long"),
            "end_row": F.sum(newline_count(gap) + newline_count(token)).over(order).cast("long"),
        }
    )
    placed = (
        offsets.withColumns({"start_byte": F.col("end_byte") - size, "start_row": F.col("end_row") - newline_count(token)})
        .withColumn("_line", line_start)
        .withColumns(
            {
                "start_col": F.col("start_byte") - F.col("_line"),
                "end_col": F.col("end_byte") - F.coalesce(after_token_newline, F.col("_line")),
            }
        )
        .drop("_line")
    )
    if not _has_blocks(lists):
        point = "struct<end_byte:bigint,end_row:bigint,end_col:bigint>"
        return placed.withColumns({"delta": F.lit(0), "depth": F.lit(0), "close": F.lit(None).cast(point)})

    def is_token(regex: str | None) -> Column:
        return token.rlike(f"(?sd)^(?:{_ungrouped(regex)})\\z") if regex else F.lit(False)

    def opens(rule_list: RuleList) -> Column:
        headers = [rule.header for rule in rule_list.rules if rule.family == "nested"]
        return is_token("|".join(p for p in [rule_list.opener, *headers] if p))

    delta = _per_list(lists, lambda r: F.when(is_token(r.closer), -1).when(opens(r), 1).otherwise(0))
    group = _per_list(lists, lambda r: F.lower(F.regexp_extract(token, r.group, 1)) if r.group else F.lit(""))
    nested = Window.partitionBy(*FILE, "group").orderBy("pos")
    # Tokens that neither open nor close have no level, so they never stand between the two.
    level = F.when(F.col("delta") == -1, F.col("depth") + 1).when(F.col("delta") == 1, F.col("depth"))
    same_level = Window.partitionBy(*FILE, "group", "level").orderBy("pos")
    closes = (F.col("delta") == 1) & (F.lead("delta").over(same_level) == -1)
    end = F.lead(F.struct("end_byte", "end_row", "end_col")).over(same_level)
    return (
        placed.withColumns({"delta": delta, "group": group})
        .withColumn("depth", F.sum("delta").over(nested))
        .withColumn("level", level)
        .withColumn("close", F.when(closes, end))
        .drop("group", "level")
    )


def passes_filters(token: Column, rule: Rule) -> Column:
    """All filters of a rule hold over what its captures take from a header.

    An unknown operator holds for nothing; ``verify_rules`` reports it.
    """
    kept = F.lit(True)
    regexes = dict(rule.captures)
    for f in rule.filters:
        captures = F.regexp_extract_all(token, F.lit(regexes[f.capture]), F.lit(1))
        check = {"contains": contains_value, "not-contains": lacks_value}.get(f.operator)
        kept = kept & (check(captures, F.lit(f.value)) if check else F.lit(False))
    return kept


def _candidates(number: int, rule: Rule) -> Column:
    """What a token says if it is a header of the rule: an array of matches, or NULL."""
    token = F.col("token")
    whole = f"(?sd)^(?:{rule.header})\\z"
    lead = F.regexp_extract(token, f"(?sd)^({_ungrouped(rule.lead)})", 1) if rule.lead else F.lit("")

    def match(names: Column) -> Column:
        return F.struct(
            F.lit(number).alias("rule_no"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.family).alias("family"),
            F.lit(rule.inside).cast("string").alias("inside"),
            names.alias("qualifiers"),
            lead.alias("lead"),
        )

    if rule.each:
        found = F.transform(
            F.regexp_extract_all(token, F.lit(rule.each), F.lit(1)), lambda name: match(F.array(utf8_text(name)))
        )
    else:
        found = F.array(match(F.array(*[utf8_text(F.regexp_extract(token, whole, g)) for g in rule.names])))
    return F.when(token.rlike(whole) & passes_filters(token, rule), found)


def rule_matches(files: DataFrame, lists: list[RuleList]) -> DataFrame:
    """Every match of every rule: (oid, list, seq, kind, qualifiers, range fields).

    ``seq`` is the document order: outer regions first, then by rule.
    """
    order = Window.partitionBy(*FILE).orderBy("pos")

    def following(column: str) -> Column:
        return F.lead(column).over(order)

    candidates = _per_list(
        lists, lambda r: F.flatten(F.array_compact(F.array(*[_candidates(n, x) for n, x in enumerate(r.rules)])))
    )
    families = {rule.family for rule_list in lists for rule in rule_list.rules}
    point = ["end_byte", "end_row", "end_col"]
    ends = _per_list(lists, lambda r: F.col("token").rlike(f"(?sd)^(?:{r.end})\\z") if r.end else F.lit(False))
    marked = located_tokens(files, lists).withColumns(
        {"candidates": candidates, "here": F.struct(*point), "ends": ends}
    )
    if families - {"match", "nested", "section"}:
        adjacent = following("gap") == ""
        marked = marked.withColumns(
            {
                "next_close": following("close"),
                "next_here": F.when(adjacent, following("here")),
                "next_gap": following("gap"),
                "next_opens": (following("delta") == 1) & adjacent,
                "next_ends": following("ends"),
            }
        )
    else:
        unknown = {"next_close": marked.schema["close"].dataType, "next_here": marked.schema["here"].dataType}
        marked = marked.withColumns(
            {
                **{name: F.lit(None).cast(type_) for name, type_ in unknown.items()},
                "next_gap": F.lit(None).cast("string"),
                "next_opens": F.lit(False),
                "next_ends": F.lit(False),
            }
        )
    if "section" in families:
        def starts_section(rule_list: RuleList) -> Column:
            headers = [rule.header for rule in rule_list.rules if rule.family in ("section", "block")]
            parts = [p for p in [rule_list.boundary, *headers] if p]
            return F.col("token").rlike(f"(?sd)^(?:{'|'.join(parts)})\\z") if parts else F.lit(False)

        starts = _per_list(lists, starts_section).cast("int")
        section = Window.partitionBy(*FILE, "_section")
        content = F.when(F.col("token") != "", F.struct(*point))
        marked = marked.withColumn("_section", F.sum(starts).over(order)).withColumn(
            "section_end", F.max(content).over(section)
        )
    if "pair" in families:
        # Value end: the last token before the separator that closes the pair.
        top_separator = ((F.col("token") == ",") & (F.col("depth") == 1)) | ((F.col("delta") == -1) & (F.col("depth") == 0))
        before = F.when(top_separator, F.lag("here").over(order))
        # From the last token back, so that each row takes one step.
        rest = Window.partitionBy(*FILE).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
        first = Window.partitionBy(*FILE)
        marked = (
            marked.withColumn("_before", before)
            .withColumn("value_end", F.min("_before").over(rest))
            .withColumn("_root", F.min_by("token", "pos").over(first))
        )
    if "file" in families:
        marked = marked.withColumn("file_end", F.max("here").over(Window.partitionBy(*FILE)))
    # A token of many candidates must not go along with each of them.
    carried = [c for c in marked.columns if c not in ("token", "gap", "candidates")]
    rows = marked.select(*carried, F.posexplode("candidates").alias("nth", "c"))
    family = F.col("c.family")
    end = (
        F.when(family.isin("block", "item") & F.col("next_opens"), F.col("next_close"))
        .when(family.isin("statement", "item") & F.col("next_ends"), F.col("next_here"))
        .when(family == "match", F.col("here"))
        .when(family == "nested", F.col("close"))
    )
    if "section" in families:
        end = end.when(family == "section", F.col("section_end"))
    if "pair" in families:
        is_key = (F.col("depth") == 1) & (F.col("_root") == "{") & F.col("next_gap").rlike(r"^\s*:")
        end = end.when((family == "pair") & is_key, F.col("value_end"))
    if "file" in families:
        end = end.when((family == "file") & F.col("next_ends"), F.col("file_end"))

    def from_start(value: Column) -> Column:
        return F.when(family == "file", F.lit(0)).otherwise(value).cast("long")

    lead = F.col("c.lead")
    lead_lines = newline_count(lead)
    column = F.when(lead_lines > 0, _after_last_newline(lead)).otherwise(F.col("start_col") + F.length(lead))
    document_order = Window.partitionBy(*FILE).orderBy("start_byte", F.desc("end_byte"), "rule_no", "pos", "nth")
    return (
        rows.withColumn("end", end)
        .where("end is not null")
        .select(
            *FILE,
            "pos",
            "nth",
            "c.rule_no",
            "c.kind",
            "c.inside",
            "c.qualifiers",
            from_start(F.col("start_byte") + F.length(lead)).alias("start_byte"),
            F.col("end.end_byte").alias("end_byte"),
            from_start(F.col("start_row") + lead_lines).alias("start_row"),
            from_start(column).alias("start_col"),
            F.col("end.end_row").alias("end_row"),
            F.col("end.end_col").alias("end_col"),
        )
        .withColumn("seq", F.row_number().over(document_order))
        .drop("pos", "rule_no", "nth")
    )


def with_full_names(matches: DataFrame) -> DataFrame:
    """Add full_qualifiers (names of all containing regions, then own) and parent_seq.

    A containment self-join as an interval join: every region's start looks up the
    regions around it. A region also finds itself, which carries its own columns
    through, so no second join is needed. Equal ranges nest by document order.
    """
    inner = matches.select(
        *FILE, F.col("seq").alias("_seq"), F.col("start_byte").alias("_start"), F.col("end_byte").alias("_end")
    )
    around = interval_join(inner, matches, FILE, "_start", "start_byte", "end_byte", BYTE_BUCKET).where(
        (F.col("end_byte") >= F.col("_end")) & (F.col("seq") <= F.col("_seq"))
    )
    itself = F.col("seq") == F.col("_seq")
    own = ["kind", "inside", "qualifiers", "start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col"]
    return (
        around.groupBy(*FILE, "_seq")
        .agg(
            *[F.max(F.when(itself, F.col(c))).alias(c) for c in own],
            F.flatten(
                F.transform(F.array_sort(F.collect_list(F.struct("seq", "qualifiers"))), lambda a: a["qualifiers"])
            ).alias("full_qualifiers"),
            F.max(F.when(~itself, F.col("seq"))).alias("parent_seq"),
            F.max_by("kind", F.when(~itself, F.col("seq"))).alias("parent_kind"),
        )
        .where("inside is null or inside = parent_kind")
        .drop("inside", "parent_kind")
        .withColumnRenamed("_seq", "seq")
    )


def merge_regions(named: DataFrame) -> DataFrame:
    """One row per (file, kind, full name) with the ranges of all its definitions in order."""
    fields = ["start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col"]
    return named.groupBy(*FILE, "kind", "full_qualifiers").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("range")))), lambda x: x["range"]
        ).alias("ranges"),
        F.min("seq").alias("first_seq"),
        F.min_by("qualifiers", "seq").alias("own_qualifiers"),
    )


def extract_regions(files: DataFrame, lists: list[RuleList]) -> DataFrame:
    """Regions of ``files`` (oid, list, content), one input row per (oid, list).

    Returns (oid, list, kind, qualifiers, full_qualifiers, ranges, line_size,
    byte_size, first_seq); ``qualifiers`` is the joined full name.
    """
    # Matches are looked up twice and are small next to the texts they come from.
    regions = merge_regions(with_full_names(cut_lineage(rule_matches(files, lists))))
    return regions.select(
        *FILE,
        "kind",
        join_names(F.col("full_qualifiers"), separator_of(F.col("list"), lists)).alias("qualifiers"),
        "full_qualifiers",
        "own_qualifiers",
        "ranges",
        line_size(F.col("ranges")).alias("line_size"),
        byte_size(F.col("ranges")).alias("byte_size"),
        "first_seq",
    )


def with_checksums(regions: DataFrame, files: DataFrame) -> DataFrame:
    """Add a hash of each region's bytes; the content is read and dropped in the same stage."""
    return (
        regions.join(files.select(*FILE, "content"), FILE)
        .withColumn("checksum", checksum(F.col("content"), F.col("ranges")))
        .drop("content")
    )


def regions_at(points: DataFrame, regions: DataFrame, on: list[str]) -> DataFrame:
    """Smallest region around each point (on.., point_id, row, col); no row for a point outside all.

    Rows are bucketed, then the exact (row, column) test runs, both ends inclusive.
    """
    ranges = regions.select(*on, "kind", "qualifiers", "byte_size", "first_seq", F.explode("ranges").alias("range")).select(
        *on, "kind", "qualifiers", "byte_size", "first_seq", "range.*"
    )
    ranges = cut_lineage(ranges)  # the join looks at them twice
    inside = interval_join(points, ranges, on, "row", "start_row", "end_row").where(
        F.struct(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c")).between(
            F.struct(F.col("start_row").alias("r"), F.col("start_col").alias("c")),
            F.struct(F.col("end_row").alias("r"), F.col("end_col").alias("c")),
        )
    )
    return inside.groupBy(*on, "point_id", "row", "col").agg(
        F.min_by(F.struct("kind", "qualifiers", "byte_size"), F.struct("byte_size", "first_seq")).alias("region")
    ).select(*on, "point_id", "row", "col", "region.*")
