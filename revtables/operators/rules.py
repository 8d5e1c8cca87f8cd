"""Rules that say which named regions a file type has, as plain data.

A rule list belongs to a set of file types and describes how its text is cut into
tokens: pieces to blank out (comments, strings), headers (one regex per rule),
openers and closers of blocks, and statement ends. A rule gives the kind of the
region, the regex groups of its names, and how far the region reaches:

``block``    from the header to the closer of the opener that follows it
``statement``  from the header to the statement end that follows it
``item``     either of the two
``match``    the header itself
``nested``   the header is an opener; to its closer at the same level of its group
``section``  from the header to the last token before the next section header
``pair``     a key at the top level of a document, to the end of its value
``file``     the whole file
"""

from __future__ import annotations

import hashlib
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtables.functions.paths import has_type
from revtables.operators.regex_loops import open_loops

FAMILIES = ("block", "statement", "item", "match", "nested", "section", "pair", "file")
OPERATORS = ("contains", "not-contains")


@dataclass(frozen=True)
class CaptureFilter:
    capture: str
    operator: str
    value: str


@dataclass(frozen=True)
class Rule:
    kind: str
    family: str
    header: str
    names: tuple[int, ...] = (1,)
    # What must follow the header without being part of it.
    before: str | None = None
    # Leading text of the header that is not part of the region.
    lead: str | None = None
    # Captures for filters: name -> regex whose first group is collected.
    captures: tuple[tuple[str, str], ...] = ()
    filters: tuple[CaptureFilter, ...] = ()
    hidden: bool = False
    # One match per capture of this regex in the header, instead of ``names``.
    each: str | None = None
    # Kind the directly containing region must have.
    inside: str | None = None


@dataclass(frozen=True)
class RuleList:
    name: str
    separator: str
    file_types: tuple[str, ...]
    rules: tuple[Rule, ...]
    exact_file_names: tuple[str, ...] = ()
    mask: str | None = None
    opener: str | None = None
    closer: str | None = None
    end: str | None = None
    # Group of an opener or closer, as a regex group of the token; blocks of
    # different groups are matched independently.
    group: str | None = None
    # Tokens that end a section.
    boundary: str | None = None
    # Other tokens the families need to see.
    extra: str | None = None
    # What every token begins with; only saves time.
    start: str | None = None
    text: str = field(default="", compare=False)


RULES = T.StructType(
    [
        T.StructField("list", T.StringType(), False),
        T.StructField("load_order", T.IntegerType(), False),
        T.StructField("rule_no", T.IntegerType(), False),
        T.StructField("family", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("header_regex", T.StringType(), False),
        T.StructField("identifier_groups", T.ArrayType(T.IntegerType()), False),
        T.StructField("captures", T.ArrayType(T.StringType()), False),
        T.StructField(
            "filters",
            T.ArrayType(
                T.StructType([T.StructField(n, T.StringType()) for n in ("capture", "operator", "value")])
            ),
            False,
        ),
        T.StructField("hidden", T.BooleanType(), False),
    ]
)

RULE_LISTS = T.StructType(
    [
        T.StructField("list", T.StringType(), False),
        T.StructField("load_order", T.IntegerType(), False),
        T.StructField("separator", T.StringType(), False),
        T.StructField("file_types", T.ArrayType(T.StringType()), False),
        T.StructField("exact_file_names", T.ArrayType(T.StringType()), False),
        T.StructField("rules_version", T.StringType(), True),
    ]
)


def rules_frame(spark: SparkSession, lists: Iterable[RuleList]) -> DataFrame:
    rows = [
        (
            rule_list.name,
            order,
            number,
            rule.family,
            rule.kind,
            rule.header,
            list(rule.names),
            [name for name, _ in rule.captures],
            [(f.capture, f.operator, f.value) for f in rule.filters],
            rule.hidden,
        )
        for order, rule_list in enumerate(lists)
        for number, rule in enumerate(rule_list.rules)
    ]
    return spark.createDataFrame(rows, RULES)


def rules_version(rule_list: RuleList) -> str:
    """A digest that changes whenever a rule of the list does."""
    return hashlib.sha256((rule_list.text or repr(rule_list)).encode()).hexdigest()


def rule_lists_frame(spark: SparkSession, lists: Iterable[RuleList]) -> DataFrame:
    """One row per list; ``rules_version`` changes whenever a rule of the list does."""
    rows = [
        (r.name, order, r.separator, list(r.file_types), list(r.exact_file_names), rules_version(r))
        for order, r in enumerate(lists)
    ]
    return spark.createDataFrame(rows, RULE_LISTS)


def rule_counts(rules: DataFrame) -> DataFrame:
    """Number of rules of each list, with the kind of its first rule."""
    return rules.groupBy("list").agg(
        F.count("*").alias("rules"), F.min_by("kind", "rule_no").alias("first_kind")
    )


def group_count(regex: Column) -> Column:
    """Capturing groups of a regex: open brackets that are neither escaped nor ``(?``."""
    plain = F.regexp_replace(regex, r"\\.", "")
    return F.size(F.regexp_extract_all(plain, F.lit(r"(\((?:[^?]|$))"), F.lit(1)))


@F.pandas_udf(T.BooleanType())
def has_open_loop(regexes: pd.Series) -> pd.Series:
    """Whether a group is repeated without being possessive or of one fixed form; see ``open_loops``."""
    return regexes.map(lambda regex: bool(open_loops(regex)) if regex is not None else None)


def verify_rules(rules: DataFrame) -> DataFrame:
    """One row (list, rule_no, problem) for every mistake in a rules table."""
    groups = group_count(F.col("header_regex"))
    problems = F.array_compact(
        F.array(
            F.when(F.length("header_regex") == 0, "empty header"),
            F.when(~F.col("family").isin(*FAMILIES), "unknown family"),
            F.when(has_open_loop(F.col("header_regex")), "group loop that is not possessive"),
            F.when(F.size("identifier_groups") == 0, "no identifier"),
            F.when(F.exists("identifier_groups", lambda g: g > groups), "unknown identifier group"),
            F.when(
                F.exists("filters", lambda f: ~F.array_contains(F.col("captures"), f["capture"])), "unknown capture"
            ),
            F.when(F.exists("filters", lambda f: ~f["operator"].isin(*OPERATORS)), "unknown operator"),
        )
    )
    return rules.select("list", "rule_no", F.explode(problems).alias("problem"))


def regex_problems(spark: SparkSession, lists: Iterable[RuleList]) -> list[tuple[str, int, str]]:
    """(list, rule number, regex) of the regexes Spark cannot compile."""
    regexes = [
        (rule_list.name, number, regex)
        for rule_list in lists
        for number, rule in enumerate(rule_list.rules)
        for regex in [rule.header, rule.before, rule.lead, rule.each, *[c for _, c in rule.captures]]
        if regex
    ]

    def compiles(some: list[tuple[str, int, str]]) -> bool:
        try:
            spark.range(1).select(*[F.lit("").rlike(regex) for _, _, regex in some]).collect()
        except SparkRuntimeException:
            return False
        return True

    if not regexes or compiles(regexes):
        return []
    return [one for one in regexes if not compiles([one])]


def parse_rule_list(name: str, text: str) -> RuleList:
    """A user rule list from TOML text; raises ValueError naming what is missing."""
    data = tomllib.loads(text)
    for section in ("file", "pattern"):
        if section not in data:
            raise ValueError(f"missing section {section}")
    tokens = data.get("tokens", {})
    try:
        rules = tuple(
            Rule(
                kind=p["kind"],
                family=p["family"],
                header=p["header"],
                names=tuple(p["names"]),
                before=p.get("before"),
                lead=p.get("lead"),
                captures=tuple(p.get("captures", {}).items()),
                filters=tuple(CaptureFilter(f["capture"], f["operator"], f["value"]) for f in p.get("filters", [])),
                hidden=p.get("hidden", False),
                each=p.get("each"),
                inside=p.get("inside"),
            )
            for p in data["pattern"]
        )
    except KeyError as missing:
        raise ValueError(f"missing field {missing}") from None
    return RuleList(
        name=name,
        separator=data.get("qualifier", {}).get("separator", ""),
        file_types=tuple(data["file"].get("file_types", ())),
        exact_file_names=tuple(data["file"].get("exact_file_names", ())),
        rules=rules,
        text=text,
        **{k: tokens.get(k) for k in ("mask", "opener", "closer", "end", "group", "boundary", "extra", "start")},
    )


def load_rule_lists(spark: SparkSession, folder: str) -> tuple[list[RuleList], list[tuple[str, str]]]:
    """User lists of a folder of TOML files, and (file, error) for the bad ones.

    Rule files are configuration, a handful of small texts, hence read on the driver.
    """
    files = (
        spark.read.option("pathGlobFilter", "*.toml")
        .text(folder, wholetext=True)
        .select(F.input_file_name().alias("file"), "value")
        .orderBy("file")
        .collect()
    )
    lists, errors = [], []
    for row in files:
        name = row.file.rsplit("/", 1)[-1].removesuffix(".toml")
        try:
            rule_list = parse_rule_list(name, row.value)
        except ValueError as error:
            errors.append((row.file, str(error)))
            continue
        bad = regex_problems(spark, [rule_list])
        errors += [(row.file, f"regex of rule {number}: {regex}") for _, number, regex in bad]
        if not bad:
            lists.append(rule_list)
    return lists, errors


def rule_list_of(path: Column, lists: Iterable[RuleList]) -> Column:
    """Name of the first list, in load order, whose file names or types fit; else NULL.

    The lists are configuration, so routing is one CASE expression and no join.
    """
    routed = None
    for rule_list in lists:
        fits = has_type(path, list(rule_list.file_types), list(rule_list.exact_file_names))
        routed = F.when(fits, rule_list.name) if routed is None else routed.when(fits, rule_list.name)
    return routed if routed is not None else F.lit(None).cast("string")


def separator_of(list_name: Column, lists: Iterable[RuleList]) -> Column:
    chosen = None
    for rule_list in lists:
        is_list = list_name == rule_list.name
        chosen = F.when(is_list, rule_list.separator) if chosen is None else chosen.when(is_list, rule_list.separator)
    return F.coalesce(chosen, F.lit("")) if chosen is not None else F.lit("")
