import pytest
from pyspark.sql import functions as F

from revtables.operators.builtin_rules import default_rule_lists
from revtables.operators.regex_loops import open_loops
from revtables.operators.rules import (
    load_rule_lists,
    parse_rule_list,
    regex_problems,
    rule_counts,
    rule_list_of,
    rule_lists_frame,
    rules_frame,
    verify_rules,
)

GOOD = """
[file]
file_types = ["txt"]
exact_file_names = ["package.json"]
[[pattern]]
kind = "line"
family = "match"
header = '(\\w+)=[^\\n]*'
names = [1]
"""


def test_default_lists_are_sound(spark):
    lists = default_rule_lists()
    assert [r.name for r in lists] == [
        "rust", "csharp", "c", "ocaml", "toml", "json", "lua", "typescript", "javascript", "go",
    ]
    assert regex_problems(spark, lists) == []
    assert verify_rules(rules_frame(spark, lists)).collect() == []
    counts = {r.list: (r.rules, r.first_kind) for r in rule_counts(rules_frame(spark, lists)).collect()}
    assert counts["rust"] == (11, "struct") and counts["go"] == (6, "const")


def test_paths_find_their_list(spark):
    mine = parse_rule_list("mine", GOOD)
    wanted = {
        "lib/core.rs": "rust", "deep/er/than.that/mod.rs": "rust", "core.rss": None, "cores": None, "src.rs/readme": None,
        "notes.txt": "mine", "x/package.json": "mine", "my-package.json": None, "package.json.bak": None, "": None,
    }
    df = spark.createDataFrame([(p,) for p in wanted], "path string")
    only_rust = [r for r in default_rule_lists() if r.name == "rust"]
    got = {r.path: r.list for r in df.select("path", rule_list_of(F.col("path"), [*only_rust, mine]).alias("list")).collect()}
    assert got == wanted
    first = df.select(rule_list_of(F.lit("package.json"), [*default_rule_lists(), mine]).alias("list")).first()
    assert first.list == "json"


@pytest.mark.parametrize("missing", ["[file]", "[[pattern]]", "kind", "header", "names"])
def test_incomplete_lists_are_errors(missing):
    text = GOOD.replace(missing, "[other]" if missing == "[file]" else "[[other]]" if missing == "[[pattern]]" else "x" + missing)
    with pytest.raises(ValueError):
        parse_rule_list("bad", text)


def test_bad_files_do_not_stop_the_others(spark, tmp_path):
    (tmp_path / "good.toml").write_text(GOOD)
    (tmp_path / "bad.toml").write_text("[file]\n")
    (tmp_path / "broken.toml").write_text("=")
    (tmp_path / "regex.toml").write_text(GOOD.replace("header = '", "header = '("))
    lists, errors = load_rule_lists(spark, str(tmp_path))
    assert [r.name for r in lists] == ["good"]
    assert sorted(f.rsplit("/", 1)[-1] for f, _ in errors) == ["bad.toml", "broken.toml", "regex.toml"]


def test_version_follows_the_rules(spark):
    one = parse_rule_list("mine", GOOD)
    two = parse_rule_list("mine", GOOD + GOOD[GOOD.index("[[pattern]]") :])
    a, b = [rule_lists_frame(spark, [r]).first().rules_version for r in (one, two)]
    assert a != b and a == rule_lists_frame(spark, [one]).first().rules_version


def test_mistakes_are_found(spark):
    schema = rules_frame(spark, []).schema
    rows = [
        ("l", 0, 0, "block", "k", "(a)", [1], [], [], False),
        ("l", 0, 1, "block", "k", "", [], [], [], False),
        ("l", 0, 2, "tree", "k", r"\(a(?:b)", [1], [], [], False),
        ("l", 0, 3, "block", "k", "(a)", [1], ["x"], [("y", "is", "v")], False),
        ("l", 0, 4, "block", "k", r"(a)\((?:[^()]|\([^()|]*\))*\)", [1], [], [], False),
        ("l", 0, 5, "block", "k", r"(a)\((?:[^()]|\([^()|]*\))*+\)[(|)]*", [1], [], [], False),
    ]
    got = {(r.rule_no, r.problem) for r in verify_rules(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (1, "empty header"),
        (1, "no identifier"),
        (2, "unknown family"),
        (2, "unknown identifier group"),
        (3, "unknown capture"),
        (3, "unknown operator"),
        (4, "group loop that is not possessive"),
    }


@pytest.mark.parametrize(
    "regex,loops",
    [
        (r"f\((?:a+b)*\)", ["(?:a+b)*"]),
        (r"f\(((a|b)c)*\)", ["((a|b)c)*"]),
        (r"f\((?:(?:a|b)c)*\)", ["(?:(?:a|b)c)*"]),
        (r"(?:a|b)+?x", ["(?:a|b)+?"]),
        (r"(a|b){2,}", ["(a|b){2,}"]),
        (r"(?:x(?:a?b)*)*+", ["(?:a?b)*"]),
        (r"(?>a|b)*", ["(?>a|b)*"]),
        (r"(?<name>a*b)+", ["(?<name>a*b)+"]),
        (r"(?i:a|b)*", ["(?i:a|b)*"]),
        (r"([^)]|\))*", [r"([^)]|\))*"]),
        (r"(?:(x)\1)*", [r"(?:(x)\1)*"]),
        (r"(?:a(?=b|c))*", []),
        (r"(?:ab)*(?:a[|*+]b)+(\(\|x)*", []),
        (r"(?:a|b)*+(?:a+b)++(?:c?d){1,}+", []),
        (r"(a|b)?(?:a|b){3}(?:a+|b){0,20}", []),
        (r"[(a|b)*]*\Q(a|b)*\E\(a|b\)*", []),
        (r"[]|(a]*[^]|(a]+[a&&[^b|(]]*", []),
        (r"(?m:^(\S+)[^\n]*)(?s).*", []),
        (r"(?:\p{L}\x{41})*", []),
        (r"a)b|(c", []),
    ],
)
def test_loops_that_take_stack(regex, loops):
    assert open_loops(regex) == loops


def test_loops_that_are_not_reported_match_long_texts(spark):
    """40 kB of one construct; the reported ones would end this process."""
    text = "f(" + "ab" * 20_000 + ")"
    for regex in (r"f\((?:ab)*\)", r"f\((?:a+b)*+\)", r"f\((?:(?:a|b)[ab])*+\)", r"f\([ab]*\)"):
        assert open_loops(regex) == []
        assert spark.range(1).select(F.lit(text).rlike(regex)).first()[0]


def test_no_built_in_rule_has_an_open_loop():
    for rule_list in default_rule_lists():
        for rule in rule_list.rules:
            for regex in (rule.header, rule.before, rule.lead, rule.each, *[c for _, c in rule.captures]):
                assert not regex or open_loops(regex) == [], (rule_list.name, rule.kind, regex)
        for regex in (rule_list.mask, rule_list.opener, rule_list.closer, rule_list.end, rule_list.boundary, rule_list.extra):
            assert not regex or open_loops(regex) == [], (rule_list.name, regex)
