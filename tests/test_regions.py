import pytest
from pyspark.sql import functions as F

from revtables.operators.builtin_rules import default_rule_lists
from revtables.operators.regions import extract_regions, regions_at, tokens, with_checksums

SOURCES = {
    "rust": """/// doc { comment
#[derive(Debug)]
pub struct Foo { a: u32 }
struct Unit;
impl Foo {
    fn new(x: [u8; 4]) -> Self { if x { y() } }
    #[inline]
    pub fn go(&self) where T: X { let s = "}"; }
}
impl<T> Bar for Foo<T> { fn bar() {} }
impl Foo { const X: u8 = 1; }
#[test]
fn it_works() { fn inner() { } }
mod tests { type A = u8; }
trait T2 { type B; fn x(); }
enum E { A, B }
""",
    "json": '{"a": {"b": [1,2,{"c": 3}]}, "d" : "x,y{", "e": 12 }',
    "toml": 'top = 1\n[deps]\na = "x" # c\nb = [\n 1,\n 2]\n\n[x.y]\nc = 1\n[next]\n',
    "lua": "local M = {}\nfunction M.foo(a)\n if a then return 1 end\nend\n"
    "local function bar() for i=1,2 do x() end end\nM.baz = function() end\nfunction M:meth() end\n",
    "go": "package x\nconst (\n\tA = 1\n\tB = 2\n)\ntype I interface {\n\tGet(x int) string\n}\ntype S struct { a int }\n"
    'func (s S) Name(x interface{}) string { return "{" }\nfunc (s *S) Ptr() {}\nfunc main() {\n\tfmt.Println(x)\n}\n',
    "javascript": "function a(x) { if (x) { b() } }\n"
    "class K extends L { m(x) { return [1].map(function() { return 2 }) } static get n() {} }\n",
    "typescript": "interface I { a: string }\ntype T = string;\n"
    "export class K { private async m(x: I): Promise<void> { for (let i=0;i<1;i++) {} } }\nfunction f(): void {}\n",
    "c": '#include "x.h"\nstruct p { int x; };\n'
    "static int *main(int argc, char **argv) { if (x) { } else if (y) { } return foo(x); }\n",
    "csharp": "namespace A {\n [Attr]\n public class K : L {\n private readonly int x = 5;\n"
    " public string P { get; set; }\n public int Q => 5;\n public async Task<int> M(int a) { return F(a); }\n"
    " public K(int a) { }\n }\n interface I { void R(); }\n}\n",
    "ocaml": "(* doc *)\nlet add x y =\n  let z = x in\n  z + y\n\nmodule M = struct\n  let f = fun x -> x\nend\n\nlet v = 1\n",
}

# Kind, full name and lines of each region.
EXPECTED = {
    "rust": {
        ("struct", "Foo", 1),
        ("struct", "Unit", 1),
        ("impl", "Foo", 6),
        ("fn", "Foo::new", 1),
        ("fn", "Foo::go", 2),
        ("trait_impl", "Foo<T>::Bar", 1),
        ("fn", "Foo<T>::Bar::bar", 1),
        ("const", "Foo::X", 1),
        ("test", "it_works", 2),
        ("fn", "it_works::inner", 1),
        ("mod", "tests", 1),
        ("type", "tests::A", 1),
        ("trait", "T2", 1),
        ("type", "T2::B", 1),
        ("enum", "E", 1),
    },
    "json": {("property", "a", 1), ("property", "d", 1), ("property", "e", 1)},
    "toml": {
        ("property", "top", 1),
        ("table", "deps", 5),
        ("property", "deps.a", 1),
        ("property", "deps.b", 3),
        ("property", "c", 1),
        ("table", "next", 1),
    },
    "lua": {("function", "foo", 3), ("function", "bar", 1), ("function", "baz", 1), ("function", "meth", 1)},
    "go": {
        ("const", "A", 4),
        ("const", "A.B", 4),
        ("interface", "I", 3),
        ("method", "I.Get", 1),
        ("struct", "S", 1),
        ("method", "S.Name", 1),
        ("function", "main", 3),
    },
    "javascript": {("function", "a", 1), ("class", "K", 1), ("method", "K.m", 1), ("method", "K.n", 1)},
    "typescript": {
        ("interface", "I", 1),
        ("type", "T", 1),
        ("class", "K", 1),
        ("method", "K.m", 1),
        ("function", "f", 1),
    },
    "c": {("struct", "p", 1), ("function", "*main(int argc, char **argv)", 1)},
    "csharp": {
        ("namespace", "A", 11),
        ("class", "A.K", 8),
        ("field", "A.K.x", 1),
        ("property", "A.K.P", 1),
        ("property", "A.K.Q", 1),
        ("method", "A.K.M", 1),
        ("interface", "A.I", 1),
        ("method", "A.I.R", 1),
    },
    "ocaml": {("function", "add", 4), ("module", "M", 3), ("function", "M.f", 1)},
}


def files(spark, sources):
    return spark.createDataFrame(
        [(name, name.split("/")[0], bytearray(text.encode())) for name, text in sources.items()],
        "oid string, list string, content binary",
    )


@pytest.fixture(scope="module")
def found(spark):
    return extract_regions(files(spark, SOURCES), default_rule_lists()).collect()


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_regions_of_each_language(found, language):
    assert {(r.kind, r.qualifiers, r.line_size) for r in found if r.oid == language} == EXPECTED[language]


def test_ranges_are_exact(found):
    source = SOURCES["rust"].encode()
    ranges = {(r.kind, r.qualifiers): [source[x.start_byte : x.end_byte] for x in r.ranges] for r in found if r.oid == "rust"}
    assert ranges["struct", "Foo"] == [b"pub struct Foo { a: u32 }"]
    assert ranges["fn", "Foo::go"] == [b'#[inline]\n    pub fn go(&self) where T: X { let s = "}"; }']
    assert [r[:10] for r in ranges["impl", "Foo"]] == [b"impl Foo {", b"impl Foo {"]
    assert ranges["test", "it_works"] == [b"#[test]\nfn it_works() { fn inner() { } }"]


def test_rows_and_columns(found):
    for r in found:
        text = SOURCES[r.oid].encode()
        for x in r.ranges:
            for byte, row, col in ((x.start_byte, x.start_row, x.start_col), (x.end_byte, x.end_row, x.end_col)):
                assert row == text[:byte].count(b"\n")
                assert col == byte - (text[:byte].rfind(b"\n") + 1)


def rust(spark, text):
    rows = extract_regions(files(spark, {"rust": text}), default_rule_lists()).orderBy("first_seq").collect()
    return [(r.kind, r.qualifiers, [(x.start_byte, x.end_byte) for x in r.ranges]) for r in rows]


def test_two_structs(spark):
    text = "\nstruct A {\n    b: u8,\n    c: }\n\nstruct Other {}\n".replace("c: }", "}")
    assert [(k, q) for k, q, _ in rust(spark, text)] == [("struct", "A"), ("struct", "Other")]


def test_nested_functions(spark):
    text = "fn main() { fn one() { fn deep() {} } fn two() {} }"
    assert [q for _, q, _ in rust(spark, text)] == ["main", "main::one", "main::one::deep", "main::two"]


def test_repeated_blocks_are_one_region(spark):
    text = "impl Foo { fn baz() {} }\nimpl Bar {}\nimpl Foo {}\nimpl Foo {}\n"
    got = {(k, q): len(r) for k, q, r in rust(spark, text)}
    assert got == {("impl", "Foo"): 3, ("fn", "Foo::baz"): 1, ("impl", "Bar"): 1}


def test_bytes_beyond_ascii(spark):
    text = "// ünïcode\nfn größe() { \"ß}\" }\nstruct Ä;\n"
    got = rust(spark, text)
    data = text.encode()
    assert [(q, data[a:b].decode()) for _, q, [(a, b)] in got] == [("größe", 'fn größe() { "ß}" }'), ("Ä", "struct Ä;")]


def test_unclosed_blocks_and_empty_files(spark):
    assert rust(spark, "fn a() { fn b() {} ") == [("fn", "b", [(9, 18)])]
    assert rust(spark, "") == []
    assert rust(spark, "}}} fn a() {}") == [("fn", "a", [(4, 13)])]


def test_file_scoped_namespace_is_the_whole_file(spark):
    text = "using X;\nnamespace A.B;\nclass K { }\n"
    rows = extract_regions(files(spark, {"csharp": text}), default_rule_lists()).orderBy("first_seq").collect()
    assert [(r.kind, r.qualifiers, r.ranges[0].start_byte, r.ranges[0].end_byte) for r in rows] == [
        ("namespace", "A.B", 0, len(text)),
        ("class", "A.B.K", 24, 35),
    ]


def test_tokens_keep_every_byte(spark):
    sources = files(spark, SOURCES)
    total = tokens(sources, default_rule_lists()).groupBy("oid").agg(F.sum(F.length("gap") + F.length("token")).alias("n"))
    assert {r.oid: r.n for r in total.collect()} == {k: len(v.encode()) for k, v in SOURCES.items()}


def test_checksums_see_only_the_region(spark):
    a, b = "fn x() { 1 }\nfn y() { 2 }\n", "// moved\nfn x() { 1 }\nfn y() { 3 }\n"
    both = files(spark, {"rust/a": a, "rust/b": b})
    got = with_checksums(extract_regions(both, default_rule_lists()), both).collect()
    sums = {(r.oid, r.qualifiers): r.checksum for r in got}
    assert sums["rust/a", "x"] == sums["rust/b", "x"]
    assert sums["rust/a", "y"] != sums["rust/b", "y"]


def test_innermost_region_at_a_point(spark):
    found = extract_regions(files(spark, {"rust": "fn a() {\n  fn b() {\n  }\n}\n"}), default_rule_lists())
    points = spark.createDataFrame(
        [("rust", 0, 0, 0), ("rust", 1, 1, 5), ("rust", 2, 2, 3), ("rust", 3, 2, 4), ("rust", 4, 4, 0)],
        "oid string, point_id int, row long, col long",
    )
    got = {r.point_id: r.qualifiers for r in regions_at(points, found, ["oid"]).collect()}
    assert got == {0: "a", 1: "a::b", 2: "a::b", 3: "a"}


# One construct of each list, as long as wanted: a function of its size in parts.
LONG = {
    "rust": lambda n: "fn f(" + "a: u8, " * n + ") { }\nimpl<" + "T, " * n + "> X { }\nconst A: u8 = [" + "1, " * n + "];\n",
    "csharp": lambda n: "class K { void F(" + "int a, " * n + ") { } int P { " + "x " * n + "get; } }\n",
    "c": lambda n: "#define A " + "x \\\n" * n + "\nint f(" + "int a, " * n + ") { }\n",
    "ocaml": lambda n: "(* " + "x * " * n + " *)\nlet f " + "a " * n + "= a\n",
    "toml": lambda n: "[t]\na = [" + "1, " * n + "]\nb = [" + "[1], " * n + "]\n",
    "json": lambda n: '{"a": [' + "1, " * n + "2]}",
    "lua": lambda n: "a." * n + "b = function() end\nfunction g(" + "a, " * n + "b) end\n",
    "typescript": lambda n: "class K { m(" + "a, " * n + ") { } }\nfunction f(" + "a, " * n + ") { }\n",
    "javascript": lambda n: "class K { m(" + "a, " * n + "(b)) { } }\n",
    "go": lambda n: "const (\n" + "\tA = 1\n" * n + ")\nfunc f(" + "a int, " * n + ") { }\n",
}


@pytest.mark.parametrize("language", sorted(LONG))
def test_long_constructs_of_each_language(spark, language):
    lists = [r for r in default_rule_lists() if r.name == language]
    sizes = {"short": 3, "long": 300 if language == "go" else 3000}
    df = spark.createDataFrame(
        [(k, language, bytearray(LONG[language](n).encode())) for k, n in sizes.items()], "oid string, list string, content binary"
    )
    found = {(r.oid, r.kind) for r in extract_regions(df, lists).collect()}
    assert {k for o, k in found if o == "long"} == {k for o, k in found if o == "short"} != set()
