"""The rule lists that are loaded by default, in load order.

Fixed values: kinds, separators, file types and the order of the lists and of the
names of a region. The headers are a lexical grammar of our own: text is split at
comments, strings, braces and statement ends, not parsed.
"""

from __future__ import annotations

from revtables.operators.rules import CaptureFilter, Rule, RuleList

NAME = r"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*"
LINE_COMMENT = r"//[^\n]*"
BLOCK_COMMENT = r"/\*.*?\*/"
DOUBLE_QUOTED = r'"(?:[^"\\]|\\.)*+"'
SINGLE_QUOTED = r"'(?:[^'\\\n]|\\.)*+'"
CHARACTER = r"'(?:[^'\\\n]|\\[^'\n]+|\\')'"
# Rest of a header up to its body or statement end; brackets may hold either.
REST = r"(?:\[[^\]]*\]|[^{};\[])*+"
# Round brackets that may hold brackets. Loops of groups are possessive throughout: the
# matcher then needs no stack for each round, so the length of a construct is no limit.
PARAMETERS = r"\([^(){};]*+(?:\([^(){};]*+\)[^(){};]*+)*+\)"
BRACES = {"opener": r"\{", "closer": r"\}", "end": ";"}


def _rust() -> RuleList:
    public = r"(?:\bpub(?:\s*\([^)]*\))?\s+)?"
    attributes = r"(?:#\[[^\]]*\]\s*)*+"
    function = rf"{attributes}{public}(?:\b(?:default|const|async|unsafe|extern)\s+)*+\bfn\s+({NAME}){REST}"
    generics = r"(?:\s*<(?:[^<>]++|<(?:[^<>]++|<[^<>]*+>)*+>)*+>)?"
    of_type = r"((?:(?!\bfor\b|\bwhere\b)[^{};])+?)"
    where = r"\s*(?:\bwhere\b[^{};]*)?"
    attribute_names = (("attr_id", rf"#\[\s*({NAME})\s*[\](=]"),)
    return RuleList(
        name="rust",
        separator="::",
        file_types=("rs",),
        start=r"[{};#]|\b[a-z]",
        mask="|".join([LINE_COMMENT, BLOCK_COMMENT, r'r#".*?"#', DOUBLE_QUOTED, CHARACTER]),
        **BRACES,
        rules=(
            Rule("struct", "item", rf"{public}\bstruct\s+({NAME}){REST}"),
            Rule("enum", "block", rf"{public}\benum\s+({NAME}){REST}"),
            Rule(
                "fn",
                "block",
                function,
                captures=attribute_names,
                filters=(CaptureFilter("attr_id", "not-contains", "test"),),
            ),
            Rule(
                "test",
                "block",
                function,
                captures=attribute_names,
                filters=(CaptureFilter("attr_id", "contains", "test"),),
            ),
            Rule("impl", "block", rf"\bimpl\b{generics}\s*{of_type}{where}", before=r"\{"),
            Rule("trait", "block", rf"{public}(?:\bunsafe\s+)?\btrait\s+({NAME}){REST}"),
            Rule("trait_impl", "block", rf"\bimpl\b{generics}\s*{of_type}\s+for\s+{of_type}{where}", names=(2, 1), before=r"\{"),
            Rule("mod", "item", rf"{public}\bmod\s+({NAME})\s*"),
            Rule("const", "item", rf"{public}\bconst\s+({NAME})\s*:{REST}"),
            Rule("type", "item", rf"{public}\btype\s+({NAME})\b(?:\[[^\]]*\]|[^{{}};\[=])*+={REST}"),
            Rule("type", "item", rf"\btype\s+({NAME})\b[^{{}};=]*+", before=";"),
        ),
    )


def _csharp() -> RuleList:
    attributes = r"(?:\[[^\]]*\]\s*)*+"
    modifier = (
        r"(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|virtual|override|async"
        r"|extern|unsafe|new|const|volatile|required)"
    )
    modifiers = rf"(?<![\w.]){attributes}(?:\b{modifier}\s+)*+"
    some_modifiers = rf"(?<![\w.]){attributes}(?:\b{modifier}\s+)++"
    statement = r"(?!(?:return|await|throw|else|if|new|in|is|as|case|goto|using|namespace|class|interface|struct|enum|record|delegate|event)\b)"
    of_type = rf"{statement}[A-Za-z_][\w.]*(?:<[^{{}};()]*?>)?(?:\[[,\s]*\])?\??"
    return RuleList(
        name="csharp",
        separator=".",
        file_types=("cs",),
        start=r"[{};\[]|\b[A-Za-z_]",
        mask="|".join([LINE_COMMENT, BLOCK_COMMENT, r'@"(?:[^"]|"")*+"', DOUBLE_QUOTED, CHARACTER]),
        **BRACES,
        rules=(
            Rule("class", "block", rf"{modifiers}\bclass\s+({NAME})[^{{}};]*"),
            Rule("interface", "block", rf"{modifiers}\binterface\s+({NAME})[^{{}};]*"),
            Rule("method", "item", rf"{modifiers}{of_type}\s+({NAME})\s*(?:<[^<>]*>)?\s*{PARAMETERS}[^{{}};]*"),
            Rule("field", "statement", rf"{some_modifiers}{of_type}\s+({NAME})\s*(?:=(?!>)[^{{}};]*)?", before=";"),
            # With accessors, and with an expression for a body.
            Rule(
                "property",
                "block",
                rf"{some_modifiers}{of_type}\s+({NAME})\s*",
                before=r"\{\s*(?:\w+\s+){0,8}?(?:get|set|init)\b",
            ),
            Rule("property", "statement", rf"{some_modifiers}{of_type}\s+({NAME})\s*=>[^{{}};]*", before=";"),
            Rule("namespace", "block", rf"\bnamespace\s+({NAME})\s*", before=r"\{"),
            Rule("namespace", "file", rf"\bnamespace\s+([\w.]+)\s*", before=";"),
        ),
    )


def _c() -> RuleList:
    keyword = r"(?!(?:if|else|for|while|switch|do|return|case|goto|sizeof)\b)"
    return RuleList(
        name="c",
        separator="",
        file_types=("c", "h"),
        start=r"[{};]|\b[A-Za-z_]",
        mask="|".join([LINE_COMMENT, BLOCK_COMMENT, DOUBLE_QUOTED, CHARACTER, r"(?m:^[ \t]*#[^\n\\]*+(?:\\.[^\n\\]*+)*+)"]),
        **BRACES,
        rules=(
            Rule(
                "function",
                "block",
                rf"\b{keyword}[A-Za-z_][\w\s*]*?[\s*](\**{keyword}{NAME}\s*{PARAMETERS})\s*",
                before=r"\{",
            ),
            # Stands for a struct on its own and for one that declares variables.
            Rule("struct", "block", rf"(?<!typedef )\bstruct\s+({NAME})\s*", before=r"\{"),
        ),
    )


def _ocaml() -> RuleList:
    comment = r"(?:\(\*(?:[^*]|\*(?!\)))*+\*\)\s*)?"
    local = r"(?![^\n]*\bin\b)"
    return RuleList(
        name="ocaml",
        separator=".",
        file_types=("ml",),
        opener=r"\b(?:struct|sig|object|begin)\b",
        closer=r"\bend\b",
        # A binding that is local to an expression ends nothing.
        end=r"(?m:^[ \t]*let\b[^\n]*\bin\b)",
        boundary=rf"{comment}(?m:^[ \t]*(?:let|module|type|open|exception|include)\b)|\bend\b",
        extra=r"\S+",
        rules=(
            Rule(
                "function",
                "section",
                rf"{comment}(?m:^[ \t]*let\s+(?:rec\s+)?({NAME})(?:\s+[^=\s][^=\n]*=|\s*=\s*(?:fun|function)\b))",
                before=local,
                lead=r"[ \t]*+",
            ),
            Rule(
                "module",
                "block",
                rf"{comment}(?m:^[ \t]*module\s+({NAME})\s*=\s*)",
                before=r"struct\b",
                lead=r"[ \t]*+",
            ),
        ),
    )


def _toml() -> RuleList:
    key = r"[A-Za-z0-9_-]+"
    value = (
        r'(?:""".*?"""|\'\'\'.*?\'\'\'|\[[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)*+\]|\{[^}]*\}|[^\n]*?)(?=[ \t\r]*(?:\n|\z))'
    )
    return RuleList(
        name="toml",
        separator=".",
        file_types=("toml",),
        mask=r"(?m:^[ \t]*#[^\n]*|(?<=\s)#[^\n\"']*$)",
        boundary=r"(?m:^[ \t]*\[[^\n]*)",
        rules=(
            Rule("table", "section", rf"(?m:^[ \t]*\[({key})\])", lead=r"[ \t]*+"),
            # Stands for a property of a table and for one at the top.
            Rule("property", "match", rf"(?m:^[ \t]*({key})[ \t]*=[ \t]*{value})", lead=r"[ \t]*+"),
        ),
    )


def _json() -> RuleList:
    return RuleList(
        name="json",
        separator=".",
        file_types=("json",),
        opener=r"[{\[]",
        closer=r"[}\]]",
        extra=r"[^\s,:{}\[\]\"]+|,",
        rules=(Rule("property", "pair", r'"((?:[^"\\]|\\.)*+)"'),),
    )


def _lua() -> RuleList:
    return RuleList(
        name="lua",
        separator=".",
        file_types=("lua",),
        start=r"\b[A-Za-z_]",
        mask="|".join([r"--\[\[.*?\]\]", r"--[^\n]*", r"\[\[.*?\]\]", DOUBLE_QUOTED, SINGLE_QUOTED]),
        opener=r"\b(?:function|if|do|repeat)\b",
        closer=r"\b(?:end|until)\b",
        rules=(
            Rule("function", "nested", rf"\b(?:local\s+)?function\s+[\w.]+:({NAME})\s*", before=r"\("),
            Rule("function", "nested", rf"\b(?:local\s+)?function\s+(?:[\w.]+\.)?({NAME})\s*", before=r"\("),
            # Stands for a field of a table constructor and for an assignment.
            Rule("function", "nested", rf"(?<![\w.])(?:{NAME}\.)*+({NAME})\s*=\s*function\b"),
        ),
    )


CALLS = r"(?!(?:if|for|while|switch|catch|with|function|return|await|super|constructor\s*$)\b)"
SCRIPT_MASK = "|".join([LINE_COMMENT, BLOCK_COMMENT, DOUBLE_QUOTED, SINGLE_QUOTED, r"`(?:[^`\\]|\\.)*+`"])
FUNCTION = rf"\b(?:async\s+)?function\s+({NAME})[^{{}};]*"


def _script_method(modifiers: str, result: str) -> str:
    return rf"(?<![\w$.#])(?:\b(?:{modifiers})\s+)*+{CALLS}(#?{NAME})\s*(?:<[^<>(){{}}]*>)?{PARAMETERS}\s*{result}"


def _typescript() -> RuleList:
    modifiers = "public|private|protected|static|async|get|set|override|readonly"
    return RuleList(
        name="typescript",
        separator=".",
        file_types=("ts",),
        start=r"[{};#]|\b[A-Za-z_$]",
        mask=SCRIPT_MASK,
        **BRACES,
        rules=(
            Rule("function", "block", FUNCTION),
            Rule("class", "block", rf"\bclass\s+({NAME})[^{{}};]*"),
            Rule("method", "block", _script_method(modifiers, r"(?::[^{};]*)?"), before=r"\{"),
            Rule("interface", "block", rf"\binterface\s+({NAME})[^{{}};]*"),
            Rule("type", "item", rf"\btype\s+({NAME})\s*(?:<[^={{}};]*>)?\s*=[^{{}};]*"),
        ),
    )


def _javascript() -> RuleList:
    return RuleList(
        name="javascript",
        separator=".",
        file_types=("js",),
        start=r"[{};#]|\b[A-Za-z_$]",
        mask=SCRIPT_MASK,
        **BRACES,
        rules=(
            Rule("function", "block", FUNCTION),
            Rule("class", "block", rf"\bclass\s+({NAME})[^{{}};]*"),
            Rule("method", "block", _script_method("static|async|get|set", ""), before=r"\{"),
        ),
    )


def _go() -> RuleList:
    rest = r"(?:(?:interface|struct)\s*\{\s*\}|[^{}])*+"
    return RuleList(
        name="go",
        separator=".",
        file_types=("go",),
        start=r"[{}\s]|\b[cft]",
        mask="|".join([LINE_COMMENT, BLOCK_COMMENT, r"`[^`]*`", DOUBLE_QUOTED, CHARACTER]),
        opener=r"\{",
        closer=r"\}",
        rules=(
            Rule(
                "const",
                "match",
                rf"\bconst\s*\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)|\bconst\s+{NAME}[^\n]*",
                each=rf"(?md)^\s*(?:const\b\s*\(?\s*)?({NAME})[^\n]*$",
            ),
            Rule("interface", "block", rf"\btype\s+({NAME})\s+interface\s*"),
            Rule(
                "method",
                "match",
                rf"(?m:^[ \t]+({NAME})\([^\n(){{}}]*\)[^\n{{}}]*$)",
                lead=r"[ \t]*+",
                inside="interface",
            ),
            Rule("struct", "block", rf"\btype\s+({NAME})\s+struct\s*"),
            Rule("method", "block", rf"\bfunc\s*\(\s*(?:{NAME}\s+)?({NAME})\s*\)\s*({NAME})\s*\({rest}", names=(1, 2)),
            Rule("function", "block", rf"\bfunc\s+({NAME}){rest}"),
        ),
    )


def default_rule_lists() -> list[RuleList]:
    return [
        _rust(),
        _csharp(),
        _c(),
        _ocaml(),
        _toml(),
        _json(),
        _lua(),
        _typescript(),
        _javascript(),
        _go(),
    ]
