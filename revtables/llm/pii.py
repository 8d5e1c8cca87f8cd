"""Personal data in texts: spans that regular expressions propose and checks confirm.

Base kinds are email, ip, card and phone, confirmed by their parts, the Luhn sum or the
count of digits. The method adds ibans (confirmed by the remainder mod 97), numbers of
persons that stand next to words such as "ssn", and cards and phones without their usual
form, which count only if words near them say so. Each span has a score: what its check
is worth, raised by words of its kind near it and lowered by words against it.

All of it is Spark expressions. A match's place is what stands between the matches before
it, so one split of the text and running sums give the places of all matches of a kind;
the words near it are cut out of the chunk of text that it is in. The patterns
are possessive, and matches that could begin anywhere in a run of letters begin at its
start or where the last match ended, so the time is linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtables.llm.arrays import bound, chunks, cut, running, running_sum

#: Code points before and after a span in which words count.
CONTEXT = 40
ACCEPT_FROM = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: What the check is worth by itself; base kinds are accepted by their check alone.
    worth: float
    base: bool
    near: str
    against: str = r"(?i)\b(?:example|sample|version|isbn|order|invoice)\b"


# The patterns of base kinds and the limits of their checks are fixed values.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9, True, r"(?i)\b(?:e-?mail|contact|mailto|write)\b",
    ),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, True, r"(?i)\b(?:ip|host|server|address|login)\b"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", 0.8, True, r"(?i)\b(?:card|visa|credit|debit|payment)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, True, r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.8, False, r"(?i)\b(?:iban|bank|account|konto|transfer)\b"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, False, r"(?i)\b(?:ssn|social|security|insured)\b"),
    Kind("local_phone", r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", 0.3, False, r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
)
ORDER = {kind.name: i for i, kind in enumerate(KINDS)}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits ends in 0."""
    backward = F.split(F.reverse(digits), "")
    values = F.transform(
        F.filter(backward, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _mod_97(match: Column) -> Column:
    """Whether the rearranged letters and digits of an iban leave 1 when divided by 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    values = F.transform(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(14, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return _mod_97(match)
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9..)|^...-00|-0000$")
    return F.lit(True)


def _matches(text: Column, kind: Kind) -> Column:
    """All matches of a kind, and the lengths of what stands before, between and after them."""
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda p: F.length(p))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("m"), gaps.alias("g"))
    return F.when(text.rlike(_SIGNS[kind.name]), found).otherwise(F.array().cast("array<struct<m:string,g:int>>"))


def _spans_of(matches: Column, ends: Column, pieces: Column, kind: Kind) -> Column:
    """The confirmed spans of a kind: start, end (exclusive, code points), kind, score; ``pieces`` are the text's chunks."""
    rows = F.arrays_zip(matches.alias("x"), ends.alias("end"))
    good = F.filter(rows, lambda r: F.when(r["x"]["m"].isNotNull(), _passes(kind.name, r["x"]["m"])).otherwise(False))
    found = F.transform(good, lambda r: F.struct((r["end"] - F.length(r["x"]["m"])).alias("start"), r["end"].alias("end")))

    def scored(s: Column) -> Column:
        before = cut(pieces, F.greatest(F.lit(0), s["start"] - CONTEXT), s["start"])
        after = cut(pieces, s["end"], s["end"] + CONTEXT)
        nearby = F.concat(before, F.lit(" \u0001 "), after)
        score = bound(
            nearby,
            lambda n: F.lit(kind.worth) + F.when(n.rlike(kind.near), 0.3).otherwise(0.0) - F.when(n.rlike(kind.against), 0.2).otherwise(0.0),
        )
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(ORDER[kind.name]).alias("rank"), F.lit(kind.name).alias("kind"),
            F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2).alias("score"), F.lit(kind.base).alias("base"),
        )

    spans = F.transform(found, scored)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= ACCEPT_FROM)


#: Cheap signs without which a text can't have a match of the kind.
_SIGNS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}",
    "ssn": "[0-9]-[0-9]{2}-[0-9]", "local_phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]",
}


def spans_of(text: Column) -> Column:
    """All spans of a text, by start and then kind: start, end, rank, kind, score, base.

    Matches of one kind never overlap; those of two kinds may. A null text counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,score:double,base:boolean>>")
    def found(x: Column) -> Column:
        each = [_spans_of(x["matches"][k], x["ends"][k], x["pieces"], kind) for k, kind in enumerate(KINDS)]
        return F.array_sort(F.concat(*each), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))

    def placed(matches: Column) -> Column:
        lengths = lambda some: F.transform(some, lambda x: x["g"] + F.coalesce(F.length(x["m"]), F.lit(0)))
        ends = F.transform(matches, lambda some: running_sum(lengths(some)))
        return bound(F.struct(matches.alias("matches"), ends.alias("ends"), chunks(text).alias("pieces")), found)

    some_sign = text.rlike("|".join(_SIGNS.values()))
    return F.when(some_sign, bound(F.array(*[_matches(text, k) for k in KINDS]), placed)).otherwise(none)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) and their personal data as ``spans``, replacing that name."""
    return docs.withColumn("spans", spans_of(F.col("text")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts.

    A null text stays null. What is left of a span that began inside an earlier one goes too.
    """
    def written(x: Column) -> Column:
        parts = F.transform(
            F.arrays_zip(spans.alias("s"), x["reached"].alias("end")),
            lambda p, i: bound(
                F.when(i > 0, F.get(x["reached"], i - 1)).otherwise(0),
                lambda at: F.when(
                    p["s"]["start"] >= at, F.concat(cut(x["pieces"], at, p["s"]["start"]), F.lit("["), p["s"]["kind"], F.lit("]"))
                ).otherwise(""),
            ),
        )
        return F.concat(F.array_join(parts, ""), cut(x["pieces"], F.element_at(x["reached"], -1), F.length(text)))

    # up to where the spans so far have taken the text
    reached = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, bound(F.struct(chunks(text).alias("pieces"), reached.alias("reached")), written)).otherwise(text)
