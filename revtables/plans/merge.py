"""Take over selected symbols from one version of files into another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revtables.operators.attribution import REGION
from revtables.operators.rules import RuleList, rule_list_of
from revtables.operators.snapshots import snapshot_diff
from revtables.plans.texts import LISTED_PAIR, ChangedTexts, changed_contents
from revtables.session import cut_lineage


def selected_edits(
    before: DataFrame,
    after: DataFrame,
    blobs: DataFrame,
    lists: list[RuleList],
    file_path: str | None = None,
    kind: str | None = None,
    qualifiers: str | None = None,
) -> DataFrame:
    """Byte ranges to replace: (path, oids, start_byte, end_byte, new_start_byte, new_end_byte).

    Chosen are symbols of modified files that exist once on both sides with
    different bytes. A symbol inside another chosen one is carried by the outer one.
    """
    if kind is None and qualifiers is None:
        raise ValueError("give a kind or qualifiers; whole files need no symbols")
    changes = snapshot_diff(before, after).where("change = 'modified'")
    if file_path is not None:
        changes = changes.where(F.col("path") == file_path)
    routed = cut_lineage(changes.withColumn("list", rule_list_of(F.col("path"), lists)).where("list is not null"))
    regions = ChangedTexts(routed, changed_contents(routed, blobs), lists).regions(checksums=True)
    wanted = regions
    if kind is not None:
        wanted = wanted.where(F.col("kind") == kind)
    if qualifiers is not None:
        wanted = wanted.where(F.col("qualifiers") == qualifiers)

    def side(oid: str, prefix: str) -> DataFrame:
        return wanted.where(F.size("ranges") == 1).select(
            F.col("oid").alias(oid),
            "list",
            *REGION,
            F.col("checksum").alias(f"{prefix}_checksum"),
            F.col("ranges")[0].alias(f"{prefix}_range"),
        )

    pairs = routed.select(*LISTED_PAIR).distinct()
    matched = (
        pairs.join(side("before_oid", "l"), ["before_oid", "list"])
        .join(side("after_oid", "r"), ["after_oid", "list", *REGION])
        .where("l_checksum <> r_checksum")
    )
    # Outer symbols first; an inner one starts before the end of an earlier one.
    order = Window.partitionBy(*LISTED_PAIR).orderBy("start_byte", F.desc("end_byte"), *REGION)
    reached = F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1))
    edits = (
        matched.select(
            *LISTED_PAIR,
            *REGION,
            F.col("l_range.start_byte").alias("start_byte"),
            F.col("l_range.end_byte").alias("end_byte"),
            F.col("r_range.start_byte").alias("new_start_byte"),
            F.col("r_range.end_byte").alias("new_end_byte"),
        )
        .withColumn("_reached", reached)
        .where("_reached is null or start_byte >= _reached")
        .drop("_reached", *REGION)
    )
    return routed.select("path", *LISTED_PAIR).join(edits, LISTED_PAIR).drop("list")


def selective_merge(
    before: DataFrame,
    after: DataFrame,
    blobs: DataFrame,
    lists: list[RuleList],
    file_path: str | None = None,
    kind: str | None = None,
    qualifiers: str | None = None,
) -> DataFrame:
    """(path, merged BINARY) of the files in which selected symbols are taken from ``after``.

    Each before content is cut at the edges of its replaced symbols and put together
    again in order, so several symbols of one file do not disturb each other.
    """
    edits = cut_lineage(selected_edits(before, after, blobs, lists, file_path, kind, qualifiers))
    ordered = edits.groupBy("path", "before_oid", "after_oid").agg(
        F.array_sort(
            F.collect_list(F.struct("start_byte", "end_byte", "new_start_byte", "new_end_byte"))
        ).alias("edits")
    )
    old = blobs.select(F.col("oid").alias("before_oid"), F.col("content").alias("b"))
    new = blobs.select(F.col("oid").alias("after_oid"), F.col("content").alias("a"))
    joined = ordered.join(old, "before_oid").join(new, "after_oid")

    def piece(source: str, start, end):
        return F.substring(F.col(source), (start + 1).cast("int"), (end - start).cast("int"))

    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("edits", lambda e: e["end_byte"]))
    pieces = F.transform(
        "edits",
        lambda e, i: F.concat(
            piece("b", F.get(starts, i), e["start_byte"]), piece("a", e["new_start_byte"], e["new_end_byte"])
        ),
    )
    tail = piece("b", F.element_at(starts, -1), F.octet_length("b").cast("long"))
    merged = F.aggregate(F.concat(pieces, F.array(tail)), F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p))
    return joined.select("path", merged.alias("merged"))
