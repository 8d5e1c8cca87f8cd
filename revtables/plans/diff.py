"""Symbol differences of two snapshots, and the status of a working tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtables.operators.attribution import match_for_diff
from revtables.operators.rules import RuleList, rule_list_of
from revtables.operators.snapshots import snapshot_diff
from revtables.plans.texts import LISTED_PAIR, PAIR, ChangedTexts, changed_contents, file_row
from revtables.schema import SYMBOL
from revtables.session import cut_lineage
from revtables.sources.contents import Contents

# A store of contents, or several, for contents that are in either.
Blobs = DataFrame | Contents | tuple[DataFrame | Contents, ...]

COLUMNS = ["change", *SYMBOL, "novel_lhs", "novel_rhs"]


def diff_files(
    changes: DataFrame,
    blobs: Blobs,
    lists: list[RuleList],
    include_children: bool = False,
    compat_key: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Symbol and file changes of changed files (path, change, before_oid, after_oid).

    Columns in ``carry`` come through, so several comparisons can be one job: contents are
    read once for all of them, and a pair of contents is compared once.

    A file without a rule list gives one file row, measured in real lines; with a
    list, file rows are measured in newlines. Added and deleted files report all
    their symbols, modified ones those that hold novel lines: each line goes to its
    innermost symbol, or with ``include_children`` to all symbols around it.
    """
    routed = cut_lineage(changes.withColumn("list", rule_list_of(F.col("path"), lists)))
    texts = ChangedTexts(routed, changed_contents(routed, *(blobs if isinstance(blobs, tuple) else (blobs,))), lists)
    one_sided = routed.where("change <> 'modified'").withColumn("oid", F.coalesce(*PAIR))
    modified = routed.where("change = 'modified'")
    added = F.col("change") == "added"

    def one_side(count: str) -> list:
        return [F.when(~added, F.col(count)).alias("novel_lhs"), F.when(added, F.col(count)).alias("novel_rhs")]

    size = F.when(F.col("list").isNull(), F.col("lines")).otherwise(F.col("newlines"))
    whole_files = (
        one_sided.join(texts.sizes(), "oid")
        .withColumn("n", size)
        .select(*carry, "change", *file_row(F.col("path").alias("file_path"), *one_side("n")))
    )
    diffs = cut_lineage(texts.diffs())
    counts = diffs.select(
        *PAIR, F.size("novel_lhs").cast("long").alias("novel_lhs"), F.size("novel_rhs").cast("long").alias("novel_rhs")
    )
    modified_files = modified.join(counts, PAIR).select(
        *carry, "change", *file_row(F.col("path").alias("file_path"), F.col("novel_lhs"), F.col("novel_rhs"))
    )
    result = whole_files.unionByName(modified_files)
    if lists:
        regions, pairs = texts.regions(), cut_lineage(texts.modified_pairs())
        whole_symbols = one_sided.join(regions, ["oid", "list"]).select(
            *carry, "change", "kind", "qualifiers", F.col("path").alias("file_path"), *one_side("line_size")
        )
        novel = texts.novel_counts(pairs, regions, diffs, all_regions=include_children)
        attributed = texts.sided(pairs, regions).join(novel, ["pair", "side", "first_seq"], "left")
        matched = match_for_diff(attributed, ["pair"], compat_key)
        modified_symbols = (
            modified.drop("change")
            .join(pairs, LISTED_PAIR)
            .join(matched, "pair")
            .select(*carry, "change", "kind", "qualifiers", F.col("path").alias("file_path"), "novel_lhs", "novel_rhs")
        )
        result = result.unionByName(whole_symbols).unionByName(modified_symbols)
    return result.select(*carry, *COLUMNS)


def diff_snapshots(
    before: DataFrame,
    after: DataFrame,
    blobs: Blobs,
    lists: list[RuleList],
    include_children: bool = False,
    compat_key: str | None = None,
) -> DataFrame:
    """Changes between two snapshots (path, mode, oid, mtime) whose contents are in ``blobs``."""
    return diff_files(snapshot_diff(before, after), blobs, lists, include_children, compat_key)


def status(
    head: DataFrame,
    index: DataFrame,
    worktree: DataFrame,
    blobs: Blobs,
    lists: list[RuleList],
    include_children: bool = False,
    compat_key: str | None = None,
) -> DataFrame:
    """Unstaged changes (index to working tree) and staged ones (head to index), by ``stage``; one job for both."""
    unstaged = snapshot_diff(index, worktree).withColumn("stage", F.lit("unstaged"))
    staged = snapshot_diff(head, index).withColumn("stage", F.lit("staged"))
    out = diff_files(unstaged.unionByName(staged), blobs, lists, include_children, compat_key, ("stage",))
    return out.select(*COLUMNS, "stage")
