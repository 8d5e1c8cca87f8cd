"""Symbols that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revtables.operators.positions import with_position
from revtables.schema import SYMBOL
from revtables.session import cut_lineage

# How many companions are listed, and the kind that is left out.
COMPANIONS = 10
FILE_KIND = "file"
# Commits with more symbols than this are not paired symbol by symbol.
WIDE_COMMIT = 200


def commit_counts(changes: DataFrame) -> DataFrame:
    """Commits per symbol; rows, as a symbol has one row per commit."""
    return changes.groupBy(*SYMBOL).agg(F.count("*").alias("commits"))


def co_changes(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """How often other symbols changed in the commits of the given ``symbols``.

    Returns the symbol, other_kind, other_qualifiers, other_file_path, together and
    ratio (of the symbol's own commits). Work is one pass over the changes for each
    asked symbol, not a join of everything with everything.
    """
    own = changes.join(symbols.select(*SYMBOL).distinct(), SYMBOL).select("commit_id", *SYMBOL)
    other = changes.select("commit_id", *[F.col(c).alias(f"other_{c}") for c in SYMBOL])
    differs = F.struct(*SYMBOL) != F.struct(*[F.col(f"other_{c}").alias(c) for c in SYMBOL])
    together = (
        own.join(other, "commit_id")
        .where(differs)
        .groupBy(*SYMBOL, *[f"other_{c}" for c in SYMBOL])
        .agg(F.count("*").alias("together"))
    )
    return together.join(commit_counts(own), SYMBOL).select(
        *SYMBOL,
        *[f"other_{c}" for c in SYMBOL],
        "together",
        (F.col("together") / F.col("commits")).alias("ratio"),
    )


def top_companions(together: DataFrame, limit: int = COMPANIONS) -> DataFrame:
    """The companions that changed most often with each symbol; files are left out first."""
    order = Window.partitionBy(*SYMBOL).orderBy(F.desc("together"), *[f"other_{c}" for c in SYMBOL])
    return (
        together.where(F.col("other_kind") != FILE_KIND)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


def top_companions_of_all(changes: DataFrame, limit: int = COMPANIONS, wide: int = WIDE_COMMIT) -> DataFrame:
    """:func:`top_companions` for every symbol of the table, exact, with giant commits.

    Commits of at most ``wide`` symbols are paired. A wider commit would give the
    square of its symbols in pairs, so wide commits are never paired by symbol:
    symbols with the same set of wide commits form a class, classes are paired
    instead, and since all members of a class do equally well, only the first
    ``limit + 1`` of the best classes can reach a symbol's list.
    """
    symbols = with_position(changes.select(*SYMBOL).distinct(), [F.col(c) for c in SYMBOL], "id")
    symbols = cut_lineage(symbols.withColumn("is_file", F.col("kind") == FILE_KIND))
    # Numbers instead of names from here on; their order is the order of names.
    rows = cut_lineage(changes.join(symbols, SYMBOL).select("commit_id", "id", "is_file"))
    wide_commits = rows.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n") > wide).select("commit_id")
    wide_commits = cut_lineage(wide_commits)

    paired = _pairs_of_narrow(rows.join(wide_commits, "commit_id", "left_anti"))
    if not wide_commits.isEmpty():
        paired = _with_wide(paired, rows.join(wide_commits, "commit_id"), limit)
    order = Window.partitionBy("id").orderBy(F.desc("together"), "other_id")
    best = paired.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    counts = rows.groupBy("id").agg(F.count("*").alias("commits"))
    names = symbols.select("id", *SYMBOL)
    others = symbols.select(F.col("id").alias("other_id"), *[F.col(c).alias(f"other_{c}") for c in SYMBOL])
    return (
        best.join(counts, "id")
        .join(names, "id")
        .join(others, "other_id")
        .select(
            *SYMBOL,
            *[f"other_{c}" for c in SYMBOL],
            "together",
            (F.col("together") / F.col("commits")).alias("ratio"),
            "rank",
        )
    )


def _pairs_of_narrow(rows: DataFrame) -> DataFrame:
    """(id, other_id, together): unordered pairs are counted, then read both ways.

    A commit's ids fit one short list, as wide commits are gone.
    """
    lists = rows.groupBy("commit_id").agg(F.sort_array(F.collect_list(F.struct("id", "is_file"))).alias("s"))
    first = lists.select("s", F.posexplode("s").alias("place", "a"))
    pairs = first.select("a", F.explode(F.slice("s", F.col("place") + 2, F.size("s"))).alias("b")).where(
        "not (a.is_file and b.is_file)"
    )
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("together"))
    ways = F.array(
        F.struct(F.col("a.id").alias("id"), F.col("b.id").alias("other_id"), F.col("b.is_file").alias("skip")),
        F.struct(F.col("b.id").alias("id"), F.col("a.id").alias("other_id"), F.col("a.is_file").alias("skip")),
    )
    return (
        counted.select(F.explode(ways).alias("w"), "together")
        .where("not w.skip")
        .select("w.id", "w.other_id", "together")
    )


def _with_wide(paired: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """Add what wide commits contribute: to the pairs already there, and new pairs that may matter."""
    members = rows.groupBy("id", "is_file").agg(F.sort_array(F.collect_list("commit_id")).alias("commits"))
    members = cut_lineage(members)
    classes = with_position(members.select("commits").distinct(), [F.col("commits")], "class")
    members = cut_lineage(members.join(classes, "commits").select("id", "is_file", "class"))
    of_class = classes.select("class", F.explode("commits").alias("commit_id"))
    shared = cut_lineage(
        of_class.join(of_class.select(F.col("class").alias("other_class"), "commit_id"), "commit_id")
        .groupBy("class", "other_class")
        .agg(F.count("*").alias("shared"))
    )

    first = Window.partitionBy("class").orderBy("id")
    heads = (
        members.where("not is_file")
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= limit + 1)
        .select(F.col("class").alias("other_class"), F.col("id").alias("other_id"))
    )
    best = Window.partitionBy("class").orderBy(F.desc("shared"), "other_id")
    leaders = shared.join(heads, "other_class").withColumn("n", F.row_number().over(best)).where(F.col("n") <= limit + 1)
    from_wide = (
        members.join(leaders.select("class", "other_id", "shared"), "class")
        .where("id <> other_id")
        .select("id", "other_id", F.col("shared").alias("together"))
    )
    own = members.select("id", "class")
    other = members.select(F.col("id").alias("other_id"), F.col("class").alias("other_class"))
    from_both = (
        paired.join(own, "id")
        .join(other, "other_id")
        .join(shared, ["class", "other_class"])
        .select("id", "other_id", (F.col("together") + F.col("shared")).alias("together"))
    )
    # A pair that is in more than one of the three has its whole count in from_both.
    return (
        paired.unionByName(from_both)
        .unionByName(from_wide)
        .groupBy("id", "other_id")
        .agg(F.max("together").alias("together"))
    )
