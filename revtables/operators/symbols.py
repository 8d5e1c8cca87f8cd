"""Look up symbols and their commits in a change table."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from revtables.operators.regions import regions_at
from revtables.schema import SYMBOL
from revtables.session import cut_lineage


SYMBOL_STRUCT = "struct<kind:string,qualifiers:string,file_path:string>"


class SymbolNotResolved(ValueError):
    """No symbol, or more than one, fits the given arguments."""


def query_symbols(
    changes: DataFrame, file_path: str | None = None, kind: str | None = None, qualifiers: str | None = None
) -> DataFrame:
    """Distinct symbols; an argument that is not given matches all."""
    given = {"file_path": file_path, "kind": kind, "qualifiers": qualifiers}
    for name, value in given.items():
        if value is not None:
            changes = changes.where(F.col(name) == value)
    return changes.select(*SYMBOL).distinct()


def changes_for_symbol(changes: DataFrame, symbol: dict) -> DataFrame:
    for name in SYMBOL:
        changes = changes.where(F.col(name) == symbol[name])
    return changes


def all_commits(changes: DataFrame) -> DataFrame:
    """Commits that have change rows; there is no other notion of all commits."""
    return changes.select("commit_id", "seconds_since_epoch").distinct()


def symbol_commits(changes: DataFrame, symbol: dict) -> DataFrame:
    return all_commits(changes_for_symbol(changes, symbol))


def find_symbol(
    changes: DataFrame,
    file_path: str | None = None,
    kind: str | None = None,
    qualifiers: str | None = None,
    row: int | None = None,
    column: int | None = None,
    regions: DataFrame | None = None,
) -> Row:
    """The one symbol that fits, as (kind, qualifiers, file_path).

    By file, row and column it is the innermost region there (``regions`` with
    file_path, kind, qualifiers, ranges, byte_size, first_seq); by file, kind and
    qualifiers it is looked up in the change table.
    """
    named = kind is not None or qualifiers is not None
    located = row is not None or column is not None
    if file_path is None and not named:
        raise SymbolNotResolved("give a file, a kind or qualifiers" if not located else "a location needs a file")
    if located and file_path is None:
        raise SymbolNotResolved("a location needs a file")
    if located and named:
        raise SymbolNotResolved("a location excludes kind and qualifiers")
    if located and (row is None or column is None):
        raise SymbolNotResolved("a location needs row and column")
    if located:
        if regions is None:
            raise SymbolNotResolved("a location needs the regions of the file")
        here = regions.where(F.col("file_path") == file_path)
        point = here.sparkSession.createDataFrame(
            [(file_path, 0, row, column)], "file_path string, point_id int, row long, col long"
        )
        found = regions_at(point, here, ["file_path"]).select(*SYMBOL).limit(2).collect()
    else:
        found = query_symbols(changes, file_path, kind, qualifiers).limit(2).collect()
    if not found:
        raise SymbolNotResolved("no symbol fits")
    if len(found) > 1:
        raise SymbolNotResolved("more than one symbol fits")
    return found[0]


def resolve_symbols(changes: DataFrame, filters: DataFrame) -> DataFrame:
    """Resolve a table of filters (filter_id, file_path, kind, qualifiers; NULL matches all).

    Returns (filter_id, matches, status, kind, qualifiers, file_path), the symbol only
    where exactly one fits. Filters are grouped by which columns they give, so each
    group is an equi-join with symbols already counted by those columns.
    """
    # Written once, so that the groups of filters do not each scan the change table.
    symbols = cut_lineage(changes.select(*SYMBOL).distinct())
    parts = []
    for given in product([True, False], repeat=len(SYMBOL)):
        keys = [name for name, is_given in zip(SYMBOL, given) if is_given]
        mine = filters
        for name, is_given in zip(SYMBOL, given):
            mine = mine.where(F.col(name).isNotNull() if is_given else F.col(name).isNull())
        if not keys:
            none = [F.lit(None).cast("long").alias("matches"), F.lit(None).cast(SYMBOL_STRUCT).alias("s")]
            parts.append(mine.select("filter_id", *none))
            continue
        counted = symbols.groupBy(*keys).agg(
            F.count("*").alias("matches"), F.min(F.struct(*[F.col(c) for c in SYMBOL])).alias("s")
        )
        parts.append(
            mine.select("filter_id", *keys)
            .join(counted, keys, "left")
            .select("filter_id", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), "s")
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    status = (
        F.when(F.col("matches").isNull(), "no argument")
        .when(F.col("matches") == 0, "none")
        .when(F.col("matches") == 1, "ok")
        .otherwise("ambiguous")
    )
    return found.select(
        "filter_id",
        "matches",
        status.alias("status"),
        *[F.when(F.col("matches") == 1, F.col(f"s.{c}")).alias(c) for c in SYMBOL],
    )
