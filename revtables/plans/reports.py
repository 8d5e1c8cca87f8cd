"""Text lines and JSON objects of the results, one per row.

Rows stay spread over the cluster; write them with ``df.write.text`` or collect a
small result. Nothing is gathered into one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtables.functions.ids import hex_id, short_id
from revtables.functions.text import strip_line_end
from revtables.operators.cochange import FILE_KIND
from revtables.schema import SYMBOL
from revtables.session import cut_lineage

# The marks of a text report and the names of the two status lists.
MARKS = {"added": "+", "deleted": "-", "modified": "~"}
STAGES = {"staged": "staged_head_diff", "unstaged": "untracked_staged_diff"}
HEADERS = {"staged": "Staged:", "unstaged": "Untracked:"}
NO_CHANGES = "No changes"


def show_id(changes: DataFrame) -> Column:
    """Binary ids as hex, others as they are."""
    if changes.schema["commit_id"].dataType.typeName() == "binary":
        return hex_id(F.col("commit_id"))
    return F.col("commit_id").cast("string")


def change_lines(changes: DataFrame) -> DataFrame:
    line = F.format_string(
        "%s %s %s %s %d (+%d -%d) -> %d",
        "kind",
        "qualifiers",
        "file_path",
        show_id(changes),
        "seconds_since_epoch",
        "novel_rhs",
        "novel_lhs",
        "size_after",
    )
    return changes.select(line.alias("line"))


def symbol_json(symbols: DataFrame) -> DataFrame:
    """{"kind", "qualifiers", "file_path", "ranges"} per symbol."""
    return symbols.select(F.to_json(F.struct("kind", "qualifiers", "file_path", "ranges")).alias("json"))


def symbol_lines(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.concat_ws(" ", "kind", "qualifiers", "file_path").alias("line"))


def _change_struct() -> Column:
    # to_json leaves NULL fields out, so an added symbol has no novel_lhs.
    return F.struct("change", *SYMBOL, "novel_lhs", "novel_rhs")


def change_json(changes: DataFrame) -> DataFrame:
    return changes.select(F.to_json(_change_struct()).alias("json"))


def status_json(status: DataFrame) -> DataFrame:
    """Change objects with the list they belong to; write with ``partitionBy("stage")``."""
    stage = F.when(F.col("stage") == "staged", STAGES["staged"]).otherwise(STAGES["unstaged"])
    return status.select(stage.alias("stage"), F.to_json(_change_struct()).alias("json"))


def log_json(log: DataFrame) -> DataFrame:
    fields = F.struct(
        "seconds_since_epoch",
        F.col("date").alias("time_formatted"),
        "title",
        "body",
        show_id(log).alias("id"),
        "novel_lhs",
        "novel_rhs",
        "size_after",
    )
    return log.select("commit_id", F.to_json(fields).alias("json"))


def log_lines(log: DataFrame) -> DataFrame:
    """``id8 dd.mm.yyyy title`` per commit."""
    binary = log.schema["commit_id"].dataType.typeName() == "binary"
    short = short_id(F.col("commit_id")) if binary else show_id(log)
    return log.select("commit_id", F.concat_ws(" ", short, "date", strip_line_end(F.col("title"))).alias("line"))


def log_header(symbol: dict) -> str:
    return f"{symbol['kind']} {symbol['qualifiers']} in {symbol['file_path']}"


def _mark(change: Column) -> Column:
    mark = F.lit(None).cast("string")
    for name, text in MARKS.items():
        mark = F.when(change == name, text).otherwise(mark)
    return mark


def _with_file_change(changes: DataFrame, *keys: str) -> DataFrame:
    """Each row with the change of its file row; rows of files without one are left out.

    The window holds the symbols of one file.
    """
    file = Window.partitionBy(*keys, "file_path")
    found = F.max(F.when(F.col("kind") == FILE_KIND, F.col("change"))).over(file)
    return changes.withColumn("file_change", found).where("file_change is not null")


def grouped_symbols(changes: DataFrame) -> DataFrame:
    """Symbols with the change of their file; symbols without a file row are left out."""
    return _with_file_change(changes).where(F.col("kind") != FILE_KIND)


def _lines(changes: DataFrame, *keys: str) -> DataFrame:
    is_file = F.col("kind") == FILE_KIND
    mark = _mark(F.col("change"))
    symbol_line = F.concat(F.lit("  "), F.concat_ws(" ", mark, "kind", "qualifiers"))
    return _with_file_change(changes, *keys).select(
        *keys,
        "file_path",
        F.when(is_file, 0).otherwise(1).alias("seq"),
        "kind",
        "qualifiers",
        F.when(is_file, F.concat_ws(" ", mark, "file_path")).otherwise(symbol_line).alias("line"),
    )


def report_lines(changes: DataFrame) -> DataFrame:
    """(file_path, seq, kind, qualifiers, line): a file line, then its symbols, files by path."""
    return _lines(changes).orderBy("file_path", "seq", "kind", "qualifiers")


def status_lines(status: DataFrame) -> DataFrame:
    """Both reports with their headers, staged first; one line when nothing has changed."""
    body = cut_lineage(_lines(status, "stage"))
    part = F.when(F.col("stage") == "staged", 0).otherwise(1)
    header = F.when(F.col("stage") == "staged", HEADERS["staged"]).otherwise(HEADERS["unstaged"])
    headers = body.select("stage").distinct()
    if headers.isEmpty():
        headers, header = body.sparkSession.range(1).select(F.lit("staged").alias("stage")), F.lit(NO_CHANGES)
    empty = F.lit("")
    first = headers.select(
        part.alias("part"),
        empty.alias("file_path"),
        F.lit(-1).alias("seq"),
        empty.alias("kind"),
        empty.alias("qualifiers"),
        header.alias("line"),
    )
    rest = body.select(part.alias("part"), "file_path", "seq", "kind", "qualifiers", "line")
    return first.unionByName(rest).orderBy("part", "file_path", "seq", "kind", "qualifiers")
