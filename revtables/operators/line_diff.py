"""Line differences of many (before, after) pairs at once."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtables.functions.text import byte_text, split_lines
from revtables.operators import alignment
from revtables.operators.interval_join import interval_join
from revtables.session import cut_lineage

# The one Python helper travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[alignment.__name__])

NOVEL = T.StructType([T.StructField(side, T.ArrayType(T.IntegerType())) for side in ("lhs", "rhs")])
_novel_between = F.pandas_udf(alignment.novel_between, NOVEL)


def _matching_prefix(before: Column, after: Column) -> Column:
    """Length of the common prefix of two arrays."""
    first_difference = F.array_position(F.zip_with(before, after, lambda b, a: b.eqNullSafe(a)), F.lit(False))
    return F.when(first_difference > 0, first_difference - 1).otherwise(F.size(before)).cast("int")


def _numbers(start: Column, count: Column) -> Column:
    return F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<int>"))


def line_diff(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Replace the two contents by novel_lhs, novel_rhs (0-based line numbers) and line counts.

    Row-local, so no shuffle: common head and tail are cut in the JVM, a pair with
    nothing left on one side is done there, and only the remaining middles of the
    other pairs go through Arrow to be aligned. A pair is one row, so its size is
    bounded by the contents it was read from.
    """
    lines = {c: split_lines(byte_text(F.col(c))) for c in (before, after)}
    return diff_of_lines(pairs.withColumns(lines), before, after)


def diff_of_lines(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """The same for arrays of lines, or of keys that are equal where the lines are (``line_keys``)."""
    rest = [c for c in pairs.columns if c not in (before, after)]
    lines = pairs.select(*rest, F.col(before).alias("_b"), F.col(after).alias("_a"))
    n_before, n_after = F.size("_b"), F.size("_a")
    head = lines.withColumn("_head", F.least(_matching_prefix(F.col("_b"), F.col("_a")), n_before, n_after))
    tail = head.select(
        *rest,
        n_before.alias("n_before"),
        n_after.alias("n_after"),
        "_head",
        F.slice("_b", F.col("_head") + 1, F.greatest(n_before - F.col("_head"), F.lit(0))).alias("_b"),
        F.slice("_a", F.col("_head") + 1, F.greatest(n_after - F.col("_head"), F.lit(0))).alias("_a"),
    )
    common = F.least(_matching_prefix(F.reverse("_b"), F.reverse("_a")), F.size("_b"), F.size("_a"))
    middle = (
        tail.withColumn("_tail", common)
        .withColumn("_nb", F.size("_b") - F.col("_tail"))
        .withColumn("_na", F.size("_a") - F.col("_tail"))
    )
    both = (F.col("_nb") > 0) & (F.col("_na") > 0)
    aligned = middle.select(
        *rest,
        "n_before",
        "n_after",
        "_head",
        "_nb",
        "_na",
        _novel_between(
            F.when(both, F.slice("_b", F.lit(1), F.col("_nb"))), F.when(both, F.slice("_a", F.lit(1), F.col("_na")))
        ).alias("_novel"),
    )

    def novel(field: str, count: str) -> Column:
        shifted = F.transform(F.col(f"_novel.{field}"), lambda n: n + F.col("_head"))
        return F.when(both, shifted).otherwise(_numbers(F.col("_head"), F.col(count)))

    return aligned.select(
        *rest,
        novel("lhs", "_nb").alias("novel_lhs"),
        novel("rhs", "_na").alias("novel_rhs"),
        F.col("n_before").cast("long").alias("n_before"),
        F.col("n_after").cast("long").alias("n_after"),
    )


def novel_lines(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, side, line) per novel line; side is ``lhs`` or ``rhs``."""
    sides = F.array(
        F.struct(F.lit("lhs").alias("side"), F.col("novel_lhs").alias("lines")),
        F.struct(F.lit("rhs").alias("side"), F.col("novel_rhs").alias("lines")),
    )
    return (
        diffs.select(*keys, F.explode(sides).alias("s"))
        .select(*keys, "s.side", F.explode("s.lines").alias("line"))
        .withColumn("line", F.col("line").cast("long"))
    )


def side_lines(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of both contents: (keys, side, row, line) with byte-exact text."""
    sides = F.array(
        F.struct(F.lit("lhs").alias("side"), split_lines(byte_text(F.col("before"))).alias("lines")),
        F.struct(F.lit("rhs").alias("side"), split_lines(byte_text(F.col("after"))).alias("lines")),
    )
    return pairs.select(*keys, F.explode(sides).alias("s")).select(
        *keys, "s.side", F.posexplode("s.lines").alias("row", "line")
    )


def multiset_line_diff(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Novel lines when order is ignored: the k-th copy of a line matches the k-th copy.

    A lower bound of the ordered diff. One shuffle on (pair, line) serves both the
    numbering of the copies and the count on the other side.
    """
    lines = side_lines(pairs, keys)
    same_line = Window.partitionBy(*keys, "line")
    copies = Window.partitionBy(*keys, "line", "side").orderBy("row")
    other = F.when(
        F.col("side") == "lhs", F.count(F.when(F.col("side") == "rhs", 1)).over(same_line)
    ).otherwise(F.count(F.when(F.col("side") == "lhs", 1)).over(same_line))
    return (
        lines.withColumn("_other", other)
        .withColumn("_copy", F.row_number().over(copies))
        .where("_copy > _other")
        .select(*keys, "side", F.col("row").cast("long").alias("row"))
    )


def _gap_sizes(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Novel lines per gap; a gap is named by the number of kept lines before it."""
    gaps = F.array(
        F.struct(F.lit(1).alias("l"), F.lit(0).alias("r"), F.transform("novel_lhs", lambda n, i: n - i).alias("gaps")),
        F.struct(F.lit(0).alias("l"), F.lit(1).alias("r"), F.transform("novel_rhs", lambda n, i: n - i).alias("gaps")),
    )
    return (
        diffs.select(*keys, F.explode(gaps).alias("g"))
        .select(*keys, "g.l", "g.r", F.explode("g.gaps").alias("gap"))
        .groupBy(*keys, "gap")
        .agg(F.sum("l").alias("lhs_lines"), F.sum("r").alias("rhs_lines"))
    )


def hunks(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of novel lines: half-open line ranges on both sides, in order."""
    order = Window.partitionBy(*keys).orderBy("gap")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum("lhs_lines").over(earlier), F.lit(0))
    new = F.coalesce(F.sum("rhs_lines").over(earlier), F.lit(0))
    return (
        _gap_sizes(diffs, keys)
        .withColumn("hunk", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("before_start", F.col("gap") + gone)
        .withColumn("after_start", F.col("gap") + new)
        .select(
            *keys,
            "hunk",
            F.col("before_start"),
            (F.col("before_start") + F.col("lhs_lines")).alias("before_end"),
            F.col("after_start"),
            (F.col("after_start") + F.col("rhs_lines")).alias("after_end"),
        )
    )


def positions_of_offsets(offsets: DataFrame, files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, offset, row, column) of byte offsets (keys, offset) in ``files``; none for an offset past the end.

    Each offset looks up the line it is in by an interval join, so a long file with many
    offsets is spread over its lines. The column counts bytes; a line end belongs to its line.
    """
    lines = cut_lineage(line_starts(files, keys, content).withColumn("_last", F.col("end_byte") - 1))
    held = interval_join(offsets, lines, keys, "offset", "start_byte", "_last", 4096)
    return held.select(*keys, "offset", "row", (F.col("offset") - F.col("start_byte")).alias("column"))


def line_starts(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Byte offset of every line: (keys, row, start_byte, end_byte) plus a last row at the end.

    ``end_byte`` is the start of the next line. Text after the last newline is a
    line too, so the last row of a file that ends in a newline is empty.
    """
    text = byte_text(F.col(content))
    lines = files.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("row", "_line"), F.length(text).alias("_size"))
    sizes = lines.select(*keys, F.col("row").cast("long").alias("row"), (F.length("_line") + 1).cast("long").alias("_n"), "_size")
    earlier = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start_byte", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        *keys, "row", "start_byte", F.least(F.col("start_byte") + F.col("_n"), F.col("_size").cast("long")).alias("end_byte")
    )


def changed_bytes(diffs: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Every line of both sides with its byte range and the gap it belongs to.

    A kept line closes the gap in front of it, so a gap has at least one row per
    side unless it is the last one and empty there.
    """
    flags = pairs.join(diffs.select(*keys, "novel_lhs", "novel_rhs"), keys)
    sides = F.array(
        F.struct(F.lit("lhs").alias("side"), byte_text(F.col("before")).alias("text"), F.col("novel_lhs").alias("novel")),
        F.struct(F.lit("rhs").alias("side"), byte_text(F.col("after")).alias("text"), F.col("novel_rhs").alias("novel")),
    )
    one = flags.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    lines = one.select(
        *keys, "side", F.length("text").alias("_size"), F.posexplode(split_lines(F.col("text"))).alias("row", "line")
    )
    marks = one.select(*keys, "side", F.explode("novel").alias("row"), F.lit(1).alias("novel"))
    order = Window.partitionBy(*keys, "side").orderBy("row")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("line") + 1
    return (
        lines.join(marks, [*keys, "side", "row"], "left")
        .withColumn("novel", F.coalesce("novel", F.lit(0)))
        .withColumn("start_byte", F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("long"))
        .withColumn("end_byte", F.least(F.col("start_byte") + size, F.col("_size")).cast("long"))
        .withColumn("gap", F.coalesce(F.sum(1 - F.col("novel")).over(earlier), F.lit(0)).cast("long"))
        .drop("_size")
    )


def byte_edits(pairs: DataFrame, diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Byte edits that turn before into after: one per hunk, one for a newline at the end of file.

    ``start_byte``/``old_end_byte`` count in the original before content,
    ``shifted_start_byte`` in the content after the earlier edits, and
    ``new_start_byte``/``new_end_byte`` in the after content. Rows and columns are
    0-based positions of the first two.
    """
    lines = changed_bytes(diffs, pairs, keys)

    def on(side: str, column: str) -> Column:
        return F.when(F.col("side") == side, F.col(column))

    novel = F.col("novel") == 1
    gaps = lines.groupBy(*keys, "gap").agg(
        F.sum(on("lhs", "novel")).alias("l"),
        F.sum(on("rhs", "novel")).alias("r"),
        F.min(on("lhs", "start_byte")).alias("l_start"),
        F.max(F.when(novel, on("lhs", "end_byte"))).alias("l_end"),
        F.min(on("rhs", "start_byte")).alias("r_start"),
        F.max(F.when(novel, on("rhs", "end_byte"))).alias("r_end"),
        F.min(on("lhs", "row")).alias("l_row"),
        # The kept line of the gap: its end differs in length only by a newline.
        F.max(F.when(~novel, on("lhs", "end_byte"))).alias("l_kept_end"),
        F.max(F.when(~novel, on("rhs", "end_byte"))).alias("r_kept_end"),
        F.max(F.when(~novel, on("lhs", "start_byte"))).alias("l_kept"),
        F.max(F.when(~novel, on("rhs", "start_byte"))).alias("r_kept"),
        F.max(F.when(~novel, on("lhs", "row"))).alias("l_kept_row"),
    )
    ends = pairs.select(
        *keys,
        F.octet_length(F.col("before").cast("binary")).cast("long").alias("l_size"),
        F.octet_length(F.col("after").cast("binary")).cast("long").alias("r_size"),
        F.size(split_lines(byte_text(F.col("before")))).alias("l_rows"),
    )
    placed = gaps.join(ends, keys)
    l_start, r_start = F.coalesce("l_start", "l_size"), F.coalesce("r_start", "r_size")
    l_row = F.coalesce("l_row", "l_rows").cast("long")
    l_length = F.col("l_kept_end") - F.col("l_kept")
    r_length = F.col("r_kept_end") - F.col("r_kept")
    common = F.least(l_length, r_length)
    hunk = F.struct(
        F.lit("hunk").alias("edit"),
        l_start.alias("start_byte"),
        F.coalesce("l_end", l_start).alias("old_end_byte"),
        r_start.alias("new_start_byte"),
        F.coalesce("r_end", r_start).alias("new_end_byte"),
        l_row.alias("start_row"),
        F.lit(0).cast("long").alias("start_col"),
    )
    end_of_file = F.struct(
        F.lit("end of file").alias("edit"),
        (F.col("l_kept") + common).alias("start_byte"),
        F.col("l_kept_end").alias("old_end_byte"),
        (F.col("r_kept") + common).alias("new_start_byte"),
        F.col("r_kept_end").alias("new_end_byte"),
        F.col("l_kept_row").cast("long").alias("start_row"),
        common.alias("start_col"),
    )
    edits = placed.select(
        *keys,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.coalesce("l", F.lit(0)) + F.coalesce("r", F.lit(0)) > 0, hunk),
                    F.when(l_length != r_length, end_of_file),
                )
            )
        ).alias("e"),
    ).select(*keys, "e.*")
    order = Window.partitionBy(*keys).orderBy("start_byte", "new_start_byte")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    growth = (F.col("new_end_byte") - F.col("new_start_byte")) - (F.col("old_end_byte") - F.col("start_byte"))
    return edits.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).withColumn(
        "shifted_start_byte", F.col("start_byte") + F.coalesce(F.sum(growth).over(earlier), F.lit(0))
    )


def apply_edits(pairs: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Rebuild the after content from before and the edits: (keys, rebuilt BINARY).

    Between two edits the before bytes are kept. The edits of a pair are bounded by
    its two contents, so they are folded in place.
    """
    ordered = edits.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct("seq", "start_byte", "old_end_byte", "new_start_byte", "new_end_byte"))
        ).alias("edits")
    )
    text = pairs.select(*keys, byte_text(F.col("before")).alias("b"), byte_text(F.col("after")).alias("a"))

    def piece(source: str, start: Column, end: Column) -> Column:
        return F.substring(F.col(source), (start + 1).cast("int"), (end - start).cast("int"))

    none = F.array().cast("array<struct<seq:bigint,start_byte:bigint,old_end_byte:bigint,new_start_byte:bigint,new_end_byte:bigint>>")
    joined = text.join(ordered, keys, "left").withColumn("edits", F.coalesce("edits", none))
    kept_from = F.concat(F.array(F.lit(0).cast("long")), F.transform("edits", lambda e: e["old_end_byte"]))
    pieces = F.transform(
        "edits",
        lambda e, i: F.concat(
            piece("b", F.get(kept_from, i), e["start_byte"]), piece("a", e["new_start_byte"], e["new_end_byte"])
        ),
    )
    last = piece("b", F.element_at(kept_from, -1), F.length("b").cast("long"))
    return joined.select(*keys, F.encode(F.concat(F.array_join(pieces, ""), last), "ISO-8859-1").alias("rebuilt"))
