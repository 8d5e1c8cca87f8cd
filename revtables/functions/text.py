"""Text, line and message functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = "\n"
DIGEST_BYTES = 16


def byte_text(content: Column) -> Column:
    """One character per byte, so that string positions are byte positions.

    Content that is not valid UTF-8 survives unchanged too.
    """
    return F.decode(content.cast("binary"), "ISO-8859-1")


def utf8_text(bytes_as_text: Column) -> Column:
    """Undo :func:`byte_text` for a piece that is to be shown."""
    return F.decode(F.encode(bytes_as_text, "ISO-8859-1"), "UTF-8")


def newline_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(NEWLINE), F.lit("")))).cast("long")


def line_count(text: Column) -> Column:
    """Number of lines; a last line without newline counts, an empty rest does not."""
    open_end = (F.length(text) > 0) & ~text.endswith(NEWLINE)
    return newline_count(text) + F.when(open_end, 1).otherwise(0)


def split_lines(text: Column) -> Column:
    """Line tokens without terminator; ``a`` and ``a\\n`` are both one line."""
    parts = F.split(text, NEWLINE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_keys(text: Column) -> Column:
    """What stands for each line where only equality counts: its bytes, or their 16-byte digest if they are as many or more.

    ``text`` is byte-wide. A key is never longer than its line.
    """
    def key(line: Column) -> Column:
        data = F.encode(line, "ISO-8859-1")
        return F.when(F.length(line) < DIGEST_BYTES, data).otherwise(F.unhex(F.md5(data)))

    return F.transform(split_lines(text), key)


def strip_line_end(text: Column) -> Column:
    """Drop one trailing newline and then one carriage return before it."""
    return F.regexp_replace(text, r"\r?\n\z", "")


def title(message: Column) -> Column:
    return F.element_at(F.split(message, "\n\n", 2), 1)


def body(message: Column) -> Column:
    """Text after the first blank line, NULL when there is none."""
    return F.try_element_at(F.split(message, "\n\n", 2), F.lit(2))


def percent(ratio: Column) -> Column:
    """Two decimals of a ratio in single precision, ties to even."""
    value = (ratio.cast("float") * F.lit(100.0).cast("float")).cast("double")
    return F.format_string("%.2f%%", F.bround(value, 2))
