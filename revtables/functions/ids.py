"""Identifiers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The header a blob is hashed with, and the length of a short id.
BLOB_HEADER = "blob "
SHORT_ID_DIGITS = 8
DATE_FORMAT = "dd.MM.yyyy"


def hex_id(commit_id: Column) -> Column:
    return F.lower(F.hex(commit_id))


def short_id(commit_id: Column) -> Column:
    return F.substring(hex_id(commit_id), 1, SHORT_ID_DIGITS)


def blob_id(content: Column) -> Column:
    """SHA-1 object id of a file content: header, byte length, NUL, bytes."""
    data = content.cast("binary")
    header = F.concat(F.lit(BLOB_HEADER), F.octet_length(data).cast("string")).cast("binary")
    return F.sha1(F.concat(header, F.unhex(F.lit("00")), data))


def author_date(seconds: Column, offset: Column) -> Column:
    """Day of the commit on its author's clock.

    Counted in whole days from the epoch, so the session time zone has no say.
    """
    days = F.floor((seconds + offset) / 86400).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), DATE_FORMAT)
