"""File names and file filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the mode of a regular file that is not executable.
REGULAR_FILE_MODE = "100644"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty for ``name`` and ``.name``."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def has_type(path: Column, file_types: list[str], exact_names: list[str]) -> Column:
    by_name = file_name(path).isin(*exact_names) if exact_names else F.lit(False)
    by_type = extension(path).isin(*file_types) if file_types else F.lit(False)
    return by_name | by_type


def is_regular_file(mode: Column) -> Column:
    return mode == REGULAR_FILE_MODE
