"""String expressions used by several operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_segment(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", 1)


def last_segment(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def is_test_path(path: Column) -> Column:
    return F.contains(F.lower(path), F.lit("test"))


def symbol_uid(repo_id: Column, symbol_id: Column) -> Column:
    return F.concat(repo_id, F.lit(":"), symbol_id)
