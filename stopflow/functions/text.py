from __future__ import annotations

from pyspark.sql import Column, functions as F


def last_segment(x: Column, sep: str = ":") -> Column:
    return F.substring_index(x, sep, -1)


def line_number(ref: Column) -> Column:
    """Digits that end a line reference as a number; NULL when there are none."""
    return F.regexp_extract(ref, r"(\d+)$", 1).try_cast("bigint")


def label_number(label: Column) -> Column:
    """Last ``_`` part of a label as a number; NULL when it is not one."""
    return last_segment(label, "_").try_cast("bigint")
