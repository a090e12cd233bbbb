from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(x: Column, kind: str = "int") -> Column:
    """Half-to-even rounding to an integer type (a plain Spark cast truncates)."""
    return F.rint(x.cast("double")).cast(kind)


def within(x: Column, limit: float) -> Column:
    """Symmetric outlier cut, both ends excluded."""
    return F.abs(x) < F.lit(limit)


def percent(flag: Column) -> Column:
    """Aggregate: share of rows (flag not NULL) for which ``flag`` holds, 0-100."""
    return F.lit(100.0) * F.avg(flag.cast("double"))
