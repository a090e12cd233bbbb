"""Aggregate expressions. Quantiles are exact: Spark keeps a value -> count map per group
and combines it map-side, so a hot group reaches its reducer as one small map per task
(its size is the number of distinct values, whole seconds inside the outlier cut)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

DECILES = (0.1, 0.25, 0.5, 0.75, 0.9)  # fixed values


def quantile_disc(col: str, p: float, kind: str = "double") -> Column:
    """Smallest value whose cumulative share reaches ``p``."""
    return F.expr(f"percentile_disc({p!r}) WITHIN GROUP (ORDER BY {col})").cast(kind)


def quantiles_disc(col: str, ps: Sequence[float] = DECILES) -> Column:
    listed = ", ".join(repr(p) for p in ps)
    return F.expr(f"percentile_disc(array({listed})) WITHIN GROUP (ORDER BY {col})")


def stats_struct(col: str) -> Column:
    """One struct holding the distribution of a column within a group."""
    x = F.col(col)
    return F.struct(
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        quantiles_disc(col).alias("percentiles"),
        F.median(x).alias("median"),
        F.round(F.avg(x)).alias("mean"),
        F.round(F.stddev_samp(x)).alias("stddev"),
    ).alias(f"{col}_stats")


def mean_band(x: Column) -> list[Column]:
    """Mean and its 95 % band (normal approximation) with the number of values."""
    half = F.try_divide(F.lit(1.96) * F.stddev_samp(x), F.sqrt(F.count(x).cast("double")))
    return [
        F.avg(x).alias("mean"),
        (F.avg(x) - half).alias("low"),
        (F.avg(x) + half).alias("high"),
        F.count(x).alias("n"),
    ]


def describe_columns(col: str) -> list[Column]:
    """Count, mean, deviation, extremes and interpolated quartiles of a column."""
    x = F.col(col)
    quartile = lambda p: F.percentile(x, F.lit(p))
    return [
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        quartile(0.25).alias("q25"),
        quartile(0.5).alias("q50"),
        quartile(0.75).alias("q75"),
        F.max(x).alias("max"),
    ]
