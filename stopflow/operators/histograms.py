"""Value histograms: how often each value of a measure occurs in a group.

Raw rows are counted once, map-side first, by (group, measure, value). Counts of a fine group add up to those of a
coarse one, so all grains of a report come from the same counts, and exact quantiles from running sums over them.
A histogram has one row for each distinct value, whatever the number of rows behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_counts(
    rows: DataFrame, keys: Sequence[str], measures: Sequence[str], extra: Sequence[Column] = (), kind: str = "bigint"
) -> DataFrame:
    """(keys, measure, value, n, and the ``extra`` aggregates of the rows behind it). NULL is a value too."""
    others = [c for c in rows.columns if c not in (*keys, *measures)]
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast(kind).alias("value")) for m in measures])
    return (
        rows.select(*keys, *others, F.inline(pairs))
        .groupBy(*keys, "measure", "value").agg(F.count(F.lit(1)).alias("n"), *extra)
    )


def rolled_up(counts: DataFrame, keys: Sequence[str], drop: str, extra: Sequence[Column] = ()) -> DataFrame:
    """``counts`` and beside them those of the coarser groups without ``drop`` (whose column is NULL there;
    ``coarse`` tells them). Needs no shuffle if ``counts`` is partitioned by the other keys."""
    grains = counts.withColumn("coarse", F.explode(F.array(F.lit(False), F.lit(True))))
    return (
        grains.withColumn(drop, F.when(~F.col("coarse"), F.col(drop)))
        .groupBy(*keys, "coarse", "measure", "value").agg(F.sum("n").alias("n"), *extra)
    )


def with_shares(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``upto``, the rows of the group up to the value, and ``known``, those with a value."""
    group = Window.partitionBy(*keys, "measure")
    running = group.orderBy(F.col("value").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    return counts.withColumn("upto", F.sum("n").over(running)).withColumn(
        "known", F.coalesce(F.sum(known).over(group), F.lit(0))
    )


def _first(measure: str, reached: Column) -> Column:
    return F.min(F.when((F.col("measure") == measure) & reached, F.col("value")))


def disc(measure: str, p: float) -> Column:
    """Smallest value whose cumulative share reaches ``p``."""
    return _first(measure, F.col("upto") >= F.lit(float(p)) * F.col("known"))


def middle(measure: str) -> Column:
    """Median: the mean of the two middle values."""
    low = _first(measure, 2 * F.col("upto") >= F.col("known"))
    high = _first(measure, 2 * F.col("upto") > F.col("known"))
    return (low + high) / F.lit(2.0)


def mean(measure: str) -> Column:
    mine = F.col("measure") == measure
    total = F.sum(F.when(mine, F.col("value") * F.col("n")))
    return total / F.sum(F.when(mine & F.col("value").isNotNull(), F.col("n"))).cast("double")


def rows_behind(measure: str) -> Column:
    """Rows of the group, those without a value included."""
    return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))
