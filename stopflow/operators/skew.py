"""Helpers that keep a plan safe when one key holds a large part of all rows.

* :func:`bounded_broadcast` broadcasts a side only after checking its rows and bytes.
* :func:`hot_groups` finds keys too large for one task with a mergeable top-k sketch: one
  scan, no shuffle of the keys, at most ``MAX_HOT`` entries on the driver.
* :func:`with_neighbours` gives each row the values of the row before / after it in its
  group. Ordinary groups use a window; hot groups are cut into ordered chunks over many
  tasks, and each chunk's edge row is carried over to the chunk next to it. Both ways are
  exact, so which one a group takes never changes the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.shared import shared_folder

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 128 << 20
#: Files of so many bytes, however well compressed, need no count.
SURELY_SMALL = 4 << 20
HOT_ROWS = 2_000_000
#: Rows that one task sorts (some 900 bytes each for whole visits).
TASK_ROWS = 250_000
MAX_HOT = 50_000


#: Nodes of a plan that may make many rows of one, which the optimizer's estimate does not see.
_MULTIPLY = ("Generate", "MapIn", "FlatMap", "Expand")


def planned_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of a side's size, from file sizes (for joins the product, hence far too large); None where
    a node may multiply rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(node in plan.toString() for node in _MULTIPLY):
        return None
    return int(plan.stats().sizeInBytes())


def _bytes_of(df: DataFrame) -> Column:
    """Bytes of a row: the length of texts and binaries, the width of anything else."""
    total = F.lit(0).cast("bigint")
    for field in df.schema:
        kind = field.dataType.simpleString()
        c = F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.length(F.to_json(F.struct(c)))
        else:
            total = total + F.lit(8)
    return total


def bounded_broadcast(
    side: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``side`` to be broadcast if it is small, else as it is, for a shuffle join whose skewed partitions adaptive
    execution splits. Small is what the files behind it already show, or else at most ``max_rows`` rows and
    ``max_bytes`` by a count; for that the side is computed once and kept (checkpointed), so the join does not run
    it again."""
    planned = planned_bytes(side)
    if planned is not None and planned <= min(SURELY_SMALL, max_bytes, 8 * max_rows):
        return F.broadcast(side)
    use_checkpoint_dir(side.sparkSession)
    held = side.limit(max_rows + 1).checkpoint()
    rows, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes_of(held)), F.lit(0))).first()
    return F.broadcast(held) if rows <= max_rows and size <= max_bytes else side


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's checkpoint folder; choose one only where none is set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark, "checkpoint"))


@dataclass(frozen=True)
class HotGroups:
    """Hashes of the keys to treat as hot and the number of rows they hold, and the rows of the whole
    table (0 where it is small). A cold key that happens to share a hash is only processed the other
    way, with the same result."""

    hashes: tuple[int, ...] = ()
    rows: int = 0
    total: int = 0

    def __bool__(self) -> bool:
        return bool(self.hashes)


NO_HOT = HotGroups()


def hot_groups(
    df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS
) -> HotGroups:
    """Groups with at least ``min_rows`` rows, or one part in MAX_HOT of the table where that
    is more. So at most ``k`` groups can be hot, and the sketch lists that many. Tables below
    ``min_rows`` cost one count."""
    total = df.count()
    if total < min_rows:
        return NO_HOT
    min_rows = max(min_rows, total // MAX_HOT)
    k = total // min_rows + 1
    top = (
        df.select(F.xxhash64(*keys).alias("h"))
        .agg(F.expr(f"approx_top_k(h, {int(k)}, {min(10 * int(k) + 1000, 1_000_000)})").alias("top"))
        .first()
        .top
    )
    hot = [(item["item"], item["count"]) for item in top if item["count"] >= min_rows]
    return HotGroups(tuple(h for h, _ in hot), sum(n for _, n in hot), total)


def partitioned_by(df: DataFrame, keys: Sequence[str], hot: HotGroups) -> DataFrame:
    """``df`` dealt out by ``keys`` for the windows to come, a task for each TASK_ROWS rows. Partitions that are
    merged by their compressed bytes, or whose number is fixed, would grow with the table until tasks spill.
    Small tables are left to the window's own shuffle."""
    if hot.total <= TASK_ROWS:
        return df
    n = max(math.ceil(hot.total / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def split_hot(
    df: DataFrame, keys: Sequence[str], hot: HotGroups
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None). The list of hashes has at
    most ``MAX_HOT`` entries, so broadcasting it is bounded."""
    if not hot:
        return df, None
    listed = F.broadcast(
        df.sparkSession.createDataFrame([(h,) for h in hot.hashes], "_hot bigint")
    )
    hashed = df.withColumn("_hot", F.xxhash64(*keys))
    cold = hashed.join(listed, "_hot", "left_anti").drop("_hot")
    return cold, hashed.join(listed, "_hot", "left_semi").drop("_hot")


def nulls_last(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def order_key(order: Sequence[str]) -> Column:
    """Struct that compares like ``nulls_last(order)``."""
    parts = []
    for i, c in enumerate(order):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    return F.struct(*parts)


def broadcast_left_join(left: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL with a side whose size the caller has bounded."""
    renamed = F.broadcast(small.withColumnsRenamed({k: f"_r_{k}" for k in keys}))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, same, "left").drop(*[f"_r_{k}" for k in keys])


def ordered_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, chunk_rows: int
) -> DataFrame:
    """Range-partition by (keys, order) and number rows (``_uid``) and chunks (``_chunk``,
    ascending with the order). Checkpointed, so that both numbers stay fixed."""
    use_checkpoint_dir(df.sparkSession)
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(wanted, math.ceil(rows / chunk_rows), 2)
    return (
        df.withColumn("_uid", F.monotonically_increasing_id())
        .repartitionByRange(n, *keys, *nulls_last(order), "_uid")
        .withColumn("_chunk", F.spark_partition_id())
        .checkpoint()
    )


def chunk_neighbours(
    chunks: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    prev: Sequence[str] = (),
    next: Sequence[str] = (),
) -> DataFrame:
    """Add ``prev_*`` / ``next_*`` to rows numbered by :func:`ordered_chunks`."""
    total_order = [*order, "_uid"]
    inside = Window.partitionBy("_chunk", *keys).orderBy(*nulls_last(total_order))
    out = chunks
    edges = chunks.groupBy("_chunk", *keys)
    wanted, carried = [], []
    if prev:
        row = F.struct(*prev)
        out = out.withColumn("_prev", F.lag(row).over(inside))
        wanted.append(F.max_by(row, order_key(total_order)).alias("_last"))
        carried.append(F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_pc"))
    if next:
        row = F.struct(*next)
        out = out.withColumn("_next", F.lead(row).over(inside))
        wanted.append(F.min_by(row, order_key(total_order)).alias("_head"))
        carried.append(F.lead("_head").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_nc"))
    # One row per (group, chunk): at most groups + chunks rows, hence safe to broadcast.
    carry = edges.agg(*wanted).select("_chunk", *keys, *carried)
    out = broadcast_left_join(out, carry, ["_chunk", *keys])
    return out.select(
        *chunks.columns,
        *[F.coalesce("_prev", "_pc")[c].alias(f"prev_{c}") for c in prev],
        *[F.coalesce("_next", "_nc")[c].alias(f"next_{c}") for c in next],
    )


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    prev: Sequence[str] = (),
    next: Sequence[str] = (),
    hot: HotGroups | None = None,
    chunk_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``prev_x`` for each x in ``prev`` and ``next_x`` for each x in ``next``: the value
    in the row before / after within the group. ``hot=None`` looks for hot groups itself."""
    if hot is None:
        hot = hot_groups(df, keys)
    cold, big = split_hot(df, keys, hot)
    w = Window.partitionBy(*keys).orderBy(*nulls_last(order))
    out = cold.select(
        "*",
        *[F.lag(c).over(w).alias(f"prev_{c}") for c in prev],
        *[F.lead(c).over(w).alias(f"next_{c}") for c in next],
    )
    if big is None:
        return out
    chunks = ordered_chunks(big, keys, order, hot.rows, chunk_rows)
    done = chunk_neighbours(chunks, keys, order, prev, next).drop("_uid", "_chunk")
    return out.unionByName(done)


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hot: HotGroups | None = None,
    chunk_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``position`` (1, 2, ... in the group) and ``group_size``. A chunk of a hot group
    starts counting at the number of rows in the chunks before it."""
    if hot is None:
        hot = hot_groups(df, keys)
    cold, big = split_hot(df, keys, hot)
    w = Window.partitionBy(*keys)
    out = partitioned_by(cold, keys, hot).select(
        "*",
        F.row_number().over(w.orderBy(*nulls_last(order))).cast("bigint").alias("position"),
        F.count(F.lit(1)).over(w).alias("group_size"),
    )
    if big is None:
        return out
    chunks = ordered_chunks(big, keys, order, hot.rows, chunk_rows)
    # at most groups + chunks rows
    sizes = chunks.groupBy("_chunk", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = w.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_chunk", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(w).alias("group_size"),
    )
    inside = Window.partitionBy("_chunk", *keys).orderBy(*nulls_last([*order, "_uid"]))
    placed = broadcast_left_join(
        chunks.withColumn("_nr", F.row_number().over(inside)), offsets, ["_chunk", *keys]
    )
    return out.unionByName(
        placed.select(*df.columns, (F.col("_before") + F.col("_nr")).alias("position"), "group_size")
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. Spark limits each task to one row per key before the shuffle
    (window group limit), so hot keys shrink to one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
