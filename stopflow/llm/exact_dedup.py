"""Exact duplicates with a heavy-hitter split. DataFrame functions only.

Digests of the whole texts are computed once and written as a narrow table. A mergeable
counter-based summary (Misra and Gries' frequent items, in Spark the ``approx_top_k``
aggregate) lists digests that may be frequent: every digest held by more than ``rows / counters``
rows is among them, whatever their order. One map-side aggregate counts these candidates
exactly and finds the row that stays in each; the winners, at most ``counters`` rows, are
broadcast, so rows of frequent digests never cross the network. All other digests hold few rows each
and use an ordinary shuffle of (id, digest).

Defined results: a NULL text counts as empty; a NULL id ranks below every other id; rows with
the same id and the same text are ties, of which exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import keep_rows, small_table, text_digest, written

#: Entries that the summary tracks; bounds the broadcast (at most this many rows of ~80 bytes).
COUNTERS = 4096
#: Share of all rows from which a digest is handled map-side, as 1 / HEAVY_SHARE.
HEAVY_SHARE = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``row`` (tells apart repeated rows), ``digest``."""
    return written(
        docs.select(
            F.col(id_col).alias("id"),
            text_digest(text_col).alias("digest"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )


def heavy_winners(rows: DataFrame, counters: int = COUNTERS) -> DataFrame | None:
    """(digest, keep_id, keep_row, group_size) of the frequent digests, counted exactly; None
    if no digest is frequent. At most ``HEAVY_SHARE`` rows pass the exact count."""
    found = rows.agg(
        F.expr(f"approx_top_k(xxhash64(digest), {counters // 2}, {counters})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    least = max(found.n // HEAVY_SHARE, 2)
    listed = [(item["item"],) for item in found.top or () if item["count"] >= least]
    if not listed:
        return None
    # A rare digest with the hash of a frequent one is only counted here too, with the same result.
    candidates = F.broadcast(small_table(rows.sparkSession, listed, "hash long"))
    best = (
        rows.join(candidates, F.xxhash64("digest") == F.col("hash"))
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    tied = (
        rows.join(F.broadcast(best), "digest")
        .filter(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "keep_id", "group_size")
        .agg(F.max("row").alias("keep_row"))
    )
    return written(tied, "winners")


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, digest`` (binary SHA-256)."""
    rows = digests(docs, id_col, text_col)
    winners = heavy_winners(rows, counters)
    rest, heavy = rows, None
    if winners is not None:
        heavy = rows.join(F.broadcast(winners), "digest").select(
            "id", "keep_id", "group_size",
            (F.col("row") == F.col("keep_row")).alias("kept"), "digest",
        )
        rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    ranked = Window.partitionBy("digest").orderBy(
        F.col("id").desc_nulls_last(), F.col("row").desc()
    )
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    light = rest.select(
        "id",
        F.first("id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"),
        "digest",
    )
    return light if heavy is None else light.unionByName(heavy)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = duplicate_groups(docs, id_col, text_col, counters).filter("kept")
    return keep_rows(docs, kept, id_col, text_col)
