"""SimHash near-duplicates with a generalised pigeonhole search.

1. A fingerprint of each text is the bitwise majority of the XXH64 hashes of its word shingles. Equal
   fingerprints are one from here on, however many documents have it.
2. The 64 bits are grouped into ``m`` parts, correlated bits together (correlations are summed
   over all fingerprints). Uneven values then meet in few parts, which the search can avoid.
3. Two fingerprints that differ in at most ``tau`` bits differ, for any thresholds that add up to
   ``tau - m + 1``, by at most its threshold in some part (-1: never probed). Each fingerprint
   chooses its own thresholds by dynamic programming over estimated candidate counts, from a
   histogram of each part of fixed size.
4. Fingerprints are indexed by their parts' values; each probes the values within its thresholds;
   pairs that meet are verified on all bits.
5. Components of the links give every document the smallest id that it reaches.

Buckets hold different fingerprints only and are joined, not collected, so a bucket that many
fingerprints share is a skewed join that adaptive execution splits.

Defined results: a NULL text is empty; texts without words have fingerprint zero, linked like any other; ``component_id``
ignores NULL ids (NULL if all are); repeated rows are rows of one group; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keep_rows, text_digest, written
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BITS = 64
FOLD = 14  # bits of a part's value that the histogram tells apart
PROBE_COST = 2.0  # a probe costs as much as so many candidates
BLOCK = 1 << 16  # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer. ASCII letters are lower-cased."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*[itertools.islice(words, k, None) for k in range(shingle)]))
        n = len(words) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        h = np.fromiter((digest(g, SEED) for g in itertools.islice(grams, size)), "<u8", size)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64
        )
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(id, fp, digest, row): one row per document, written to the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["id", "digest", "fp"]
            )

    rows = docs.select(
        F.col(id_col).alias("id"), text_digest(text_col).alias("digest"), f"`{text_col}`"
    ).mapInArrow(run, f"id {kind}, digest binary, fp long")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_moments(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of bits set together) over all of ``distinct(fp)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            b = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += b.T @ b
            n += len(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, BITS * BITS)), pa.array([n, *total.ravel().astype(np.int64)])],
            names=["cell", "n"],
        )

    cells = (
        distinct.select("fp").mapInArrow(count, "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).collect()
    )
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in cells:
        flat[r.cell + 1] = r.n
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of the bits: each is grown by the free bit that correlates most with it."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = (len(free) + m - k - 1) // (m - k)
        order = sorted(free)
        seed = max(order, key=lambda i: (corr[i, order].max(initial=0), -i))
        part = [seed]
        free.remove(seed)
        while len(part) < width:
            best = max(sorted(free), key=lambda i: corr[i, part].sum())
            part.append(best)
            free.remove(best)
        parts.append(part)
    return parts


@dataclass(frozen=True)
class Partitioning:
    parts: list[list[int]]
    tau: int
    histogram: np.ndarray | None = None  # (m, 2 ** FOLD) counts

    @property
    def m(self) -> int:
        return len(self.parts)

    def values(self, fps: np.ndarray) -> np.ndarray:
        """(m, n) value of each part."""
        b = _bits(fps)
        return np.stack([
            b[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))
            for part in self.parts
        ])

    def folded(self, part: int, values: np.ndarray) -> np.ndarray:
        return values >> max(0, len(self.parts[part]) - FOLD)

    def masks(self, part: int, threshold: int) -> np.ndarray:
        """All differences of at most ``threshold`` bits."""
        width = len(self.parts[part])
        return np.array([
            sum(1 << k for k in chosen)
            for size in range(threshold + 1)
            for chosen in itertools.combinations(range(width), size)
        ], np.int64)

    def costs(self, part: int, values: np.ndarray) -> np.ndarray:
        """(tau + 2, n): estimated cost of the thresholds -1, 0 .. tau in a part."""
        width = len(self.parts[part])
        share = 2.0 ** -max(0, width - FOLD)
        counts = self.histogram[part]
        out = np.zeros((self.tau + 2, len(values)))
        near = counts[self.folded(part, values)] * share
        out[1] = near + PROBE_COST
        ring = sum(counts[self.folded(part, values ^ (1 << k))] for k in range(width)) * share
        probes, total = 1, near
        for t in range(1, self.tau + 1):
            extra = math.comb(width, t)
            total = total + ring * extra / width
            probes += extra
            out[t + 1] = total + PROBE_COST * probes
        return out

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """(m, n) thresholds with sum tau - m + 1 of least estimated cost for each fingerprint."""
        n, budget = values.shape[1], self.tau + 1  # thresholds count from -1 here
        best = np.full((budget + 1, n), np.inf)
        best[0] = 0
        choices = []
        for part in range(self.m):
            cost = self.costs(part, values[part])
            options = np.full((budget + 1, budget + 1, n), np.inf)
            for spent in range(budget + 1):
                for used in range(spent + 1):
                    options[spent, used] = best[spent - used] + cost[used]
            choices.append(options.argmin(axis=1))
            best = options.min(axis=1)
        out = np.zeros((self.m, n), np.int64)
        left, each = np.full(n, budget), np.arange(n)
        for part in reversed(range(self.m)):
            out[part] = choices[part][left, each]
            left = left - out[part]
        return out - 1


KEY_SHIFT = 58  # a key is part << KEY_SHIFT | value


#: Parts of the bits, at every size: with two, chance meetings stay few up to some 10^9 fingerprints.
PARTS = 2


def near_pairs(distinct: DataFrame, tau: int = MAX_BITS, m: int = PARTS) -> DataFrame:
    """(a, b) of different fingerprints in ``distinct(fp)`` that differ in at most ``tau`` bits; a
    pair may come more than once."""
    n, together = bit_moments(distinct)
    plain = Partitioning(group_bits(n, together, m), tau)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys = plain.values(fps) | (np.arange(m, dtype=np.int64)[:, None] << KEY_SHIFT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.tile(fps, m))], names=["key", "b"]
            )

    indexed = distinct.select("fp").mapInArrow(index, "key long, b long")
    shift = [max(0, len(p) - FOLD) for p in plain.parts]
    low = F.col("key").bitwiseAND((1 << KEY_SHIFT) - 1)
    part = F.shiftright("key", KEY_SHIFT)
    fold = F.coalesce(*[F.when(part == k, F.shiftright(low, s)) for k, s in enumerate(shift)])
    histogram = np.zeros((m, 1 << FOLD))
    for r in indexed.groupBy(part.alias("part"), fold.alias("fold")).count().collect():
        histogram[r["part"], r["fold"]] = r["count"]
    search = Partitioning(plain.parts, tau, histogram)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            values = search.values(fps)
            chosen = search.thresholds(values)
            for k in range(m):
                for t in range(tau + 1):
                    at = np.flatnonzero(chosen[k] == t)
                    if not len(at):
                        continue
                    masks = search.masks(k, t)
                    step = max(1, 1_000_000 // len(masks))
                    for lo in range(0, len(at), step):
                        some = at[lo : lo + step]
                        keys = (values[k][some][:, None] ^ masks[None, :]) | (k << KEY_SHIFT)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.ravel()), pa.array(np.repeat(fps[some], len(masks)))],
                            names=["key", "a"],
                        )

    probes = distinct.select("fp").mapInArrow(probe, "key long, a long")
    # Each fingerprint finds all its partners, so one direction is enough.
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    return probes.join(indexed, "key").filter((F.col("a") < F.col("b")) & close).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per document: id, fp (signed), component_id, digest, row, keep (one row of each component)."""
    rows = fingerprints(docs, id_col, text_col, shingle)
    distinct = written(
        rows.groupBy("fp").agg(F.min("id").alias("least"), F.max("row").alias("last")), "distinct"
    )
    roots = components(near_pairs(distinct, max_bits))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", "last", F.coalesce("root", "fp").alias("root")
    )
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"), F.max("last").alias("any_row"))
    by_fp = written(
        named.join(whole, "root").select("fp", "component_id", "any_row"), "classes"
    )
    # The row with the smallest id stays; where that id is repeated or all are NULL, one of them.
    out = rows.join(by_fp, "fp")
    first = (
        out.filter(F.col("id") == F.col("component_id"))
        .groupBy("component_id", "any_row").agg(F.max("row").alias("keep_row"))
    )
    return (
        out.join(first, ["component_id", "any_row"], "left")
        .withColumn("keep", F.col("row") == F.coalesce("keep_row", "any_row"))
        .select("id", "fp", "component_id", "digest", "row", "keep")
    )


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, max_bits: int = MAX_BITS,
) -> DataFrame:
    """The documents that stay, with all their columns: one of each component."""
    kept = near_duplicates(docs, id_col, text_col, shingle, max_bits).filter("keep")
    return keep_rows(docs, kept.select("id", "digest"), id_col, text_col)
