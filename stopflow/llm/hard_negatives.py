"""Hard negatives by exact search in an inverted multi-index.

1. Vectors become whole numbers, so scores (inner products) are exact. A codebook for each half of the
   components is fitted on a bounded sample (SAMPLE rows, least hashes); every row is filed under its cell,
   the pair of its nearest codewords.
2. Rows are dealt in order of cells to shards, anchors to blocks. Each task holds one block and one
   shard: it knows the radius of every codeword among its own rows, so the half scores of a cell's rows are
   at most ``anchor . codeword + |anchor half| * radius``.
3. For each anchor a heap over the two sorted lists of half bounds visits cells by falling sums. What an anchor wants
   is a set of windows of scores with so many places each; a window is certified once its last place scores more
   than the next cell's bound, and an anchor stops when all of its windows are.
4. Pass one finds the positives (one window without an upper end); pass two the negatives (one window for each
   positive). Scores in the sample are a first bound for every window. The shards' winners are merged by rank.

Work is the anchors times the cells that no bound excludes; where vectors do not cluster that is nearly all
of them, as dense products. Blocks and shards hold bounded numbers of rows, so a vector, label or cell of
a third of all rows is many tasks. Nothing but the sample, counts and codebooks reaches the driver.

Defined results: rows with a NULL id, label or vector, or a NULL or non-finite component take no part, nor do those
with one so large (some 46,000 with 64 components) that a score could pass 2 ** 53; short vectors count as if
filled with zeros; repeated rows are rows of their own; ties go to the smaller id; no anchors or an empty table
give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shuffle_partitions, written

SCALE = 256
EXACT = 1 << 53  # whole numbers up to here are exact as floats
CODEWORDS = 32
SAMPLE = 4096
SHARD = BLOCK = 32768  # rows and anchors of a task
CHUNK = 1024  # anchors that search together
FIRST_ROWS = 256  # rows that an anchor looks at before its windows are judged
TILE = 1 << 20  # scores computed at a time
ROUNDS = 12  # of k-means

_FOUND = ("anchor_row long, anchor_id long, place int, positive_id long, positive_score long, "
          "row long, id long, score long")


def fit(halves: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` codewords of ``halves`` (points as rows), by k-means from far-apart points."""
    points = np.unique(halves, axis=0).astype(float)
    if len(points) <= k:
        return points
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    words = points[chosen]
    for _ in range(ROUNDS):
        own = nearest(points, words)
        for c in range(k):
            mine = points[own == c]
            if len(mine):
                words[c] = mine.mean(0)
    return words


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * points @ words.T).argmin(1)


def multi_sequence(u: list[float], v: list[float]) -> Iterator[tuple[float, int, int]]:
    """(u[x] + v[y], x, y) of all pairs by falling sums; both lists fall."""
    if not u or not v:
        return
    heap = [(-u[0] - v[0], 0, 0)]
    while heap:
        bound, x, y = heapq.heappop(heap)
        yield -bound, x, y
        if y + 1 < len(v):
            heapq.heappush(heap, (-u[x] - v[y + 1], x, y + 1))
        if y == 0 and x + 1 < len(u):
            heapq.heappush(heap, (-u[x + 1] - v[0], x + 1, 0))


class Best:
    """The first ``places`` candidates of each key, by (score falling, id, row)."""

    def __init__(self, keys: int, places: int):
        self.keys, self.places, self.waiting = keys, places, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, key, score, ids, rows) -> None:
        self.parts.append((key, score, ids, rows))
        self.waiting += len(key)
        if self.waiting > TILE:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        if len(self.parts) > 1 or self.waiting:
            key, score, ids, rows = (np.concatenate(c) for c in zip(*self.parts))
            order = np.lexsort((rows, ids, -score, key))
            key = key[order]
            first = np.searchsorted(key, key)  # where the key begins
            keep = np.arange(len(key)) - first < self.places
            self.parts = [(key[keep], *(c[order][keep] for c in (score, ids, rows)))]
            self.waiting = 0
        return self.parts[0]

    def last_places(self, floor: np.ndarray) -> np.ndarray:
        """``floor``, raised to the last place of keys whose places are all taken."""
        key, score, _, _ = self.settle()
        out = floor.copy()
        full = np.flatnonzero(np.arange(len(key)) - np.searchsorted(key, key) == self.places - 1)
        out[key[full]] = np.maximum(out[key[full]], score[full])
        return out


class Shard:
    """Rows of a task, sorted by cell, with the radii of the codewords among them."""

    def __init__(self, x: np.ndarray, ids, rows, labels, books):
        half = x.shape[1] // 2
        self.half, self.words, self.radii, codes = half, [], [], []
        for part, book in zip((x[:, :half], x[:, half:]), books):
            own = nearest(part, book)
            used, place = np.unique(own, return_inverse=True)
            away = np.sqrt(((part - book[own]) ** 2).sum(1))
            radius = np.zeros(len(used))
            np.maximum.at(radius, place, away)
            self.words.append(book[used])
            self.radii.append(radius)
            codes.append(place)
        cell = codes[0] * len(self.words[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.x, self.ids, self.rows, self.labels = x[order], ids[order], rows[order], labels[order]
        named, first = np.unique(cell[order], return_index=True)
        ends = [*first[1:].tolist(), len(order)]
        self.spans = dict(zip(named.tolist(), zip(first.tolist(), ends)))

    def bounds(self, a: np.ndarray) -> list[np.ndarray]:
        """For both halves, the bound of each codeword for each anchor (a little more than exact)."""
        out = []
        for part, words, radius in zip((a[:, : self.half], a[:, self.half :]), self.words, self.radii):
            size = np.sqrt((part**2).sum(1))[:, None]
            bound = part @ words.T + size * radius
            out.append(bound + 1e-9 * (size * (np.sqrt((words**2).sum(1)) + radius)) + 1e-6)
        return out

    def search(self, a, a_rows, a_labels, same: bool, upper, floor, places: int) -> tuple[np.ndarray, ...]:
        """(window, score, id, row): the first ``places`` rows of each window of scores floor .. upper (both anchors x
        windows) with the anchor's label (``same``) or another. Window w of anchor i is i * windows + w."""
        windows = upper.shape[1]
        best = Best(upper.size, places)
        stops = floor.copy()
        walks, orders = [], []
        u, v = self.bounds(a)
        by_u, by_v = np.argsort(-u, axis=1, kind="stable"), np.argsort(-v, axis=1, kind="stable")
        u, v = np.take_along_axis(u, by_u, 1).tolist(), np.take_along_axis(v, by_v, 1).tolist()
        by_u, by_v = (by_u * len(self.words[1])).tolist(), by_v.tolist()
        for i in range(len(a)):
            walks.append(multi_sequence(u[i], v[i]))
            orders.append((by_u[i], by_v[i]))
        alive, quota = range(len(a)), FIRST_ROWS
        while alive:
            wanted: dict[int, list[int]] = defaultdict(list)
            stop = stops.min(axis=1).tolist()
            left = []
            for i in alive:
                seen, (xs, ys), least = 0, orders[i], stop[i]
                for bound, x, y in walks[i]:
                    if bound < least:
                        break
                    cell = xs[x] + ys[y]
                    span = self.spans.get(cell)
                    if span is not None:
                        wanted[cell].append(i)
                        seen += span[1] - span[0]
                        if seen >= quota:
                            left.append(i)
                            break
            for cell, anchors in wanted.items():
                lo, hi = self.spans[cell]
                self._visit(lo, hi, np.array(anchors), a, a_rows, a_labels, same, upper, stops, best)
            stops = best.last_places(floor.ravel()).reshape(-1, windows)
            alive, quota = left, quota * 4
        return best.settle()

    def _visit(self, lo, hi, anchors, a, a_rows, a_labels, same, upper, stops, best) -> None:
        windows = upper.shape[1]
        step = max(1, TILE // max(1, len(anchors)))
        for at in range(lo, hi, step):
            to = min(hi, at + step)
            score = a[anchors] @ self.x[at:to].T
            fit_label = (a_labels[anchors][:, None] == self.labels[at:to]) == same
            if same:
                fit_label &= a_rows[anchors][:, None] != self.rows[at:to]
            for w in range(windows):
                inside = fit_label & (score <= upper[anchors, w][:, None]) & (score >= stops[anchors, w][:, None])
                i, j = np.nonzero(inside)
                if len(i):
                    best.add(
                        anchors[i] * windows + w, score[i, j].astype(np.int64), self.ids[at:to][j], self.rows[at:to][j]
                    )


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``dim`` (filled with zeros). Floats, whose products are exact here."""
    out = np.zeros((len(column), dim))
    at = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        flat = part.flatten().to_numpy(zero_copy_only=False)
        size = part.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(at, at + len(part)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        at += len(part)
    return out


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _limits(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score of a positive score, ``low`` and ``high`` percent of it."""
    return -((-low * positive) // 100), (high * positive) // 100


def _seeds(a, a_rows, a_labels, sample, same, lower, upper, places) -> np.ndarray:
    """A floor of each window: the last of its places in the sample alone, if that fills them."""
    x, rows, labels = sample
    out = lower.astype(float)
    for at in range(0, len(a), 256):
        some = slice(at, at + 256)
        score = a[some] @ x.T
        fits = (a_labels[some][:, None] == labels) == same
        if same:
            fits &= a_rows[some][:, None] != rows
        for w in range(lower.shape[1]):
            inside = fits & (score >= lower[some, w][:, None]) & (score <= upper[some, w][:, None])
            if score.shape[1] >= places:
                last = np.partition(np.where(inside, score, -np.inf), -places, axis=1)[:, -places]
                out[some, w] = np.maximum(out[some, w], last)
    return out


def _pairs(rows: DataFrame, anchors: DataFrame, blocks: int, shards: int, function) -> DataFrame:
    """``function`` over every pair of an anchor block and a shard of rows."""
    tasks = min(20_000, 2 * blocks * shards)
    keys = ["block", "shard"]
    left = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return (
        left.repartition(tasks, *keys).groupBy(*keys)
        .cogroup(right.repartition(tasks, *keys).groupBy(*keys))
        .applyInArrow(function, _FOUND)
    )


def _table(columns: list, names: str = _FOUND) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.strip().split() for f in names.split(",")]
    return pa.table({n: pa.array(c, kinds[t]) for c, (n, t) in zip(columns, fields)})


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
    label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: int = SCALE, codewords: int = CODEWORDS, sample_rows: int = SAMPLE,
    block_rows: int = BLOCK, shard_rows: int = SHARD,
) -> DataFrame:
    """For each row where ``anchor`` holds and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels that score ``low`` to ``high`` percent of the positive: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    vec, whole = F.col(f"`{vec_col}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    usable = F.forall(vec, lambda x: x.isNotNull() & F.coalesce(whole(x).between(-(1 << 30), 1 << 30), F.lit(False)) & ~F.isnan(x))
    rows = written(
        vectors.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & vec.isNotNull() & usable)
        .select(
            F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
            F.transform(vec, lambda x: whole(x).cast("int")).alias("q"),
            F.coalesce(anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row"),
        ),
        "vectors",
    )
    n, n_anchors, dim = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("q"))).first()
    final = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n_anchors:
        return spark.createDataFrame([], final)
    dim = max(2, dim)
    rows = rows.filter(F.forall("q", lambda x: F.abs(x) <= math.isqrt(EXACT // dim)))
    drawn = rows.orderBy(F.xxhash64("id", "q"), "row").limit(sample_rows).select("row", "label", "q").collect()
    x = np.zeros((len(drawn), dim))
    for at, r in enumerate(drawn):
        x[at, : len(r.q)] = r.q
    books = [fit(x[:, : dim // 2], codewords), fit(x[:, dim // 2 :], codewords)]
    sample = x, np.array([r.row for r in drawn]), np.array([r.label for r in drawn])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("q")), dim)
            cell = nearest(x[:, : dim // 2], books[0]) * len(books[1]) + nearest(x[:, dim // 2 :], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    kinds = "id long, label long, q array<int>, anchor boolean, row long"
    shards = max(shuffle_partitions(spark), math.ceil(n / shard_rows))
    filed = written(
        rows.mapInArrow(file, f"{kinds}, cell long").repartitionByRange(shards, "cell", "row")
        .withColumn("shard", F.spark_partition_id()), "cells",
    )
    shards = filed.agg(F.max("shard")).first()[0] + 1
    blocks = math.ceil(n_anchors / block_rows)
    held = filed.select("id", "label", "q", "row", "shard")

    def seeded_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns))
            a = _matrix(c["q"], dim)
            ends = np.full((len(a), 1), np.inf)
            floor = _seeds(a, _numbers(c["row"]), _numbers(c["label"]), sample, True, -ends, ends, positives)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor[:, 0])], names=[*batch.schema.names, "floor"])

    anchors = filed.filter("anchor").select(
        "id", "label", "q", "row", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    )
    first = anchors.mapInArrow(seeded_positives, "id long, label long, q array<int>, row long, block int, floor double")

    def sides(left: pa.Table, right: pa.Table):
        """The anchors' columns in chunks, and the shard."""
        a = _matrix(left["q"], dim)
        shard = Shard(_matrix(right["q"], dim), *(_numbers(right[c]) for c in ("id", "row", "label")), books)
        ids, rows, labels = (_numbers(left[c]) for c in ("id", "row", "label"))
        return shard, [(slice(at, at + CHUNK), a[at : at + CHUNK], ids[at : at + CHUNK], rows[at : at + CHUNK],
                        labels[at : at + CHUNK]) for at in range(0, len(a), CHUNK)]

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table([[]] * 8)
        out = []
        shard, chunks = sides(left, right)
        floors = left["floor"].to_numpy(zero_copy_only=False)
        for some, a, a_ids, a_rows, a_labels in chunks:
            floor = floors[some][:, None]
            at, score, ids, rows = shard.search(a, a_rows, a_labels, True, np.full(floor.shape, np.inf), floor, positives)
            none = np.zeros(len(at), np.int64)
            out.append(_table([a_rows[at], a_ids[at], none, none, none, rows, ids, score]))
        return pa.concat_tables(out)

    by_score = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    chosen = (
        _pairs(held, first, blocks, shards, find_positives)
        .withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= positives)
        .groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("chosen"))
    )

    def seeded_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns))
            a, score = _matrix(c["q"], dim), _padded(c["score"], positives)
            lower, upper = _limits(score, low, high)
            lower, upper = lower.astype(float), upper.astype(float)
            _close(c["score"], lower, upper)
            floor = _seeds(a, _numbers(c["row"]), _numbers(c["label"]), sample, False, lower, upper, negatives)
            flat = pa.array(list(floor), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "floor"])

    again = (
        anchors.join(chosen, anchors.row == chosen.anchor_row)
        .select("id", "label", "q", "row", "block", F.col("chosen.id").alias("positive"), F.col("chosen.score").alias("score"))
    )
    second = written(
        again.mapInArrow(
            seeded_negatives,
            "id long, label long, q array<int>, row long, block int, positive array<long>, score array<long>, floor array<double>",
        ), "positives",
    )

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table([[]] * 8)
        out = []
        shard, chunks = sides(left, right)
        ids_of, score_of = _padded(left["positive"], positives), _padded(left["score"], positives)
        _, upper = _limits(score_of, low, high)
        upper = upper.astype(float)
        floor = np.array(left["floor"].to_pylist(), float).reshape(upper.shape)
        _close(left["score"], floor, upper)
        for some, a, a_ids, a_rows, a_labels in chunks:
            at, score, ids, rows = shard.search(a, a_rows, a_labels, False, upper[some], floor[some], negatives)
            i, w = at // positives, at % positives
            out.append(_table([a_rows[i], a_ids[i], w, ids_of[some][i, w], score_of[some][i, w], rows, ids, score]))
        return pa.concat_tables(out)

    by_rank = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "id", "row")
    return (
        _pairs(held, second, blocks, shards, find_negatives)
        .withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= negatives)
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )


def _padded(column, width: int) -> np.ndarray:
    """Lists of at most ``width`` longs as rows, filled with zeros."""
    return np.array([[*x, *[0] * (width - len(x))] for x in column.to_pylist()], np.int64).reshape(-1, width)


def _close(scores, floor: np.ndarray, upper: np.ndarray) -> None:
    """Windows without a positive, and empty ones, want nothing."""
    given = np.array([len(x) for x in scores.to_pylist()])
    shut = (np.arange(upper.shape[1]) >= given[:, None]) | (floor > upper)
    floor[shut], upper[shut] = np.inf, -np.inf
