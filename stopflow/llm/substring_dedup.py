"""Substring dedup by relative Lempel-Ziv factors.

A window is ``window`` consecutive words. Every document is parsed into factors against an index
of all documents:

1. Each task hashes words and windows by arithmetic on whole arrays. Winnowed word grams are the anchors: any two
   equal windows hold the same anchor at the same offset, so neighbouring windows with one anchor
   form a factor, the longest stretch that an index entry of this anchor can cover.
2. Factors are dealt by the hash of their anchor; each bucket is the index of its anchors over all
   reference blocks. A factor whose whole text occurs elsewhere is a duplicate span at once (the greedy match). Where only
   the anchor is shared, the factor lies at the boundary of a longer match, and its windows
   are looked up one by one among the windows of all factors of that anchor.
3. Matched windows become spans of words, which are removed from the document.

Inside a block of one task, windows that repeat are settled at once and of equal factors only the
first is dealt out, so what meets in a bucket is at most one copy for each block, however
often a passage occurs. Blocks hold about BLOCK_WORDS words; a longer document is a block of its own.

Anchors of very many different factors (a phrase shorter than a window in a third of all documents) would still
gather one factor for each document in a bucket. They are found in a sample of the documents; their factors are split
into windows, each filed under itself, so they spread over all buckets. Which anchors are split changes no result.

Windows are equal when the 64-bit hash of their anchor, its offset and KEPT_BYTES bytes of their
own 64-bit hash are equal.

Defined results: a NULL text has no words; documents shorter than a window stay whole; rows with equal id and
text are rows of their own (each repeats the other) and get the same result; NULL ids are ids like any
other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import shuffle_partitions

WINDOW = 35
GRAM = 12
BLOCK_WORDS = 1_000_000
BUCKETS_PER_PARTITION = 2
KEPT_BYTES = 5
#: An anchor with so many different factors among so many sampled documents is split.
SAMPLE_DOCS, HOT_FACTORS = 50_000, 20
MEMO = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2 ** 64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers, so that no order or low bit stays visible."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def word_list(text: str | None) -> list[bytes]:
    """Words in UTF-8; ``bytes.split`` splits at exactly the six white characters."""
    return (text or "").encode().split()


class Rolling:
    """Hashes of all grams of a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.cumprod(powers[:n], dtype=np.uint64), out=self._sums[1:])
        inverse = np.full(n + 1, _INVERSE, np.uint64)
        inverse[0] = 1
        self._inverse = np.cumprod(inverse, dtype=np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[end] - self._sums[start]) * self._inverse[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self._sums) - size
        return _mixed((self._sums[size:] - self._sums[:-size]) * self._inverse[:n])


def _rightmost_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the rightmost minimum of each window of ``width`` values."""
    best = x[width - 1 :].copy()
    at = np.arange(width - 1, len(x))
    for k in range(width - 2, -1, -1):
        here = x[k : len(x) - width + 1 + k]
        less = here < best
        best[less] = here[less]
        at[less] = np.flatnonzero(less) + k
    return at


# ---- parsing one block -----------------------------------------------------------------------

def _times(keys: np.ndarray) -> np.ndarray:
    """How often the key of each element occurs."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back]


def _numbers(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (size[0] of them), first[1], .."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans of one document; spans that touch become one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[cut], reach[np.r_[cut[1:], len(start)] - 1]


def spans_by_document(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(document, starts, ends) with the merged spans of each document."""
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield (int(doc[lo]), *merged(start[lo:hi], end[lo:hi]))


class Factors:
    """The factors of one block: parallel arrays, and the hashes of all windows in their order."""

    def __init__(self, sequences: list[np.ndarray], window: int, gram: int):
        parts = []
        for number, words in enumerate(sequences):
            if len(words) < window:
                continue
            rolling = Rolling(words)
            at = _rightmost_minima(rolling.grams(gram), window - gram + 1)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            end = np.r_[first[1:], len(at)]
            place = at[first]
            offset = place - first
            whole = _mixed(rolling.spans(first, end + window - 1) + offset.astype(np.uint64))
            parts.append((
                np.full(len(first), number), first, end - first, offset,
                rolling.spans(place, place + gram), whole, rolling.grams(window),
            ))
        self.empty = not parts
        if parts:
            (self.doc, self.first, self.size, self.offset, self.anchor, self.whole,
             self.windows) = (np.concatenate(c) for c in zip(*parts))
            self.at = np.cumsum(self.size) - self.size


#: One packed row: the factors of one block whose anchors fall into one bucket. Without
#: anchors, ``first`` and ``size`` are settled spans of windows.
PACKED = (
    "bucket long, docs binary, doc binary, first binary, size binary, offset binary, "
    "anchor binary, whole binary, windows binary"
)
SPANS = "k1 long, k2 long, starts binary, ends binary"


def parse_block(
    keys: np.ndarray, sequences: list[np.ndarray], buckets: int, window: int, gram: int, hot: np.ndarray
) -> Iterator[tuple]:
    """PACKED rows of one block; ``keys`` are two 64-bit integers for each document. Factors whose anchors are ``hot`` are
    split: each window becomes a factor of its own, filed under itself."""
    f = Factors(sequences, window, gram)
    if f.empty:
        return
    repeated = np.flatnonzero(_times(f.windows) > 1)
    if len(repeated):
        owner = np.repeat(np.arange(len(f.size)), f.size)[repeated]
        start = f.first[owner] + repeated - f.at[owner]
        for doc, lo, hi in spans_by_document(f.doc[owner], start, start + 1):
            yield (  # settled, so any bucket will do: copies of one text are spread
                int((keys[doc, 0] + doc) % buckets), keys[doc].tobytes(), bytes(4 * len(lo)),
                lo.astype("<u4").tobytes(), (hi - lo).astype("<u4").tobytes(), b"", b"", b"", b"",
            )
    crowded = np.isin(f.anchor, hot)
    plain = np.flatnonzero(~crowded)
    keep = plain[np.unique(f.whole[plain], return_index=True)[1]]
    yield from _packed(
        keys, buckets, f.doc[keep], f.first[keep], f.size[keep], f.offset[keep], f.anchor[keep], f.whole[keep],
        f.windows, f.at[keep],
    )
    split = np.flatnonzero(crowded)
    places = _numbers(f.at[split], f.size[split])
    owner = np.repeat(split, f.size[split])
    name, once = np.unique(_mixed(f.windows[places] ^ _mixed(f.anchor[owner])), return_index=True)
    owner, places = owner[once], places[once]
    one, none = np.ones(len(once), np.int64), np.zeros(len(once), np.int64)
    yield from _packed(
        keys, buckets, f.doc[owner], f.first[owner] + places - f.at[owner], one, none, name, name, f.windows, places
    )


def _packed(keys, buckets, doc, first, size, offset, anchor, whole, windows, at) -> Iterator[tuple]:
    """PACKED rows, one for each bucket, of factors given by their columns; the windows of each begin at ``at``."""
    if not len(doc):
        return
    bucket = (anchor % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
    for lo, hi in zip(edges[:-1], edges[1:]):
        some = order[lo:hi]
        used, local = np.unique(doc[some], return_inverse=True)
        hashes = windows[_numbers(at[some], size[some])]
        yield (
            int(bucket[some[0]]), keys[used].tobytes(), local.astype("<u4").tobytes(),
            first[some].astype("<u4").tobytes(), size[some].astype("<u4").tobytes(),
            offset[some].astype("u1").tobytes(), anchor[some].tobytes(), whole[some].tobytes(),
            hashes.view("u1").reshape(-1, 8)[:, 8 - KEPT_BYTES :].tobytes(),
        )


# ---- one bucket of the index -----------------------------------------------------------------

def match_bucket(rows: list[dict]) -> Iterator[tuple]:
    """SPANS rows (spans of windows) of the factors and windows that occur more than once."""
    keys, doc, first, size, offset, anchor, whole, windows = ([] for _ in range(8))
    n_docs = 0
    for r in rows:
        own = np.frombuffer(r["docs"], "<i8").reshape(-1, 2)
        start = np.frombuffer(r["first"], "<u4").astype(np.int64)
        length = np.frombuffer(r["size"], "<u4").astype(np.int64)
        if not r["anchor"]:
            yield (int(own[0, 0]), int(own[0, 1]), r["first"], (start + length).astype("<u4").tobytes())
            continue
        keys.append(own)
        doc.append(np.frombuffer(r["doc"], "<u4").astype(np.int64) + n_docs)
        n_docs += len(own)
        first.append(start)
        size.append(length)
        offset.append(np.frombuffer(r["offset"], "u1"))
        anchor.append(np.frombuffer(r["anchor"], "<u8"))
        whole.append(np.frombuffer(r["whole"], "<u8"))
        windows.append(np.frombuffer(r["windows"], "u1").reshape(-1, KEPT_BYTES))
    if not keys:
        return
    keys, doc, first, size, offset, anchor, whole, windows = map(
        np.concatenate, (keys, doc, first, size, offset, anchor, whole, windows)
    )
    at = np.cumsum(size) - size
    shared = np.flatnonzero(_times(anchor) > 1)
    # The greedy match: the whole factor lies in another reference block as well.
    _, rep, back, n = np.unique(
        whole[shared], return_index=True, return_inverse=True, return_counts=True
    )
    full = shared[n[back] > 1]
    # At the boundaries of matches: windows of the other factors among all of their anchor.
    some = shared[np.sort(rep)]
    places = _numbers(at[some], size[some])
    hashes = np.zeros((len(places), 8), "u1")
    hashes[:, :KEPT_BYTES] = windows[places]
    step = _numbers(np.zeros(len(some), np.int64), size[some])
    there = (np.repeat(offset[some], size[some]) - step).astype(np.uint64)
    owner = np.repeat(some, size[some])
    key = _mixed(anchor[owner] ^ _mixed(hashes.view("<u8").ravel() | there << np.uint64(56)))
    single = np.zeros(len(anchor), bool)
    single[shared[n[back] == 1]] = True
    hit = (_times(key) > 1) & single[owner]
    begin = np.r_[first[full], (first[owner] + step)[hit]]
    stop = np.r_[first[full] + size[full], (first[owner] + step)[hit] + 1]
    for d, lo, hi in spans_by_document(np.r_[doc[full], doc[owner[hit]]], begin, stop):
        yield (
            int(keys[d, 0]), int(keys[d, 1]), lo.astype("<u4").tobytes(), hi.astype("<u4").tobytes()
        )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, field.type) for c, field in zip(columns, schema)], schema=schema
    )


def _arrow(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, columns.split(", "))])


# ---- anchors of very many factors ----

def hot_anchors(keyed: DataFrame, window: int, gram: int, sample: int = SAMPLE_DOCS, least: int = HOT_FACTORS) -> np.ndarray:
    """Anchors that ``least`` different factors or more have in a sample of some ``sample`` documents. The list only says
    which factors are split, not what is found; the sample bounds it."""
    n = keyed.count()
    if not n:
        return np.zeros(0, np.uint64)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_list(t) for t in batch.column(0).to_pylist()]
            sequences = [np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w)) for w in words if len(w) >= window]
            f = Factors(sequences, window, gram)
            if not f.empty:
                keep = np.unique(f.whole, return_index=True)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.anchor[keep].view("<i8")), pa.array(f.whole[keep].view("<i8"))], names=["anchor", "whole"]
                )

    found = (
        keyed.sample(min(1.0, sample / n), seed=1).select(keyed.columns[-1]).mapInArrow(factors, "anchor long, whole long")
        .groupBy("anchor").agg(F.approx_count_distinct("whole").alias("n")).filter(F.col("n") >= least).select("anchor")
    )
    return np.array([r.anchor for r in found.collect()], np.int64).view(np.uint64)


# ---- the operator ----------------------------------------------------------------------------

def duplicate_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, gram: int = GRAM, buckets: int | None = None,
) -> DataFrame:
    """(k1, k2, spans): k1 and k2 hash id and text; spans of window positions whose windows also start elsewhere."""
    if not 0 < gram <= window or window - gram > 255:
        raise ValueError("gram must lie in 1 .. window, at most 255 below it")
    n = buckets or BUCKETS_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    packed_schema, spans_schema = _arrow(PACKED), _arrow(SPANS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, held = [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            rows, weight = [], 0
            for row in parse_block(np.array(keys, np.int64), sequences, n, window, gram, hot):
                rows.append(row)
                weight += len(row[8])
                if weight > 4_000_000:
                    yield _batch(rows, packed_schema)
                    rows, weight = [], 0
            yield _batch(rows, packed_schema)

        for batch in batches:
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = word_list(text)
                if len(words) < window:
                    continue
                keys.append((k1, k2))
                sequences.append(
                    np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
                )
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield from block()
                    keys, sequences, held = [], [], 0
        if keys:
            yield from block()

    def match(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(list(match_bucket(table.to_pylist())), spans_schema)])

    keyed = docs.select(
        F.xxhash64(f"`{id_col}`").alias("k1"), F.xxhash64(f"`{text_col}`").alias("k2"), f"`{text_col}`"
    )
    hot = hot_anchors(keyed, window, gram)
    return (
        keyed.mapInArrow(parse, PACKED)
        .groupBy("bucket").applyInArrow(match, SPANS).distinct()
        .groupBy("k1", "k2").agg(F.collect_list(F.struct("starts", "ends")).alias("spans"))
    )


def remove_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, gram: int = GRAM, buckets: int | None = None,
) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, ``kept_text`` (kept words joined by one
    space) and ``removed`` (spans of words)."""
    found = duplicate_windows(docs, id_col, text_col, window, gram, buckets)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string, "
        "removed array<struct<start:long,end:long>>"
    )
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(text: str | None, spans: list[dict] | None):
        words = word_list(text)
        if not spans:
            return len(words), 0, b" ".join(words).decode(), []
        start, end = (
            np.concatenate([np.frombuffer(s[k], "<u4") for s in spans]).astype(np.int64)
            for k in ("starts", "ends")
        )
        start, end = merged(start, end + window - 1)  # from windows to words
        kept, at = [], 0
        for lo, hi in zip(start.tolist(), end.tolist()):
            kept += words[at:lo]
            at = hi
        kept += words[at:]
        removed = [{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist())]
        return len(words), int((end - start).sum()), b" ".join(kept).decode(), removed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*rows)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.string(), span]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=[id_col, "n_words", "n_removed", "kept_text", "removed"],
            )

    keyed = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
        F.xxhash64(f"`{id_col}`").alias("k1"), F.xxhash64(f"`{text_col}`").alias("k2"),
    )
    return keyed.join(found, ["k1", "k2"], "left").select("_id", "_text", "spans").mapInArrow(run, schema)
