"""Token ids in files: Simple-8b blocks with offsets, in the order of documents.

A file is a Parquet part that Spark writes and commits, so any store that Spark reaches will do and a task that
runs again replaces its part. Parts are in the order of ids, and so are the rows in a part. A row is a segment of some
SEGMENT ids, whole documents only:

    part, before (token ids in the part's earlier segments), ids (array of document ids), counts (array of their
    numbers of token ids), data (binary)

``data`` is little-endian: "SF8B", version, numbers of blocks, words and escapes (each 32 bits); block sizes, offsets of
words (blocks + 1) and of escapes (blocks + 1) as 32-bit integers; the 64-bit words; the 32-bit escapes. A document's
blocks follow from the counts, so one document of a segment is decoded without the others.

Defined results: a NULL text is empty and its document the end token alone; NULL ids come first; of equal ids, the text's
hash and then the order of the input decide; repeated rows are documents of their own; an empty table gives no
segments and an empty result. A segment holds less than 2 GB, hence a text does too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import simple8b
from .common import shared_folder, small_table, shuffle_partitions
from .tokens import load, slices

MAGIC, VERSION = b"SF8B", 1
END_TOKEN = 2
SEGMENT = 1 << 20  # ids


def pack(blocks: simple8b.Blocks) -> bytes:
    head = np.array([VERSION, len(blocks.sizes), len(blocks.words), len(blocks.escapes)], "<u4")
    return b"".join([
        MAGIC, head.tobytes(), blocks.sizes.astype("<u4").tobytes(), blocks.word_at.astype("<u4").tobytes(),
        blocks.escape_at.astype("<u4").tobytes(), blocks.words.astype("<u8").tobytes(), blocks.escapes.astype("<u4").tobytes(),
    ])


def unpack(data: bytes) -> simple8b.Blocks:
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    version, n, words, escapes = np.frombuffer(data, "<u4", 4, 4).tolist()
    if version != VERSION:
        raise ValueError(f"segment version {version}")
    at, out = 20, []
    for kind, count in (("<u4", n), ("<u4", n + 1), ("<u4", n + 1), ("<u8", words), ("<u4", escapes)):
        part = np.frombuffer(data, kind, count, at)
        at += part.nbytes
        out.append(part.astype(np.int64) if len(out) < 3 else part)
    return simple8b.Blocks(*out)


def document(data: bytes, counts: list[int], at: int) -> np.ndarray:
    """The ids of document ``at`` of a segment alone."""
    blocks = -(-np.asarray(counts, np.int64) // simple8b.BLOCK)
    first = int(blocks[:at].sum())
    return simple8b.decode(unpack(data), first, first + int(blocks[at]))


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    end_token: int = END_TOKEN, segment: int = SEGMENT, parts: int | None = None,
) -> None:
    """Tokenise ``docs`` and write their ids under ``path`` in ascending order of ``id_col``. Texts are shuffled once, by
    ranges of ids; equal ids are told apart, so that one id of very many rows is spread too."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = load(vocabulary), np.array([end_token], "<u4")
        part, before = TaskContext.get().partitionId(), 0
        ids, counts, kept, held = [], [], [], 0

        def finished() -> pa.RecordBatch:
            nonlocal before, held
            size = np.concatenate(counts)
            data = pack(simple8b.encode(np.concatenate(kept), size))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([before], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.concat_arrays(ids)),
                    pa.array([size], pa.list_(pa.int64())), pa.array([data], pa.binary()),
                ],
                names=["part", "before", "ids", "counts", "data"],
            )
            before, held = before + held, 0
            for x in (ids, counts, kept):
                x.clear()
            return out

        for batch in batches:
            for some in slices(batch, 1):
                flat, bounds = tokenizer.ids(some.column(1))
                n = np.diff(bounds)
                ids.append(some.column(0))
                kept.append(np.insert(flat, bounds[1:], end[0]))
                counts.append(n + 1)
                held += len(flat) + len(n)
                if held >= segment:
                    yield finished()
        if held:
            yield finished()

    number = parts or shuffle_partitions(docs.sparkSession)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(f"`{text_col}`").alias("h"), F.monotonically_increasing_id().alias("row"),
    )
    (
        rows.repartitionByRange(number, "id", "h", "row").sortWithinPartitions("id", "h", "row").select("id", "text")
        .mapInArrow(encode, _schema(kind))
        .write.option("compression", "none").parquet(path)
    )


def _schema(id_kind: str) -> str:
    return f"part int, before long, ids array<{id_kind}>, counts array<bigint>, data binary"


def read_tokens(spark: SparkSession, path: str, id_kind: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """The documents of the files under ``path``: id_col, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit). Parts are placed by their totals, one number each on the driver."""
    segments = spark.read.schema(_schema(id_kind)).parquet(path)
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.max(F.col("before") + size).alias("n")).collect())
    begin = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    firsts = small_table(spark, [(p, int(b)) for (p, _), b in zip(totals, begin)], "part int, part_start long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                doc_ids, counts, data, start = (batch.column(c)[at] for c in range(4))
                n = counts.values.to_numpy()
                ids = simple8b.decode(unpack(data.as_py()))
                ends = np.cumsum(n)
                if ids.nbytes >= 1 << 31:
                    raise ValueError("a segment of 2 GB of ids or more")
                buffers = [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype("<i4")), pa.py_buffer(ids)]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.values, pa.array(start.as_py() + ends - n), pa.array(n),
                        pa.Array.from_buffers(pa.binary(), len(n), buffers),
                    ],
                    names=[id_col, "start", "n_tokens", "ids"],
                )

    return (
        segments.join(F.broadcast(firsts), "part")
        .select("ids", "counts", "data", (F.col("part_start") + F.col("before")).alias("start"))
        .mapInArrow(decode, f"`{id_col}` {id_kind}, start long, n_tokens long, ids binary")
    )


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` written as token files in a new shared folder, and what the files say."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, id_col, text_col)
    return read_tokens(docs.sparkSession, path, docs.schema[id_col].dataType.simpleString(), id_col)
