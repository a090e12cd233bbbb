"""Packing of tokenised documents by the sum-of-squares rule.

Each task packs its documents online. Windows of ``capacity`` tokens that are partly full are counted by fill
level in an array; a document goes to the level (or into a new window) for which the sum
of the squared counts becomes smallest, ties to the fullest level. Documents longer than a window fill whole windows
first; their rest is placed. At the end of a task, or when more than MAX_OPEN windows are open, the open
windows are drained: gaps of the fullest are filled with pieces cut from the emptiest. The last window
of a task is cut into sequences whose lengths are powers of two, which need no padding.

A task holds at most MAX_OPEN windows, whatever the input. Sequence ids are the partition
number and a counter, so a task that runs again gives the same rows.

Defined results: a NULL text is empty; an empty document is its end token alone; NULL and
repeated ids are kept, each row being its own document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import LEAN_BYTES, LEAN_MEMO, LEAN_WORDS, SLICE_BYTES, load, slices

CAPACITY = 4096
END_TOKEN = 2
MAX_OPEN = 1024
#: Sequence ids are partition << SEQUENCE_BITS | counter.
SEQUENCE_BITS = 32


class SumOfSquares:
    """Online packer; ``sequences`` collects finished ones as lists of pieces. A piece is
    (document, start, ids); pieces of a window follow each other without a gap."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.counts = np.zeros(capacity + 1, np.int64)
        self.levels: dict[int, list[list]] = {}
        self.open = 0
        self.sequences: list[list] = []

    def _level_for(self, size: int) -> int:
        """The fill level to place ``size`` on; 0 for a new window."""
        counts, capacity = self.counts, self.capacity
        here = counts[1 : capacity - size + 1]  # levels 1 .. capacity - size
        # Squares change by 2 (there - here) + 2; at the last level the window leaves instead.
        change = 2 * (counts[size + 1 : capacity + 1] - here) + 2
        change[-1] = 1 - 2 * here[-1]
        change[here == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(change[::-1].argmin())
        return best + 1 if change[best] <= 2 * counts[size] + 1 else 0

    def _push(self, level: int, window: list) -> None:
        self.levels.setdefault(level, []).append(window)
        self.counts[level] += 1
        self.open += 1

    def add(self, document, ids: np.ndarray) -> None:
        capacity, start = self.capacity, 0
        while len(ids) - start >= capacity:
            self.sequences.append([(document, start, ids[start : start + capacity])])
            start += capacity
        size = len(ids) - start
        if not size:
            return
        level, window = self._level_for(size), []
        if level:
            window = self.levels[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        window.append((document, start, ids[start:].copy() if start else ids[start:]))
        if level + size == capacity:
            self.sequences.append(window)
        else:
            self._push(level + size, window)
            if self.open > self.max_open:
                left, fill = self._drain()
                if left:
                    self._push(fill, left)

    def _drain(self) -> tuple[list, int]:
        """Fill the fullest open windows from the emptiest; returns the one left over."""
        waiting = [(level, w) for level in sorted(self.levels) for w in self.levels[level]]
        self.levels, self.open = {}, 0
        self.counts[:] = 0
        first = 0
        while first < len(waiting):
            fill, window = waiting.pop()
            while fill < self.capacity and first < len(waiting):
                level, source = waiting[first]
                document, start, ids = source.pop()
                cut = max(0, len(ids) - (self.capacity - fill))
                window.append((document, start + cut, ids[cut:]))
                fill += len(ids) - cut
                if cut:
                    source.append((document, start, ids[:cut]))
                waiting[first] = (level - len(ids) + cut, source)
                if not source:
                    first += 1
            if fill < self.capacity:
                return window, fill
            self.sequences.append(window)
        return [], 0

    def finish(self) -> None:
        window, fill = self._drain()
        while fill:
            room = 1 << (fill.bit_length() - 1)
            fill -= room
            sequence = []
            while room:
                document, start, ids = window.pop()
                cut = max(0, len(ids) - room)
                sequence.append((document, start + cut, ids[cut:]))
                room -= len(ids) - cut
                if cut:
                    window.append((document, start, ids[:cut]))
            self.sequences.append(sequence)

    def take(self) -> list[list]:
        out, self.sequences = self.sequences, []
        return out


def pack_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_token: int = END_TOKEN, max_open: int = MAX_OPEN,
    keep_memory: bool = True,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, sequence_tokens. ``keep_memory=False`` lets workers take less
    text at once, remember fewer pieces and words, and forget them after each task, for jobs that are
    short of memory."""
    if capacity < 2:
        raise ValueError("capacity must be at least 2")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long, sequence_tokens long"
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = load(path), SumOfSquares(capacity, max_open)
        if not keep_memory:
            tokenizer.forget(LEAN_MEMO, LEAN_WORDS)
        end = np.array([end_token], "<u4")
        number = TaskContext.get().partitionId() << SEQUENCE_BITS
        id_type = None

        def finished() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for sequence in packer.take():
                offset, total = 0, sum(len(ids) for _, _, ids in sequence)
                for (doc, doc_tokens), start, ids in sequence:
                    rows.append(
                        (doc, start, len(ids), ids.tobytes(), doc_tokens, number, offset, total)
                    )
                    offset += len(ids)
                number += 1
            columns = list(zip(*rows)) or [()] * 8
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset",
                       "sequence_tokens"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch, 1, SLICE_BYTES if keep_memory else LEAN_BYTES):
                ids, bounds = tokenizer.ids(part.column(1))
                for doc, lo, hi in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.concatenate((ids[lo:hi], end))
                    packer.add((doc, len(own)), own)
                yield finished()
        if not keep_memory:
            tokenizer.forget()
        if id_type is not None:
            packer.finish()
            yield finished()

    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(pack, schema)
