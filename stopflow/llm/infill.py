"""Fill-in-middle: documents cut in three at unit boundaries and written in another order.

The characters of a batch of texts become classes, and the classes a wavelet matrix: one bit vector for each bit of a
class, with counts before every 64 positions. A rank query counts a class before any position. Units end where ranks
say: the units of a span are combined from the ranks of its two ends (lines: newlines, and one more if the last
character is none; words: white characters followed by others). The place of the k-th end is found by select, that is by
bisection on ranks for all texts at once.

Forms, of prefix, middle and suffix: psm is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle,
plain is the text as it was. ``restored`` rebuilds the text from output and form.

Defined results: a NULL text is empty, and an empty text plain, as is one that holds a mark; a NULL id draws as the
empty string does; equal rows are cut alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tokens import slices

MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100  # percent of texts that are cut
SPM = 50  # percent of those in the form spm

#: Classes of characters.
OTHER, NEWLINE, WHITE, WHITE_END = range(4)
UNITS = ("line", "word")


class BitVector:
    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)])
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank and select of small whole numbers."""

    def __init__(self, values: np.ndarray, bits: int = 2):
        self.n, self.levels = len(values), []
        for bit in reversed(range(bits)):
            ones = (values >> bit & 1).astype(bool)
            vector = BitVector(ones)
            self.levels.append((bit, vector, self.n - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before each position."""
        lo, hi = np.zeros_like(at), at
        for bit, vector, zeros in self.levels:
            a, b = vector.rank(lo), vector.rank(hi)
            lo, hi = (zeros + a, zeros + b) if value >> bit & 1 else (lo - a, hi - b)
        return hi - lo

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """The least position before which ``value`` stands ``k`` times (it must), by bisection on ranks."""
        lo, hi = np.zeros_like(k), np.full_like(k, self.n)
        while (open_ := lo < hi).any():
            middle = (lo + hi) >> 1
            enough = self.rank(value, middle) >= k
            hi = np.where(open_ & enough, middle, hi)
            lo = np.where(open_ & ~enough, middle + 1, lo)
        return lo


class Cutter:
    """Unit boundaries of texts."""

    def __init__(self, texts: list[str], unit: str = "line"):
        if unit not in UNITS:
            raise ValueError(f"unit {unit}")
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        white = (codes == 32) | ((codes >= 9) & (codes <= 13))
        kinds = np.where(white, WHITE, OTHER).astype(np.uint8)
        if unit == "line":
            kinds[codes == 10] = NEWLINE
            self.mark = NEWLINE
        else:
            # White characters that another one follows, in the same text, end a word.
            follows = np.concatenate([~white[1:], [False]]) if len(codes) else white
            ends = white & follows
            ends[self.start[1:][self.start[1:] > 0] - 1] = False
            kinds[ends] = WHITE_END
            self.mark = WHITE_END
        self.matrix = WaveletMatrix(kinds)
        first, last = self.start[:-1], self.start[1:]
        self.before = self.matrix.rank(self.mark, first)
        closed = self.matrix.rank(self.mark, last) - self.before
        # The end of a text closes a unit unless its last character has.
        size = last - first
        tail = np.maximum(last - 1, first)
        own = self.matrix.rank(self.mark, last) - self.matrix.rank(self.mark, tail)
        self.closed = closed
        self.units = closed + ((size > 0) & (own == 0))

    def cuts(self, k: np.ndarray) -> np.ndarray:
        """Characters of each text in its first ``k`` units."""
        inside = k <= self.closed
        target = np.where(inside, self.before + k, 0)
        found = self.matrix.select(self.mark, target) - self.start[:-1]
        out = np.where(inside, found, np.diff(self.start))
        return np.where(k == 0, 0, out)


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """h1 .. h4 of a document: 32-bit groups of the SHA-256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def written_as(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return prefix + middle + suffix


def restored(form: str, output: str) -> str:
    """The text that became ``output``. Texts with marks are plain, so each mark is the first of its kind."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
    spm: int = SPM, unit: str = "line",
) -> DataFrame:
    """One row per document: id_col, n (units), form, prefix_chars, middle_chars (NULL if plain), output, restored."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                h1, h2, h3, h4 = (part.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4))
                cutter = Cutter(texts, unit)
                n = cutter.units
                one, two = h1 % (n + 1), h2 % (n + 1)
                first, second = cutter.cuts(np.minimum(one, two)), cutter.cuts(np.maximum(one, two))
                forms = np.where(h3 % 100 >= rate, "plain", np.where(h4 % 100 < spm, "spm", "psm")).tolist()
                outputs, back = [], []
                prefix, middle = first.tolist(), (second - first).tolist()
                for k, text in enumerate(texts):
                    if not text or any(mark in text for mark in MARKS):
                        forms[k] = "plain"
                    a, b = prefix[k], prefix[k] + middle[k]
                    outputs.append(written_as(forms[k], text[:a], text[a:b], text[b:]))
                    back.append(restored(forms[k], outputs[-1]))
                    if forms[k] == "plain":
                        prefix[k] = middle[k] = None
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                        pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.string()),
                        pa.array(back, pa.string()),
                    ],
                    names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output", "restored"],
                )

    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"), *draws(id_col, seed)).mapInArrow(cut, schema)
