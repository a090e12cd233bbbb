"""BPE encoding and decoding with a priority queue of merge ranks.

A word's symbols form a doubly linked list; possible merges wait in a heap by (rank,
position). A popped merge whose two symbols have changed meanwhile is stale and skipped.
Decoding concatenates vocabulary strings. The text rules (normalisation, splitting, bytes as
characters, word ends) are read from the vocabulary file.

White space never takes part in a token, so the ids of a text are those of its pieces between
ASCII white space, one after the other; each Python worker remembers pieces and words within bounds
(see ``tokens``), which changes only the speed.

Defined results: a NULL text is empty and has no ids; strings of special tokens in a text are those
tokens, as in the library's default; every row is encoded for itself, so nulls in other
columns, repeated rows and an empty table need no rule.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import LATIN_END, MEMO, WORDS, Memo, encode_pieces, gather, slices


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that
    print stand for themselves, the others get the characters from 256 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder of a vocabulary with word ends (``model.end_of_word_suffix``)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = vocab | self.special
        self.strings = [b""] * (max(strings.values()) + 1)
        for token, i in strings.items():
            self.strings[i] = token.encode()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pieces = regex.compile(pattern, regex.V1).findall
        self._specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._library = Tokenizer.from_file(path)  # its normaliser and splitter only
        letters, suffix = byte_characters(), model["end_of_word_suffix"]
        self._bytes = {c: b for b, c in enumerate(letters)}
        self._inner = [vocab[c] for c in letters]
        self._final = [vocab[c + suffix] for c in letters]
        # (left, right) -> (rank, merged), each pair packed into one integer.
        self._merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        self._find = regex.compile(r"\n|" + pattern, regex.V1).findall
        self._memo, self._words = Memo(MEMO), Memo(WORDS)

    def _word(self, word: str) -> list[int]:
        data = word.encode()
        inner = self._inner
        symbols = [inner[b] for b in data]
        symbols[-1] = self._final[data[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        merges = self._merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << 32 | symbols[i + 1])
            if found is not None:
                heap.append((found >> 32 << 32 | i, found))
        heapq.heapify(heap)
        while heap:
            key, wanted = heapq.heappop(heap)
            i = key & 0xFFFFFFFF
            j = after[i]
            # Stale: the symbol went into another one, or one of the two is not what it was.
            if symbols[i] < 0 or j >= n or merges.get(symbols[i] << 32 | symbols[j]) != wanted:
                continue
            symbols[i] = wanted & 0xFFFFFFFF
            symbols[j] = -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                found = merges.get(symbols[i] << 32 | symbols[j])
                if found is not None:
                    heapq.heappush(heap, (found >> 32 << 32 | i, found))
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] << 32 | symbols[i])
                if found is not None:
                    heapq.heappush(heap, (found >> 32 << 32 | h, found))
        return [s for s in symbols if s >= 0]

    def _split(self, chunk: str) -> list[str]:
        """The words of a piece of text, normalised. Scripts that newer Unicode versions still
        extend are left to the library, whose tables may be older than those at hand."""
        if chunk.isascii():
            return self._pieces(chunk.lower())
        if max(chunk) <= LATIN_END:
            return self._pieces(unicodedata.normalize("NFC", chunk).lower())
        pieces = self._library.pre_tokenizer.pre_tokenize_str(
            self._library.normalizer.normalize_str(chunk)
        )
        back = self._bytes
        return [bytes(back[c] for c in piece).decode() for piece, _ in pieces]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return [b"" if w == "\n" else np.array(self._word(w), "<u4").tobytes() for w in words]

    def _odd(self, piece: str) -> bytes:
        """A piece with strings of special tokens or letters beyond LATIN_END."""
        out = []
        for part in self._specials.split(piece):
            i = self.special.get(part)
            words = self._split(part) if i is None else []
            out += [i.to_bytes(4, "little")] if i is not None else self._encode_words(words)
        return b"".join(out)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return encode_pieces(pieces, self._find, self._words, self._encode_words, lambda odd: list(map(self._odd, odd)))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, n + 1 offsets)."""
        return gather(texts, self._memo, self._encode_pieces)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text]))[0].tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """The vocabulary strings with a space between, in UTF-8."""
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One encoder for each Python worker."""
    return WordBpe(path)


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id_col, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in slices(batch, 1):
                flat, bounds = model.encode_batch(part.column(1))
                cuts = bounds.tolist()
                ids = [flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
                decoded = [model.decode_bytes(x).decode() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=[id_col, "ids", "decoded"],
                )

    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(encode, schema)
