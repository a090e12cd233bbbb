"""Token ids of whole texts, a batch at a time.

A vocabulary with word ends drops white space, so a text's ids are those of its pieces between ASCII white
space, one after the other. The pieces of a batch are split and made distinct by Arrow; only distinct
pieces reach Python, where they are remembered; all ids of the batch are gathered at once.

Pieces are split into words by the vocabulary file's own pattern, and the library encodes words seen for
the first time. Pieces with strings of special tokens, or with letters that newer Unicode versions may treat in
another way, go to the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Up to here (Latin Extended-B) all code points have been assigned for long.
LATIN_END = "\u024f"
#: Pieces of text and words that a Python worker remembers, in each of two generations (some 200 bytes each).
MEMO = 400_000
WORDS = 350_000


#: Rows and bytes of text that are tokenised together.
SLICE, SLICE_BYTES = 2048, 8 << 20
#: The same bounds for jobs that are short of memory: a slice's arrays take some 30 times its text.
LEAN_MEMO, LEAN_WORDS, LEAN_BYTES = 60_000, 60_000, 1 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most SLICE rows and, but for single rows, ``most`` bytes of the text ``column``."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        to = max(at + 1, min(to, at + SLICE, batch.num_rows))
        yield batch.slice(at, to - at)
        at = to


class Memo:
    """Two generations of a dictionary; what is used again moves to the recent one."""

    def __init__(self, size: int):
        self.size, self.recent, self.older = size, {}, {}

    def values(self, keys: Sequence[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The value of each of the distinct ``keys``; those that neither generation holds come from ``make``."""
        if len(self.recent) >= self.size:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        out = list(map(recent.get, keys))
        new = []
        for at, value in enumerate(out):
            if value is None:
                found = older.get(keys[at])
                if found is None:
                    new.append(at)
                else:
                    out[at] = recent[keys[at]] = found
        if new:
            for at, value in zip(new, make([keys[at] for at in new])):
                out[at] = recent[keys[at]] = value
        return out


def spread(codes: np.ndarray, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids behind each of ``codes`` one after the other, and where each one's end."""
    size = np.fromiter(map(len, values), np.int64, len(values)) >> 2
    store = np.frombuffer(b"".join(values), "<u4")
    begin = np.cumsum(size) - size
    n = size[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return store[np.repeat(begin[codes] - (ends - n), n) + np.arange(total)], ends


def gather(texts: pa.Array, memo: Memo, make: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, n + 1 offsets). ``make`` gives the ids of pieces, as little-endian
    unsigned 32-bit integers; NULL texts are empty."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    values = memo.values(coded.dictionary.to_pylist(), make)
    ids, ends = spread(coded.indices.to_numpy(zero_copy_only=False), values)
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    return ids, np.concatenate([[0], ends])[bounds]


def encode_pieces(
    pieces: list[str], find: Callable[[str], list[str]], memo: Memo,
    encode_words: Callable[[list[str]], list[bytes]], encode_odd: Callable[[list[str]], list[bytes]],
) -> list[bytes]:
    """The ids of each piece. All are normalised and split at once by ``find``, which must also find line ends: one
    follows each piece, and it must have no ids as a word. Pieces with strings of special tokens or letters beyond
    LATIN_END go to ``encode_odd`` whole."""
    out = [b""] * len(pieces)
    strange = [at for at, p in enumerate(pieces) if "<|" in p or not p.isascii() and max(p) > LATIN_END]
    for at, data in zip(strange, encode_odd([pieces[at] for at in strange])):
        out[at] = data
    skip = set(strange)
    plain = [at for at in range(len(pieces)) if at not in skip] if skip else range(len(pieces))
    text = "".join([pieces[at] + "\n" for at in plain])
    coded = pa.array(find(unicodedata.normalize("NFC", text).lower()), pa.string()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ids, ends = spread(codes, memo.values(words, encode_words))
    if plain:
        data, cut = ids.tobytes(), (4 * ends[codes == words.index("\n")]).tolist()
        for at, i, j in zip(plain, [0, *cut], cut):
            out[at] = data[i:j]
    return out


class Tokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import regex
        import tokenizers

        self._library = tokenizers.Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._find = regex.compile(r"\n|" + pattern, regex.V1).findall
        vocab, suffix = self._library.get_vocab(), spec["model"]["end_of_word_suffix"]
        self._final = np.zeros(max(vocab.values()) + 1, bool)
        self._final[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self, memo: int = MEMO, words: int = WORDS) -> None:
        """Give memory back (an idle Python worker stays for a while); from now on remember so many pieces and words."""
        self._pieces, self._words = Memo(memo), Memo(words)

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        found = self._library.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _side_by_side(self, words: list[str]) -> list[bytes]:
        """Plain words as one text; each ends with the only token of a word's end."""
        ids = np.array(self._library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self._final[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self._one_by_one(words)
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        odd = [w for w in words if not w.isascii() and max(w) > LATIN_END or "<|" in w or not w.strip()]
        strange = set(odd)
        plain = [w for w in words if w not in strange] if odd else words
        known = {}
        for some, encode in ((odd, self._one_by_one), (plain, self._side_by_side)):
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                known.update(zip(part, encode(part)))
        return list(map(known.__getitem__, words))

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return encode_pieces(pieces, self._find, self._words, self._encode_words, self._one_by_one)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, n + 1 offsets)."""
        return gather(texts, self._pieces, self._encode_pieces)


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """One for each Python worker."""
    return Tokenizer(path)
