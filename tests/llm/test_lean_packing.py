"""Bounds of tokenising in jobs that are short of memory."""

import random

import pyarrow as pa

from stopflow.llm import tokens
from stopflow.llm.catalog import vocabulary


def test_lean_bounds_hold_and_change_no_ids():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=8)) for _ in range(2000)) for _ in range(150)]
    batch = pa.record_batch([pa.array(range(150)), pa.array(texts)], names=["id", "text"])
    parts = list(tokens.slices(batch, 1, tokens.LEAN_BYTES))
    assert sum(p.num_rows for p in parts) == 150 and len(parts) > 1
    assert all(sum(map(len, p.column(1).to_pylist())) <= tokens.LEAN_BYTES for p in parts)
    tokenizer = tokens.Tokenizer(vocabulary())
    wanted = [tokenizer.ids(p.column(1))[0].tolist() for p in parts]
    tokenizer.forget(tokens.LEAN_MEMO, tokens.LEAN_WORDS)
    new = tokens.LEAN_BYTES // 9 + 1  # pieces that one slice may add beyond the bound
    for part, ids in zip(parts, wanted):
        assert tokenizer.ids(part.column(1))[0].tolist() == ids
        for memo, bound in ((tokenizer._pieces, tokens.LEAN_MEMO), (tokenizer._words, tokens.LEAN_WORDS)):
            assert len(memo.recent) + len(memo.older) <= 2 * (bound + new)
