"""Simple-8b coding, token files and the batch tokenizer, by round trips and against the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")

from stopflow.llm import simple8b, token_files, tokens
from stopflow.llm.catalog import OPERATORS, vocabulary

from .conftest import DATA


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def drawn(rng, n):
    kind = rng.randrange(5)
    if kind == 0:
        return [0] * n
    if kind == 1:
        return [rng.randrange(4) for _ in range(n)]
    if kind == 2:
        return [rng.choice((1, 2, 3, 2**32 - 1)) for _ in range(n)]
    if kind == 3:
        return [rng.randrange(2**32) for _ in range(n)]
    return [min(49_407, int(rng.paretovariate(0.6))) for _ in range(n)]


def test_codes_round_trip():
    rng = random.Random(1)
    counts = [0, 1, 2, 239, 240, 241, 480, 0, 1000, 7, 0]
    docs = [drawn(rng, n) for _ in range(8) for n in counts]
    blocks = simple8b.encode(np.array([x for d in docs for x in d], np.uint64), [len(d) for d in docs])
    assert simple8b.decode(blocks).tolist() == [x for d in docs for x in d]
    assert int(blocks.sizes.max()) <= simple8b.BLOCK and len(blocks.word_at) == len(blocks.sizes) + 1
    data = token_files.pack(blocks)
    for at in (0, 3, 8, 20, len(docs) - 2):
        assert token_files.document(data, [len(d) for d in docs], at).tolist() == docs[at]
    with pytest.raises(ValueError):
        token_files.unpack(b"else" + data[4:])


def test_every_selector_and_escape_is_used():
    ids = []
    for s, (n, width) in enumerate(zip(simple8b.COUNTS.tolist(), simple8b.WIDTHS.tolist())):
        ids += [max(0, (1 << min(width, 32)) - 2) if width else 0] * simple8b.BLOCK
    ids += ([5] * 9 + [40_000]) * 24
    ids.append(2**32 - 1)
    blocks = simple8b.encode(np.array(ids, np.uint64), [len(ids) - 1, 1])
    assert simple8b.decode(blocks).tolist() == ids
    used = set((blocks.words >> np.uint64(60)).tolist())
    assert used >= set(range(16)) - {1} and len(blocks.escapes)
    assert simple8b.decode(simple8b.encode(np.zeros(0, np.uint64), [])).tolist() == []


def test_skewed_ids_take_less_than_16_bits():
    rng = np.random.default_rng(2)
    ids = np.minimum(49_407, rng.zipf(1.3, 50_000)).astype(np.uint64)
    blocks = simple8b.encode(ids, [len(ids)])
    assert 64 * len(blocks.words) + 32 * len(blocks.escapes) < 16 * len(ids)


def test_batches_equal_the_library(library):
    texts = [
        "", None, " ", "  It's  a\ttest\n\n", "Ünïcode ǅ ẞ İstanbul Ωμέγα 漢字 é ́x", "a<|endoftext|>b <|startoftext|>",
        " nbsp wide", "x" * 700, "1234 5.6 --- !?", "İ ıı ŉ 'S 'll",
    ] * 3
    tokenizer = tokens.Tokenizer(vocabulary())
    ids, bounds = tokenizer.ids(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_slices_bound_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 3)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 10)
    texts = ["aaaa", None, "b", "c" * 50, "", "dddddddddd", "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [p.column(0).to_pylist() for p in tokens.slices(batch, 0)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or len(p) <= 3 and sum(len(t or "") for t in p) <= 10 for p in parts)


def test_memory_forgets_by_generations():
    memo = tokens.Memo(3)
    make = lambda keys: [k.encode() for k in keys]
    for keys in (["a", "b"], ["c", "d"], ["a"], ["e", "f", "g"], ["a", "b"]):
        assert memo.values(keys, make) == make(keys)
    assert len(memo.recent) + len(memo.older) < 7


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want, start = [], 0
    for i in sorted(docs):
        ids = library.encode(docs[i], add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in OPERATORS["op12_token_files"].run(spark, DATA).collect()) == want


def test_odd_rows(spark, library, tmp_path):
    rows = [(None, None), (None, "b"), (3, ""), (3, "a b"), (3, "a b"), (-1, "x " * 40_000), (7, None)]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, part string, ids int")
    token_files.write_tokens(docs, str(tmp_path / "f"), vocabulary(), segment=10)
    got = token_files.read_tokens(spark, str(tmp_path / "f")).collect()
    lengths = sorted(((r[0] is not None, r[0] or 0), len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    found = sorted((((r.doc_id is not None, r.doc_id or 0), r.n_tokens) for r in got))
    assert found == lengths
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(rows))]
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert ids == sorted(ids)
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 2 for r in got)
    assert token_files.round_trip(docs.limit(0), vocabulary()).collect() == []
