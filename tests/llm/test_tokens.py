"""BPE and packing against the library and against what a packing must satisfy."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")

from stopflow.llm import bpe, packing
from stopflow.llm.catalog import OPERATORS, vocabulary

from .conftest import DATA

ODD = [
    "", " ", "\n\t", "a", "İI Σας ΣΑΣ", "can't WE'LL", "́abc 가", "x y z​q\x85r\x1cs",
    "<|endoftext|>hi<|startoftext|>", "<|endoftext", "日本語 \U0001f600\U0001f600 ՘ Ᲊ", "a" * 20_000,
    "12 345 ½ ²", "é Å ﬁ", "!!!'s ### %%%", "\x00\x01", "word " * 9_000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


def test_bpe_equals_library(library):
    model = bpe.WordBpe(vocabulary())
    rng = random.Random(5)
    letters = "abcdeéüßñ '’.-#%09ΑΣ́中\U0001f680"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == ids, text[:50]
        decoded = library.decode(ids, skip_special_tokens=False)
        assert model.decode_bytes(np.array(model.encode(text), "<u4").tobytes()).decode() == decoded


def test_every_code_point_equals_library(library):
    model = bpe.WordBpe(vocabulary())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        texts = ["aB" + chr(c) + "c1" + chr(c) for c in points[at : at + 4096]]
        found = library.encode_batch(texts, add_special_tokens=False)
        ids, bounds = model.encode_batch(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [e.ids for e in found]


def test_bpe_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = OPERATORS["op8_bpe"].run(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_odd_rows(spark, library):
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(None, None, "x"), (3, "a", "y"), (3, "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(docs, vocabulary()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.ids)) for r in got) == sorted(
        (i is None, i or 0, 4 * len(library.encode(t or "", add_special_tokens=False).ids))
        for i, t, _ in rows
    )
    assert bpe.encode_documents(docs.limit(0), vocabulary()).count() == 0


def check_packing(pieces, wanted, capacity=4096):
    """``pieces``: rows with ids; ``wanted``: list of (doc_id, ids)."""
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc, ids in wanted:
        at = 0
        for p in sorted(by_doc.pop(doc), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert np.frombuffer(bytes(p.ids), "<u4").tolist() == ids[at : at + p.length]
            at += p.length
        assert at == len(ids)
    assert not by_doc
    return padding


@pytest.mark.parametrize("capacity,max_open", [(4096, 1024), (64, 4), (16, 1), (2, 3)])
def test_packing_holds_every_token_once(spark, library, capacity, max_open):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    wanted = [
        (r.doc_id, library.encode(r.text, add_special_tokens=False).ids + [2]) for r in rows
    ]
    pieces = packing.pack_documents(
        docs.repartition(3), vocabulary(), capacity=capacity, max_open=max_open
    ).collect()
    assert check_packing(pieces, wanted, capacity) == 0


def test_packing_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in OPERATORS["op1_packing"].run(spark, DATA).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids + [2]
        part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(part))


def test_packing_odd_rows(spark, library):
    rows = [(None, None), (1, ""), (1, ""), (2, "x " * 30_000), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, vocabulary()).collect()
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    assert sum(p.length for p in got) == sum(lengths)
    assert sum(p.doc_id is None for p in got) >= 2
    assert packing.pack_documents(docs.limit(0), vocabulary()).count() == 0


def test_level_minimises_squares():
    rng = random.Random(1)
    packer = packing.SumOfSquares(32, 10**6)
    for n in range(2000):
        size = rng.randint(1, 31)
        before = packer.counts.copy()

        def squares(level):
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return int((after[1:32] ** 2).sum())

        options = [0] + [h for h in range(1, 33 - size) if before[h]]
        least = min(map(squares, options))
        assert squares(packer._level_for(size)) == least
        packer.add(n, np.zeros(size, np.uint32))
