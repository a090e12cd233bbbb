"""SimHash, components and substring dedup against brute force."""

import itertools
import random

import numpy as np
import pytest

from stopflow.llm import simhash, substring_dedup
from stopflow.llm.components import components

from . import brute


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(1000)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Near copies, exact copies, shared passages, short and empty texts."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [rng.choices(vocabulary, k=rng.randint(30, 400)) for _ in range(25)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for b in bases:
        for k in range(6):
            w = edited(rng, b, k)
            if k == 3:
                w[10:10] = passage
            if k == 5:
                w += passage[:34]
            texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += [texts[0]] * 30 + ["", None, " ", "a", "A", "a b", "b a", "é Ü x", "x " * 40]
    rng.shuffle(texts)
    return texts


def test_fingerprint():
    for text in ["", None, "a", "A b", "a b c", "A B C d e f a b c", "É x y z", "w " * 100]:
        want = brute.simhash(text)
        assert simhash.fingerprint(text) % 2**64 == want
        assert simhash.fingerprint(text, 5) % 2**64 == brute.simhash(text, 5)


@pytest.mark.parametrize("bits", [3, 6])
def test_classes(spark, corpus, bits):
    rows = [(2 * i + 1, t, 0, "x") for i, t in enumerate(corpus)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, row string").repartition(4)
    got = simhash.near_duplicates(docs, max_bits=bits).collect()
    want = brute.classes([brute.simhash(t) for t in corpus], bits)
    assert {r.id: r.component_id for r in got} == {2 * i + 1: 2 * c + 1 for i, c in enumerate(want)}
    assert {r.id for r in got if r.keep} == {2 * c + 1 for c in want}
    kept = simhash.near_dedup(docs, max_bits=bits)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2 * c + 1 for c in want}


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (4, "q r s"), (4, "q r s"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.id or 0), r.component_id or 0) for r in got) == [(0, 0), (0, 0), (4, 4), (4, 4), (8, 8), (9, 8)]
    assert sum(r.keep for r in got) == 3
    assert sorted(r.doc_id or 0 for r in simhash.near_dedup(docs).collect()) == [0, 4, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_search_finds_every_pair(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(25):
            bits = rng.choice(64, rng.integers(1, 6), replace=False)
            fps.add(int(np.int64(np.uint64(c % 2**64) ^ np.uint64(sum(1 << int(b) for b in bits)))))
    fps = sorted(fps)
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    for tau in (0, 1, 3, 5):
        got = {(r.a, r.b) for r in simhash.near_pairs(distinct, tau).collect()}
        want = {
            (a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) % 2**64).bit_count() <= tau
        }
        assert got == want, tau


def test_thresholds_keep_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63, 500, dtype=np.int64)
    for m in (2, 3):
        parts = [list(range(64))[k::m] for k in range(m)]
        search = simhash.Partitioning(parts, 3, rng.integers(0, 50, (m, 1 << simhash.FOLD)).astype(float))
        chosen = search.thresholds(search.values(fps))
        assert (chosen.sum(axis=0) == 3 - m + 1).all() and chosen.min() >= -1


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("window,gram,parts", [(35, 12, 1), (35, 12, 7), (10, 4, 3), (5, 5, 2)])
def test_substrings(spark, corpus, window, gram, parts):
    docs = spark.createDataFrame(
        [(i, t, 1, 2) for i, t in enumerate(corpus)], "doc_id long, text string, k1 int, spans int"
    ).repartition(parts)
    got = {r.doc_id: r for r in substring_dedup.remove_substrings(docs, window=window, gram=gram).collect()}
    want = brute.windows_removed(corpus, window)
    assert len(got) == len(corpus)
    for i, (n_words, n_removed, kept) in enumerate(want):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (n_words, n_removed, kept)
        assert sum(s["end"] - s["start"] for s in r.removed) == n_removed


@pytest.mark.parametrize("share", [0, 1, 0.5])
def test_substrings_in_small_blocks(spark, corpus, share):
    """Blocks and split anchors are a matter of memory only: parse in blocks of a few documents, match by hand."""
    keys = [(i, -i) for i in range(len(corpus))]
    hashes = [
        np.array([substring_dedup._hashes[w] for w in substring_dedup.word_list(t)], np.uint64) for t in corpus
    ]
    anchors = np.unique(substring_dedup.Factors([h for h in hashes if len(h) >= 35], 35, 12).anchor)
    hot = anchors[: int(share * len(anchors))]
    buckets = {}
    for at in range(0, len(corpus), 5):
        rows = substring_dedup.parse_block(np.array(keys[at : at + 5]), hashes[at : at + 5], 3, 35, 12, hot)
        for row in rows:
            names = substring_dedup._arrow(substring_dedup.PACKED).names
            buckets.setdefault(row[0], []).append(dict(zip(names, row)))
    spans = {}
    for rows in buckets.values():
        for k1, _, starts, ends in substring_dedup.match_bucket(rows):
            for s, e in zip(np.frombuffer(starts, "<u4"), np.frombuffer(ends, "<u4")):
                spans.setdefault(k1, set()).update(range(int(s), int(e) + 34))
    want = brute.windows_removed(corpus)
    assert [len(spans.get(i, ())) for i in range(len(corpus))] == [n for _, n, _ in want]


def test_substrings_odd_rows(spark):
    long = " ".join(f"u{k}" for k in range(40))
    rows = [(None, long), (None, long), (1, None), (2, ""), (3, "z " * 34), (4, "z " * 36), (5, long + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(
        (r.doc_id or 0, r.n_words, r.n_removed, r.kept_text)
        for r in substring_dedup.remove_substrings(docs).collect()
    )
    want = sorted((i or 0, *w) for (i, _), w in zip(rows, brute.windows_removed([t for _, t in rows])))
    assert got == want
    assert substring_dedup.remove_substrings(docs.limit(0)).count() == 0


def test_a_short_phrase_of_all_documents_spreads_over_buckets(spark):
    """No window repeats, but all documents share an anchor."""
    rng = random.Random(6)
    phrase = [f"common{k}" for k in range(20)]
    texts = [
        " ".join([f"a{rng.random()}" for _ in range(30)] + phrase + [f"b{rng.random()}" for _ in range(30)])
        for _ in range(120)
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    keyed = docs.select("text")
    hot = substring_dedup.hot_anchors(keyed, 35, 12)
    assert 0 < len(hot) <= 20
    sequences = [np.array([substring_dedup._hashes[w] for w in substring_dedup.word_list(t)], np.uint64) for t in texts]
    keys = np.array([(i, i) for i in range(len(texts))])

    def largest(anchors):
        rows = substring_dedup.parse_block(keys, sequences, 400, 35, 12, anchors)
        return max(len(r[8]) for r in rows)

    assert largest(hot) < largest(np.zeros(0, np.uint64)) / 3
    assert sum(r.n_removed for r in substring_dedup.remove_substrings(docs).collect()) == 0
