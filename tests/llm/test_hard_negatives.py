"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopflow.llm import hard_negatives
from stopflow.llm.hard_negatives import hard_negatives as mine

COLUMNS = "vec_id long, embedding array<float>, label int, row string, q int, anchor double"


def brute(rows, every=5, positives=5, negatives=3, low=50, high=95):
    kept = []
    for i, vec, label in rows:
        if i is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in vec], label))
    out = []
    for k, (i, a, label) in enumerate(kept):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), j, own == label) for n, (j, b, own) in enumerate(kept) if n != k]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(t, j) for t, j, same in scored if not same and low * -s <= 100 * -t <= high * -s]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit[:negatives])]
    return sorted(out)


def got(spark, rows, every=5, **how):
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], COLUMNS)
    return sorted(tuple(r) for r in mine(df, F.col("vec_id") % every == 0, **how).collect())


def clustered(rng, n, dim=8, labels=4):
    centres = [[rng.gauss(0, 0.5) for _ in range(dim)] for _ in range(6)]
    return [
        (i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)
    ]


@pytest.mark.parametrize("how", [
    {}, {"block_rows": 7, "shard_rows": 30, "codewords": 3, "sample_rows": 20}, {"codewords": 1, "sample_rows": 1},
])
def test_equals_brute_force(spark, how):
    rows = clustered(random.Random(3), 150)
    assert got(spark, rows, **how) == brute(rows)


def test_hot_vector_and_ties(spark):
    rng = random.Random(4)
    hot = [0.5, 0.25, -0.125, 0.5]
    rows = [(i, hot if i % 3 == 0 else [rng.choice((-0.5, 0.25, 0.5)) for _ in range(4)], i % 2) for i in range(120)]
    rows += rows[:20]
    assert got(spark, rows, shard_rows=16, block_rows=5, sample_rows=10) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = clustered(rng, 60, 4)
    rows += [
        (None, [1.0] * 4, 1), (100, None, 1), (105, [1.0, None, 0.0, 0.0], 1), (110, [float("nan")] * 4, 1),
        (115, [float("-inf"), 0.0, 0.0, 0.0], 1), (120, [0.5] * 4, None), (125, [0.5], 1), (130, [], 1), (135, [0.0] * 4, 2),
        (-10, [0.5, 0.5, 0.1, 0.2], 7), (140, [-0.5] * 4, 1),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:1] and [(None, None, None)]) == []
    assert got(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2)]) == []
    empty = spark.createDataFrame([], COLUMNS)
    assert mine(empty, F.col("vec_id") % 5 == 0).collect() == []


def test_multi_sequence_falls_and_is_complete():
    rng = random.Random(6)
    u, v = (sorted((rng.random() for _ in range(n)), reverse=True) for n in (7, 5))
    walked = list(hard_negatives.multi_sequence(u, v))
    assert [w[0] for w in walked] == sorted((w[0] for w in walked), reverse=True)
    assert {w[1:] for w in walked} == {(x, y) for x in range(7) for y in range(5)}
    assert list(hard_negatives.multi_sequence([], v)) == []


def test_certified_windows_skip_cells(monkeypatch):
    rng = np.random.default_rng(7)
    x = np.floor(256 * (np.eye(8)[rng.integers(0, 8, 4000)] + rng.normal(0, 0.02, (4000, 8))))
    ids = np.arange(4000)
    books = [hard_negatives.fit(x[:500, :4], 8), hard_negatives.fit(x[:500, 4:], 8)]
    shard = hard_negatives.Shard(x, ids, ids, ids % 3, books)
    seen = []
    visit = shard._visit
    monkeypatch.setattr(shard, "_visit", lambda lo, hi, *a: (seen.append(hi - lo), visit(lo, hi, *a)))
    key, score, found, _ = shard.search(
        x[:1], ids[:1], ids[:1] % 3, True, np.full((1, 1), np.inf), np.full((1, 1), -np.inf), 5
    )
    want = sorted((-(x[0] @ x[j]), j) for j in range(1, 4000) if j % 3 == 0)[:5]
    assert [(-s, i) for s, i in zip(score, found)] == want
    assert sum(seen) < 2000
