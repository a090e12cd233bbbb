"""Fill-in-middle against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest

from stopflow.llm import infill

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def lines(text):
    return LINES.findall(text)


def words(text):
    """Units end at a white character that another one follows."""
    return re.split(r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", text) if text else []


def brute(doc, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = lines(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc, len(units), "plain", None, None, text, text)
    if h[3] % 100 < spm:
        return (doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 4, n)
        matrix = infill.WaveletMatrix(values.astype(np.uint8))
        at = np.arange(n + 1)
        for v in range(4):
            want = np.concatenate([[0], np.cumsum(values == v)])
            assert (matrix.rank(v, at) == want).all()
            k = np.arange(want[-1] + 1)
            assert (matrix.select(v, k) == np.searchsorted(want, k)).all()


@pytest.mark.parametrize("unit, split", [("line", lines), ("word", words)])
def test_cuts_equal_plain_splitting(unit, split):
    rng = random.Random(2)
    texts = ["", "\n", "\n\n", "a", "a\n", " a", "a b\nc", "é\n漢 😀\n", " \n "]
    texts += ["".join(rng.choice("ab \n\té😀") for _ in range(rng.randrange(80))) for _ in range(200)]
    cutter = infill.Cutter(texts, unit)
    parts = [split(t) for t in texts]
    assert cutter.units.tolist() == [len(p) for p in parts]
    for k in range(6):
        at = np.minimum(k, cutter.units)
        assert cutter.cuts(at).tolist() == [len("".join(p[: int(n)])) for p, n in zip(parts, at)]
    with pytest.raises(ValueError):
        infill.Cutter(texts, "page")


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (0, 50)])
def test_equals_plain_version(spark, rate, spm):
    rng = random.Random(3)
    texts = ["".join(rng.choice(("ab", "\n", " ", "é", "<P", "<S>"[: rng.randrange(3)], "😀", "M>")) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", "x<P>y", "<M>", "<<S", "\n", "long line " * 20_000 + "\n" + "z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (None, None), (5, "a\nb"), (5, "a\nb"), (-3, "q\r\nr")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, form string")
    got = infill.fill_in_middle(docs, rate=rate, spm=spm)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(brute(*r, rate=rate, spm=spm)) for r in rows)
    assert infill.fill_in_middle(docs.limit(0)).collect() == []
