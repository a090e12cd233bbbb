"""Secrets that are rare in their stratum, and the control of levels."""

import random

from stopflow.llm import secret_scan


def test_few_candidates_are_not_lost():
    for bins in ([30], [20, 45], [2], [10, 30, 45]):
        level = secret_scan.levels([("base64", 6, k, 1) for k in bins])
        assert level["base64", 6] <= min(bins), bins


def test_crowds_are_refused_below_and_above_one_half():
    low = secret_scan.levels([("base64", 6, k, 5) for k in range(1, 21)] + [("base64", 6, 30, 1)])
    assert 10 < low["base64", 6] <= 30
    high = secret_scan.levels([("base64", 6, k, 5) for k in range(1, 71)])
    assert high.get(("base64", 6), 100) >= 69
    even = secret_scan.levels([("base64", 6, k, 20) for k in range(100)])
    assert even["base64", 6] == 1
    many = secret_scan.levels([("base64", 6, k, 5000 if k < 10 else 50) for k in range(100)])
    assert 8 <= many["base64", 6] <= 11


def test_one_key_in_each_stratum(spark):
    rng = random.Random(11)
    keys = {}
    while len(keys) < 40:
        name = rng.choice([n for n in secret_scan.ALPHABETS])
        size = rng.choice([24, 28, 40, 50, 80, 100, 150, 200])
        key = "".join(rng.choices(secret_scan.ALPHABETS[name], k=size))
        found = secret_scan.randomness(key)
        stratum = (found and found[0], size.bit_length())
        if found and not secret_scan.base_spans(key) and (found[0] != "hex" or size < 32):
            keys.setdefault(stratum, key)
        if len(keys) >= 19:
            break
    rows = [(k, f"see {key} here") for k, key in enumerate(keys.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [r for r in secret_scan.scan_secrets(docs).collect() if any(s.kind == "random" for s in r.spans)]
    assert len(found) >= len(keys) - 1
