"""Names, slugs and paths against keys, each alone in its stratum."""

import random

import numpy as np

from stopflow.llm import secret_scan

# Words of the documents, and other words that only the names use.
TEXT = """the quick report of a former minister was reviewed before the final version went to the printers in
spring because several readers had asked for better tables and clearer figures about traffic in northern towns
while others complained that vaccination programmes and their results were hardly mentioned although many people
had expected detailed information on health services schools housing energy water transport and public finance
from 2019 to 2024 when 12 of 35 districts were merged into larger regions with 7 councils and one assembly""".split()
OTHER = """update release candidate archive project summary annual customer account manager controller
service handler request response default template configuration monitor storage network message delivery schedule
production environment migration database connection parser builder factory component""".split()


def sentences(rng):
    return " ".join(rng.choices(TEXT, k=60))


def names(rng):
    out = ["2024-report-final-version-reviewed", "COVID-19-vaccination-programme-update"]
    while len(out) < 200:
        words, number = rng.sample(OTHER, k=rng.randint(3, 5)), rng.randint(1, 2025)
        kind = len(out) % 4
        if kind == 0:
            name = "-".join([*words, str(number)])
        elif kind == 1:
            name = "/".join(["srv", *words, f"v{number % 10}"])
        elif kind == 2:
            name = "_".join([*words[:-1], str(number), words[-1]])
        else:
            name = words[0] + "".join(w.title() for w in words[1:]) + str(number)
        if len(name) >= 20:
            out.append(name)
    return out


def key(rng):
    alphabet = secret_scan.ALPHABETS[rng.choice(["base64", "base64url", "base36", "base32"])]
    return "".join(rng.choices(alphabet, k=rng.randint(24, 60)))


def test_words_and_chance_are_told_apart_one_by_one():
    rng = random.Random(5)
    counts = sum(secret_scan.pair_counts(sentences(rng)) for _ in range(200)).astype(float)
    model = secret_scan.ratios(counts.reshape(secret_scan._SEPARATOR + 1, -1))

    def alone(token):  # a stratum of its own: the level is the least one
        return [c for c in secret_scan.candidates(token, [], model) if c[4] >= secret_scan.LEAST]

    taken = [n for n in names(rng) if alone(n)]
    assert len(taken) <= 2, taken  # at most one in a hundred names
    keys = [k for k in (key(rng) for _ in range(400)) if secret_scan.randomness(k)]
    found = [k for k in keys if alone(k)]
    assert len(found) >= 0.95 * len(keys), len(found) / len(keys)


def test_a_corpus_without_words_refuses_nothing():
    model = secret_scan.ratios(np.zeros((secret_scan._SEPARATOR + 1,) * 2))
    rng = random.Random(6)
    for _ in range(50):
        token = key(rng)
        found = secret_scan.randomness(token)
        if found:
            assert secret_scan.chance_over_words(token, model[found[0]]) == 0


def test_pairs_leave_candidates_out():
    size = secret_scan._SEPARATOR + 1
    long = "ab1" * 10

    def named(text):
        counts = secret_scan.pair_counts(text).reshape(size, size)
        symbols = secret_scan.SYMBOLS + " "
        return {symbols[a] + symbols[b]: int(counts[a, b]) for a, b in zip(*np.nonzero(counts))}

    assert named("Abba a") == {" a": 2, "ab": 1, "bb": 1, "ba": 1, "a ": 1}
    assert named(f"x {long} y") == {" x": 1, "x ": 1, " y": 1}
    assert named("") == {} and named("é") == {} and named("aéb") == {" a": 1}


def test_one_name_and_one_key_in_prose(spark):
    rng = random.Random(7)
    rows = [(i, f"{sentences(rng)} see {n} {sentences(rng)}") for i, n in enumerate(names(rng)[:40])]
    keys = [key(rng) + "7" for _ in range(40)]
    rows += [(100 + i, f"{sentences(rng)} use {k} {sentences(rng)}") for i, k in enumerate(keys)]
    docs = spark.createDataFrame([*rows, (None, None), (None, "")], "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.scan_secrets(docs).collect() if any(s.kind == "random" for s in r.spans)}
    assert len([i for i in found if i < 100]) <= 1
    assert len([i for i in found if i >= 100]) >= 37
