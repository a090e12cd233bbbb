"""The corpus pipeline against a brute-force version."""

import duckdb
import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline
from stopflow.llm.catalog import OPERATORS, vocabulary

from . import brute
from .conftest import DATA
from .test_tokens import check_packing


def redacted(text):
    out, at = [], 0
    for _, s, e in brute.base_secrets(text):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def brute_force():
    """id -> text of the documents that reach the packing."""
    db = duckdb.connect()
    db.execute(f"create view documents as from '{DATA}/documents.parquet'")
    good = {r[0] for r in db.sql(f"select doc_id from ({OPERATORS['op3_quality_rules'].sql}) where kept").fetchall()}
    docs = dict(db.sql("select doc_id, text from documents").fetchall())
    by_text = brute.groups((docs[i], i) for i in good)
    left = sorted(max(ids) for ids in by_text.values())
    roots = brute.classes([brute.simhash(docs[i]) for i in left])
    return {left[k]: redacted(docs[left[k]]) for k in sorted(set(roots))}


def test_pipeline_equals_brute_force(spark):
    want = brute_force()
    library = tokenizers.Tokenizer.from_file(vocabulary())
    ids = [(i, library.encode(t, add_special_tokens=False).ids + [2]) for i, t in want.items()]
    pieces = corpus_pipeline.run(spark, DATA).collect()
    assert check_packing(pieces, ids) == 0
    assert 50 < len(want) < 200


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name


def test_stages_take_odd_rows(spark):
    text = " ".join(f"the word{i} of" for i in range(40))
    rows = [
        (None, None, None, None, None), (None, text, "en", "s", 3), (1, text, None, None, None), (1, text, None, None, None),
        (2, "", "en", "s", 0), (3, text + " password=1234567890", "en", "s", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, DATA)
        found = now.collect()
        assert (len(found) == 0) == empty
    assert {p.doc_id for p in found} <= {1, 3}
    assert np.sum([p.length for p in found]) >= 0
