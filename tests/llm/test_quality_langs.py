"""The quality stage and languages without stop words."""

from stopflow.llm import quality


def test_clean_text_of_other_languages_stays(spark):
    clean = " ".join(f"slowo{k} nastepne{k}" for k in range(40))
    rows = [(k, clean, lang) for k, lang in enumerate(["pl", "tr", None, "en", "de-AT"])]
    rows += [(9, "krotki tekst", "pl"), (10, "# " * 60 + clean, "pl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in quality.quality_filter(docs).collect()) == [0, 1, 2]
    assert sorted(r.doc_id for r in quality.quality_filter(docs.drop("lang")).collect()) == []
