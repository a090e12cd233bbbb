"""The contract of op2 on hosts that only the method's rules know."""

from stopflow.llm.catalog import OPERATORS


def test_rule_is_null_where_only_the_method_judges(spark, tmp_path):
    urls = {
        1: ("https://spam-farm.example.net/en/7?x", ("spam-farm.example.net", "/en/7", None, "block")),
        2: ("https://spam-farm.example.org/es/7", ("spam-farm.example.org", "/es/7", "example.org/es/", "block")),
        3: ("http://cheap-pills.com/fr/1", ("cheap-pills.com", "/fr/1", "com/fr/", "allow")),
        4: ("http://plain.net/", ("plain.net", "/", None, "allow")),
    }
    rows = [(i, url) for i, (url, _) in urls.items()]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = OPERATORS["op2_url_filter"].run(spark, str(tmp_path)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: w for i, (_, w) in urls.items()}
