"""Secret scan and HTML extraction."""

import base64
import random
import string

import pytest

from stopflow.llm import html_text, secret_scan
from stopflow.llm.catalog import OPERATORS

from . import brute
from .conftest import DATA

TEXTS = [
    None, "", "password=short", "password=12345678", "PassWord : 'a1b2c3d4'", "token: secret = abcdefghij",
    "api_key=x.y/z+w_1-2= apikey\"=\"12345678", "AKIAABCDEFGHIJKL", "AKIAABCDEFGHIJK", "xAKIA" + "A" * 30,
    "AKIAxAKIA" + "0" * 12, "deadbeef" * 4, "deadbeef" * 4 + "g", "DEADBEEF" * 5, "a" * 31,
    "é secret=ééééééééé secret=12345678é", "ſecret=12345678", "tokentoken=12345678", "x" * 100_000 + " passwd=abcdefgh",
    "secret=" + "0123456789abcdef" * 3,
]


def test_base_spans():
    for text in TEXTS:
        got = [(secret_scan.KINDS[k], s, e) for s, k, e in secret_scan.base_spans(text or "")]
        assert got == brute.base_secrets(text), text and text[:40]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = OPERATORS["op6_secret_scan"].run(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute.base_secrets(docs[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == brute.sha(text)
        assert [r.n_assign, r.n_access, r.n_hex] == [
            sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")
        ]
        assert set(text.split(",")) <= set(r.spans.split(","))


def test_random_strings_are_told_from_names(spark):
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits + "+/"
    keys = ["".join(rng.choices(letters, k=rng.randint(30, 60))) + "9" for _ in range(200)]
    keys += [base64.b64encode(rng.randbytes(30)).decode() for _ in range(100)]
    names = [f"the_{a}_of_the_{b}_in_release_{k}" for k in range(100) for a, b in [("name", "function")]]
    rows = [(i, f"see {k} here", 1) for i, k in enumerate(keys)]
    rows += [(1000 + i, f"see {n} here", 1) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    found = {r.doc_id for r in secret_scan.scan_secrets(docs).collect() if any(s.kind == "random" for s in r.spans)}
    assert len([i for i in found if i < 1000]) > 0.9 * len(keys)
    assert len([i for i in found if i >= 1000]) <= 0.05 * len(found)


def test_odd_rows_and_redaction(spark):
    rows = [(i, t, 5, "s") for i, t in enumerate(TEXTS)] + [(None, "token=12345678", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string")
    got = secret_scan.scan_secrets(docs).collect()
    assert len(got) == len(rows)
    clean = secret_scan.redact(docs)
    assert clean.schema.names == docs.schema.names
    texts = dict((i, t) for i, t, *_ in rows)
    for r in clean.collect():
        spans = brute.base_secrets(texts[r.doc_id])
        assert r.spans in ("s", None)
        if not spans:
            assert (r.text, r.n_chars) == (texts[r.doc_id], 5)
        else:
            assert r.n_chars == len(r.text) and "[secret]" in r.text
            assert not brute.base_secrets(r.text)
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0
    assert secret_scan.redact(docs.limit(0)).count() == 0


def page(main, n=0):
    return (
        f"<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
        f"<body><header><h2>Site</h2></header><nav><ul><li><a href=/x>Menu {n}</a></li></ul></nav><!-- c > -->"
        f"<div class='ad'>Buy {n}</div>{main}<aside>side</aside><form><input>Go</form>"
        f"<div id=comments><p>first!</p></div><footer>&copy; {n}</footer></body></html>"
    )


PAGES = [
    (page("<article><h1>A &amp; B</h1><p>one  <b>two</b>\n three<p>four<br>five</article>"), "A & B\n\none two three\n\nfour five"),
    (page("<article><p>x</p><div class='share'>Share</div><ul><li>i<li>j</ul></article>"), "x\n\ni\n\nj"),
    (page("<main><p>m</p></main>"), "m"),
    (page("<p>plain</p><div>text<p>in</p>after</div>"), "plain\n\ntext\n\nin\n\nafter"),
    (page("<article><p>cut &am"), "cut &am"), ("<article><p>a < b and 3 > 2</p><p", "a < b and 3 > 2"),
    ("no markup &lt;b&gt; at   all", "no markup <b> at all"), ("", ""), (None, ""),
    ("<article><article class=comment>reply</article><p>kept</p></article>", "kept"),
    ("<article><p>a<script>if(a<b)x('</p>')</script>b</p></article>", "ab"),
    ("<article><P TITLE='>'>q</P><p>&#233;&nbsp;&eacute;&#x1F600;</p></article>", "q\n\né é\U0001f600"),
]


@pytest.mark.parametrize("source,text", PAGES)
def test_main_text(source, text):
    assert html_text.main_text(source, frozenset()) == text


def test_style_tree_removes_what_repeats(spark):
    rows = []
    for n in range(12):
        body = f"<div class=b><p class=t>text number {n} with its own words {n * 7}</p><p class=s>Same on every page</p></div>"
        rows.append((n, "http://one.example/x", page(body, n)))
    for n in range(12):  # copies of one page: nothing can be told apart, nothing goes
        rows.append((100 + n, "http://copies.example/x", page("<div class=b><p>all the same</p></div>", 1)))
    rows.append((200, "http://small.example/", page("<div class=b><p class=s>Same on every page</p></div>")))
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages.repartition(3)).collect()}
    for n in range(12):
        assert got[n] == f"text number {n} with its own words {n * 7}"
        assert got[100 + n] == "all the same"
    assert got[200] == "Same on every page"


def test_html_odd_rows(spark):
    rows = [(None, None, None), (1, None, "<p>x"), (1, None, "<p>x"), (2, "http://h/", "<p>" + "y " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.text) for r in html_text.extract_text(pages).collect())
    assert got == [(0, ""), (1, "x"), (1, "x"), (2, ("y " * 50_000).strip())]
    assert html_text.extract_text(pages.limit(0)).count() == 0
