"""URL filter, quality rules, line dedup and exact dedup: SQL twins, brute force, odd rows."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from stopflow.llm import exact_dedup, line_dedup, quality, url_filter
from stopflow.llm.catalog import OPERATORS
from stopflow.llm.common import small_table

from . import brute
from .conftest import DATA

TABLES = ("documents", "pages")


@pytest.mark.parametrize("name", [n for n, o in OPERATORS.items() if o.sql])
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    twin = db.sql(OPERATORS[name].sql)
    columns = sorted(twin.columns)
    theirs = sorted(map(repr, twin.select(*[f'"{c}"' for c in columns]).fetchall()))
    df = OPERATORS[name].run(spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == theirs


NATIVE = ["op2_url_filter", "op3_quality_rules", "op4_line_dedup", "op10_exact_dedup"]


@pytest.mark.parametrize("name", NATIVE)
def test_plan_has_no_python(spark, name):
    plan = OPERATORS[name].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_quality_has_no_shuffle(spark):
    plan = OPERATORS["op3_quality_rules"].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_small_table(spark):
    rows = [(1, "a'\"\\"), (2, None)]
    assert [tuple(r) for r in small_table(spark, rows, "n long, s string").collect()] == rows


# ---- URL filter ------------------------------------------------------------------------------

def expected_verdict(url):
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = re.split(r"[?#]", rest[cut:])[0]
    best = None
    for verdict, rule in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
                          ("allow", "com/fr/"), ("block", "com/de/")):
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            if best is None or len(rule) > len(best[1]):
                best = verdict, rule
    if best is None:
        words = [r.tokens[0] for r in url_filter.PATTERN_RULES]
        hit = [w for w in words if w in re.split("[^a-z0-9]", host)]
        if hit:
            best = "block", max(("host word " + w for w in hit), key=lambda r: (len(r), r))
    return host, path, best[1] if best else None, best[0] if best else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG/", "http://org", "http://org?x=/", "http://x.org/a#b",
    "http://notorg.com/fr/", "http://example.org/es/", "http://a.example.org/es", "http://example.org/en/1",
    "http://example.org/en/123?y", "http://myexample.org/en/1", "http://com/de/x", "http://a.com/fr/x",
    "http://a.com/FR/x", "https://spam.example.net/", "https://spam-farm.pills.example.org/es/1",
    "https://spammy.net/", "a://b://org/", "http://é.org/", "http://org./", "http://a.org/\n/es/",
    "http://x.com/" + "a/" * 20_000 + "de/", "http://example.org//es/", "http://example.org:80/es/",
]


def test_urls(spark):
    rows = [(i, u, "extra") for i, u in enumerate(URLS)] * 2 + [(None, None, "x")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge_urls(pages.repartition(3)).collect()
    wanted = [(i, *expected_verdict(u)) for i, u, _ in rows]
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in got)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_rule_is_filed_under_its_rarest_token(spark):
    urls = spark.createDataFrame([(["com", "fr", "x"],), (["com", "x"],)], "tokens array<string>")
    index = {r["rank"]: r.token for r in url_filter.rule_index(urls, url_filter.CONTRACT_RULES).collect()}
    ranked = sorted(url_filter.CONTRACT_RULES, key=lambda r: (r.tier, len(r.name), r.name))
    assert {ranked[k].name: t for k, t in index.items()}["com/fr/"] == "fr"


# ---- quality ---------------------------------------------------------------------------------

TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "a a a a a", "x\nx\n\nx\n y", "# $ % & | < > *",
    "the and of " * 20, "b a " * 30_000, "é ñ 中 \U0001f600 the", "w " * 2 + "q",
    "\x0bw\x0cv\rz\x1cu\x85t", " ".join(f"word{i} the of and" for i in range(60)),
]


def test_quality_measures(spark):
    rows = [(i, t, 7, "own") for i, t in enumerate(TEXTS)] + [(None, "a b", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, _text string")
    got = quality.judged(docs.repartition(2)).collect()
    assert len(got) == len(rows)
    texts = dict((i, t) for i, t, *_ in rows)
    for r in got:
        text = texts[r.doc_id] or ""
        w = brute.words(text)
        lines = [x for x in text.split("\n") if brute.WORD.search(x)]
        assert r.n_words == len(w)
        assert r.word_chars == sum(map(len, w))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute.repeat_words(text), text[:40]
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert r.kept == (not r.failed_rules)
        assert r._text in ("own", None)
    assert quality.judged(docs.limit(0)).count() == 0
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_filters_do_not_repeat_the_measures(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")

    def sorts(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("array_sort")

    plain = sorts(quality.judged(docs))
    assert plain == sorts(quality.judged(docs).filter("not base_failed"))
    assert plain == sorts(quality.judged(docs).filter("kept and n_words > 10 and symbol_ratio < 0.05"))
    assert plain == sorts(quality.quality_filter(docs))


def test_quality_keeps_clean_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    clean = quality.judged(docs).join(labels, "doc_id").filter("not base_failed")
    assert clean.count() > 100
    assert clean.filter("not kept").count() == 0


# ---- line dedup ------------------------------------------------------------------------------

def test_lines_against_brute_force(spark):
    import random

    rng = random.Random(3)
    pool = [f"line {k}" for k in range(6)] + ["", "  "]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(150)]
    docs += [(1000, None), (1001, "\n".join(f"u{k}" for k in range(5000)))]
    frame = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, n_lines int, _id string")
    got = line_dedup.dedup_lines(frame.repartition(4)).collect()
    wanted = brute.lines_removed(docs)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text or "") for r in got} == wanted
    assert len(got) == len(docs)
    assert sum(r.n_removed for r in got) > 100


@pytest.mark.parametrize("t,gram", [(1, 1), (2, 1), (4, 2), (5, 3)])
def test_lines_with_other_sizes(spark, t, gram):
    import random

    rng = random.Random(t)
    docs = [(i, "\n".join(rng.choices("abcd", k=rng.randint(0, 14)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.dedup_lines(frame, min_lines=t, gram=gram).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got} == brute.lines_removed(docs, t)


def test_lines_odd_rows(spark):
    same = "a\nb\nc"
    rows = [(None, same), (None, same), (5, same), (6, "z\n" + same)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(frame).collect())
    assert got == [(0, same), (0, same), (5, ""), (6, "z")]
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


# ---- exact dedup -----------------------------------------------------------------------------

@pytest.mark.parametrize("heavy_share", [1, 1024])
def test_exact_groups(spark, monkeypatch, heavy_share):
    monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", heavy_share)
    texts = ["hot"] * 400 + ["", None, " ", "a", "A", "a"] + [f"t{k % 90}" for k in range(200)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "a", "y"), (700, "hot", "z"), (700, "hot", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(4)
    got = exact_dedup.duplicate_groups(docs).collect()
    by_text = brute.groups((t or "", i) for i, t, _ in rows)
    assert len(got) == len(rows)
    for r in got:
        ids = by_text[{brute.sha(t): t for t in by_text}[bytes(r.digest).hex()]]
        assert r.group_size == len(ids)
        assert r.keep_id == max(i for i in ids if i is not None)
        assert not r.kept or r.id == r.keep_id
    assert sum(r.kept for r in got) == len(by_text)
    staying = exact_dedup.exact_dedup(docs)
    assert staying.columns == docs.columns
    left = staying.collect()
    assert sorted(r.text or "" for r in left) == sorted(by_text)
    assert all(r.doc_id == max(i for i in by_text[r.text or ""] if i is not None) for r in left)


def test_exact_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicate_groups(docs).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [(r.keep_id, r.group_size) for r in exact_dedup.duplicate_groups(nulls).collect()] == [(None, 2)] * 2
    assert exact_dedup.exact_dedup(nulls).count() == 1


def test_thousands_of_rules_with_shared_rare_and_no_tokens(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(60)]
    rules = [
        url_filter.Rule(f"{a} {b} {k}", rng.choice(("allow", "block")), f"^[^/]*{a}.*{b}", (a, b), rng.randrange(3))
        for k, (a, b) in enumerate((rng.choice(names[:10]), rng.choice(names)) for _ in range(3000))
    ]
    rules += [
        url_filter.Rule("digit host", "block", r"^[^/]*[0-9]", (), 1), url_filter.Rule("long", "block", r"^.{30,}", (), 9),
    ]
    urls = [f"http://{rng.choice(names)}.{rng.choice(names)}/{rng.choice(names)}/{rng.choice(names)}" for _ in range(150)]
    urls += ["http://a1.net/", "http://zz/", None, "", "http://abc.def/" + "x" * 40]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    ranked = sorted(rules, key=lambda r: (r.tier, len(r.name), r.name))
    want = {}
    for i, url in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        text = m[1] + m[2] if m else ""
        have = set(re.findall(url_filter.TOKEN, text))
        fit = [r for r in ranked if re.search(r.pattern, text) and have.issuperset(r.tokens)]
        want[i] = (fit[-1].name, fit[-1].verdict) if fit else (None, "allow")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules=rules).collect()}
    assert got == want
    assert got[150] == ("digit host", "block") and got[154] == ("long", "block")


def test_lines_of_long_documents_cost_in_proportion(spark):
    lines = [f"line {k} of a very long document" for k in range(40_000)]
    lines[30_000:30_010] = lines[5:15]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[100:20_100]) + "\nnew\n\nend")], "doc_id long, text string")
    started = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - started < 60
    assert (got[1].n_lines, got[1].n_removed) == (40_000, 10)
    assert (got[2].n_removed, got[2].text) == (20_000, "new\n\nend")
    assert got[1].text == "\n".join(lines[:30_000] + lines[30_010:])
