"""The registered query of every corpus operator, with a SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, hard_negatives, html_text, infill, line_dedup, packing, quality, secret_scan, simhash, substring_dedup, token_files, url_filter
from .common import table, text_of


@dataclass(frozen=True)
class Operator:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


OPERATORS: dict[str, Operator] = {}


def vocabulary() -> str:
    """Place of the vocabulary file that the contracts name, on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


OPERATORS["op1_packing"] = Operator(op1)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    # The contract names its own rules only; the method's (words of a host) show in the verdict.
    named = F.col("rule").isin([r.name for r in url_filter.CONTRACT_RULES])
    return judged.withColumn("rule", F.when(named, F.col("rule")))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(
        str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'" for x in row
    ) + ")" for row in rows)


OPERATORS["op2_url_filter"] = Operator(op2, f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
base(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
words(word) AS (VALUES {_values([(r.tokens[0],) for r in url_filter.PATTERN_RULES])}),
fits AS (
  SELECT r, b.host || b.path AS rule, verdict, 1 AS tier FROM parts p JOIN base b
    ON (p.host = b.host OR ends_with(p.host, '.' || b.host)) AND starts_with(p.path, b.path)
  UNION ALL
  SELECT r, 'host word ' || word, 'block', 0 FROM parts p JOIN words
    ON list_contains(regexp_split_to_array(p.host, '[^a-z0-9]'), word)),
won AS (SELECT * FROM fits
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY tier DESC, length(rule) DESC, rule DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN won USING (r)""")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


#: Judged documents in DuckDB, also for the pipeline; ``kept`` follows quality.RULES.
QUALITY_SQL = f"""
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text,
    regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t),
grams AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(0, 3) AS s(k) GROUP BY r),
stops(word) AS (VALUES {_values(sorted({(w,) for w in quality.STOP_WORDS}))}),
said AS (SELECT r, lower(rtrim(unnest(words), '.,;:!?')) AS word FROM w),
stopped AS (SELECT r, count(*) AS n FROM said SEMI JOIN stops USING (word) GROUP BY r),
m AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(s.n, 0) AS n_stop
  FROM w LEFT JOIN covered c USING (r) LEFT JOIN stopped s USING (r)),
judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    n_symbols / greatest(n_words, 1) > 0.1 OR n_dup_lines / greatest(n_lines, 1) > 0.4
    OR word_chars / greatest(n_words, 1) < 3.0 OR word_chars / greatest(n_words, 1) > 10.0
    OR n_stop / greatest(n_words, 1) < 0.06 AS rules_failed FROM m)"""

OPERATORS["op3_quality_rules"] = Operator(op3, f"""WITH {QUALITY_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR rules_failed) AS kept FROM judged""")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"),
    )


OPERATORS["op4_line_dedup"] = Operator(op4, r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
worded AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (SELECT a.doc_id, a.k, a.line || chr(10) || b.line || chr(10) || c.line AS run
  FROM worded a JOIN worded b ON b.doc_id = a.doc_id AND b.k = a.k + 1
    JOIN worded c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
later AS (SELECT doc_id, k FROM runs
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT w.doc_id, w.pos FROM worded w
  JOIN later x ON x.doc_id = w.doc_id AND w.k BETWEEN x.k AND x.k + 2),
counted AS (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN counted c USING (doc_id) LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)""")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


OPERATORS["op5_simhash"] = Operator(op5)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    counts = [
        F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
        for kind in secret_scan.KINDS[:3]
    ]
    base = secret_scan.spans_text(F.col("base_spans"))
    return found.select(
        "doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


OPERATORS["op6_secret_scan"] = Operator(op6)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


OPERATORS["op7_html_text"] = Operator(op7)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


OPERATORS["op8_bpe"] = Operator(op8)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


OPERATORS["op9_substring_dedup"] = Operator(op9, r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT r, i, md5(array_to_string(words[i : i + 34], ' ')) AS h
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM again, range(0, 35) AS s(k)),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
said AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM said ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)""")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OPERATORS["op10_exact_dedup"] = Operator(op10, """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0
    )


OPERATORS["op11_hard_negatives"] = Operator(op11, """
WITH v AS (SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r),
positives AS (SELECT ar, anchor_id, br AS pr, id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) <= 5),
negatives AS (SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY n.score DESC, n.id, n.br) AS rank
  FROM positives p JOIN scored n ON n.ar = p.ar AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 3""")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary()).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


OPERATORS["op12_token_files"] = Operator(op12)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


OPERATORS["op13_fill_in_middle"] = Operator(op13, r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
drawn AS (SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
cut AS (SELECT doc_id, text, n, form, array_to_string(units[1 : least(one, two)], '') AS p,
    array_to_string(units[least(one, two) + 1 : greatest(one, two)], '') AS m,
    array_to_string(units[greatest(one, two) + 1 :], '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut""")
