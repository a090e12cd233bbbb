"""URL filter: pattern rules indexed by their rarest literal token. No user functions.

A rule says which literal tokens every URL that it fits must contain, and a regular expression over
``host + path`` decides. Token frequencies are counted over all URLs, each rule is
filed under its rarest token, and a URL fetches by its own tokens only the rules that could fit; regular
expressions run on those pairs alone. Rules have a total order (rank), so the winner of a URL is one
``max`` of longs, combined map-side.

Rows are grouped by (id, host, path) and repeated rows are restored by their count, so that no
row needs a number that a recomputation could change.

Defined results: a NULL url, or one without ``://``, has an empty host and path and gets the default verdict;
NULL ids stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import small_table

#: The rule table travels with the plan and its index is broadcast; this bounds both.
MAX_RULES = 100_000
TOKEN = r"[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str  # over host + path, where the path is empty or starts with "/"
    tokens: tuple[str, ...]  # literal tokens of every fitting host + path
    tier: int = 0  # a higher tier wins, then the longer name


def prefix_rule(verdict: str, rule: str) -> Rule:
    """A rule ``host/path``: the host and all its subdomains, paths starting with the path."""
    host, slash, path = rule.partition("/")
    path = slash + path
    whole = re.findall(TOKEN, host)
    # The last token of the path is a whole token of the URL only if something ends it.
    in_path = re.findall(TOKEN + r"(?=[^A-Za-z0-9])", path)
    literal = re.sub(r"([^A-Za-z0-9/])", r"\\\1", host), re.sub(r"([^A-Za-z0-9/])", r"\\\1", path)
    pattern = rf"^(?:[^/]*\.)?{literal[0]}{literal[1]}"
    return Rule(rule, verdict, pattern, tuple(dict.fromkeys([*whole, *in_path])), tier=1)


# The rules of the contract.
CONTRACT_RULES = (
    prefix_rule("allow", "org/"),
    prefix_rule("block", "example.org/es/"),
    prefix_rule("block", "example.org/en/1"),
    prefix_rule("allow", "com/fr/"),
    prefix_rule("block", "com/de/"),
)

#: The method's own rules, below the contract's: words of a host label that sell or spam.
PATTERN_RULES = tuple(
    Rule(f"host word {word}", "block", rf"^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9]|\z)", (word,))
    for word in ("spam", "pills", "casino", "viagra", "porn", "xxx", "payday", "torrent", "warez")
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``; A-Z lower-cased; empty without ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(token, rank, pattern): every rule once, under the token that fewest URLs hold; rules without a token under the
    empty one, which every URL fetches. Counts are of the rules' tokens only, over all rows of ``urls(tokens)``."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; their table is broadcast")
    spark = urls.sparkSession
    ranked = sorted(rules, key=lambda r: (r.tier, len(r.name), r.name))
    listed = small_table(
        spark, [(i, r.pattern, t) for i, r in enumerate(ranked) for t in r.tokens or ("",)],
        "rank long, pattern string, token string",
    )
    tokens = F.broadcast(listed.select("token").distinct())
    counts = (
        urls.select(F.explode("tokens").alias("token"))
        .join(tokens, "token", "left_semi")
        .groupBy("token").count()
    )
    rarest = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")
    return listed.join(F.broadcast(counts), "token", "left").groupBy("rank", "pattern").agg(rarest)


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[Rule] = (*CONTRACT_RULES, *PATTERN_RULES), default: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: id_col, host, path, ``rule`` (name of the winner or NULL),
    ``verdict`` (its, else ``default``)."""
    spark = pages.sparkSession
    urls = pages.select(
        F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    tokens = F.array_distinct(
        F.regexp_extract_all(F.concat("host", "path"), F.lit(f"({TOKEN})"), F.lit(1))
    )
    index = F.broadcast(rule_index(urls.select(tokens.alias("tokens")), rules))
    # Copies are counted for each task, so a url that many rows repeat stays many small rows.
    urls = urls.withColumn("_task", F.spark_partition_id()).groupBy("_id", "host", "path", "_task")
    urls = urls.agg(F.count(F.lit(1)).alias("_copies")).withColumn("tokens", tokens)
    # The empty token stands for the row itself, so rows without a rule stay.
    named = urls.withColumn("token", F.explode(F.array_append("tokens", F.lit("")))).drop("tokens")
    fits = F.rlike(F.concat("host", "path"), F.col("pattern"))
    tried = named.join(index, "token", "left").withColumn("rank", F.when(fits, F.col("rank"))).filter(
        (F.col("token") == "") | F.col("rank").isNotNull()
    )
    won = tried.groupBy("_id", "host", "path", "_task", "_copies").agg(F.max("rank").alias("rank"))
    ranked = sorted(rules, key=lambda r: (r.tier, len(r.name), r.name))
    names = F.broadcast(small_table(
        spark, [(i, r.name, r.verdict) for i, r in enumerate(ranked)],
        "rank long, rule string, verdict string",
    ))
    return (
        won.join(names, "rank", "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        .select(
            F.col("_id").alias(id_col), "host", "path", "rule",
            F.coalesce("verdict", F.lit(default)).alias("verdict"),
        )
    )
