"""Quality rules: a threshold table compiled into one projection. No user functions.

The measures of a text are array and string functions of its own row, so judging documents
is one scan without a shuffle. Repeated 3-word windows are found by sorting the windows of
the row with their positions; equal neighbours in that order repeat.

Defined results: a NULL text has no words and no lines; an empty table gives an empty result; NULL in
other columns changes nothing; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 3

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on was be as with by at this are from an or not "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine "
    "de la le les et en un une que qui dans est pour par sur pas au du avec "
    "el los las y se del por con no para es al una"
).split()
STOP_WORD_LANGS = ("en", "de", "fr", "es")


@dataclass(frozen=True)
class Rule:
    """A document fails where ``measure`` lies outside [least, most]."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def fails(self) -> Column:
        value, out = F.col(self.measure), F.lit(False)
        if self.least is not None:
            out = out | (value < F.lit(float(self.least)))
        if self.most is not None:
            out = out | (value > F.lit(float(self.most)))
        return out


#: The base rules, which the contract fixes (whole numbers, hence exact), and the others.
BASE = (Rule("few_words", "n_words", least=50), Rule("repetitive", "_repeat_excess", most=0))
RULES = (
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("repeated_lines", "dup_line_ratio", most=0.4),
    Rule("word_length", "mean_word_length", least=3.0, most=10.0),
    Rule("few_stop_words", "stop_word_ratio", least=0.06),
)


def _windows(words: Column) -> Column:
    """All windows of WINDOW words, as strings (words hold no space)."""
    def window(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)])

    spans = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.when(F.size(words) >= WINDOW, F.transform(spans, window)).otherwise(
        F.array().cast("array<string>")
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The measures of each text beside ``_own``, the row as a struct (so that no column of
    ``docs`` can clash)."""
    step = docs.select(
        F.struct(*[f"`{c}`" for c in docs.columns]).alias("_own"), text_of(f"`{text_col}`").alias("_text")
    )
    step = step.withColumns({
        "_words": words_of(F.col("_text")),
        "_lines": F.filter(
            F.split(F.col("_text"), "\n"), lambda line: F.translate(line, WHITE, "") != ""
        ),
    })
    words = F.col("_words")
    step = step.withColumn("_windows", _windows(words))
    # Without a repeated window there is nothing to sort.
    step = step.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.arrays_zip(
                F.col("_windows").alias("g"),
                F.sequence(F.lit(0), F.size("_windows") - 1).alias("i"),
            )),
        ),
    )
    ordered = F.col("_sorted")
    last = F.size(ordered) - 1
    repeats = F.filter(
        ordered,
        lambda x, k: ((k > 0) & (x["g"] == F.get(ordered, k - 1)["g"]))
        | ((k < last) & (x["g"] == F.get(ordered, k + 1)["g"])),
    )
    step = step.withColumn("_at", F.array_sort(F.transform(repeats, lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(
            at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))
        ),
        F.lit(0), lambda total, x: total + x,
    )
    squeezed = F.length(F.translate("_text", WHITE, ""))
    bare = F.transform(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    step = step.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": squeezed.cast("long"),
        "n_symbols": (
            F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))
        ).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "_stop": F.size(F.filter(bare, lambda w: w.isin(STOP_WORDS))),
    })
    n = F.greatest(F.col("n_words"), F.lit(1))
    return step.withColumns({
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "mean_word_length": F.col("word_chars") / n,
        "stop_word_ratio": F.col("_stop") / n,
        "_repeat_excess": 100 * F.col("n_repeat_words") - 50 * F.col("n_words"),
    })


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "symbol_ratio", "dup_line_ratio", "mean_word_length", "stop_word_ratio",
)


def judged(
    docs: DataFrame, text_col: str = "text",
    base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept`` and ``failed_rules`` (names); columns
    of ``docs`` with these names are replaced."""
    def any_of(table: Sequence[Rule]) -> Column:
        out = F.lit(False)
        for rule in table:
            out = out | rule.fails()
        return out

    # The measures go through a generator of one row, which stops the optimizer from writing them out
    # once more in every filter on the result.
    once = F.inline(F.array(F.struct(*MEASURES, "_repeat_excess")))
    held = measured(docs, text_col).select("_own", once)
    failed = F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in (*base, *rules)]))
    added = (*MEASURES, "base_failed", "kept", "failed_rules")
    return held.select(
        *[F.col(f"_own.`{c}`") for c in docs.columns if c not in added],
        *MEASURES,
        any_of(base).alias("base_failed"),
        (~any_of([*base, *rules])).alias("kept"),
        failed.alias("failed_rules"),
    )


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that pass every rule, with their own columns. Where ``lang_col`` names no language
    with stop words here, the other rules decide."""
    own = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), f"`{text_col}`")
    marked = judged(own, text_col)
    kept = F.col("kept")
    if lang_col in docs.columns:
        main = F.lower(F.regexp_extract(F.col(f"_row.`{lang_col}`").cast("string"), "^\\s*([A-Za-z]*)", 1))
        foreign = F.coalesce(~main.isin(*STOP_WORD_LANGS), F.lit(True))
        kept = kept | (foreign & (F.array_except("failed_rules", F.array(F.lit("few_stop_words"))) == F.array().cast("array<string>")))
    return marked.filter(kept).select("_row.*")
