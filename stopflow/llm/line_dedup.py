"""Line dedup by winnowing. DataFrame functions only.

Of every document the lines that hold a word are hashed. Grams of ``gram`` neighbouring lines are winnowed:
each window of ``min_lines - gram + 1`` grams selects its smallest (the rightmost of equal
ones), so any run of ``min_lines`` lines that two places share has a selected fingerprint in
common. Fingerprints that occur once are dropped by a map-side counting aggregate. The positions of the
others are extended to both sides, in every way in which a run of ``min_lines`` lines holds
the fingerprint; of equal runs the first place (by id, then text digest, then line) is the
original, and the lines of all later ones are deleted.
So exactly the lines covered by a run of ``min_lines`` lines that occurs earlier go.

Defined results: a NULL text is empty; lines without a word count for nothing and stay; NULL ids come first; rows
with equal id and text are one document and get one result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, text_of, written

MIN_LINES = 3
GRAM = 2


def _has_word(line: Column) -> Column:
    return F.translate(line, WHITE, "") != ""


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _picks(digests: Column, min_lines: int, gram: int) -> Column:
    """The winnowed gram of each window of one document, as (hash, minus position)."""
    n = F.size(digests)
    width = min_lines - gram + 1

    def hashed(p: Column) -> Column:
        return F.struct(
            F.xxhash64(*[F.get(digests, p + k) for k in range(gram)]).alias("h"), (-p).alias("p")
        )

    def smallest(start: Column) -> Column:
        return F.array_min(F.array(*[hashed(start + k) for k in range(width)]))

    starts = F.sequence(F.lit(0), n - min_lines)
    return F.when(n >= min_lines, F.transform(starts, smallest))


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_lines: int = MIN_LINES, gram: int = GRAM,
) -> DataFrame:
    """(id, text_digest, doomed): positions, among the lines with a word, of the lines to delete;
    documents without any are left out."""
    text = text_of(text_col)
    lined = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.md5(text.cast("binary"))).alias("text_digest"),
            F.transform(
                F.filter(F.split(text, "\n"), _has_word), lambda x: F.unhex(F.md5(x.cast("binary")))
            ).alias("lines"),
        ).filter(F.size("lines") >= min_lines),
        "lines",
    )
    # Picks move forward only, so equal ones are neighbours.
    picked = lined.withColumn("picks", _picks(F.col("lines"), min_lines, gram))
    once = F.filter(
        "picks", lambda f, i: (i == 0) | (f["p"] != F.get(F.col("picks"), i - 1)["p"])
    )
    # Every run of min_lines lines around a fingerprint, as far as the document goes.
    reach = min_lines - gram

    def around(f: Column) -> Column:
        starts = F.filter(
            F.sequence(-f["p"] - reach, -f["p"]), lambda s: (s >= 0) & (s + min_lines <= F.size("lines"))
        )
        return F.transform(
            starts,
            lambda s: F.struct(
                s.alias("at"),
                _digest(*[F.get("lines", s + k) for k in range(min_lines)]).alias("run"),
            ),
        )

    near = picked.select(
        "id", "text_digest",
        F.inline(F.transform(once, lambda f: F.struct(f["h"].alias("h"), around(f).alias("runs")))),
    )
    repeated = near.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    runs = (
        near.join(repeated, "h", "left_semi")
        .select("id", "text_digest", F.inline("runs"))
        .withColumn("place", F.struct(F.col("id"), F.col("text_digest"), F.col("at")))
    )
    first = (
        runs.groupBy("run")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .filter("first < last")
        .select("run", "first")
    )
    later = runs.join(first, "run").filter("place > first")
    covered = F.explode(F.sequence(F.col("at"), F.col("at") + min_lines - 1)).alias("at")
    return (
        later.select("id", "text_digest", covered)
        .groupBy("id", "text_digest")
        .agg(F.collect_set("at").alias("doomed"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_lines: int = MIN_LINES, gram: int = GRAM,
) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col`` and, replacing columns of
    these names, ``n_lines`` (lines with a word before) and ``n_removed``."""
    doomed = repeated_lines(docs, id_col, text_col, min_lines, gram).select(
        F.col("id").alias("_id"), F.col("text_digest").alias("_digest"), F.col("doomed").alias("_doomed")
    )
    text = text_of(f"`{text_col}`")
    marked = docs.select(
        F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").alias("_own_id"), F.unhex(F.md5(text.cast("binary"))).alias("_own_digest"),
        F.split(text, "\n").alias("_lines"),
    )
    same = (F.col("_own_digest") == F.col("_digest")) & F.col("_own_id").eqNullSafe(F.col("_id"))
    step = marked.join(doomed, same, "left")
    # Number the lines that hold a word, then keep what is not listed.
    step = step.withColumn(
        "_numbers",
        F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: _has_word(F.get("_lines", i))),
    )
    step = step.withColumn("_gone", F.transform("_doomed", lambda k: F.get("_numbers", k)))
    # What lies between the lines that go.
    step = step.withColumn(
        "_cuts", F.concat(F.array(F.lit(-1)), F.sort_array("_gone"), F.array(F.size("_lines")))
    )
    cuts = F.col("_cuts")
    between = F.transform(
        F.sequence(F.lit(0), F.size(cuts) - 2),
        lambda k: F.slice("_lines", F.get(cuts, k) + 2, F.get(cuts, k + 1) - F.get(cuts, k) - 1),
    )
    kept = F.array_join(F.flatten(between), "\n")
    changed = F.col("_gone").isNotNull()
    own = [
        F.when(changed, kept).otherwise(F.col(f"_row.`{c}`")).alias(c)
        if c == text_col else F.col(f"_row.`{c}`")
        for c in docs.columns if c not in ("n_lines", "n_removed")
    ]
    return step.select(
        *own,
        F.size("_numbers").cast("long").alias("n_lines"),
        F.when(changed, F.size("_gone")).otherwise(0).cast("long").alias("n_removed"),
    )
