"""Secret scans: fixed patterns and a battery of randomness tests.

The patterns (assignments, access keys, long hexadecimal runs) are the base. Beside them every run of 20 or more
token characters with a letter and a digit is a candidate: its encoding is inferred as the smallest known
alphabet that holds it, and three tests ask whether it could be uniform over that alphabet:
chi-squared over equal bins, runs above and below the middle, and serial correlation. The
smallest of the three p-values, times three, is the candidate's p-value.

Names, slugs and paths may pass these tests where they are alone in their stratum. They are told by a likelihood
ratio: a bigram model of letters, digits and separators, counted over the ordinary words of all documents (runs
shorter than a candidate), against the uniform one of the encoding. A candidate that the words explain better
than chance is no candidate. The model leans on the uniform one by WEIGHT pairs for each symbol, so a corpus
without words refuses nothing.

Short strings of ordinary text pass such tests more easily than long ones, so the level is set for each
(encoding, length class) from all documents: p-values of random strings are uniform, so of those that pass a
level a known share lies in the upper half of what is left, while other strings crowd just above the
level. A level is refused where so few lie in that half that, with at most RATE of others among
them, the chance is below DOUBT. The smallest level not refused (LEAST at least) is taken. A lone
candidate refuses nothing, so a rare key is found by itself, whatever other documents hold; and what
crowds together is refused above one half as well as below. Both sets of counts, pairs of symbols and p-values,
are of fixed size.

Defined results: a NULL text is empty; rows are judged one by one, so NULL or repeated ids
need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The patterns of the contract; kinds in the order in which spans are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from the smallest on; a candidate has the first that holds all its characters.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _LOWER.upper() + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _LOWER.upper(),
    "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/",
    "base64url": _LOWER.upper() + _LOWER + _DIGITS + "-_",
}
#: Accepted share of non-random strings among those found, and the least level of the tests.
RATE, LEAST = 0.05, 0.01
BINS = 100
DOUBT = 0.01
#: Pairs of the uniform model that stand behind each symbol of the bigram model.
WEIGHT = 37.0
SYMBOLS = _LOWER + _DIGITS  # letters of either case, digits; then the separator, then what takes no part
_SEPARATOR, _OTHER = len(SYMBOLS), len(SYMBOLS) + 1
HIGHEST = 90  # levels end here; the bins above are too few to be halved


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    found = [
        (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
    ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str) -> tuple[str, float] | None:
    """(encoding, p-value of uniformity), or None if no alphabet holds the token."""
    body = token.rstrip("=")
    used = set(body)
    if used.isdisjoint(_DIGITS) or used <= set(_DIGITS):
        return None
    encoding = next((name for name, a in ALPHABETS.items() if used <= set(a)), None)
    if encoding is None:
        return None
    alphabet = ALPHABETS[encoding]
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.fromiter((place[c] for c in body), np.int64, len(body))
    n, size = len(x), len(alphabet)
    # Chi-squared over bins of the alphabet that expect five or more symbols each.
    bins = max(2, min(size, n // 5))
    counts = np.bincount(x * bins // size, minlength=bins)
    widths = np.bincount(np.arange(size) * bins // size, minlength=bins)
    expected = n * widths / size
    chi = float(((counts - expected) ** 2 / expected).sum())
    df = bins - 1
    # Wilson and Hilferty: the cube root of chi-squared over df is nearly normal.
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    tests = [_two_sided(z)]
    # Runs above and below the middle (Wald and Wolfowitz).
    high = x >= (size + 1) // 2
    up = int(high.sum())
    down = n - up
    if up and down:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * up * down / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        tests.append(_two_sided((runs - mean) / spread))
    else:
        tests.append(0.0)
    # Serial correlation of neighbouring symbols.
    d = x - x.mean()
    power = float((d * d).sum())
    tests.append(
        _two_sided((float((d[1:] * d[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    )
    return encoding, min(1.0, 3 * min(tests))


def _symbol_table() -> np.ndarray:
    table = np.full(256, _SEPARATOR, np.int64)
    table[128:] = _OTHER
    for k, c in enumerate(SYMBOLS):
        table[ord(c)] = table[ord(c.upper())] = k
    return table


_SYMBOL = _symbol_table()
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in _LOWER + _LOWER.upper() + _DIGITS + "+/_-"]] = True
LEAST_LENGTH = 20


def pair_counts(text: str) -> np.ndarray:
    """Counts of neighbouring symbols outside runs that are long enough for a candidate."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = _SEPARATOR + 1
    if not len(raw):
        return np.zeros(size * size, np.int64)
    symbol = _SYMBOL[raw]
    ends = np.flatnonzero(~_TOKEN[raw])
    ends = np.concatenate([[-1], ends, [len(raw)]])
    gaps = np.diff(ends) - 1
    for k in np.flatnonzero(gaps >= LEAST_LENGTH):
        symbol[ends[k] + 1 : ends[k + 1]] = _OTHER
    symbol = np.concatenate([[_SEPARATOR], symbol])
    left, right = symbol[:-1], symbol[1:]
    both = (left != _OTHER) & (right != _OTHER)
    return np.bincount(left[both] * size + right[both], minlength=size * size)


def word_model(docs: DataFrame, text_col: str = "text") -> dict[str, np.ndarray]:
    """For each encoding the logarithms of uniform over bigram chances, by (symbol, next symbol)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_SEPARATOR + 1) ** 2, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total += pair_counts(text)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["pair", "n"]
        )

    rows = (
        docs.select(f"`{text_col}`").mapInArrow(count, "pair long, n long")
        .groupBy("pair").agg(F.sum("n").alias("n")).collect()
    )
    counts = np.zeros((_SEPARATOR + 1) ** 2)
    for row in rows:
        counts[row.pair] = row.n
    return ratios(counts.reshape(_SEPARATOR + 1, -1))


def ratios(counts: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for name, alphabet in ALPHABETS.items():
        symbols = _SYMBOL[np.frombuffer(alphabet.encode(), np.uint8)]
        uniform = np.bincount(symbols, minlength=_SEPARATOR + 1) / len(alphabet)
        # What the alphabet lacks takes no part, so its counts go too.
        known = counts * (uniform > 0)
        bigram = (known + WEIGHT * uniform) / (known.sum(axis=1, keepdims=True) + WEIGHT)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[name] = np.where(uniform > 0, np.log(uniform) - np.log(bigram), 0.0)
    return out


def chance_over_words(token: str, ratio: np.ndarray) -> float:
    """Logarithm of how much likelier chance makes the token than the words do."""
    symbol = _SYMBOL[np.frombuffer(token.rstrip("=").encode(), np.uint8)]
    return float(ratio[np.concatenate([[_SEPARATOR], symbol[:-1]]), symbol].sum())


def candidates(
    text: str, known: list[tuple[int, int, int]], model: dict[str, np.ndarray]
) -> Iterator[tuple[int, int, str, int, float]]:
    """(start, end, encoding, length class, p) of candidates that overlap no known span and that the
    words do not explain."""
    at = 0
    for m in CANDIDATE.finditer(text):
        while at < len(known) and known[at][2] <= m.start():
            at += 1
        if any(s < m.end() and e > m.start() for s, _, e in known[at:]):
            continue
        found = randomness(m[0])
        if found is not None and chance_over_words(m[0], model[found[0]]) >= 0:
            yield m.start(), m.end(), found[0], (m.end() - m.start()).bit_length(), found[1]


def _bin(p: float) -> int:
    return min(BINS - 1, int(p * BINS))


def p_value_counts(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """(encoding, length_class, bin, n) over all documents; at most 7 x 32 x BINS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for _, _, encoding, size, p in candidates(text, base_spans(text), model):
                        total[encoding, size, _bin(p)] += 1
        rows = [(*key, n) for key, n in total.items()]
        columns = list(zip(*rows)) or [()] * 4
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["encoding", "length_class", "bin", "n"],
        )

    return (
        docs.select(f"`{text_col}`")
        .mapInArrow(count, "encoding string, length_class long, bin long, n long")
        .groupBy("encoding", "length_class", "bin")
        .agg(F.sum("n").alias("n"))
    )


def _at_most(k: int, n: int, p: float) -> float:
    """The chance of at most ``k`` of ``n``; beyond a thousand by the normal curve."""
    if n > 1000:
        return math.erfc(-(k + 0.5 - n * p) / math.sqrt(2 * n * p * (1 - p))) / 2
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def levels(counts: list[tuple[str, int, int, int]], rate: float = RATE, least: float = LEAST) -> dict:
    """(encoding, length class) -> the bin from which candidates count as random."""
    strata: dict[tuple[str, int], np.ndarray] = {}
    for encoding, size, k, n in counts:
        strata.setdefault((encoding, size), np.zeros(BINS))[k] += n
    out = {}
    for key, n in strata.items():
        passing = n[::-1].cumsum()[::-1]
        for k in range(max(1, round(least * BINS)), HIGHEST + 1):
            if not passing[k]:
                break
            half = k + (BINS - k) // 2
            expected = (1 - rate) * (BINS - half) / (BINS - k)
            if _at_most(int(passing[half]), int(passing[k]), expected) >= DOUBT:
                out[key] = k
                break
    return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    rate: float = RATE, least: float = LEAST,
) -> DataFrame:
    """One row per document: id_col, ``base_spans`` and ``spans`` (base and random), each an
    array of (kind, start, end) by start, then kind as in KINDS; code points, end exclusive."""
    model = word_model(docs, text_col)
    counted = p_value_counts(docs, model, text_col).collect()
    level = levels([(r.encoding, r.length_class, r.bin, r.n) for r in counted], rate, least)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def listed(spans):
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, both = [], []
            for text in batch.column(1).to_pylist():
                known = base_spans(text) if text else []
                more = [
                    (s, 3, e) for s, e, encoding, size, p in candidates(text or "", known, model)
                    if _bin(p) >= level.get((encoding, size), BINS)
                ]
                base.append(listed(known))
                both.append(listed(sorted(known + more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(span)), pa.array(both, pa.list_(span))],
                names=[id_col, "base_spans", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(
        scan, f"`{id_col}` {kind}, base_spans {SPANS}, spans {SPANS}"
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(
    docs: DataFrame, text_col: str = "text", mark: str = "[secret]",
    rate: float = RATE, least: float = LEAST,
) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; a column ``n_chars`` of
    the table follows the new text. Documents all stay."""
    own = docs.columns
    packed = docs.select(F.struct(*[f"`{c}`" for c in own]).alias("_row"), F.col(text_col).alias("_text"))
    model = word_model(docs, text_col)
    counted = p_value_counts(docs, model, text_col).collect()
    level = levels([(r.encoding, r.length_class, r.bin, r.n) for r in counted], rate, least)

    def cleaned(text: str | None) -> str | None:
        known = base_spans(text) if text else []
        spans = known + [
            (s, 3, e) for s, e, encoding, size, p in candidates(text or "", known, model)
            if _bin(p) >= level.get((encoding, size), BINS)
        ]
        out, at = [], 0
        for start, _, end in sorted(spans):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return text if not spans else "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([cleaned(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), new], names=["_row", "_text"])

    kind = packed.schema["_row"].dataType.simpleString()
    done = packed.mapInArrow(run, f"_row {kind}, _text string")
    columns = {c: F.col(f"_row.`{c}`") for c in own}
    columns[text_col] = F.col("_text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(
            F.col("_text").eqNullSafe(F.col(f"_row.`{text_col}`")), columns["n_chars"]
        ).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[c.alias(name) for name, c in columns.items()])
