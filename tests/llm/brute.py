"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def windows_removed(docs, window=35):
    """(n_words, n_removed, kept text) of each text."""
    all_words = [words(t) for t in docs]
    seen = Counter(
        tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1)
    )
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def lines_removed(docs, t=3):
    """(n_lines, n_removed, kept text) of ``docs``: (id, text), in the order of ids."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        lines = (text or "").split("\n")
        worded = [k for k, line in enumerate(lines) if WORD.search(line)]
        gone, own = set(), []
        for i in range(len(worded) - t + 1):
            run = tuple(lines[k] for k in worded[i : i + t])
            if run in seen:
                gone |= set(worded[i : i + t])
            seen.add(run)
        out[doc] = (len(worded), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def simhash(text, shingle=3):
    ascii_lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = words((text or "").translate(ascii_lower))
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, bits=3):
    """Smallest index reachable from each fingerprint."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def repeat_words(text, k=3):
    w = words(text)
    grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    n = Counter(grams)
    return len({i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(k)})


def base_secrets(text):
    """(kind, start, end) as the contract states them."""
    text = text or ""
    spans = []
    assign = (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
        r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    kinds = [("assign", assign, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                spans.append((m.start(), rank, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(spans)]


def groups(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
