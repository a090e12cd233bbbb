"""Simple-8b word-aligned coding of whole numbers of 32 bits, in blocks.

A 64-bit word is a 4-bit selector and 60 bits of equal slots; the selector says how many ids it holds. An id that
does not fit its slot may be escaped: the slot is all ones and the id stands in the block's escape list. From
each position the selector with the fewest bits an id wins, escapes counted, ties to the longer run.

Every document is cut into blocks of BLOCK ids; a block begins with a word of its own, so the words and escapes of
a block are found by offsets and any set of blocks is decoded without the others. Both ways work on all
blocks at once: encoders walk them in step, decoders take all words of one selector together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Ids in a word and bits of a slot, by selector (Simple-8b).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
SLOT_BITS = 60
ESCAPE_BITS = 32
BLOCK = 240


@dataclass(frozen=True)
class Blocks:
    """Encoded blocks: ids in each, n + 1 offsets into the words and into the escapes."""

    sizes: np.ndarray
    word_at: np.ndarray
    escape_at: np.ndarray
    words: np.ndarray
    escapes: np.ndarray


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def block_sizes(counts: np.ndarray) -> np.ndarray:
    """Ids in each block of documents of ``counts`` ids."""
    counts = np.asarray(counts, np.int64)
    blocks = -(-counts // BLOCK)
    sizes = np.full(int(blocks.sum()), BLOCK, np.int64)
    ends = np.cumsum(blocks)[blocks > 0] - 1
    left = counts[blocks > 0] % BLOCK
    sizes[ends] = np.where(left, left, BLOCK)
    return sizes


class _Costs:
    """Chooses selectors: for each width, how many ids up to a position would need an escape."""

    def __init__(self, ids: np.ndarray):
        self.large = []
        for s in range(15):
            width = int(WIDTHS[s])
            count = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(ids >= (1 << width) - 1 if width else ids > 0, out=count[1:], dtype=np.int32)
            self.large.append(count)

    def choose(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The selector at each position, where its block has ``left`` ids left."""
        best, least = np.full(len(at), 15, np.uint8), np.full(len(at), SLOT_BITS + 4.0, np.float32)
        for s in range(14, -1, -1):
            held = np.minimum(left, COUNTS[s])
            escaped = self.large[s][at + held] - self.large[s][at]
            cost = (ESCAPE_BITS * escaped + np.float32(SLOT_BITS + 4)) / held.astype(np.float32)
            better = cost <= least
            if not WIDTHS[s]:
                better &= escaped == 0  # no slots, hence nothing that could mark an escape
            best[better] = s
            np.copyto(least, cost, where=better)
        return best


def encode(ids: np.ndarray, counts: np.ndarray) -> Blocks:
    """Blocks of documents that have ``counts`` of the ``ids``, one after the other."""
    sizes = block_sizes(counts)
    begin = offsets(sizes)
    ids = np.asarray(ids, np.uint64)
    if not len(sizes):
        none = np.zeros(0, np.int64)
        return Blocks(sizes, offsets(none), offsets(none), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    costs = _Costs(ids)
    # All blocks walk in step: one word of each block that has ids left.
    at, block = begin[:-1].copy(), np.arange(len(sizes))
    starts, owners, chosen = [], [], []
    while len(at):
        picked = costs.choose(at, begin[block + 1] - at)
        starts.append(at)
        owners.append(block)
        chosen.append(picked)
        at = at + COUNTS[picked]
        more = at < begin[block + 1]
        at, block = at[more], block[more]
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    selector = np.concatenate(chosen)[order].astype(np.int64)
    held = np.minimum(COUNTS[selector], begin[owner + 1] - start)
    words = selector.astype(np.uint64) << np.uint64(SLOT_BITS)
    escape_place, escape_id = [], []
    for s in range(16):
        width = int(WIDTHS[s])
        which = np.flatnonzero(selector == s)
        if not width or not len(which):
            continue
        full = np.uint64((1 << width) - 1)
        value = words[which]
        for k in range(int(COUNTS[s])):
            has = np.flatnonzero(held[which] > k)
            if not len(has):
                break
            place = start[which[has]] + k
            slot = ids[place]
            if s < 15:
                out = slot >= full
                escape_place.append(place[out])
                escape_id.append(slot[out])
                slot = np.where(out, full, slot)
            value[has] |= slot << np.uint64(k * width)
        words[which] = value
    place = np.concatenate([*escape_place, np.zeros(0, np.int64)])
    escaped = np.concatenate([*escape_id, np.zeros(0, np.uint64)])
    order = np.argsort(place, kind="stable")
    return Blocks(
        sizes, offsets(np.bincount(owner, minlength=len(sizes))),
        np.searchsorted(place[order], begin).astype(np.int64), words, escaped[order].astype(np.uint32),
    )


def decode(blocks: Blocks, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` .. ``last`` - 1, one after the other, without touching other blocks' words."""
    last = len(blocks.sizes) if last is None else last
    sizes = blocks.sizes[first:last]
    begin = offsets(sizes)
    words = blocks.words[blocks.word_at[first] : blocks.word_at[last]]
    owner = np.repeat(np.arange(len(sizes)), np.diff(blocks.word_at[first : last + 1]))
    selector = (words >> np.uint64(SLOT_BITS)).astype(np.int64)
    count = COUNTS[selector]
    # Where each word's ids begin: counts before it in its block; only a block's last word is not full.
    before = offsets(count)[:-1]
    first_word = blocks.word_at[first:last] - blocks.word_at[first]
    start = begin[:-1][owner] + before - before[first_word][owner] if len(words) else np.zeros(0, np.int64)
    held = np.minimum(count, begin[1:][owner] - start) if len(words) else count
    out, marked = np.zeros(int(begin[-1]), np.uint32), np.zeros(int(begin[-1]), bool)
    for s in range(16):
        width = int(WIDTHS[s])
        which = np.flatnonzero(selector == s)
        if not width or not len(which):
            continue
        full = np.uint64((1 << width) - 1)
        k = np.arange(COUNTS[s])
        slots = (words[which][:, None] >> (k * width).astype(np.uint64)) & full
        there = k < held[which][:, None]
        place, value = (start[which][:, None] + k)[there], slots[there]
        out[place] = value.astype(np.uint32)
        if s < 15:
            marked[place] = value == full
    out[marked] = blocks.escapes[blocks.escape_at[first] : blocks.escape_at[last]]
    return out
