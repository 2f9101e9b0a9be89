"""Re-Pair grammar compression of id sequences, in numpy.

Each round counts all adjacent pairs, gives the most frequent ones a nonterminal each, and replaces their occurrences
from left to right without overlap, until no pair is frequent.  A block keeps its rules, the expansion length of each
rule, and the remaining symbols, so any range of ids can be decoded alone: a running sum of expansion lengths leads to
the symbols that cover it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Ids of a block at most, besides the rest of a document.
BLOCK_IDS = 1 << 20
#: Rounds go on until no pair is frequent; a text of repeats gets so many at least.
ROUNDS = 5
#: New rules of a round at most, and how often a pair must occur to get one.
RULES = 4096
LEAST = 24
_BUCKETS = 20


class Block(NamedTuple):
    base: int  # the first nonterminal
    rules: np.ndarray  # uint32, two symbols each
    lengths: np.ndarray  # uint32, ids that a rule expands to
    symbols: np.ndarray  # uint32


def _bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) ^ (right * np.uint32(0x85EBCA77) + np.uint32(1))) >> np.uint32(32 - _BUCKETS)


def _frequent(symbols: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs, as (left, right) rows; positions that hold one; which one each holds; all frequent positions.

    Only the open positions are looked at.  Counts by hash bucket are upper bounds and only sort out what cannot be
    frequent; the rest is counted exactly.
    """
    whole = len(open_) == len(symbols) - 1
    left, right = (symbols[:-1], symbols[1:]) if whole else (symbols[open_], symbols[open_ + 1])
    bucket = _bucket(left, right)
    may = np.flatnonzero(np.bincount(bucket, minlength=1 << _BUCKETS)[bucket] >= LEAST)
    codes = (left[may].astype(np.uint64) << np.uint64(32)) | right[may]
    kinds = np.sort(codes)
    starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(kinds)))
    often = counts >= LEAST
    kinds, counts = kinds[starts[often]], counts[often]
    if not len(kinds):
        return np.empty((0, 2), np.uint32), open_[:0], open_[:0], open_[:0]
    # a bucket leads to one of its frequent pairs; the few others are searched for
    table = np.full(1 << _BUCKETS, -1, np.int32)
    table[_bucket((kinds >> np.uint64(32)).astype(np.uint32), kinds.astype(np.uint32))] = np.arange(len(kinds))
    of = table[bucket[may]]
    other = np.flatnonzero(kinds[of] != codes)
    of[other] = np.minimum(np.searchsorted(kinds, codes[other]), len(kinds) - 1)
    hit = kinds[of] == codes
    at, of = may[hit] if whole else open_[may[hit]], of[hit]
    taken, which = at, of
    if len(kinds) > RULES:
        top = np.sort(np.argsort(-counts, kind="stable")[:RULES])
        number = np.full(len(counts), -1, np.int32)
        number[top] = np.arange(RULES)
        kinds = kinds[top]
        which = number[of]
        chosen = which >= 0
        taken, which = at[chosen], which[chosen]
    pairs = np.stack([kinds >> np.uint64(32), kinds & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
    return pairs, taken, which, at


def _apart(at: np.ndarray) -> np.ndarray:
    """Which positions to take, every other one of each run of neighbours, so that no two pairs overlap."""
    places = np.arange(len(at), dtype=np.int32)
    start = places.copy()
    start[1:][np.diff(at) == 1] = 0
    np.maximum.accumulate(start, out=start)
    return np.flatnonzero(((places - start) & 1) == 0)


def compress(ids: np.ndarray, base: int) -> Block:
    """ids are below base."""
    symbols = np.array(ids, dtype=np.uint32)
    rules: list[np.ndarray] = []
    known = np.ones(base, np.uint32)
    made = 0
    # a pair that was seldom in one round can only be seldomer in the next, so only frequent ones and those with a new
    # symbol stay open
    open_ = np.arange(max(0, len(symbols) - 1))
    while True:
        pairs, at, which, frequent = _frequent(symbols, open_)
        if not len(pairs):
            break
        apart = _apart(at)
        keep = at[apart]
        symbols[keep] = (base + made + which[apart]).astype(np.uint32)
        live = np.zeros(len(symbols) + 1, bool)
        live[frequent] = True
        live[keep] = True
        stays = np.ones(len(symbols), bool)
        stays[keep + 1] = False
        symbols, live = symbols[stays], live[:-1][stays]
        live[:-1] |= symbols[1:] >= base + made
        open_ = np.flatnonzero(live[:-1])
        known = np.concatenate([known, known[pairs[:, 0]] + known[pairs[:, 1]]])
        rules.append(pairs)
        made += len(pairs)
    lengths = known[base:]
    return Block(base, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), lengths, symbols)


class Decoder:
    """Expands a block, or any range of its ids."""

    def __init__(self, block: Block):
        self.symbols = block.symbols
        base, rules = block.base, block.rules.astype(np.int64)
        size = np.concatenate([np.ones(base, np.int64), block.lengths.astype(np.int64)])
        self.size = size
        self.at = np.concatenate([[0], np.cumsum(size)[:-1]])
        table = np.empty(int(size.sum()), np.uint32)
        table[:base] = np.arange(base)
        # a rule's parts are shorter than the rule, so rules of one length can be filled in at once
        for n in np.unique(block.lengths):
            of = np.flatnonzero(block.lengths == n)
            for part, shift in ((rules[of, 0], np.zeros(len(of), np.int64)), (rules[of, 1], size[rules[of, 0]])):
                table[self._places(self.at[base + of] + shift, size[part])] = table[self._places(self.at[part], size[part])]
        self.table = table

    @staticmethod
    def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All indices of the ranges that begin at starts."""
        before = np.cumsum(sizes) - sizes
        return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.table[self._places(self.at[symbols], self.size[symbols])]

    def whole(self) -> np.ndarray:
        return self._expand(self.symbols)

    def between(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop, from the symbols that cover them alone."""
        ends = np.cumsum(self.size[self.symbols])
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skipped = int(ends[first - 1]) if first else 0
        return self._expand(self.symbols[first:last])[start - skipped : stop - skipped]
