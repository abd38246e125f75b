"""Periodic runs of words: dyadic blocks look for themselves in the window after them, through a suffix array under a wavelet tree."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_bytes, with_batches

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that are worked on at a time: texts are put together up to it, a longer text is alone.
BLOCK_WORDS = 1 << 17


class FactorRanks:
    """Equal stretches of 1, 2, 4, ... words of one text have equal ranks: prefix doubling over many texts at a time.

    A stretch's rank is the place of the first suffix that begins with it, so
    the suffixes that do are the slots [rank, rank + size) of the suffix
    array. Levels stop when all suffixes differ. Memory: 4 bytes a word and level.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray):
        """ids: word numbers of all texts, one after another; starts: where each text begins, and the end."""
        n = len(ids)
        lengths = np.diff(starts)
        self.begin = np.repeat(starts[:-1], lengths)
        self.end = np.repeat(starts[1:], lengths)
        key = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order], alone = self._number(key[order], np.arange(n))
        self.levels, self.array = [rank], order
        active, span = order[~alone], 1
        while len(active):
            after = active.astype(np.int64) + span
            second = np.where(after < self.end[active], rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            key = rank[active].astype(np.int64) * (n + 1) + second
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            # The groups of one rank fill its slots; active suffixes are in the order of their slots.
            old = rank[active]
            slots = old + (np.arange(len(active)) - np.searchsorted(old, old))
            rank = rank.copy()
            rank[active], alone = self._number(key, slots)
            self.array[slots] = active
            self.levels.append(rank)
            active, span = active[~alone], span * 2

    @staticmethod
    def _number(key: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: the slot of each one's first equal, and whether it has no other equal."""
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(key)))
        return np.repeat(slots[first], sizes), np.repeat(sizes == 1, sizes)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from a and from b (> a) on, within the text."""
        a, b, n = a.copy(), b.copy(), len(self.end)
        start, end = a.copy(), self.end[a]
        for level in reversed(range(len(self.levels))):
            rank = self.levels[level]
            same = (b < end) & (rank[a] == rank[np.minimum(b, n - 1)])
            a, b = a + (same << level), b + (same << level)
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words before a and before b (> a), within the text."""
        a, b = a.copy(), b.copy()
        start, begin = a.copy(), self.begin[a]
        for level in reversed(range(len(self.levels))):
            rank, wide = self.levels[level], 1 << level
            same = a - wide >= begin
            same &= rank[np.maximum(a - wide, 0)] == rank[np.maximum(b - wide, 0)]
            a, b = a - (same << level), b - (same << level)
        return start - a


class SuccessorTree:
    """Wavelet tree (as a matrix) of a sequence of numbers: smallest numbers from a bound on within ranges of places, many ranges at a time."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, now = [], values
        for level in reversed(range(self.bits)):
            low = (now >> level) & 1 == 0
            upto = np.zeros(len(now) + 1, np.int32)
            np.cumsum(low, out=upto[1:])
            self.zeros.append(upto)
            now = np.concatenate([now[low], now[~low]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Numbers under the bound in places [left, right)."""
        count = np.zeros(len(left), np.int64)
        over = bound >> self.bits > 0
        count[over] = (right - left)[over]
        bound = np.where(over, 0, bound)
        for i, upto in enumerate(self.zeros):
            a, b = upto[left], upto[right]
            one = (bound >> (self.bits - 1 - i)) & 1 == 1
            count += np.where(one, b - a, 0)
            left, right = np.where(one, upto[-1] + left - a, a), np.where(one, upto[-1] + right - b, b)
        return count

    def nth(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The nth smallest number (from 0) in places [left, right)."""
        value = np.zeros(len(left), np.int64)
        for upto in self.zeros:
            a, b = upto[left], upto[right]
            one = n >= b - a
            n = np.where(one, n - (b - a), n)
            value = value << 1 | one
            left, right = np.where(one, upto[-1] + left - a, a), np.where(one, upto[-1] + right - b, b)
        return value


def block_periods(block: int) -> tuple[int, int]:
    """Least and greatest period of the runs that blocks of so many words find.

    A run of period q has 4q words or more. An aligned block of B words lies
    within its first 2B - 1, and the next occurrence, q words on, still in the
    run, if 2B - 1 + q <= 4q; of the B for which that holds the greatest is
    taken. Blocks of two words also find period 1 (runs of six words).
    """
    return 1 if block == 2 else (2 * block + 1) // 3, (4 * block - 2) // 3


def find_runs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run in all texts, by start and then period; places count over all texts."""
    none = np.zeros(0, np.int64)
    ranks = FactorRanks(ids, starts)
    if len(ranks.levels) < 2:
        return none, none, none
    tree = SuccessorTree(ranks.array)
    found = []
    for level in range(1, len(ranks.levels)):
        block = 1 << level
        low, high = block_periods(block)
        rank = ranks.levels[level]
        # Aligned within each text; a block that occurs once there has no other place to look for.
        sizes = np.bincount(rank, minlength=len(rank))
        at = np.flatnonzero((sizes[rank] > 1) & ((np.arange(len(rank)) - ranks.begin) % block == 0)).astype(np.int64)
        if not len(at):
            continue
        left = rank[at].astype(np.int64)
        right = left + sizes[left]
        before = tree.below(left, right, at + low)
        many = tree.below(left, right, at + high + 1) - before
        hit = many > 0
        at, left, right, before, many = at[hit], left[hit], right[hit], before[hit], many[hit]
        first = tree.nth(left, right, before)
        found += [(at, first - at)]
        two = many > 1
        second = tree.nth(left[two], right[two], before[two] + 1)
        found += [(at[two & (many == 2)], (second - at[two])[many[two] == 2])]
        # Three or more occurrences are a progression whose step is the block's own period. A run's period then shifts the
        # block's maximal stretch of that step onto the occurrence's, so one of their ends gives it; the same stretch gives none.
        far = many[two] > 2
        p, o = at[two][far], first[two][far]
        step = second[far] - o
        if len(p):
            s, e = p - ranks.backward(p, p + step), p + step + ranks.forward(p, p + step)
            s2, e2 = o - ranks.backward(o, o + step), o + step + ranks.forward(o, o + step)
            last = o + (many[two][far] - 1) * step
            for d in (s2 - s, e2 - e):
                ok = (s2 != s) & (p + d >= o) & (p + d <= last) & ((p + d - o) % step == 0)
                found.append((p[ok], d[ok]))
    p, d = (np.concatenate(x) if found else none for x in zip(*found, strict=True)) if found else (none, none)
    if not len(p):
        return none, none, none
    start, end = p - ranks.backward(p, p + d), p + d + ranks.forward(p, p + d)
    long = end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * d)
    start, end, d = start[long], end[long], d[long]
    by = np.lexsort((d, end, start))
    start, end, d = start[by], end[by], d[by]
    # The same stretch under several periods: they are multiples of the smallest.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, d = start[new], end[new], d[new]
    by = np.lexsort((d, start))
    return start[by], end[by], d[by]


def _work(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text's words: its runs as (start, length, period), and the words that stay."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(starts[-1]))
    start, end, period = find_runs(ids, starts)
    owner = np.searchsorted(starts, start, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, t in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            yield [], b" ".join(t)
            continue
        s, e, d = start[a:b] - starts[i], end[a:b] - starts[i], period[a:b]
        cover = np.zeros(len(t) + 1, np.int64)
        np.add.at(cover, s + d, 1)
        np.add.at(cover, e, -1)
        stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
        yield list(zip(s.tolist(), (e - s).tolist(), d.tolist(), strict=True)), b" ".join([t[k] for k in stay.tolist()])


def collapse_runs(docs: DataFrame, text: str = "text", into: str = "collapsed") -> DataFrame:
    """docs with `n_words`, `runs` (array of start, length, period in words) and `into`, the text without the repeats.

    Words are what stands between the six ASCII blanks. A run is a stretch of
    consecutive words with smallest period q (words q apart are the same) that
    no neighbour extends, of at least six words and four periods; runs come by
    start and then period. `into` holds the words that no run contains after
    that run's first q words, joined by one space.

    Each aligned block of 2, 4, 8, ... words asks a wavelet tree over its
    text's suffix array for its next occurrences in the window behind it; they
    are one progression, whose terms are candidate periods, and each candidate
    is extended both ways over the ranks of equal stretches. Work is
    n log n for a text of n words, whatever repeats in it.

    Null and empty texts have no words, no run and an empty collapsed text;
    a text is worked on whole, however long, within one row; rows that repeat
    are worked on each; an empty table gives an empty one. Columns named like
    an added one (in any case) are replaced; all others pass through. Nothing
    is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            counts, runs, kept, waiting, words = [], [], [], [], 0

            def flush() -> None:
                for found, rest in _work(waiting):
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    kept.append(rest)
                waiting.clear()

            for x in text_bytes(b.column(0)):
                t = x.split()  # of bytes: exactly the six ASCII blanks
                counts.append(len(t))
                if waiting and words + len(t) > BLOCK_WORDS:
                    flush()
                    words = 0
                waiting.append(t)
                words += len(t)
            flush()
            yield [pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())]

    return with_batches(docs, run, [("n_words", "long"), ("runs", "array<struct<start:long,length:long,period:long>>"), (into, "string")], [text])
