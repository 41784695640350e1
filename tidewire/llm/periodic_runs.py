"""Runs (maximal repetitions) of words in a text, as maximal pairs at a bounded distance.

Suffixes of a text are sorted by doubling, neighbours get their longest common prefix (LCP), and
the LCP-interval tree is walked bottom up. Each interval holds its positions in one list per word
to their left. When two children meet, each position of the smaller child looks up the other
child's positions at most one LCP away whose left word differs from its own: such a pair (i, j) of
positions is a maximal pair, neither side of it can be extended, so words i to j + LCP have
period j - i and no neighbour extends them. With 2 (j - i) and the least length reached, that is a
run as it stands. Pairs with multiples of the period end up at the same stretch, the smallest wins.
Blocks of equal left words let a look-up pass over positions that would give no pair, so its time
is that of the pairs it finds.

Pairs need six words in common, so positions whose next six words occur once in the text are left
out from the start.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.text import map_batches, raw_text, split_words

LEAST_LENGTH = 12
# Words that are numbered and sorted together, from one text or many.
BATCH_WORDS = 1 << 18
# Up to this many positions an interval's positions are compared one by one.
FEW = 8


def _named(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0, in the order of the keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeated_grams(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, repeated): a number for the next ``least`` words of each position, by sort order.

    ``ends`` has the end of each position's text; grams of different texts have different numbers,
    and so have those cut short by the end of a text. ``repeated`` marks grams that occur more
    than once.
    """
    n = len(words)
    place = np.arange(n)

    def shifted(names: np.ndarray, by: int) -> np.ndarray:
        """The name ``by`` words on, from 1; 0 beyond the end of the text."""
        out = np.zeros(n, dtype=np.int64)
        if by < n:
            out[: n - by] = names[by:] + 1
        out[place + by >= ends] = 0
        return out

    # The end of a text tells it from all others.
    gram = _named(ends * (int(words.max()) + 2) + words)
    have = 1
    while have < least:
        step = min(have, least - have)
        gram = _named(gram * (n + 2) + shifted(gram, step))
        have += step
    return gram, np.bincount(gram)[gram] > 1


def sorted_suffixes(gram: np.ndarray, ends: np.ndarray, at: np.ndarray, have: int) -> np.ndarray:
    """The positions ``at`` in the order of their suffixes, by doubling from prefixes of ``have`` words.

    Only positions whose prefix still ties take part in a step.
    """
    rank = gram.copy()
    # Ranks leave room: a group of m equal prefixes owns m numbers from its own on.
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
    starts = np.repeat(first, np.diff(np.r_[first, len(order)]))
    rank[order] = starts
    open_ = at
    while len(open_):
        onward = open_ + have
        beyond = onward >= ends[open_]
        after = np.where(beyond, -1, rank[np.minimum(onward, len(rank) - 1)])
        by = np.lexsort((after, rank[open_]))
        open_, after, group = open_[by], after[by], rank[open_[by]]
        new_group = np.r_[True, group[1:] != group[:-1]]
        differs = new_group | np.r_[True, after[1:] != after[:-1]]
        spot = np.arange(len(open_))
        base = np.maximum.accumulate(np.where(new_group, spot, 0))
        start = np.maximum.accumulate(np.where(differs, spot, 0))
        rank[open_] = group + (start - base)
        size = np.diff(np.r_[np.flatnonzero(differs), len(open_)])
        open_ = open_[np.repeat(size, size) > 1]
        have *= 2
    return at[np.argsort(rank[at], kind="stable")]


def common_prefixes(words: list[int], end: int, order: list[int], chosen: set[int], least: int) -> list[int]:
    """LCP of each suffix in ``order`` with the one before it; 0 for the first and where below ``least``.

    ``order`` are sorted positions of one text that ends at ``end``. Positions are visited as they
    stand in the text, so a prefix is at most one word shorter than that of the position before.
    """
    spot = {p: i for i, p in enumerate(order)}
    lcp = [0] * len(order)
    h, last = 0, -2
    for p in sorted(chosen):
        i = spot[p]
        # With fewer than ``least`` words left over, the neighbour need not be among the chosen.
        h = h - 1 if p == last + 1 and h > least else 0
        last = p
        if not i:
            h = 0
            continue
        q = order[i - 1]
        stop = end - max(p, q)
        while h < stop and words[p + h] == words[q + h]:
            h += 1
        lcp[i] = h if h >= least else 0
    return lcp


class Classes:
    """Positions of an interval: a sorted list per left word, and where blocks of one left word start."""

    def __init__(self, places: Sequence[int], left: Sequence[int]):
        self.size = 0
        self.left = left
        self.lists: dict[int, list[int]] = {}
        self.blocks: list[int] = []
        for place in sorted(places):
            self.add(place)

    def places(self) -> list[int]:
        return [p for places in self.lists.values() for p in places]

    def add(self, place: int) -> None:
        left, blocks, word = self.left, self.blocks, self.left[place]
        at = bisect_right(blocks, place) - 1
        if at >= 0 and left[blocks[at]] == word:
            pass
        else:
            after = None
            if at >= 0:
                same = self.lists[left[blocks[at]]]
                nearest = bisect_right(same, place)
                if nearest < len(same) and (at + 1 == len(blocks) or same[nearest] < blocks[at + 1]):
                    after = same[nearest]
            if after is not None:
                blocks[at + 1 : at + 1] = [place, after]
            elif at + 1 < len(blocks) and left[blocks[at + 1]] == word:
                blocks[at + 1] = place
            else:
                blocks.insert(at + 1, place)
        insort(self.lists.setdefault(word, []), place)
        self.size += 1

    def others_near(self, place: int, reach: int) -> list[int]:
        """Positions at most ``reach`` away with another left word than ``place``'s."""
        low, high, word = place - reach, place + reach, self.left[place]
        blocks = self.blocks
        at = max(bisect_right(blocks, low) - 1, 0)
        found: list[int] = []
        while at < len(blocks) and blocks[at] <= high:
            other = self.left[blocks[at]]
            if other != word:
                same = self.lists[other]
                stop = min(blocks[at + 1] - 1, high) if at + 1 < len(blocks) else high
                found += same[bisect_left(same, max(blocks[at], low)) : bisect_right(same, stop)]
            at += 1
        return found


def maximal_pairs(order: list[int], lcp: list[int], left: Sequence[int], least: int, found: dict[tuple[int, int], int]) -> None:
    """Add to ``found`` the (start, end) -> smallest period of all runs of one text.

    ``order`` and ``lcp`` are its sorted suffixes, ``left`` the word before each position (of its
    own for the first), ``least`` the least length of a run.
    """

    def tell(i: int, j: int, common: int) -> None:
        start, period = (i, j - i) if i < j else (j, i - j)
        if period <= common and period + common >= least:
            stretch = (start, start + period + common)
            if period < found.get(stretch, period + 1):
                found[stretch] = period

    def joined(a, b, common: int):
        """Two children as one interval; lists up to FEW positions, Classes beyond."""
        if (a.size if isinstance(a, Classes) else len(a)) < (b.size if isinstance(b, Classes) else len(b)):
            a, b = b, a
        if isinstance(a, list):
            for i in b:
                for j in a:
                    if left[i] != left[j]:
                        tell(i, j, common)
            both = a + b
            return Classes(both, left) if len(both) > FEW else both
        small = b if isinstance(b, list) else b.places()
        for i in small:
            for j in a.others_near(i, common):
                tell(i, j, common)
        for i in small:
            a.add(i)
        return a

    stack: list[list] = []
    for place, common in zip(order, [*lcp[1:], 0], strict=True):
        current = [place]
        while stack and stack[-1][0] > common:
            level, held = stack.pop()
            current = joined(held, current, level)
        if common:
            if stack and stack[-1][0] == common:
                stack[-1][1] = joined(stack[-1][1], current, common)
            else:
                stack.append([common, current])


def runs_of(texts: Sequence[np.ndarray], least: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period.

    Texts are arrays of word numbers that stand for the same words throughout. Positions of all
    texts are sorted together, each text on its own.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return out
    shared = -(-least // 2)
    words = np.concatenate(texts).astype(np.int64)
    stops = np.cumsum(sizes)
    ends = np.repeat(stops, sizes)
    gram, repeated = repeated_grams(words, ends, shared)
    at = np.flatnonzero(repeated)
    if not len(at):
        return out
    order = sorted_suffixes(gram, ends, at, shared)
    number = np.searchsorted(stops, order, side="right")
    by = np.argsort(number, kind="stable")
    order, number = order[by], number[by]
    for t in np.unique(number):
        low, high = np.searchsorted(number, [t, t + 1])
        start = int(stops[t] - sizes[t])
        mine = (order[low:high] - start).tolist()
        own = words[start : stops[t]].tolist()
        lcp = common_prefixes(own, len(own), mine, set(mine), shared)
        left = [-1, *own]
        stretches: dict[tuple[int, int], int] = {}
        maximal_pairs(mine, lcp, left, least, stretches)
        out[t] = sorted((s, e - s, q) for (s, e), q in stretches.items())
        out[t].sort(key=lambda r: (r[0], r[2]))
    return out


def planted(words: list, mark: int) -> list:
    """The contract's change of a text: one in ten becomes periodic from a word on."""
    n, g = len(words), mark // 10
    if mark % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def as_is(words: list, mark: int) -> list:
    return words


def detect(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_LENGTH,
    change=as_is,
) -> DataFrame:
    """One row per row of ``docs``: id, n_runs, the longest run, runs, collapsed text's digest.

    A run is a stretch of consecutive words with smallest period q and length of at least
    ``least`` and 2 q that no neighbouring word extends. ``start``, ``length``, ``period`` and
    ``exponent_milli`` are of the longest (ties: smallest start, then period), NULL without runs.
    ``runs_sha256`` is the digest of all runs as lines, ``collapsed_sha256`` that of the words
    that no run holds after its first q words. ``change`` may rewrite the list of words by the
    crc32 of the id (a NULL id counts as the empty text). NULL text has no words, like an empty
    one: no runs, digests of the empty text. Repeated rows and ids each give their row, an empty
    table an empty result; texts of any length are taken whole, in memory that grows with the
    longest. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def step(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in _COLUMNS}
        numbers: dict[bytes, int] = {}
        group: list[tuple[list[bytes], np.ndarray]] = []
        held = 0

        def flush() -> None:
            for (words, _), runs in zip(group, runs_of([ids for _, ids in group], least), strict=True):
                _describe(out, words, runs)
            group.clear()
            numbers.clear()

        for key, text in zip(cols["id"], cols["text"], strict=True):
            mark = zlib.crc32(b"" if key is None else str(key).encode())
            words = change(split_words(text), mark)
            if held and held + len(words) > BATCH_WORDS:
                flush()
                held = 0
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            group.append((words, ids))
            held += len(words)
        flush()
        return {"id": cols["id"], **out}

    schema = f"id {id_type}, " + ", ".join(f"{name} {kind}" for name, kind in _COLUMNS.items())
    return map_batches(rows, step, schema)


def _describe(out: dict[str, list], words: list[bytes], runs: list[tuple[int, int, int]]) -> None:
    lines = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode())
    if runs:
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        dropped = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in runs:
            dropped[s + q] += 1
            dropped[s + n] -= 1
        kept = np.flatnonzero(np.cumsum(dropped)[:-1] == 0)
        told = (start, length, period, 1000 * length // period)
        words = [words[i] for i in kept.tolist()]
    else:
        told = (None, None, None, None)
    out["n_runs"].append(len(runs))
    for name, value in zip(("start", "length", "period", "exponent_milli"), told, strict=True):
        out[name].append(value)
    out["runs_sha256"].append(lines.hexdigest())
    out["collapsed_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())


_COLUMNS = {
    "n_runs": "long",
    "start": "long",
    "length": "long",
    "period": "long",
    "exponent_milli": "long",
    "runs_sha256": "string",
    "collapsed_sha256": "string",
}
