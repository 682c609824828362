"""Recompression of word sequences: rounds that name runs of equal symbols, then pairs of neighbours.

A round replaces each maximal run of one symbol by a new symbol, then puts each symbol of a left
class together with a following one of the right class. The class of a symbol and the name of a new
one are digests of names alone, so all tasks on all machines give equal sequences equal names
without a common dictionary: away from the ends of a repeated passage its symbols agree on every level.

Sequences lie one after the other in one array of 64-bit names. `fixed` marks separators, which
never join anything; one stands before the first sequence and one after each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from . import textbatch as tb

_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Fixed: words are [^\x20\x09-\x0D]+.
WORD = tb.class_table((0x00, 0x08), (0x0E, 0x1F), (0x21, tb.POINTS - 1))


@dataclass
class Sequences:
    """Words of several texts as names, with separators; text t is names[first[t]:last[t]]."""

    names: np.ndarray
    fixed: np.ndarray
    first: np.ndarray
    last: np.ndarray


def word_names(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The name of each word of the texts, and words per text."""
    points = tb.Points(texts)
    starts, ends, owner = points.runs(WORD)
    return tb.span_hashes(points.points, starts, ends), np.bincount(owner, minlength=len(texts)).astype(np.int64)


def separated(words: np.ndarray, counts: np.ndarray) -> Sequences:
    """The words of texts, `counts` of them each, with separators between the texts."""
    stops = np.cumsum(counts)
    last = stops + np.arange(1, len(counts) + 1)
    first = last - counts
    names = np.empty(len(words) + len(counts) + 1, np.uint64)
    fixed = np.zeros(len(names), bool)
    fixed[0] = True
    fixed[last] = True
    names[~fixed] = words
    # Any names do, if no two are equal.
    names[fixed] = tb.mix(np.arange(len(counts) + 1, dtype=np.uint64) + np.uint64(1 << 63))
    return Sequences(names, fixed, first, last)


def _digest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tb.mix(tb.mix(a) * _ODD + b)


@dataclass
class Grouping:
    """One round's step: the new symbols, the first old one of each and how many they hold."""

    names: np.ndarray
    fixed: np.ndarray
    heads: np.ndarray
    sizes: np.ndarray


def runs(names: np.ndarray, fixed: np.ndarray) -> Grouping:
    """Each maximal run of one symbol becomes a symbol; a run of one keeps its name."""
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(heads, append=len(names))
    out = names[heads]
    many = np.flatnonzero(sizes > 1)
    out[many] = _digest(out[many], sizes[many].astype(np.uint64))
    return Grouping(out, fixed[heads], heads, sizes)


def right_class(names: np.ndarray, fixed: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols pair with the next and which with the one before; separators do neither."""
    side = (tb.mix(names + np.uint64(level + 1)) >> np.uint64(17)).astype(np.uint8) & 1
    return (side == 0) & ~fixed, (side == 1) & ~fixed


def pairs(names: np.ndarray, left: np.ndarray, right: np.ndarray, fixed: np.ndarray) -> Grouping:
    """Each symbol of the left class and one of the right class after it become a symbol."""
    joined = left[:-1] & right[1:]
    heads = np.flatnonzero(np.concatenate([[True], ~joined]))
    sizes = np.diff(heads, append=len(names))
    out = names[heads]
    two = np.flatnonzero(sizes > 1)
    out[two] = _digest(out[two] + _ODD, names[heads[two] + 1])
    return Grouping(out, fixed[heads], heads, sizes)


class Grammar:
    """All levels of a run-length grammar over sequences, from words up to one symbol a sequence.

    `names[k]` are the symbols of level k, `starts[k]` the words they begin at, `heads[k]` the first
    child on level k - 1 of each, and `parents[k]` the symbol on level k + 1 that holds each.
    """

    def __init__(self, names: list, starts: list, heads: list, parents: list, words: int):
        self.names, self.starts, self.heads, self.parents, self.words = names, starts, heads, parents, words

    @classmethod
    def of(cls, seqs: Sequences) -> Grammar:
        n = len(seqs.names)
        names, starts, heads, parents = [seqs.names], [np.arange(n)], [None], []
        fixed, level = seqs.fixed, 0
        while int((~fixed).sum()) > 0:
            before = len(names[-1])
            for step in (runs, pairs):
                at = names[-1]
                made = step(at, fixed) if step is runs else step(at, *right_class(at, fixed, level), fixed)
                if len(made.names) == len(at):
                    continue
                fixed = made.fixed
                parents.append(np.repeat(np.arange(len(made.heads)), made.sizes))
                names.append(made.names)
                heads.append(made.heads)
                starts.append(starts[-1][made.heads])
            level += 1
            # Two neighbours, neither of them a separator, go on.
            if len(names[-1]) == before and not np.any(~fixed[1:] & ~fixed[:-1]):
                break
        return cls(names, starts, heads, parents, n)

    def mirrored(self) -> Grammar:
        """The same grammar read backwards."""
        names = [x[::-1] for x in self.names]
        starts, heads, parents = [], [None], []
        for k, s in enumerate(self.starts):
            ends = np.append(s[1:], self.words)
            starts.append(self.words - ends[::-1])
            if k:
                size = len(self.names[k - 1])
                stops = np.append(self.heads[k][1:], size)
                heads.append(size - stops[::-1])
                parents.append(len(s) - 1 - self.parents[k - 1][::-1])
        return Grammar(names, starts, heads, parents, self.words)

    def _run_left(self, k: int, at: np.ndarray) -> np.ndarray:
        """How many symbols from `at` on, the first included, repeat it inside its parent."""
        if k == len(self.parents):
            return np.ones(len(at), np.int64)
        up = self.parents[k][at]
        head = self.heads[k + 1][up]
        stop = np.append(self.heads[k + 1], len(self.names[k]))[up + 1]
        # Pairs hold two different symbols, runs equal ones.
        return np.where(self.names[k][head] == self.names[k][stop - 1], stop - at, 1)

    def _match(self, k: int, i: np.ndarray, j: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Step over equal symbols of level k at i and j, in place; gives those that still match."""
        names, n = self.names[k], len(self.names[k])
        a, b = i[active], j[active]
        inside = (a < n) & (b < n)
        a, b, active = a[inside], b[inside], active[inside]
        same = names[a] == names[b]
        a, b, active = a[same], b[same], active[same]
        step = np.minimum(self._run_left(k, a), self._run_left(k, b))
        i[active] = a + step
        j[active] = b + step
        return active

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of equal words from i on and from j on, for each i and j, i < j.

        Climbs while both places begin a symbol of the next level, stepping over at most two equal
        runs on each: past the first equal symbol the parts before both places agree, so the next
        level begins at both or the symbols differ. Then descends, where a pair that differs holds at most one equal
        symbol and a run that differs one shorter run. The whole takes a fixed number of steps per level.
        """
        start = i
        i, j = i.astype(np.int64), j.astype(np.int64)
        top = np.zeros(len(i), np.int64)
        climbing = np.arange(len(i))
        for k in range(len(self.parents)):
            heads, up = self.heads[k + 1], self.parents[k]
            moving, risen = climbing, []
            while len(moving):
                n = len(self.names[k])
                live = moving[(i[moving] < n) & (j[moving] < n)]
                pi, pj = up[i[live]], up[j[live]]
                edge = (heads[pi] == i[live]) & (heads[pj] == j[live])
                risen.append(live[edge])
                moving = self._match(k, i, j, live[~edge])
            climbing = np.concatenate(risen) if risen else climbing[:0]
            i[climbing], j[climbing] = up[i[climbing]], up[j[climbing]]
            top[climbing] = k + 1
            if not len(climbing):
                break
        # Descend from where each stands; those that stand lower join on their level.
        for k in range(len(self.parents), -1, -1):
            moving = np.flatnonzero(top >= k)
            while len(moving):
                moving = self._match(k, i, j, moving)
            if k:
                down = np.flatnonzero(top >= k)
                heads = np.append(self.heads[k], len(self.names[k - 1]))
                i[down], j[down] = heads[i[down]], heads[j[down]]
        return i - start


@dataclass
class _Level:
    """Symbols with their words and the words that must be seen to know that they are symbols."""

    names: np.ndarray
    fixed: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _run_level(at: _Level, words: np.ndarray) -> _Level:
    made = runs(at.names, at.fixed)
    tails = made.heads + made.sizes - 1
    starts, ends = at.starts[made.heads], at.ends[tails]
    before, after = np.maximum(made.heads - 1, 0), np.minimum(tails + 1, len(at.names) - 1)
    # A neighbour is another symbol if its next word already differs from the word it would need.
    left = np.where(words[starts - 1] != words[at.ends[made.heads] - 1], np.minimum(at.left[made.heads], starts - 1), at.left[before])
    last = np.minimum(ends, len(words) - 1)
    right = np.where(words[last] != words[at.starts[tails]], np.maximum(at.right[tails], ends + 1), at.right[after])
    left, right = np.where(made.fixed, starts, left), np.where(made.fixed, ends, right)
    return _Level(made.names, made.fixed, starts, ends, left, right)


def _pair_level(at: _Level, level: int) -> _Level:
    first, second = right_class(at.names, at.fixed, level)
    made = pairs(at.names, first, second, at.fixed)
    tails = made.heads + made.sizes - 1
    alone = made.sizes == 1
    # Left alone: the neighbour that might have joined must be seen.
    see_left = np.where(alone & second[made.heads], made.heads - 1, made.heads)
    see_right = np.where(alone & first[tails], tails + 1, tails)
    return _Level(made.names, made.fixed, at.starts[made.heads], at.ends[tails], at.left[see_left], at.right[see_right])


def levels(seqs: Sequences, size: int) -> Iterator[_Level]:
    """Levels, each after a full round, while some symbol can be known from `size` words of its text."""
    n = len(seqs.names)
    place = np.arange(n)
    at = _Level(seqs.names, seqs.fixed, place, place + 1, place, place + 1)
    level = 0
    walls = np.concatenate([[0], np.cumsum(seqs.fixed)])
    while np.any((at.right - at.left <= size) & (walls[at.right] == walls[at.left])):
        yield at
        at = _pair_level(_run_level(at, seqs.names), level)
        level += 1


def _least(names: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The symbol of least digest among `count` ones from `first` on, the leftmost of equal ones."""
    rank = tb.mix(names + _ODD)
    best, width = [np.arange(len(names))], 1
    most = int(count.max())
    while 2 * width <= most:
        a, b = best[-1][:-width], best[-1][width:]
        best.append(np.where(rank[a] <= rank[b], a, b))
        width *= 2
    step = np.frexp(count.astype(np.float64))[1] - 1
    out = np.empty(len(first), np.int64)
    for k in range(len(best)):
        mine = np.flatnonzero(step == k)
        a = best[k][first[mine]]
        b = best[k][first[mine] + count[mine] - (1 << k)]
        out[mine] = np.where(rank[a] <= rank[b], a, b)
    return out


def anchors(seqs: Sequences, size: int, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of `size` words inside a sequence: its first word, and the first and last word of its anchor.

    The anchor is a symbol of the highest level of which the window's own words prove at least `least` symbols, the one of
    least digest, together with the words that prove it. All this depends on the window's words
    alone, so equal windows have equal anchors at equal places; and windows next to each other mostly share theirs.
    """
    n = len(seqs.names)
    at = tb.ragged(seqs.first, np.maximum(seqs.last - seqs.first - size + 1, 0))
    left, right = at.copy(), at + 1
    for level in levels(seqs, size):
        before = np.bincount(level.left, minlength=n + 1)
        first = (np.cumsum(before) - before)[at]
        stop = np.cumsum(np.bincount(level.right, minlength=n + 1))[at + size]
        good = np.flatnonzero(stop - first >= least)
        if not len(good):
            break
        pick = _least(level.names, first[good], (stop - first)[good])
        left[good], right[good] = level.left[pick], level.right[pick]
    return at, left, right
