"""Periodic runs of words, found on a run-length grammar.

A run is a stretch of words with least period q and at least max(LEAST, TIMES * q) words that no
neighbouring word extends under that period. Every such stretch covers TIMES words of any grid with spacing
q, all of them equal. So the grids of all spacings (n log n places in all) give the candidates, and
two common-extension queries on the grammar, forward and on its mirror image, give the exact ends of
each. An interval that comes up under several periods keeps the least: each other one is its multiple.

A task holds one slice of texts, about `CHUNK` characters, and its grammar; a longer text is a slice
of its own. No text is cut and nothing is shuffled.

Defined cases: a null or empty text has no words and no run. Repeated rows and repeated ids are
treated one by one. Other columns stay; the result column takes a free name if `periodic` is taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import recompression as rc
from . import textbatch as tb

LEAST = 6
TIMES = 4
CHUNK = 1_500_000

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("runs", T.ArrayType(RUN, False), False),
        T.StructField("strongest", RUN, True),
        T.StructField("collapsed", T.StringType(), False),
    ]
)


def planted_period(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The contract's planted repetition: (first word, period), for a tenth of the ids."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _planted(ids: list, counts: np.ndarray) -> np.ndarray | None:
    """For each word of the texts the word that replaces it."""
    first = np.cumsum(counts) - counts
    source = np.arange(int(counts.sum()))
    for t, doc_id in enumerate(ids):
        at = planted_period(doc_id, int(counts[t]))
        if at is not None:
            a, p = at
            tail = np.arange(a, counts[t])
            source[first[t] + tail] = first[t] + a + (tail - a) % p
    return source


def _candidates(names: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i with period q such that words i, i + q, ... (TIMES of them) are equal, on the grid of each q."""
    places, periods = [], []
    for q in range(1, longest // TIMES + 1):
        grid = names[::q]
        same = grid[1:] == grid[:-1]
        hit = same[: len(same) - TIMES + 2].copy()
        for k in range(1, TIMES - 1):
            hit &= same[k : len(same) - TIMES + 2 + k]
        at = np.flatnonzero(hit)
        if len(at):
            places.append(at * q)
            periods.append(np.full(len(at), q))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    if not len(words):
        return found
    seqs = rc.separated(words, counts)
    at, period = _candidates(seqs.names, int(counts.max()))
    if not len(at):
        return found
    grammar = rc.Grammar.of(seqs)
    n = len(seqs.names)
    forward = grammar.common(at, at + period)
    # Words before i and before i + q, read backwards.
    backward = grammar.mirrored().common(n - at - period, n - at)
    start, length = at - backward, backward + forward + period
    long = length >= np.maximum(LEAST, TIMES * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    owner = np.searchsorted(seqs.first, start, side="right") - 1
    for k in order.tolist():
        t = int(owner[k])
        found[t].append((int(start[k] - seqs.first[t]), int(length[k]), int(period[k])))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period; of equal ones the first, then the shortest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None


def _dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Words that some run repeats."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _named(run: tuple[int, int, int] | None) -> dict | None:
    return run and dict(zip(("start", "length", "period"), run))


def _rows(texts: list[str | None], ids: list | None) -> list[dict]:
    points = tb.Points(texts)
    starts, ends, owner = points.runs(rc.WORD)
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    names = tb.span_hashes(points.points, starts, ends)
    source = _planted(ids, counts) if ids is not None else np.arange(len(names))
    found = find_runs(names[source], counts)
    first = np.cumsum(counts) - counts
    out = []
    for t, runs in enumerate(found):
        a, n = int(first[t]), int(counts[t])
        kept = source[a : a + n]
        if runs:
            kept = kept[~_dropped(runs, n)]
        text, base = texts[t] or "", int(points.bounds[t])
        spelled = " ".join([text[s:e] for s, e in zip((starts[kept] - base).tolist(), (ends[kept] - base).tolist())])
        listed = [_named(r) for r in runs]
        out.append({"n_words": n, "runs": listed, "strongest": _named(strongest(runs)), "collapsed": spelled})
    return out


def find(docs: DataFrame, text: str = "text", plant: str | None = None, name: str = "periodic") -> DataFrame:
    """`docs` with a struct `periodic`: the number of words, all runs, the strongest, and the words that remain without repetitions.

    `plant` names an id column; a tenth of the ids then get a repetition planted before the search, which
    tests use.
    """
    name = tb.fresh(docs.columns, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(FOUND)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches, text, CHUNK):
            ids = part.column(part.schema.get_field_index(plant)).to_pylist() if plant else None
            column = pa.array(_rows(texts, ids), type=kind)
            yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)
