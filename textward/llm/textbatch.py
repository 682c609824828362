"""Whole batches of texts as numpy arrays: code points, words and hashes of spans.

Tasks see texts in Arrow batches. Here a slice of such a batch becomes one array of code
points, so that splitting and hashing cost a few array passes instead of a Python step per
word. Slices hold about `CHUNK` characters, which bounds the memory whatever the batch; a
single longer text makes a slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 300_000
POINTS = 0x110000
#: Separates the texts of a slice; never part of a word.
SEPARATOR = "\n"

_PRIME = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def fresh(columns: Iterable[str], name: str) -> str:
    """The name, or one like it, that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of each batch of about `limit` characters, with their texts as Python strings."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=np.int64)
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths + sizes)
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, column.slice(start, stop - start).to_pylist()
            start = stop


class Points:
    """The code points of a list of texts, one after the other, null as empty.

    `points` holds every text followed by a separator; text i is points[bounds[i]:bounds[i + 1] - 1].
    """

    def __init__(self, texts: list[str | None]):
        filled = [t or "" for t in texts]
        joined = SEPARATOR.join(filled) + SEPARATOR
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in filled])]).astype(np.int64)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of points marked in the table `inside`.

        The separator must not be marked, so a run never leaves its text.
        """
        flags = inside[self.points].view(np.int8)
        edges = np.flatnonzero(np.diff(flags, prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edges[0::2], edges[1::2]
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1


def class_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Marks for all code points inside the given closed ranges."""
    table = np.zeros(POINTS, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def lower_ascii(points: np.ndarray) -> np.ndarray:
    return points + np.where((points >= 65) & (points <= 90), np.uint32(32), np.uint32(0))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: near values get far apart."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    v ^= v >> np.uint64(33)
    return v


def _grow(n: int) -> None:
    """Powers of the odd multiplier and of its inverse modulo 2 to the 64."""
    global _powers, _inverses
    if len(_powers) >= n:
        return
    n = max(n, 2 * CHUNK)
    factors = np.empty((2, n + 1), dtype=np.uint64)
    factors[:, 0] = 1
    factors[0, 1:] = _PRIME
    factors[1, 1:] = pow(_PRIME, -1, 1 << 64)
    _powers, _inverses = np.cumprod(factors, axis=1, dtype=np.uint64)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span that depends only on its points and their order."""
    _grow(len(points) + 1)
    with np.errstate(over="ignore"):
        terms = mix(points) * _powers[: len(points)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        spans = (sums[ends] - sums[starts]) * _inverses[starts]
    return mix(spans ^ (ends - starts).astype(np.uint64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], ..., starts[i] + lengths[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
