"""Canonical text: per-character NFKC, removed controls, folded look-alikes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Zero-width and bidirectional controls.
CONTROLS = (
    "\u200b\u200c\u200d\u200e\u200f\ufeff"
    "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
)
# Cyrillic and Greek look-alikes and the Latin letters they imitate.
LOOKALIKES = "аАсСеЕоОрРхХѕЅіІκΚοΟρΡυΥ"
LETTERS = "aAcCeEoOpPxXsSiIkKoOpPyY"

CONTROL_CLASS = "[\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]"
# The look-ahead dismisses ASCII characters with one test.
CONTROL_PATTERN = rf"(?=[^\x00-\x7F]){CONTROL_CLASS}"
# All controls lie in this one range, which a text is searched for first.
CONTROL_GUARD = "[\u200b-\ufeff]"


@cache
def fold_table() -> dict[int, str]:
    """Every character canonicalization changes, built from the Unicode data by rule."""
    letters = dict(zip(LOOKALIKES, LETTERS, strict=True))
    table: dict[int, str] = {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if char in CONTROLS:
            table[code] = ""
            continue
        shown = "".join(letters.get(c, c) for c in unicodedata.normalize("NFKC", char))
        if shown != char:
            table[code] = shown
    return table


@cache
def changed_pattern() -> str:
    """A cheap necessary condition: a character outside the long unchanged ranges, which is the last one of the match."""
    table = fold_table()
    runs, first = [], 0
    for code in range(0x2100):
        if code in table:
            if code - first >= 16:
                runs.append((first, code - 1))
            first = code + 1
    inside = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)
    # One run from the start over characters that stay, ASCII first; only others meet the ranges.
    return rf"\A[\x00-\x7F[{inside}]]*+(?s:.)"


#: Characters canonicalized at once; a longer text makes a slice of its own.
SLICE = 1 << 18
CANONICAL = pa.struct([("text", pa.string()), ("source", pa.list_(pa.int32()))])


@cache
def _fold_arrays() -> tuple[re.Pattern, np.ndarray]:
    """A pattern of the characters that change, and the number of characters that each one becomes."""
    table = fold_table()
    sizes = np.ones(0x110000, np.uint8)
    sizes[list(table)] = [len(v) for v in table.values()]
    codes, runs = sorted(table), []
    for code in codes:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    inside = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    return re.compile(f"[{inside}]"), sizes


def _folded(texts: list[str | None]) -> pa.StructArray:
    """The new text and the source of each of its characters, as arrays; NULL for texts that stay."""
    table = fold_table()
    pattern, sizes = _fold_arrays()
    shown, sources, ends = [], [], [0]
    for text in texts:
        if text is None or pattern.search(text) is None:
            shown.append(None)
            ends.append(ends[-1])
            continue
        shown.append(pattern.sub(lambda m: table[ord(m[0])], text))
        times = sizes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        sources.append(np.repeat(np.arange(len(times), dtype=np.int32), times))
        ends.append(ends[-1] + len(sources[-1]))
    values = np.concatenate(sources) if sources else np.zeros(0, np.int32)
    kept = np.array([t is not None for t in shown], dtype=bool)
    source = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array(~kept))
    return pa.StructArray.from_arrays([pa.array(shown, pa.string()), source], fields=list(CANONICAL))


def _canonical(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The plain form of canonical(), batch by batch in slices; no query uses it, tests hold canonical() against it."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(batch):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + SLICE, side="right")))
            yield _folded(batch.slice(start, stop - start).to_pylist())
            start = stop
        if not len(batch):
            yield _folded([])


#: Characters whose sources are made at once.
PIECE = 4096


def _char_class(codes: Iterable[int]) -> str:
    """A Java pattern of one of these characters; the look-ahead dismisses ASCII characters with one test."""
    runs: list[list[int]] = []
    for code in sorted(codes):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "(?=[^\\x00-\\x7F])[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]"


def _expanded(text: Column, wide: dict[str, str]) -> Column:
    """Every character that becomes several ones, replaced kind by kind; no replacement holds such a character."""
    pattern = F.lit(_char_class(map(ord, wide)))
    mark = "\x01"
    table = F.map_from_arrays(F.split(F.lit(mark.join(wide)), mark), F.split(F.lit(mark.join(wide.values())), mark))
    kinds = F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(0)))
    return F.when(F.rlike(text, pattern), F.aggregate(kinds, text, lambda acc, c: F.replace(acc, c, F.element_at(table, c)))).otherwise(text)


def _sources(text: Column, odd: dict[str, int]) -> Column:
    """The original character of each canonical one; `odd` has how many a character becomes, if not one."""
    # One character stands for all that become as many, so that few comparisons tell them apart.
    stands: dict[int, str] = {}
    for char, size in odd.items():
        stands.setdefault(size, char)
    shape = F.translate(text, "".join(odd), "".join(stands[size] for size in odd.values()))
    pattern = _char_class(map(ord, stands.values()))

    def places(piece: Column, k: Column) -> Column:
        def times(char: Column, i: Column) -> Column:
            place = k * PIECE + i
            out = F.when(F.octet_length(char) == 1, F.array(place))
            for size, stand in stands.items():
                out = out.when(char == stand, F.array_repeat(place, size))
            return out.otherwise(F.array(place))

        return F.when(piece.rlike(pattern), F.flatten(F.transform(F.split(piece, ""), times))).otherwise(
            F.sequence(k * PIECE, k * PIECE + F.length(piece) - 1)
        )

    return F.flatten(F.transform(F.regexp_extract_all(shape, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), places))


def canonical(text: str) -> Column:
    """Struct(text, source) for texts canonicalization changes, NULL for all others.

    `source` maps each canonical character to its original character. Characters change one by one, so the table
    of what they become is all that the engine lacks: the text is translated by it, and no text leaves the engine.
    """
    table = {chr(code): shown for code, shown in fold_table().items()}
    single = {c: shown for c, shown in table.items() if len(shown) == 1}
    dropped = [c for c, shown in table.items() if not shown]
    wide = {c: shown for c, shown in table.items() if len(shown) > 1}
    # Characters without a counterpart are removed.
    moved = F.translate(text, "".join([*single, *dropped]), "".join(single.values()))
    sources = _sources(F.col(text), {c: len(shown) for c, shown in table.items() if len(shown) != 1})
    # No character that changes is among those that others become, so a changed text is another text.
    # Each step is an array of one, so that its result is made once.
    shown = F.transform(F.array(moved), lambda once: _expanded(once, wide))
    made = F.transform(shown, lambda new: F.when(new != F.col(text), F.struct(new.alias("text"), sources.alias("source"))))
    return F.when(F.col(text).rlike(changed_pattern()), made[0])
