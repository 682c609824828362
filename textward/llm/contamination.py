"""Benchmark passages inside documents, found by winnowed fingerprints.

Words are runs of digits, ASCII letters (lower-cased) and anything beyond ASCII. An item's
windows are its runs of `WINDOW` words; an item with fewer words, but some, is one window.
A document word is hit when it lies inside any occurrence of any window.

Winnowing: hash every `GRAM` consecutive words, and of each `WINDOW - GRAM + 1` neighbouring
hashes keep the least (all of equal ones). A window is exactly one such neighbourhood, so two
texts that share a window keep a common hash inside it: no shared span of a window's length is
missed. The kept hashes of the documents are joined with those of the items, and each meeting is
extended to the windows around it, which are compared word by word.

The items are the small side. They are read in blocks of at most `BLOCK_WORDS` words, each
sent to the tasks as sorted arrays; a larger benchmark takes more blocks and more passes over the
documents, never a larger broadcast. A task holds one slice of texts and one block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.session import cut_lineage

from . import textbatch as tb

WINDOW = 10
GRAM = 5
BLOCK_WORDS = 200_000
#: Fixed: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z.
WORD = tb.class_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, tb.POINTS - 1))



def _words(texts: list[str | None]) -> tuple[tb.Points, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points (lower-cased), and per word its start, end, text number and hash."""
    points = tb.Points(texts)
    starts, ends, owner = points.runs(WORD)
    points.points = tb.lower_ascii(points.points)
    return points, starts, ends, owner, tb.span_hashes(points.points, starts, ends)


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive words; entry i covers words i to i + size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = tb.mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def winnow(words: np.ndarray, owner: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams kept from each text.

    A gram is kept if it is the least of some `window - gram + 1` neighbours within one text.
    Texts shorter than `window` words keep nothing.
    """
    hashes = _gram_hashes(words, gram)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    span = window - gram + 1
    least = hashes[:n].copy()
    for k in range(1, span):
        np.minimum(least, hashes[k : k + n], out=least)
    whole = owner[:n] == owner[window - 1 :]
    kept = np.zeros(len(hashes), dtype=bool)
    for k in range(span):
        kept[k : k + n] |= whole & (hashes[k : k + n] == least)
    at = np.flatnonzero(kept)
    return at, hashes[at]


class Block:
    """One block of items: its windows by length, and its fingerprints."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        points, starts, ends, owner, words = _words(texts)
        text = points.points
        n_words = np.bincount(owner, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(n_words)])
        self.windows: dict[int, dict[bytes, tuple[int | None, ...]]] = {}
        for i, item in enumerate(ids):
            size = min(window, int(n_words[i]))
            table = self.windows.setdefault(size, {}) if size else {}
            for a in range(first[i], first[i + 1] - size + 1) if size else ():
                key = _spelled(text, starts, ends, a, size)
                if item not in table.get(key, ()):
                    table[key] = (*table.get(key, ()), item)
        self.marks = np.unique(winnow(words, owner, window, gram)[1])
        # A short item is its own neighbourhood of one gram.
        self.short = {
            size: np.unique(
                np.concatenate([_gram_hashes(words[first[i] : first[i + 1]], size) for i in range(len(ids)) if n_words[i] == size])
            )
            for size in self.windows
            if size < window
        }

    def occurrences(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[int, int, int, tuple[int, ...]]]]:
        """Words per text, and (text number, first word, word after the last, items) of each occurrence.

        Words are numbered through the whole list of texts.
        """
        points, starts, ends, owner, words = _words(texts)
        found = []
        if self.window in self.windows:
            at, hashes = winnow(words, owner, self.window, self.gram)
            at = at[_member(self.marks, hashes)]
            # Extend: a window that holds the gram starts up to window - gram words before it.
            reach = np.unique((at[:, None] - np.arange(self.window - self.gram + 1)[None, :]).ravel())
            found += self._verified(points, starts, ends, owner, reach, self.window)
        for size, marks in self.short.items():
            hashes = _gram_hashes(words, size)
            found += self._verified(points, starts, ends, owner, np.flatnonzero(_member(marks, hashes)), size)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        return first, found

    def _verified(self, points, starts, ends, owner, positions, size):
        positions = positions[(positions >= 0) & (positions + size <= len(owner))]
        positions = positions[owner[positions] == owner[positions + size - 1]]
        table = self.windows[size]
        for a in positions.tolist():
            items = table.get(_spelled(points.points, starts, ends, a, size))
            if items:
                yield int(owner[a]), a, a + size, items


def _spelled(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, size: int) -> bytes:
    """The words themselves, split by a point that no word holds."""
    return b"\x00\x00\x00\x00".join(
        points[starts[k] : ends[k]].tobytes() for k in range(first, first + size)
    )


def _member(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(marks) or not len(hashes):
        return np.zeros(len(hashes), dtype=bool)
    place = np.minimum(np.searchsorted(marks, hashes), len(marks) - 1)
    return marks[place] == hashes


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Items of over `limit` words in pieces that have every window in one of them; the others as they are."""
    size = max(limit, 2 * WINDOW)
    for part, texts in tb.slices(batches):
        ids, pieces = [], []
        for item, text in zip(part.column(0).to_pylist(), texts, strict=True):
            _, starts, ends, _, _ = _words([text])
            if len(starts) <= size:
                cut = [text]
            else:
                cut = [text[starts[k] : ends[min(k + size, len(ends)) - 1]] for k in range(0, len(starts) - WINDOW + 1, size - WINDOW + 1)]
            ids += [item] * len(cut)
            pieces += cut
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.string())], names=["item_id", "text"])


def _read_items(benchmark: DataFrame, item: str, text: str, limit: int) -> tuple[DataFrame, int]:
    """Items with a block number, and the number of blocks of about `limit` words."""
    rows = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.where("text IS NOT NULL").mapInArrow(lambda batches: _cut(batches, limit), "item_id long, text string")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // (4 * limit)))
    return rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def _block(items: DataFrame, part: int) -> Block:
    """One block of items; no other block is in the driver meanwhile."""
    got = items.where(F.col("part") == part).collect()
    return Block([r["item_id"] for r in got], [r["text"] for r in got])


def find_passages(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    block_words: int = BLOCK_WORDS,
    result: str = "found",
) -> DataFrame:
    """The `carry` columns of each document row, and `result`: n_words, spans and items.

    Spans are word numbers, end exclusive, merged where they touch; items ascend.

    Defined results: a null or empty text has no words, no spans and no items; a null item
    text takes no part; an item with a null id has its windows hit, but is not listed; an item without words has no window; repeated items share their
    windows, a repeated document row is answered for each copy; an empty benchmark gives the
    documents without hits, and no documents give no rows. Other columns are not read, and carried
    columns may have any names but the result's.
    """
    wanted = list(carry)
    docs = documents.select(
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(wanted)],
        *([] if text in wanted else [F.col(f"`{text}`").alias(f"c{len(wanted)}")]),
    )
    at = wanted.index(text) if text in wanted else len(wanted)
    items, n = _read_items(benchmark, item_id, item_text, block_words)
    kept = [f"c{k}" for k in range(len(wanted))]
    if n == 1:
        found = _one_pass(docs, _block(items, 0), f"c{at}", kept)
    else:
        # Several blocks: every row gets a key, and what the blocks found meets under it.
        docs = cut_lineage(docs.withColumn("key", F.expr("uuid()")))
        parts = [_one_pass(docs, _block(items, k), f"c{at}", ["key"]).select("key", "found.*") for k in range(n)]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part.where("size(spans) > 0"))
        merged = every.groupBy("key").agg(
            F.struct(
                F.max("n_words").alias("n_words"),
                _union_of(F.flatten(F.collect_list("spans"))).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            ).alias("found")
        )
        found = docs.select("key", *kept).join(merged, "key")
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(wanted)], F.col("found").alias(result))


def _union_of(spans: Column) -> Column:
    """Overlapping and touching spans of one document made one."""
    kind = "array<struct<start:bigint,stop:bigint>>"

    def add(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when(
            (F.size(out) > 0) & (x["start"] <= F.try_element_at(out, F.lit(-1))["stop"]),
            F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer)),
        ).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def _one_pass(docs: DataFrame, block: Block, text: str, kept: list[str]) -> DataFrame:
    fields = [docs.schema[c] for c in kept]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema = f"{columns}, found struct<n_words:long,spans:array<struct<start:long,stop:long>>,items:array<long>>"
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            ("items", pa.list_(pa.int64())),
        ]
    )

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for part, texts in tb.slices(batches, text):
            first, found = block.occurrences(texts)
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            items: list[set[int]] = [set() for _ in texts]
            for i, a, b, got in found:
                spans[i].append((a - int(first[i]), b - int(first[i])))
                items[i].update(x for x in got if x is not None)
            out = [
                {"n_words": n, "spans": [{"start": a, "stop": b} for a, b in _merged(s)], "items": sorted(x)}
                for n, s, x in zip(np.diff(first).tolist(), spans, items, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(out, kind)],
                names=[*kept, "found"],
            )

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(scan, schema)


def hit_words() -> Column:
    """Number of words inside the spans."""
    return F.expr("aggregate(found.spans, 0L, (n, s) -> n + s.stop - s.start)")


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The document rows that hold no passage of the benchmark, with the columns of documents."""
    name = tb.fresh(documents.columns, "found")
    found = find_passages(documents, benchmark, carry=tuple(documents.columns), result=name)
    return found.where(F.size(F.col(name)["spans"]) == 0).drop(name)
