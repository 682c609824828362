"""Exact substring deduplication by recompression.

A window is `size` consecutive words of one text. A word goes if some window that covers it also
starts earlier: in a text with a smaller id, or earlier in the same text.

Every text is parsed into levels of runs and pairs (`recompression`), whose names are the same in all
tasks. Each window takes a symbol of a high level that its own words prove as its anchor, named by these words, so
equal windows meet under one name:

1. Every slice of texts sends each of its anchors' names once, in one shuffle; names of two or more places come
   back. A name that a slice holds twice is known to repeat, so its other places need no answer.
2. Windows of such anchors go by the anchor's name, those of one anchor together as digests; of equal ones in
   a slice only the first goes, the others are settled there. The task of the name keeps the first
   window by id and start and sends back the others. Name and digest, 128 bits, must agree.
3. The ranges of a text are gathered beside it and cut out.

A passage that a third of all texts hold thus travels once per slice of `CHUNK` characters, not once per text,
and no task sees pairs of places. Nothing is broadcast or collected in the driver.

Defined cases: a null or empty text has no words. A null id counts as the least long. Rows with one id and one
text are one document, each copy gets its result; different texts under one id are ordered by a digest of
the text. Other columns stay; the result takes a free name if `repeats` is taken.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import recompression as rc
from . import textbatch as tb

SIZE = 20
CHUNK = 3_000_000

SPAN = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("stop", T.IntegerType(), False)])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_removed", T.LongType(), False),
        T.StructField("spans", T.ArrayType(SPAN, False), False),
        T.StructField("kept", T.StringType(), False),
    ]
)
ASKED = "key long, doc long, version long, place int"
WINDOWS = "key long, doc long, version long, first int, last int, digests binary"
RANGES = "doc long, version long, first int, last int"


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(np.ascontiguousarray(values), type=kind)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _longs(names: np.ndarray) -> np.ndarray:
    return names.view(np.int64)


class _Parsed:
    """Texts of a slice in the order of their documents, with the anchors of their windows."""

    def __init__(self, part: pa.RecordBatch, texts: list[str | None], size: int):
        doc, version = _numbers(part, "doc"), _numbers(part, "version")
        # Copies of a row are one document.
        order = np.lexsort((version, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (version[order][1:] != version[order][:-1])
        self.rows = order[new]
        self.doc, self.version = doc[self.rows], version[self.rows]
        words, counts = rc.word_names([texts[r] for r in self.rows.tolist()])
        self.seqs = rc.separated(words, counts)
        self.at, self.place, self.stop = rc.anchors(self.seqs, size)

    def digests(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return tb.span_hashes(self.seqs.names, starts, stops)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.seqs.first, at, side="right") - 1


def _asked(size: int, text: int):
    """Anchors of each slice: those to ask for, and, with place -1 - p, those known to repeat."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, text):
            got = _Parsed(part, texts, size)
            if not len(got.at):
                continue
            # Windows of one anchor mostly follow each other; a later one elsewhere repeats at worst a row.
            new = _breaks(got.place, got.stop)
            place = got.place[new]
            key = got.digests(place, got.stop[new])
            order = np.lexsort((place, key))
            place, key = place[order], key[order]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (place[1:] == place[:-1])
            place, key = place[~again], key[~again]
            twice = np.zeros(len(key), bool)
            twice[1:] = key[1:] == key[:-1]
            twice[:-1] |= twice[1:]
            owner = got.owner(place)
            local = place - got.seqs.first[owner]
            # The first of them goes under its name, so that other slices hear of it.
            more = np.zeros(len(key), bool)
            more[1:] = key[1:] == key[:-1]
            key = np.where(more, tb.mix(got.doc[owner].view(np.uint64) + got.version[owner].view(np.uint64)), key)
            local = np.where(twice, -1 - local, local)
            order = np.lexsort((local, owner))
            yield pa.RecordBatch.from_arrays(
                [
                    _column(_longs(key)[order], pa.int64()),
                    _column(got.doc[owner][order], pa.int64()),
                    _column(got.version[owner][order], pa.int64()),
                    _column(local[order], pa.int32()),
                ],
                ["key", "doc", "version", "place"],
            )

    return run


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of names that repeat; all rows of a name are in this partition."""
    held = [[_numbers(b, n) for n in ("key", "doc", "version", "place")] for b in batches]
    if not held:
        return
    key, doc, version, place = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(key, kind="stable")
    k = key[order]
    chosen = place < 0
    place = np.where(chosen, -1 - place, place)
    same = order[1:][k[1:] == k[:-1]], order[:-1][k[1:] == k[:-1]]
    chosen[same[0]] = chosen[same[1]] = True
    chosen = np.flatnonzero(chosen)
    for a in range(0, len(chosen), 200_000):
        pick = chosen[a : a + 200_000]
        yield pa.RecordBatch.from_arrays(
            [_column(doc[pick], pa.int64()), _column(version[pick], pa.int64()), _column(place[pick], pa.int32())], ["doc", "version", "place"]
        )


def _texts(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of rows with their texts, field number `text` of the struct `row`."""
    for batch in batches:
        row = batch.column(batch.schema.get_field_index("row"))
        whole = pa.RecordBatch.from_arrays([*batch.columns, row.flatten()[text]], [*batch.schema.names, "words_of"])
        yield from tb.slices([whole], "words_of", CHUNK)


def _breaks(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes; the first row counts."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _windows(size: int, text: int):
    """Windows of repeated anchors: the first of equal ones in a slice with digests, the others as settled ranges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, text):
            got = _Parsed(part, texts, size)
            if not len(got.at):
                continue
            lists = part.column(part.schema.get_field_index("places")).take(pa.array(got.rows))
            asked = np.zeros(len(got.seqs.names), bool)
            offsets = lists.offsets.to_numpy()
            base = np.repeat(got.seqs.first, np.diff(offsets))
            asked[base + lists.values.to_numpy()[offsets[0] : offsets[-1]]] = True
            chosen = np.flatnonzero(asked[got.place])
            if not len(chosen):
                continue
            at, key = got.at[chosen], got.digests(got.place[chosen], got.stop[chosen])
            digest = got.digests(at, at + size)
            both = digest ^ tb.mix(key)
            order = np.argsort(both, kind="stable")
            heads = np.flatnonzero(_breaks(both[order]))
            head = order[np.repeat(heads, np.diff(heads, append=len(order)))]
            settled = np.zeros(len(at), bool)
            settled[order] = (order != head) & (digest[order] == digest[head]) & (key[order] == key[head])
            owner = got.owner(at)
            # One row per stretch of windows of one anchor, or of settled windows.
            new = _breaks(owner, settled, np.where(settled, np.uint64(0), key))
            new[1:] |= at[1:] != at[:-1] + 1
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(at)) - 1
            who = owner[a]
            name = np.where(settled[a], tb.mix(got.doc[who].view(np.uint64) + got.version[who].view(np.uint64)), key[a])
            # All digests one after the other, none for settled windows.
            kept = np.where(settled, 0, 8)
            bounds = np.concatenate([[0], np.cumsum(kept)])[np.append(a, len(at))]
            data = pa.py_buffer(np.ascontiguousarray(digest[~settled]).tobytes())
            digests = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), data])
            yield pa.RecordBatch.from_arrays(
                [
                    _column(_longs(name), pa.int64()),
                    _column(got.doc[who], pa.int64()),
                    _column(got.version[who], pa.int64()),
                    _column(at[a] - got.seqs.first[who], pa.int32()),
                    _column(at[b] - got.seqs.first[who], pa.int32()),
                    digests,
                ],
                ["key", "doc", "version", "first", "last", "digests"],
            )

    return run


def _later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of windows that are not the first of their kind; all windows of an anchor's name are in this partition."""
    held, blobs = [], []
    for batch in batches:
        held.append([_numbers(batch, n) for n in ("key", "doc", "version", "first", "last")])
        column = batch.column(batch.schema.get_field_index("digests"))
        offsets = column.buffers()[1]
        offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        blobs.append(np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].copy() if raw is not None else np.zeros(0, np.uint8))
        held[-1].append(np.diff(offsets) // 8)
    if not held:
        return
    key, doc, version, first, last, sizes = (np.concatenate(x) for x in zip(*held))
    digest = np.concatenate(blobs).view(np.uint64)
    settled = np.flatnonzero(sizes == 0)
    row = np.repeat(np.arange(len(key)), sizes)
    at = tb.ragged(first.astype(np.int64), sizes)
    # Names met in one row alone hold nothing that repeats here: their slice settled the rest.
    order = np.lexsort((at, version[row], doc[row], digest, key[row]))
    row, at, digest = row[order], at[order], digest[order]
    later = ~_breaks(digest, key[row]) if len(row) else np.zeros(0, bool)
    row, at = row[later], at[later]
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = _breaks(row)
    if len(row):
        new[1:] |= at[1:] != at[:-1] + 1
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(row)) - 1
    who = np.concatenate([row[a], settled])
    start = np.concatenate([at[a], first[settled]])
    stop = np.concatenate([at[b], last[settled]]) if len(row) else last[settled]
    yield pa.RecordBatch.from_arrays(
        [_column(doc[who], pa.int64()), _column(version[who], pa.int64()), _column(start, pa.int32()), _column(stop, pa.int32())],
        ["doc", "version", "first", "last"],
    )


def _covered(firsts: np.ndarray, lasts: np.ndarray, n: int, size: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, firsts, 1)
    np.add.at(edge, lasts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _rows(texts: list[str | None], ranges: list, size: int) -> list[dict]:
    points = tb.Points(texts)
    starts, ends, owner = points.runs(rc.WORD)
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    first = np.cumsum(counts) - counts
    out = []
    for t, spans in enumerate(ranges):
        n, a, base, text = int(counts[t]), int(first[t]), int(points.bounds[t]), texts[t] or ""
        s, e = starts[a : a + n] - base, ends[a : a + n] - base
        gone: list[dict] = []
        if spans:
            mask = _covered(np.array([x["first"] for x in spans]), np.array([x["last"] for x in spans]), n, size)
            s, e = s[~mask], e[~mask]
            edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
            gone = [{"start": x, "stop": y} for x, y in zip(edges[::2], edges[1::2])]
        kept = " ".join([text[x:y] for x, y in zip(s.tolist(), e.tolist())])
        out.append({"n_words": n, "n_removed": n - len(s), "spans": gone, "kept": kept})
    return out


def _identified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """`row` with all columns, doc and version; and which of these two tell documents apart."""
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long"))
    shared = docs.select(doc.alias("doc")).groupBy("doc").count().where("count > 1")
    # Digests of texts take room in every shuffle; without shared ids no order needs them.
    unique = shared.isEmpty()
    version = F.lit(0).cast("long") if unique else F.coalesce(F.xxhash64(text), F.lit(0))
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc.alias("doc"), version.alias("version"))
    return rows, ["doc"] if unique else ["doc", "version"]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, name: str = "repeats") -> DataFrame:
    """`docs` with a struct `repeats`: number of words, removed words, their ranges, and the kept text."""
    name, place = tb.fresh(docs.columns, name), docs.columns.index(text)
    rows, ids = _identified(docs, key, text)
    answers = rows.mapInArrow(_asked(size, place), ASKED).repartition("key").mapInArrow(_answers, "doc long, version long, place int")
    places = answers.groupBy(*ids).agg(F.collect_list("place").alias("places"))
    # Both joins read the rows in one and the same exchange.
    windows = rows.join(places, ids).mapInArrow(_windows(size, place), WINDOWS)
    later = windows.repartition("key").mapInArrow(_later, RANGES)
    ranges = later.groupBy(*ids).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    beside = rows.join(ranges, ids, "left")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    kind, fields = to_arrow_type(FOUND), to_arrow_schema(docs.schema)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, place):
            ranges = part.column(part.schema.get_field_index("ranges")).to_pylist()
            found = pa.array(_rows(texts, ranges, size), type=kind)
            row = part.column(part.schema.get_field_index("row"))
            yield pa.RecordBatch.from_arrays([*row.flatten(), found], [*fields.names, name])

    return beside.mapInArrow(cut, schema)
