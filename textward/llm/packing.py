"""Documents packed into as few token sequences as possible, by a linear grouping scheme.

1. Tokenize, end every document with one token, cut longer ones into full pieces (the first
   piece takes the remainder).
2. Large pieces (over `SMALL` of the capacity) are sorted by length and dealt into `GROUPS`
   groups of equal cardinality; each counts as its group's largest length.
3. With so few sizes the best mix of configurations (what one sequence holds) is a small linear
   program, solved by column generation: a knapsack proposes the configuration that pays
   most under the current prices. Whole uses are kept; the few pieces left by rounding
   are packed one configuration at a time.
4. The actual pieces take the slots of their group: the piece of rank r takes slot r.
5. What rounding up left free is counted per sequence, and small pieces are best-fitted into it,
   longest first.

The plans depend on counts per length alone, at most `capacity` numbers, so they stay small on
any input. The pieces themselves never meet in one place: they only need their rank within a
length or group, which counts per block provide even if all pieces have one length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.session import cut_lineage

from . import textbatch as tb

CAPACITY = 1024
END = 2
GROUPS = 200
STALE = 20
#: Rounds after which the inverse of the basis, updated in each, is computed anew.
REFRESH = 100
SMALL = 1 / 4
BLOCKS = 64
#: Words whose ids a worker remembers at most.
REMEMBERED = 1 << 20


# ---------------------------------------------------------------- tokens

#: Fixed: the byte-level vocabulary merges inside these words only.
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
_CONTRACTED = ("s", "t", "m", "d", "re", "ve", "ll")
#: Characters of whose class all Unicode versions agree; texts with others go through the tokenizer whole.
_AGREED = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0x233), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x410, 0x44F), (0x2013, 0x2026), (0x20AC, 0x20AC))
_LETTER, _NUMBER, _SIGN, _SPACE = 1, 2, 3, 4


def _classes() -> np.ndarray:
    import regex

    table = np.zeros(tb.POINTS, np.uint8)
    for low, high in _AGREED:
        for c in range(low, high + 1):
            known = (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")
            table[c] = next((k for k, p in known if regex.match(p, chr(c))), _SIGN)
    return table


class Ids:
    """Token ids of texts, each distinct word encoded once per worker while it is remembered.

    Texts are split into the tokenizer's words by array passes; a word's ids are looked up by its
    hash in a table of `REMEMBERED` places, and what is missing there is encoded. Texts with rarer
    characters, or with a special token spelled out, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(REMEMBERED, np.uint64)
        self.first = np.zeros(REMEMBERED, np.int64)
        self.number = np.zeros(REMEMBERED, np.int32)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        filled = [t or "" for t in texts]
        points = tb.Points(filled)
        kinds = self.classes[points.points]
        ends = points.bounds[1:] - 1
        kinds[ends] = 0
        strange = np.add.reduceat(kinds == 0, points.bounds[:-1]) > 1 if len(texts) else np.zeros(0, bool)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        whole = [i for i, t in enumerate(filled) if strange[i] or any(s in t for s in self.special)]
        for i, ids in zip(whole, self._encoded([filled[i] for i in whole]), strict=True):
            out[i] = np.array(ids, np.uint32)
        starts, stops = _words(points.points, kinds)
        first, number = self._looked_up(tb.SEPARATOR.join(filled), points.points, starts, stops)
        ids = self.ids[tb.ragged(first, number)]
        before = np.concatenate([[0], np.cumsum(number)])
        cuts = before[np.searchsorted(starts, points.bounds)]
        for i in sorted(set(range(len(texts))) - set(whole)):
            out[i] = ids[cuts[i] : cuts[i + 1]]
        return out

    def _looked_up(self, joined: str, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in `self.ids`, and how many they are."""
        if self.used > 4 * REMEMBERED:
            self._forget()
        hashes = tb.span_hashes(points, starts, stops)
        place = (hashes >> np.uint64(32)).astype(np.int64) % REMEMBERED
        known = self.hashes[place] == hashes
        first, number = self.first[place], self.number[place]
        missing = np.flatnonzero(~known)
        if len(missing):
            _, pick, where = np.unique(hashes[missing], return_index=True, return_inverse=True)
            new = missing[pick]
            found = self._encoded([joined[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
            size = np.array([len(f) for f in found], np.int32)
            flat = np.fromiter((x for f in found for x in f), np.uint32, int(size.sum()))
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
            at = self.used + np.cumsum(size) - size
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.hashes[place[new]], self.first[place[new]], self.number[place[new]] = hashes[new], at, size
            first[missing], number[missing] = at[where], size[where]
        return first, number


def _words(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's words; kind 0 separates texts.

    Letters, numbers and signs form runs, which take one space before them. Of other white space
    the last character before a run stands alone, and what is before it is one word.
    """
    before = np.concatenate([[0], kinds[:-1]]).astype(np.uint8)
    after = np.concatenate([kinds[1:], [0]]).astype(np.uint8)
    space = kinds == _SPACE
    blank_before = np.concatenate([[False], points[:-1] == 0x20]) & (before == _SPACE)
    begins = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != 0)), (before != kinds) & ~blank_before)
    begins &= kinds != 0
    quote = np.flatnonzero(begins & (points == 0x27) & (after == _LETTER))
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        for ending in _CONTRACTED:
            held = quote[np.all([padded[quote + 1 + k] == ord(c) for k, c in enumerate(ending)], axis=0)]
            begins[held + 1] = False
            following = held + 1 + len(ending)
            begins[following[kinds[following] == _LETTER]] = True
    edges = np.flatnonzero(begins | (kinds == 0))
    is_word = kinds[edges] != 0
    return edges[is_word], np.concatenate([edges[1:], [len(points)]])[is_word]


_loaded: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document row; null text: empty."""
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for part, texts in tb.slices(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text_ids in enumerate(ids(texts)):
                all_ids = np.append(text_ids, np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(all_ids) % capacity or capacity, len(all_ids) + 1, capacity)]
                for k in range(len(cuts) - 1):
                    rows.append(i)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    crc.append(zlib.crc32(all_ids[cuts[k] : cuts[k + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(scan, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- plans from counts


def grouped(counts: np.ndarray, low: int, groups: int) -> np.ndarray:
    """Group size of each length over `low`: the largest length of its group; 0 for others.

    Groups hold about equally many pieces; pieces of one length stay together.
    """
    size = np.zeros(len(counts), np.int64)
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > low]
    if not len(lengths):
        return size
    n = counts[lengths]
    number = (np.cumsum(n) - n) * groups // n.sum()
    for g in np.unique(number):
        own = lengths[number == g]
        size[own] = own.max()
    return size


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of highest total price that fits: how many of each size.

    Size by size, over stretches of that size: each stretch builds on the one before, so a size may come any number of times.
    """
    value = np.zeros(capacity + 1)
    paying = np.flatnonzero(prices > 0)
    for k in paying.tolist():
        size, price = int(sizes[k]), prices[k]
        for c in range(size, capacity + 1, size):
            stop = min(c + size, capacity + 1)
            np.maximum(value[c:stop], value[c - size : stop - size] + price, out=value[c:stop])
    out, c = np.zeros(len(sizes), np.int64), capacity
    while value[c] > 1e-9:
        fits = paying[sizes[paying] <= c]
        k = int(fits[np.argmax(value[c - sizes[fits]] + prices[fits])])
        out[k] += 1
        c -= int(sizes[k])
    return float(prices @ out), out


def covering(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Configurations (columns), their fractional uses, and the price of each size: the optimum of the covering program.

    Column generation until no configuration pays. Of exchanges that change nothing, `STALE` for each size
    are made in a row before the program counts as settled.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    uses = wanted / np.diag(basis)
    least, stale, rounds = uses.sum(), 0, 0
    while True:
        if rounds % REFRESH == 0:
            inverse = np.linalg.inv(basis)
        rounds += 1
        prices = inverse.sum(axis=0)
        gain, column = _best_configuration(sizes, prices, capacity)
        step = inverse @ column
        up = step > 1e-9
        if gain <= 1 + 1e-7 or stale >= STALE * m or not up.any():
            return basis, uses, prices
        ratio = np.where(up, uses / np.where(up, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        uses = np.maximum(uses - ratio[leave] * step, 0)
        uses[leave] = ratio[leave]
        basis[:, leave] = column
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        stale = 0 if uses.sum() < least * (1 - 1e-12) else stale + 1
        least = min(least, uses.sum())


def configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, uses) covering exactly `wanted` pieces of each size.

    Whole parts of the uses in the covering program are taken, the rest is packed greedily, largest first.
    """
    m = len(sizes)
    if not m:
        return []
    basis, uses, _ = covering(sizes, wanted, capacity)
    plan, left = [], wanted.astype(np.int64).copy()
    for j in np.argsort(-uses):
        held = basis[:, j].astype(np.int64)
        some = held > 0
        times = int(min(np.floor(uses[j] + 1e-9), (left[some] // held[some]).min())) if some.any() else 0
        if times > 0:
            plan.append((held, times))
            left -= held * times
    order = np.argsort(-sizes)
    while left.any():
        held, room = np.zeros(m, np.int64), capacity
        for k in order:
            take = int(min(left[k], room // sizes[k]))
            held[k] = take
            room -= take * sizes[k]
        some = held > 0
        times = int((left[some] // held[some]).min())
        plan.append((held, times))
        left -= held * times
    return plan


def slots(plan: list[tuple[np.ndarray, int]], sizes: np.ndarray) -> dict[int, np.ndarray]:
    """Per size: rows (first rank, held per sequence, first sequence) in rank order."""
    out: dict[int, list] = defaultdict(list)
    rank, sequence = defaultdict(int), 0
    for held, times in plan:
        for k in np.flatnonzero(held):
            size = int(sizes[k])
            out[size].append((rank[size], int(held[k]), sequence))
            rank[size] += int(held[k]) * times
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def best_fit(free: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """Where small pieces go: free[r] sequences have room r; counts[l] pieces have length l.

    Longest first, each into the sequence with the least room that holds it; a new sequence if
    none does. Sequences of equal room are handled together, as ranges of (their room at the
    start, rank among those). Per length, rows (first rank of piece, room at the start, first
    rank of sequence, how many); new sequences have room `capacity` at the start and ranks from
    free[capacity] on. Also the number of new sequences.
    """
    rooms: list[deque] = [deque() for _ in range(capacity + 1)]
    for r in range(1, capacity + 1):
        if free[r]:
            rooms[r].append((r, 0, int(free[r])))
    opened, base = 0, int(free[capacity])
    out: dict[int, list] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        todo, rank, rows, r = int(counts[length]), 0, [], length
        while todo:
            while r <= capacity and not rooms[r]:
                r += 1
            if r > capacity:
                new = -(-todo // (capacity // length))
                rooms[capacity].append((capacity, base + opened, new))
                opened += new
                r = capacity
            origin, first, n = rooms[r].popleft()
            take = min(n, todo)
            rows.append((rank, origin, first, take))
            if take < n:
                rooms[r].appendleft((origin, first + take, n - take))
            rooms[r - length].append((origin, first, take))
            rank, todo, r = rank + take, todo - take, max(length, r - length)
        out[length] = np.array(rows, np.int64)
    return out, opened


# ---------------------------------------------------------------- ranks and places


def ranked(rows: DataFrame, key: str, spread: Column, order: list[str], name: str = "rank") -> DataFrame:
    """Rank from 0 of each row among those with its key, through `BLOCKS` blocks per key.

    Counts per (key, block) are few, as keys are lengths; they give each block its base.
    """
    rows = rows.withColumn("block", F.pmod(spread, F.lit(BLOCKS)).cast("int"))
    counts = rows.groupBy(key, "block").count()
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(key, "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(key, "block").orderBy(*order)
    numbered = rows.withColumn("within", F.row_number().over(within) - 1)
    return (
        numbered.join(F.broadcast(bases), [key, "block"])
        .withColumn(name, (F.col("within") + F.col("base")).cast("long"))
        .drop("block", "within", "base")
    )


def _looked_up(rows: DataFrame, key: str, tables: dict[int, np.ndarray], place, columns: str) -> DataFrame:
    """Rows with the columns that `place(table, ranks)` gives for their key's table; a plan is small."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    names = [c.split()[0] for c in columns.split(", ")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + columns

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            ranks = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            out = np.zeros((len(names), len(keys)), np.int64)
            for k in np.unique(keys):
                own = keys == k
                out[:, own] = place(tables[int(k)], ranks[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(o) for o in out]], names=[*batch.schema.names, *names])

    return rows.mapInArrow(scan, schema)


def _slot(table: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    row = table[np.searchsorted(table[:, 0], ranks, side="right") - 1]
    return [row[:, 2] + (ranks - row[:, 0]) // row[:, 1]]


def _room(table: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    row = table[np.searchsorted(table[:, 0], ranks, side="right") - 1]
    return [row[:, 1], row[:, 2] + ranks - row[:, 0]]


def _histogram(rows: DataFrame, column: str, capacity: int) -> np.ndarray:
    """Rows per value of a column between 0 and `capacity`."""
    out = np.zeros(capacity + 1, np.int64)
    for value, n in rows.groupBy(column).count().collect():
        out[value] = n
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """The pieces with `sequence_id` and `offset`.

    `cut` has doc_id, piece and length between 1 and `capacity`; other columns stay. Sequence
    numbers have no meaning of their own. Equal rows (repeated documents) are packed like any others; an empty table
    gives no rows. `cut` is read several times: pass a written table.
    """
    counts = _histogram(cut, "length", capacity)
    low = int(capacity * small)
    size = grouped(counts, low, groups)
    sizes = np.unique(size[size > 0])
    wanted = np.bincount(size, weights=counts, minlength=capacity + 1)[sizes].astype(np.int64) if len(sizes) else sizes
    plan = configurations(sizes, wanted, capacity)
    n_large = sum(times for _, times in plan)

    lookup = F.array(*[F.lit(int(s)) for s in size])
    spread = F.xxhash64("doc_id", "piece")
    order = ["doc_id", "piece", *[c for c in cut.columns if c not in ("doc_id", "piece", "length")]]
    large = ranked(cut.where(F.col("length") > low).withColumn("size", F.get(lookup, F.col("length").cast("int"))), "size", spread, order)
    large = cut_lineage(_looked_up(large, "size", slots(plan, sizes), _slot, "sequence_id long").select(*cut.columns, "sequence_id"))

    loads = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    free = _histogram(loads, "room", capacity)
    few = np.where(np.arange(capacity + 1) <= low, counts, 0)
    places, _ = best_fit(free, few, capacity)
    rooms = ranked(loads.where("room > 0"), "room", F.xxhash64("sequence_id"), ["sequence_id"]).withColumnRenamed("rank", "nth")
    tiny = ranked(cut.where(F.col("length") <= low), "length", spread, order)
    tiny = _looked_up(tiny, "length", places, _room, "room long, nth long").drop("rank")
    held = tiny.join(rooms, ["room", "nth"], "left").select(
        *cut.columns,
        F.coalesce("sequence_id", F.lit(n_large) + F.col("nth")).alias("sequence_id"),
    )
    every = large.unionByName(held)
    before = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("length"), *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return every.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def packed(documents: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined results: a null or empty text is one piece with the end token alone; a null doc_id and
    repeated rows are packed like any other row; columns besides the two named are not read.
    """
    return pack(cut_lineage(pieces(documents, path, capacity, doc_id=doc_id, text=text)), capacity)
