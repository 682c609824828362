"""Spelling variants: words one edit apart, each with the form that its near words suggest.

Words are maximal runs of letters. Two are near if one inserted, deleted or replaced code point
turns one into the other. The vocabulary with its counts is a table, which may be of any size; near words are
found from generated edits:

1. The words of each length go into blocked Bloom filters of at most `SHARD_WORDS` words, cut by a
   digest of the word. A filter is one array of 64-bit blocks; a word sets a few bits of one block.
2. As many filters as fit in `PASS_BYTES` are broadcast at a time. Every word makes its deletions and, position by
   position, its replacements by larger letters of the alphabet; each pair of near words comes up exactly once that
   way. Digests of the edits follow from that of the word by arithmetic on whole arrays.
3. Edits that the filters hold, true ones and a few false, are spelled and joined with the vocabulary.

A larger vocabulary takes more filters and more passes, never a larger broadcast. The alphabet is that of
the word pattern, a constant.

Defined cases: null and empty texts have no words; repeated rows count as often as they stand; a null id reads as
an empty one when the contract's marked runs lose a code point; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.session import cut_lineage

from . import textbatch as tb

#: Fixed: runs of these letters are words; only A-Z are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], dtype=np.uint32)
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
MARKED = 199

SHARD_WORDS = 1 << 20
BITS = 16
PASS_BYTES = 32 << 20
#: Words of a task's counter before it is passed on, and edits generated at once.
COUNTER, EDITS = 400_000, 2_000_000
_LOWER = {c: c + 32 for c in range(65, 91)}
_BASE = 0x9E3779B97F4A7C15


def words_of(doc_id: int | None, text: str | None, counts: Counter, marked: int | None) -> None:
    """Add the words of a text; a run whose checksum `marked` divides loses a code point."""
    runs: Counter = Counter()
    for run, n in Counter(RUN.findall(text or "")).items():
        runs[run.translate(_LOWER)] += n
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        if len(run) < LEAST_LENGTH:
            continue
        if marked:
            h = zlib.crc32(run.encode(), prefix)
            if h % marked == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
        counts[run] += n


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", marked: int | None = None) -> DataFrame:
    """`word`, `n`: words of at least LEAST_LENGTH code points with at least LEAST_COUNT occurrences in all texts."""

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part, texts in tb.slices(batches, "text"):
            for doc_id, t in zip(part.column(0).to_pylist(), texts):
                words_of(doc_id, t, counts, marked)
            if len(counts) > COUNTER:
                yield batch(counts)
                counts = Counter()
        yield batch(counts)

    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = _BASE
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _terms(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points and mixed code points of words of one length, one row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
    return points, tb.mix(points)


def _digests(terms: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """A sum over positions, so that an edit changes it by a few terms."""
    with np.errstate(over="ignore"):
        return (terms * powers[: terms.shape[1]]).sum(axis=1, dtype=np.uint64)


def _bits(mixed: np.ndarray) -> np.ndarray:
    """Four bits of a block."""
    out = np.zeros(len(mixed), np.uint64)
    for k in (0, 6, 12, 18):
        out |= np.uint64(1) << ((mixed >> np.uint64(k)) & np.uint64(63))
    return out


class Shards:
    """How the words of each length are cut: `parts[length]` filters of `blocks[length]` blocks each."""

    def __init__(self, counts: dict[int, int], shard_words: int = SHARD_WORDS):
        self.parts = {n: -(-c // shard_words) for n, c in counts.items()}
        self.blocks = {n: max(1, -(-c * BITS // self.parts[n] // 64)) for n, c in counts.items()}

    def place(self, length: int, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filter number, block and bits of words given by their digests."""
        mixed = tb.mix(digest + np.uint64(length))
        part = (mixed >> np.uint64(24)) % np.uint64(self.parts[length])
        block = tb.mix(mixed) % np.uint64(self.blocks[length])
        return part.astype(np.int64), block.astype(np.int64), _bits(mixed)

    def passes(self, budget: int) -> Iterator[list[tuple[int, int]]]:
        """Filters, as (length, number), in lots of at most `budget` bytes."""
        lot, size = [], 0
        for length in sorted(self.parts):
            for part in range(self.parts[length]):
                need = 8 * self.blocks[length]
                if lot and size + need > budget:
                    yield lot
                    lot, size = [], 0
                lot.append((length, part))
                size += need
        if lot:
            yield lot


def _by_length(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths).tolist():
            yield n, [words[k] for k in np.flatnonzero(lengths == n).tolist()]


def _filter_rows(vocab: DataFrame, shards: Shards) -> DataFrame:
    """`length`, `part`, `block`, `bits`: the non-empty blocks of all filters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, words in _by_length(batches):
            _, terms = _terms(words, length)
            part, block, bits = shards.place(length, _digests(terms, _powers(length)))
            columns = [pa.array(np.full(len(words), length), pa.int32()), pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(bits.view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["length", "part", "block", "bits"])

    rows = vocab.select("word").mapInArrow(run, "length int, part int, block long, bits long")
    return rows.groupBy("length", "part", "block").agg(F.bit_or("bits").alias("bits"))


def _filters(rows: DataFrame, shards: Shards, lot: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The filters of one lot; together they take at most PASS_BYTES."""
    low, high = lot[0], lot[-1]
    order = F.struct("length", "part")
    bound = lambda x: F.struct(F.lit(x[0]).alias("length"), F.lit(x[1]).alias("part"))
    table = rows.where((order >= bound(low)) & (order <= bound(high))).toArrow()
    length, part, block, bits = (table.column(n).to_numpy() for n in ("length", "part", "block", "bits"))
    out = {}
    for n, p in lot:
        mine = (length == n) & (part == p)
        out[n, p] = np.zeros(shards.blocks[n], np.uint64)
        out[n, p][block[mine]] = bits[mine].view(np.uint64)
    return out


def _held(filters: dict, shards: Shards, length: int, digest: np.ndarray) -> np.ndarray:
    """Places of the digests that a filter of this lot holds."""
    part, block, bits = shards.place(length, digest)
    hit = np.zeros(len(digest), bool)
    for (n, p), table in filters.items():
        if n == length:
            mine = np.flatnonzero(part == p) if shards.parts[n] > 1 else slice(None)
            hit[mine] = (table[block[mine]] & bits[mine]) == bits[mine]
    return np.flatnonzero(hit)


def _probed(filters: dict, shards: Shards, length: int, words: list[str]) -> Iterator[tuple[str, str]]:
    """(word, edit) for each deletion and each replacement by a larger letter that a filter holds."""
    lengths = {n for n, _ in filters}
    points, terms = _terms(words, length)
    powers = _powers(length)
    with np.errstate(over="ignore"):
        placed = terms * powers[:length]
        whole = placed.sum(axis=1, dtype=np.uint64)
        if length - 1 in lengths:
            before = np.cumsum(placed, axis=1, dtype=np.uint64) - placed
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            after = (whole[:, None] - before - placed) * inverse
            # Of a run of equal letters, deleting the first makes the same word as any other.
            first = np.ones(points.shape, bool)
            first[:, 1:] = points[:, 1:] != points[:, :-1]
            w, i = np.nonzero(first)
            at = _held(filters, shards, length - 1, (before + after)[w, i])
            for a, b in zip(w[at].tolist(), i[at].tolist()):
                yield words[a], words[a][:b] + words[a][b + 1 :]
        if length in lengths:
            letters = tb.mix(ALPHABET)
            for i in range(length):
                rest = whole - placed[:, i]
                digest = rest[:, None] + letters[None, :] * powers[i]
                w, c = np.nonzero(ALPHABET[None, :] > points[:, i : i + 1])
                at = _held(filters, shards, length, digest[w, c])
                for a, b in zip(w[at].tolist(), c[at].tolist()):
                    yield words[a], words[a][:i] + chr(ALPHABET[b]) + words[a][i + 1 :]


def near_pairs(vocab: DataFrame, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """`word`, `n`, `near`, `near_n`: each pair of near words of the vocabulary once."""
    spark = vocab.sparkSession
    lengths = {r["length"]: r["count"] for r in vocab.groupBy(F.length("word").alias("length")).count().collect()}
    shards = Shards(lengths, shard_words)
    rows = cut_lineage(_filter_rows(vocab, shards))
    found = spark.createDataFrame([], "word string, n long, near string")
    for lot in shards.passes(pass_bytes):
        sent = spark.sparkContext.broadcast(_filters(rows, shards, lot))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                for length, words in _by_length([batch]):
                    step = max(1, EDITS // (length * len(ALPHABET)))
                    for a in range(0, len(words), step):
                        pairs = list(_probed(sent.value, shards, length, words[a : a + step]))
                        columns = [pa.array([w for w, _ in pairs], pa.string()), pa.array([number[w] for w, _ in pairs], pa.int64()), pa.array([e for _, e in pairs], pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, ["word", "n", "near"])

        reach = [n for n in {n for n, _ in lot} | {n + 1 for n, _ in lot} if n in lengths]
        words = vocab.select("word", "n").where(F.length("word").isin(reach))
        found = found.unionByName(words.mapInArrow(run, "word string, n long, near string"))
    exact = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(exact, "near").select("word", "n", "near", "near_n")


def variants(vocab: DataFrame, **limits: int) -> DataFrame:
    """`word`, `n`, `n_near`, `form`, `form_n`, `root` for each word of a vocabulary (`word`, `n`).

    The form of a word is its near word of greatest n (the first in code-point order of equal ones), if that n is at least TIMES
    its own. n grows TIMES-fold with each step, so a chain of forms is short; its end is found by
    doubling steps.
    """
    vocab = cut_lineage(vocab.select("word", "n"))
    pairs = near_pairs(vocab, **limits)
    both = pairs.unionByName(pairs.selectExpr("near AS word", "near_n AS n", "word AS near", "n AS near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    large = -F.col("best.less") >= TIMES * F.col("n")
    forms = cut_lineage(
        vocab.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(large, F.col("best.near")).alias("form"),
            F.when(large, -F.col("best.less")).alias("form_n"),
        )
    )
    steps = cut_lineage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut_lineage(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return forms.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
