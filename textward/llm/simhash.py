"""Near-duplicate texts by SimHash fingerprints and a grid join on segment popcounts.

A fingerprint holds, for each of 64 bits, the majority over the XXH64 of all word shingles.
Two fingerprints within `RADIUS` differing bits are linked. To find them, a fingerprint is
embedded as the bit counts of its 16 four-bit segments. One differing bit moves one count by
one, so the Manhattan distance of two embeddings never exceeds the number of differing
bits. Integer points at distance 2 or less share a point at distance 1 or less from both:
each fingerprint enters the cells of its own embedding and of the 32 points next to it, an
equi-join on the cell meets every pair within the bound, and the differing bits decide.

Equal fingerprints are made one before the join, so thousands of copies cost one row. A
fingerprint has at most 2,080 others within two bits, which bounds its links whatever the
size of its group.

`near_duplicates` adds what two bits of 64 cannot see. A pair at similarity 0.8 differs in about
ten bits, and no grid of counts separates that from chance. So a text also has a few sample
fingerprints, each over its `SAMPLE` least shingle hashes under another salt: texts at
similarity s agree in one with probability s ** SAMPLE. In every group of equal
samples the text nearest to the group's majority fingerprint stands for the group, and each
other member is compared with it: the work is one comparison per text and sample, never all
pairs, and a group of edited copies meets its original because the majority undoes the
edits. All candidates, of either kind, are then held against the exact similarity.

What these leave apart is compared completely, by prefixes. All shingles have one order, rare ones first by a
sketch of their counts. Two texts at similarity t have ceil(t / (1 + t) * (a + b)) shingles in common, so their
least shingles in that order, a text's size less this number and one more, share one. Texts that
share one there, and are not connected yet, are candidates, unless their sizes or the shingle's
positions already rule the similarity out. A passage in many texts comes last in the order, so it
makes no candidates of texts that have enough besides it. Groups of very common shingles are cut
into pieces, and every piece meets every other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.session import cut_lineage, free

from . import graph
from . import textbatch as tb

#: Buckets of row hashes that are broadcast at most, to leave most texts out of a shuffle.
FILTER = 1 << 20
SEED = 42
RADIUS = 2
SAMPLES = 8
SAMPLE = 2
#: Counters of the sketch of shingle counts; they set the order of shingles, never what is compared.
COUNTERS, SEGMENT = 1 << 20, 1 << 16
#: Texts of one shingle that meet in one piece, about; and pairs that are looked at in one array.
PIECE = 4_096
PAIRS = 1_000_000
#: Marks that a set of shingles has for each of them at least.
MARKS = 4
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Every second bit, and every second pair of bits, of half a fingerprint; a one in each segment.
_PAIRS, _FOURS, _ONES = 0x55555555, 0x33333333, 0x1111111111111111


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included: lower-cased words joined by one space.

    Fewer words than `size`: one shingle of them all. No words: none.
    """
    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(size, len(words)) - 1 :]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Fingerprint: the bits set in over half the hashes; zero if there are none."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(documents: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) per row; null text: no words."""
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches):
            found = [_signed(majority(shingle_hashes(t, shingle))) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.mapInArrow(scan, f"doc_id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 16 four-bit segments, each plus one, packed into a long.

    Built from the two halves, so that no sum leaves the range of a long.
    """

    def counts(half: Column) -> Column:
        pairs = half.bitwiseAND(F.lit(_PAIRS)) + F.shiftright(half, 1).bitwiseAND(F.lit(_PAIRS))
        return pairs.bitwiseAND(F.lit(_FOURS)) + F.shiftright(pairs, 2).bitwiseAND(F.lit(_FOURS))

    low = counts(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    high = counts(F.shiftrightunsigned(fp, 32))
    return F.shiftleft(high, 32).bitwiseOR(low) + F.lit(_ONES)


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def grid_pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u < v: the pairs of different fingerprints within `radius` (at most 2) differing bits.

    `distinct` has one long column fp without repeats. Neighbouring counts stay inside their
    four bits: counts run from 1 to 5, and one step leaves them between 0 and 6. There are 33 cells a fingerprint,
    of which Spark's estimate knows nothing, so it is told not to broadcast them.
    """
    if radius > 2:
        raise ValueError("two cells next to each other reach two differing bits")
    steps = [0] + [sign << (4 * k) for k in range(16) for sign in (1, -1)]
    cells = distinct.select("fp", embedding(F.col("fp")).alias("at")).select(
        "fp", F.explode(F.array(*[F.col("at") + F.lit(s).cast("long") for s in steps])).alias("cell")
    )
    a = cells.select("cell", F.col("fp").alias("u"))
    b = cells.select("cell", F.col("fp").alias("v"))
    near = a.join(b.hint("merge"), (a.cell == b.cell) & (F.col("u") < F.col("v")) & (differing(F.col("u"), F.col("v")) <= radius))
    return near.select("u", "v").distinct()


def linked_fingerprints(documents: DataFrame, shingle: int = 3, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id per document row.

    component_id is the least doc_id reachable over links of at most `radius` differing bits,
    the row's own included.

    Defined results: null, empty and blank texts have no words, hence fingerprint zero, and are linked
    like any other; a null doc_id keeps its row but is no candidate for the least (null if a
    component has no other); repeated rows are answered for each copy; an empty table gives no rows;
    other columns are not read.
    """
    prints = cut_lineage(fingerprints(documents, shingle, doc_id, text))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut_lineage(graph.components(grid_pairs(distinct.select("fp"), radius)))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- near duplicates by exact similarity

#: One salt per sample; any fixed numbers will do.
_SALTS = tb.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def _sketch(text: str | None, shingle: int) -> tuple[int, int, int, list[int]]:
    """Two hashes of the words, the fingerprint, and the sample fingerprints."""
    words = b" ".join(WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower()))
    hashes = shingle_hashes(text, shingle)
    distinct = np.unique(hashes)
    if not len(distinct):
        samples = [0] * SAMPLES
    else:
        salted = np.sort(np.stack([_least(distinct ^ s) for s in _SALTS]), axis=1)
        with np.errstate(over="ignore"):
            total = np.zeros(SAMPLES, np.uint64)
            for k in range(salted.shape[1]):
                total = tb.mix(total * np.uint64(3) + salted[:, k])
        samples = [_signed(int(x)) for x in total]
    exact = xxhash.xxh128_intdigest(words, SEED)
    return _signed(exact >> 64), _signed(exact & (1 << 64) - 1), _signed(majority(hashes)), samples


def _node(text: str | None) -> int:
    """The first hash of the words, as in _sketch()."""
    return _signed(xxhash.xxh128_intdigest(b" ".join(WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())), SEED) >> 64)


def _least(values: np.ndarray) -> np.ndarray:
    salted = tb.mix(values)
    return salted if len(salted) <= SAMPLE else np.partition(salted, SAMPLE - 1)[:SAMPLE]


def _rows(documents: DataFrame) -> DataFrame:
    """The documents with `row`, a hash of id and text: equal for repeated rows."""
    return documents.withColumn("row", F.xxhash64("doc_id", "text"))


def _touched(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may have one of the keys (a column `row`), and those that have none.

    Keys are told apart by bucket only, so the broadcast side never exceeds `FILTER` entries; an
    exact join of the first part follows. With very many keys that part is nearly all rows.
    """
    buckets = keys.select(F.pmod("row", F.lit(FILTER)).alias("bucket"), F.lit(True).alias("hit")).distinct()
    columns = rows.columns
    flagged = rows.withColumn("bucket", F.pmod("row", F.lit(FILTER))).join(F.broadcast(buckets), "bucket", "left")
    return flagged.where("hit IS NOT NULL").select(*columns), flagged.where("hit IS NULL").select(*columns)


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """row, doc_id, two hashes of the words, fp and samples."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches):
            found = [_sketch(t, shingle) for t in texts]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            samples = pa.array([f[3] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, samples], names=["row", "doc_id", "exact_a", "exact_b", "fp", "samples"])

    return rows.select("row", "doc_id", "text").mapInArrow(scan, f"row long, doc_id {kind}, exact_a long, exact_b long, fp long, samples array<long>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """row and the distinct shingle hashes of its text."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "shingles"])

    return rows.select("row", "text").mapInArrow(scan, "row long, shingles array<long>")


def _marks(distinct: np.ndarray) -> np.ndarray:
    """A bit for the low bits of each hash, in a power of two of longs; larger marks fold to smaller ones."""
    bits = 64 << max(0, -(-MARKS * len(distinct) // 64) - 1).bit_length()
    marks = np.zeros(bits, bool)
    marks[(distinct & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").view("<i8")


def shingle_marks(rows: DataFrame, shingle: int) -> DataFrame:
    """row, the number of distinct shingles of its text, and their marks."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            columns = [pa.array([len(s) for s in sets], pa.int32()), pa.array([_marks(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["row", "size", "marks"])

    return rows.select("row", "text").mapInArrow(scan, "row long, size int, marks array<long>")


def most_common(a: str, b: str, n: str, m: str) -> Column:
    """Shingles that sets of `n` and `m` with marks `a` and `b` have in common at most: a mark that only one has is a shingle that only one has."""

    def folded(x: str, y: str) -> Column:
        small = F.size(y)
        every = F.transform(
            F.sequence(F.lit(0), small - 1),
            lambda i: F.aggregate(F.sequence(i, F.size(x) - 1, small), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseOR(F.get(x, j))),
        )
        return F.when(F.size(x) > small, every).otherwise(F.col(x))

    def alone(x: Column, y: Column) -> Column:
        own = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(own, F.lit(0), lambda acc, k: acc + k)

    x, y = folded(a, b), folded(b, a)
    return F.least(F.col(n) - alone(x, y), F.col(m) - alone(y, x))


def _sample_candidates(classes: DataFrame) -> DataFrame:
    """u, v: each text with the one that stands for its group, for every group of equal samples."""
    members = classes.select("row", "fp", F.posexplode("samples").alias("t", "sample"))
    shared = members.groupBy("t", "sample").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.getbit("fp", F.lit(k)).cast("long")).alias(f"b{k}") for k in range(64)]
    ).where("n > 1")
    bits = [F.when(2 * F.col(f"b{k}") > F.col("n"), F.lit(_signed(1 << k)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(64)]
    centre = bits[0]
    for bit in bits[1:]:
        centre = centre.bitwiseOR(bit)
    centres = shared.select("t", "sample", centre.alias("centre"))
    # Spark sizes the samples of a text as one row; neither side is for broadcasting by that estimate.
    inside = cut_lineage(members.join(centres.hint("merge"), ["t", "sample"]).select("t", "sample", "row", differing(F.col("fp"), F.col("centre")).alias("off")))
    heads = inside.groupBy("t", "sample").agg(F.min(F.struct("off", "row")).alias("head"))
    return inside.join(heads, ["t", "sample"]).select(F.col("head.row").alias("u"), F.col("row").alias("v"))


def _new_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[int, str]]:
    """Node and text of each slice's texts with words; of equal ones in a task mostly the first, to save work."""
    seen: set[int] = set()
    for _, texts in tb.slices(batches):
        new = {_node(t): t for t in texts if t}
        new = {node: t for node, t in new.items() if node not in seen and WORDS.search(t.encode("utf-8", "surrogatepass"))}
        if len(seen) > 1 << 17:
            seen.clear()
        seen.update(new)
        yield new


def _shingle_counts(documents: DataFrame, shingle: int) -> np.ndarray:
    """How many texts hold the shingles of each counter, by the lowest bits of their hash."""
    schema = "segment int, counts binary"

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["segment", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for texts in _new_texts(batches):
            for t in texts.values():
                np.add.at(total, (np.unique(shingle_hashes(t, shingle)) % np.uint64(COUNTERS)).astype(np.int64), 1)
        if total.any():
            yield rows(dict(enumerate(total.reshape(-1, SEGMENT))))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(part.as_py(), np.int64)
                total[k] = total[k] + found if k in total else found
        if total:
            yield rows(total)

    out = np.zeros(COUNTERS, np.int64)
    summed = documents.select("text").mapInArrow(count, schema).repartition(COUNTERS // SEGMENT, "segment").mapInArrow(add, schema)
    for r in summed.collect():
        out[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["counts"], np.int64)
    return out


def _overlap(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that sets of these sizes have in common at least if they are similar; rounding never adds one."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-6).astype(np.int64)


#: As what a row takes part in its piece: each `_SHORTER` meets every `_LONGER`.
_SHORTER, _LONGER = 1, 2
_PREFIX = "piece long, node long, size int, at int, parts int"


def _prefixes(documents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """One row for each shingle of each text's prefix: its piece, the text's node and size, the place in the order, and the parts taken.

    The longer text of a pair needs its places up to size - similarity * size, the shorter one fewer.
    """
    counts = _shingle_counts(documents, shingle)
    mean = int(counts.mean())
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def prefix(node: int, text: str) -> list[np.ndarray]:
        hashes = np.unique(shingle_hashes(text, shingle))
        n = len(hashes)
        often = shared.value[(hashes % np.uint64(COUNTERS)).astype(np.int64)]
        order = np.lexsort((hashes, often))[: n - int(np.ceil(similarity * n - 1e-6)) + 1]
        at = np.arange(len(order))
        least = n - int(_overlap(np.int64(n), np.int64(n), similarity))
        parts = np.where(at <= least, _SHORTER | _LONGER, _LONGER)
        key, cuts = hashes[order], 1 + np.maximum(often[order] - mean, 0) // PIECE
        out = [(key[cuts == 1], at[cuts == 1], parts[cuts == 1])]
        for k in np.flatnonzero(cuts > 1).tolist():
            n_cuts = int(cuts[k])
            own, others = node % n_cuts, np.arange(n_cuts, dtype=np.uint64)
            for role, cell in ((_SHORTER, np.uint64(own * n_cuts) + others), (_LONGER, others * np.uint64(n_cuts) + np.uint64(own))):
                if parts[k] & role:
                    size = np.full(n_cuts, at[k])
                    out.append((tb.mix(key[k] ^ tb.mix(cell + np.uint64(1))), size, np.full(n_cuts, role)))
        piece, at, parts = (np.concatenate(x) for x in zip(*out, strict=True))
        return [piece.view(np.int64), np.full(len(piece), node), np.full(len(piece), n), at, parts]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _new_texts(batches):
            found = [prefix(node, t) for node, t in texts.items()]
            if found:
                columns = [np.concatenate(x) for x in zip(*found, strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], names=["piece", "node", "size", "at", "parts"])

    return documents.select("text").mapInArrow(scan, _PREFIX)


def _whole_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by piece, no piece cut, with the first row of each."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0] == batch.column(0)[-1]:
                continue
        if not held:
            return
        table = pa.Table.from_batches(held)
        piece = table.column(0).to_numpy()
        stop = len(piece) if batch is None else int(np.searchsorted(piece, piece[-1]))
        held = table.slice(stop).to_batches()
        yield table.slice(0, stop), np.flatnonzero(np.diff(piece[:stop], prepend=piece[0] - 1 if piece[0] > 0 else piece[0] + 1))


def _differ(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, first) != np.maximum.reduceat(values, first)


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces in which two texts can meet."""
    for table, first in _whole_pieces(batches):
        keep = _differ(table.column("node").to_numpy(), first) & (np.bitwise_or.reduceat(table.column("parts").to_numpy(), first) == _SHORTER | _LONGER)
        size = np.diff(first, append=table.num_rows)
        yield from table.filter(pa.array(np.repeat(keep, size))).combine_chunks().to_batches()


def _prefix_candidates(documents: DataFrame, known: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """u, v: nodes not connected yet whose similarity the prefixes leave open.

    `known` has node and root of the nodes that are connected with others.
    """
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def by_piece(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "piece").sortWithinPartitions("piece")

    met = by_piece(_prefixes(documents, shingle, similarity)).mapInArrow(_met, _PREFIX)
    placed = met.join(known, "node", "left").select("piece", "node", "size", "at", "parts", F.coalesce("root", "node").alias("root"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_pieces(batches):
            node, size, at, parts, root = (table.column(c).to_numpy() for c in ("node", "size", "at", "parts", "root"))
            size, at = size.astype(np.int64), at.astype(np.int64)
            count = np.diff(first, append=len(node))
            begin, count = np.repeat(first, count), np.repeat(np.where(_differ(root, first), count, 0), count)
            short = np.flatnonzero((parts & _SHORTER > 0) & (count > 0))
            group = np.cumsum(count[short]) // PAIRS
            for own in np.split(short, np.flatnonzero(np.diff(group)) + 1) if len(short) else ():
                u, v = np.repeat(own, count[own]), tb.ragged(begin[own], count[own])
                ok = (root[u] != root[v]) & (parts[v] & _LONGER > 0) & (size[u] <= size[v]) & (size[u] >= similarity * size[v] - 1e-6)
                u, v = u[ok], v[ok]
                common = _overlap(size[u], size[v], similarity)
                ok = (at[u] + common <= size[u]) & (at[v] + common <= size[v])
                pairs = np.unique(np.sort(np.column_stack([node[u[ok]], node[v[ok]]]), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return by_piece(placed).mapInArrow(compare, "u long, v long").distinct()


def _similar(documents: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs of rows whose exact similarity is large enough, as a written table.

    Sizes alone rule out many pairs, marks of a few bits a shingle nearly all others. Only then the sets go to the pairs,
    and of the sets at the `u` ends, which are few, only these.
    """
    rows = _rows(documents).select("row", "text")
    wanted = cut_lineage(pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct())
    texts, _ = _touched(rows, wanted)
    # Repeated rows have equal sets; one of them is enough.
    marks = cut_lineage(shingle_marks(texts, shingle).join(wanted, "row").dropDuplicates(["row"]))
    sizes = marks.select("row", "size")
    sized = pairs.join(sizes.toDF("u", "n"), "u").join(sizes.toDF("v", "m"), "v")
    alike = cut_lineage(sized.where(F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-6).select("u", "v"))
    marked = alike.join(marks.toDF("u", "n", "a"), "u").join(marks.toDF("v", "m", "b"), "v").select("u", "v", "n", "m", most_common("a", "b", "n", "m").alias("most"))
    close = cut_lineage(marked.where(F.col("most") >= similarity * (F.col("n") + F.col("m") - F.col("most")) - 1e-6).select("u", "v"))
    free(wanted, marks, alike)

    ends = cut_lineage(close.select(F.col("u").alias("row")).union(close.select("v")).distinct())
    texts, _ = _touched(rows, ends)
    # The rows of `ends` are distinct; a semi join would be pushed below the filter and send all texts.
    sets = cut_lineage(shingle_sets(texts.join(ends, "row").dropDuplicates(["row"]), shingle))
    heads = close.select(F.col("u").alias("row")).distinct()
    firsts, _ = _touched(sets, heads)
    both = close.join(firsts.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    common = F.size(F.array_intersect("a", "b"))
    found = cut_lineage(both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"))
    free(ends, sets, close)
    return found


def near_duplicates(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """row (a hash of id and text) and `head`, the row that its group keeps.

    Two texts are linked if the Jaccard similarity of their word shingles is `similarity` or more;
    equal word sequences are always linked. A group is what links connect. It keeps the row with the least
    doc_id (null last).
    """
    sketch = cut_lineage(sketches(_rows(documents), shingle))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    firsts = cut_lineage(sketch.groupBy("exact_a", "exact_b").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("samples").alias("samples")))
    classes = firsts.select(F.col("first.row").alias("row"), "fp", "samples")

    by_print = cut_lineage(classes.groupBy("fp").agg(F.min("row").alias("row")))
    near = grid_pairs(by_print.select("fp"), radius)
    ends = by_print.select(F.col("fp"), "row")
    near = near.join(ends.select(F.col("fp").alias("u"), F.col("row").alias("a")), "u").join(ends.select(F.col("fp").alias("v"), F.col("row").alias("b")), "v")
    same = classes.select("row", "fp").join(by_print.withColumnRenamed("row", "a"), "fp").select("a", F.col("row").alias("b"))
    candidates = near.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same.toDF("u", "v")).unionByName(_sample_candidates(classes))
    # The end that stands for a group stays `u`: these are few.
    pairs = cut_lineage(candidates.where("u != v").distinct())
    free(by_print)

    links = _similar(documents, pairs, shingle, similarity)
    roots = cut_lineage(graph.components(links))
    free(pairs)

    # What is left: texts of different groups, met by their prefixes.
    nodes = cut_lineage(firsts.select(F.col("exact_a").alias("node"), F.col("first.row").alias("row")))
    known = nodes.join(roots.withColumnRenamed("node", "row"), "row").select("node", "root")
    apart = _prefix_candidates(documents, known, shingle, similarity)
    ends = apart.join(nodes.toDF("u", "a"), "u").join(nodes.toDF("v", "b"), "v")
    more = cut_lineage(ends.select(F.col("a").alias("u"), F.col("b").alias("v")))
    free(nodes)
    if not more.isEmpty():
        links = roots.toDF("u", "v").unionByName(_similar(documents, more, shingle, similarity))
        roots = cut_lineage(graph.components(links))
    free(more)

    grouped = firsts.join(roots, F.col("first.row") == F.col("node"), "left")
    grouped = grouped.select("exact_a", "exact_b", "first", F.coalesce("root", F.col("first.row")).alias("root"))
    heads = grouped.groupBy("root").agg(F.min("first").alias("kept")).select("root", F.col("kept.row").alias("head"))
    named = grouped.select("exact_a", "exact_b", "root").join(heads, "root")
    return sketch.select("row", "exact_a", "exact_b").join(named, ["exact_a", "exact_b"]).select("row", "head")


def deduplicated(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates, with the columns of documents.

    Defined results: null, empty and blank texts are equal and form one group; repeated rows are copies of each
    other, and one is kept; a null doc_id is kept only if its group has no other; no rows give none;
    extra columns are carried along.
    """
    # Own column names, whatever the documents' are called.
    docs = documents.select(
        *[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"c{k}") for k, c in enumerate(documents.columns)]
    )
    groups = cut_lineage(near_duplicates(docs, shingle, similarity))
    dropped = cut_lineage(groups.where("row != head").select("row").distinct())
    touched, untouched = _touched(_rows(docs), dropped)
    # An anti join would be pushed below the filter and send all texts.
    known = touched.join(dropped.withColumn("gone", F.lit(True)), "row", "left").where("gone IS NULL").drop("gone")
    left = untouched.unionByName(known)
    if not groups.where("row = head").groupBy("row").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["row"])
    return left.select(*docs.columns).toDF(*documents.columns)
