"""Exact top-k inner products over a bit-sliced index.

Vectors become integers, floor(256 * x). A block of rows is indexed dimension by dimension: the
value, made non-negative by an offset per dimension, is cut into bits, and bit b of dimension d over all
rows of the block is one bitmap. A query is a weight per dimension. Its score for all rows
at once is a sum of bitmaps: every set bit of a weight adds that dimension's slices, shifted;
slices of equal worth are added three at a time into a sum and a carry until one
bitmap per worth is left (a negative weight adds the complement). The result is the score as
a bit-sliced number. The k best rows are selected from its most significant slice downward: rows with the bit set
win over those without, as long as at least k candidates remain. Rows tied at the end are
the boundary; the least ids among them are kept.

Slices are quantised: only the `PRECISION` highest bits of a block's values and of a query's
weights enter the bitmaps. If that drops bits, the largest possible error widens the boundary, and
the rows inside it are settled by their exact integer scores. Vectors of common range lose
nothing.

Work is blocks of rows times blocks of queries; each pair of blocks is one row of a job, so it
spreads over any number of tasks. A pair yields at most k rows per query, and a window per query
keeps the best.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textward.session import cut_lineage

#: Rows and queries per block at most; small tables take smaller blocks of rows, to spread.
ROWS = 32_768
LEAST_ROWS = 2_048
QUERIES = 1_024
PRECISION = 14
QUANTUM = 256


def _add(slices: list[np.ndarray], words: int) -> list[np.ndarray]:
    """One bitmap per worth: slices[w] holds all bitmaps of worth 2 ** w, as rows."""
    out, carried = [], np.zeros((0, words), np.uint64)
    w = 0
    while w < len(slices) or len(carried):
        held = np.concatenate([slices[w], carried]) if w < len(slices) else carried
        up = []
        while len(held) > 2:
            n = len(held) // 3
            a, b, c = held[:n], held[n : 2 * n], held[2 * n : 3 * n]
            x = a ^ b
            up.append((a & b) | (x & c))
            held = np.concatenate([x ^ c, held[3 * n :]])
        if len(held) == 2:
            up.append((held[0] & held[1])[None])
            held = (held[0] ^ held[1])[None]
        out.append(held[0] if len(held) else np.zeros(words, np.uint64))
        carried = np.concatenate(up) if up else np.zeros((0, words), np.uint64)
        w += 1
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    """Flags, as many as a multiple of 64, packed into words."""
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _set(bitmap: np.ndarray) -> np.ndarray:
    """The rows whose bit is set."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Index:
    """The slices of one block of rows; `values` are integers, one row each."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, precision: int = PRECISION):
        self.ids, self.values = ids, values
        self.rows, self.dims = values.shape
        self.words = -(-self.rows // 64)
        self.low = values.min(axis=0)
        height = [int(h) for h in values.max(axis=0).astype(object) - self.low.astype(object)]
        bits = max(1, max(height, default=0).bit_length())
        self.dropped = max(0, bits - precision)
        self.top = [h >> self.dropped for h in height]
        raised = (values.astype(object) - self.low.astype(object)) if bits > 62 else values - self.low
        coarse = np.array(raised >> self.dropped, dtype=np.int64)
        padded = np.zeros((self.words * 64, self.dims), np.int64)
        padded[: self.rows] = coarse
        n = bits - self.dropped
        # slices[d, b]: bit b of dimension d over all rows.
        self.slices = np.zeros((self.dims, n, self.words), np.uint64)
        for d in range(self.dims):
            for b in range(n):
                self.slices[d, b] = _bits((padded[:, d] >> b) & 1 == 1)
        self.present = _bits(np.arange(self.words * 64) < self.rows)

    def top_rows(self, query: np.ndarray, k: int, left_out: int | None, precision: int = PRECISION) -> list[tuple[int, int]]:
        """(score, id) of the k best rows, by falling score, then rising id; rows with the id left out do not count."""
        weights = [int(q) for q in query]
        cut = max(0, max((abs(q) for q in weights), default=0).bit_length() - precision)
        coarse = [(abs(q) >> cut) * (1 if q >= 0 else -1) for q in weights]
        n = self.slices.shape[1]
        total = _add(self._piles(coarse, n), self.words)
        candidates = self.present.copy()
        if left_out is not None:
            own = np.zeros(self.words * 64, bool)
            own[: self.rows] = self.ids == left_out
            candidates &= ~_bits(own)
        sure, boundary, floor = self._select(total, candidates, k)
        error = self._error(weights, coarse, cut, n)
        if error:
            rows = self._at_least(total, candidates, floor - 2 * error)
        else:
            rows = _set(sure | boundary)
        return self._resolved(rows, query, k)

    def _piles(self, coarse: list[int], n: int) -> list[np.ndarray]:
        """The bitmaps to add, by worth. -c * x is c * (2 ** n - 1 - x) less a constant, so it adds complements."""
        flat = self.slices.reshape(-1, self.words)
        size = np.abs(np.array(coarse, np.int64))
        dim, bit = np.nonzero(size[:, None] >> np.arange(64)[None, :] & 1)
        place = (dim[:, None] * n + np.arange(n)[None, :]).ravel()
        worth = (bit[:, None] + np.arange(n)[None, :]).ravel()
        turned = np.where(np.array(coarse)[dim] < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)).repeat(n)
        order = np.argsort(worth, kind="stable")
        cuts = np.searchsorted(worth[order], np.arange(int(worth.max(initial=-1)) + 2))
        return [flat[place[order[a:b]]] ^ turned[order[a:b], None] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _select(self, total: list[np.ndarray], candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows surely among the k best, the rows tied for the places left, and the coarse score of these."""
        sure, open_, places, floor = np.zeros_like(candidates), candidates, k, 0
        for w in range(len(total) - 1, -1, -1):
            high = open_ & total[w]
            n = int(np.bitwise_count(high).sum())
            if n >= places:
                open_, floor = high, floor | 1 << w
            else:
                sure = sure | high
                places -= n
                open_ = open_ & ~total[w]
        return sure, open_, floor

    def _error(self, weights: list[int], coarse: list[int], cut: int, n: int) -> int:
        """How far a coarse score, in its own unit, may be from the exact one (both less their constants)."""
        if not cut and not self.dropped:
            return 0
        unit = cut + self.dropped
        loss = 0
        for q, c, top in zip(weights, coarse, self.top, strict=True):
            loss += abs(q) * ((1 << self.dropped) - 1) + ((top + 1) << self.dropped) * (abs(q) - (abs(c) << cut))
        return (loss >> unit) + 1

    def _at_least(self, total: list[np.ndarray], candidates: np.ndarray, floor: int) -> np.ndarray:
        """The candidates whose coarse score reaches the floor."""
        if floor <= 0:
            return _set(candidates)
        above, equal = np.zeros_like(candidates), candidates
        for w in range(len(total) - 1, -1, -1):
            if floor >> w & 1:
                equal = equal & total[w]
            else:
                above = above | (equal & total[w])
                equal = equal & ~total[w]
        return _set(above | equal)

    def _resolved(self, rows: np.ndarray, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Exact integer scores of a few rows, in order. Ties are broken by id, so all tied rows are here."""
        if self.values.dtype == object or query.dtype == object:
            scores = [sum(int(a) * int(b) for a, b in zip(self.values[r], query, strict=True)) for r in rows]
        else:
            scores = (self.values[rows] @ query).tolist()
        return sorted(zip(scores, self.ids[rows].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]


def integer_vectors(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the integers of the vectors that take part.

    Left out: null ids, null vectors, and vectors with a null or non-finite component. A component whose integer
    does not fit 62 bits is an error, as no score of it would fit the 64 bits of a score. Empty vectors take part; they score 0.
    """
    large = F.raise_error(F.lit("a component does not fit 62 bits after scaling")).cast("long")
    whole = lambda x: F.when(F.abs(x.cast("double")) * QUANTUM < float(1 << 62), F.floor(x.cast("double") * QUANTUM)).otherwise(large)
    scaled = F.transform(F.col(f"`{embedding}`"), whole)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    sound = F.coalesce(F.forall(F.col(f"`{embedding}`"), finite), F.lit(False))
    rows = embeddings.where(F.col(f"`{vec_id}`").isNotNull() & sound)
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), scaled.alias("v"))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Integers as a matrix; as Python numbers where sums of products might leave 64 bits."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), dims)
    return flat if not flat.size or int(np.abs(flat).max()) < 1 << 27 else flat.astype(object)


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by `every`.

    Vectors are compared within their own number of components only. Ties go to the smaller
    id. Defined results: see integer_vectors() for the vectors that take no part; repeated ids
    are repeated candidates, never of a query of their own id; a repeated query is
    answered once per distinct (id, vector); a query without candidates, and an empty table, give no rows;
    other columns are not read. Scores beyond 64 bits raise an error.
    """
    vectors = cut_lineage(integer_vectors(embeddings, vec_id, embedding).withColumn("dims", F.size("v")))
    sizes = {r["dims"]: r["count"] for r in vectors.groupBy("dims").count().collect()}
    parts = [_top_k(vectors.where(F.col("dims") == d).drop("dims"), d, n, k, every) for d, n in sorted(sizes.items())]
    if not parts:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """Rows dealt into blocks of about equal size, equal rows too: `name` and the block's ids and vectors."""
    spread = F.pmod(F.xxhash64("nth"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("nth", F.monotonically_increasing_id()).withColumn(name, spread)
    return dealt.groupBy(name).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))


def _top_k(vectors: DataFrame, dims: int, n: int, k: int, every: int) -> DataFrame:
    spread = vectors.sparkSession.sparkContext.defaultParallelism
    row_blocks = -(-n // min(ROWS, max(LEAST_ROWS, n // (2 * spread))))
    asked = cut_lineage(vectors.where(F.col("vec_id") % every == 0).distinct())
    query_blocks = max(1, -(-asked.count() // QUERIES))
    index = cut_lineage(_packed(vectors, row_blocks, "row_block"))
    queries = _packed(asked, query_blocks, "query_block").withColumnRenamed("rows", "asked")
    # Every block of queries is sent to every block of rows: an equi-join on the block's number.
    sent = queries.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    pairs = sent.join(index, "row_block").select("row_block", "rows", "asked")

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                if block != held:
                    rows = batch.column(1)[i].values
                    held, index = block, Index(rows.field(0).to_numpy(zero_copy_only=False), _matrix(rows.field(1), dims))
                asked = batch.column(2)[i].values
                out = [
                    (q, row, score)
                    for q, v in zip(asked.field(0).to_pylist(), _matrix(asked.field(1), dims), strict=True)
                    for score, row in index.top_rows(v, k, q)
                ]
                columns = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    # A pair of blocks is seconds of work: deal them out singly.
    found = pairs.repartition(row_blocks * query_blocks).mapInArrow(answer, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
