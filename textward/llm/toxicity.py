"""Toxic texts by subword bags: n-gram vectors averaged into a linear softmax.

A word is wrapped in boundary signs and taken as its character n-grams of 3 to 5 and as a whole,
each hashed to a bucket that owns a small vector. A text is the mean vector of all its
n-grams; a linear softmax on it gives the score. Vectors and softmax are trained jointly, in
numpy, by gradient steps over minibatches. A misspelled word shares most n-grams with the word it stands for, so
it lands near it without having been seen.

Training reads a bounded sample of labelled rows (`SAMPLE`, those with the least hash of
their id) in one task. Scoring is a projection over all rows: mean and softmax are linear
in the vectors, so each bucket reduces to one number, and that table (512 kB) is what the
tasks receive.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .sampling import least_hashed

#: Training rows at most; fewer if fewer are labelled.
SAMPLE = 6_000
BUCKETS = 1 << 17
SIZE = 8
GRAMS = (3, 4, 5)
EPOCHS = 8
#: Rows per gradient step at most; fewer rows take smaller steps, so that there are about STEPS of them.
BATCH = 256
STEPS = 190
RATE = 0.3
#: Means of thousands of n-grams are small; the softmax sees them enlarged.
GAIN = 64.0
THRESHOLD = 0.3
#: The bias of a model that has seen no labelled row.
NEVER = -1e6
#: N-grams of an average clean text that every text is averaged with: a few words are little evidence.
NEUTRAL = 200.0

#: Letters, digits, everything beyond ASCII, and signs that stand in for letters.
_WORD = tb.class_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, tb.POINTS - 1), (0x24, 0x24), (0x2A, 0x2A), (0x40, 0x40))
_BEGIN, _END = 0x3C, 0x3E


def _subwords(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of each n-gram of the given words."""
    lengths = ends - starts + 2
    last = np.cumsum(lengths)
    first = last - lengths
    wrapped = np.empty(int(last[-1]) if len(last) else 0, np.uint32)
    wrapped[first] = _BEGIN
    wrapped[last - 1] = _END
    wrapped[tb.ragged(first + 1, ends - starts)] = points[tb.ragged(starts, ends - starts)]
    words, hashes = [np.arange(len(starts))], [tb.span_hashes(wrapped, first, last)]
    for n in GRAMS:
        count = np.maximum(lengths - n + 1, 0) * (lengths != n)  # the whole word is there already
        at = tb.ragged(first, count)
        words.append(np.repeat(np.arange(len(starts)), count))
        hashes.append(tb.span_hashes(wrapped, at, at + n))
    return np.concatenate(words), (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text and the n-grams of each word.

    Text, word and weight of every (text, word) that occurs, the weight growing slower than how
    often: a word repeated a thousand times does not drown the others. Then word and bucket of every n-gram,
    by word, and the n-grams per word.
    """
    points = tb.Points([(t or "").lower() for t in texts])
    starts, ends, owner = points.runs(_WORD)
    _, pick, word = np.unique(tb.span_hashes(points.points, starts, ends), return_index=True, return_inverse=True)
    pair, times = np.unique(owner * max(1, len(pick)) + word, return_counts=True)
    gram_word, bucket = _subwords(points.points, starts[pick], ends[pick])
    order = np.argsort(gram_word, kind="stable")
    n = np.bincount(gram_word, minlength=len(pick))
    return pair // max(1, len(pick)), pair % max(1, len(pick)), times**0.75, gram_word[order], bucket[order], n


class Model:
    """What scoring needs: a number per bucket, that of an average clean n-gram, and a bias."""

    def __init__(self, weights: np.ndarray, clean: float, bias: float):
        self.weights, self.clean, self.bias = weights, clean, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        owner, word, weight, gram_word, bucket, n = _bags(texts)
        per_word = np.bincount(gram_word, weights=self.weights[bucket], minlength=len(n))
        total = np.bincount(owner, weights=weight * per_word[word], minlength=len(texts))
        grams = np.bincount(owner, weights=weight * n[word], minlength=len(texts))
        margin = GAIN * (total + NEUTRAL * self.clean) / (grams + NEUTRAL) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


class Bags:
    """The sampled texts as rows of (bucket, share); a text of any length takes BUCKETS entries at most."""

    def __init__(self):
        self.buckets: list[np.ndarray] = []
        self.shares: list[np.ndarray] = []

    def add(self, texts: list[str | None]) -> None:
        owner, word, weight, _, bucket, n = _bags(texts)
        first = np.cumsum(n) - n
        at = tb.ragged(first[word], n[word])
        key, where = np.unique(np.repeat(owner, n[word]) * BUCKETS + bucket[at], return_inverse=True)
        mass = np.bincount(where, weights=np.repeat(weight, n[word]), minlength=len(key))
        cuts = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.buckets.append((key[a:b] % BUCKETS).astype(np.int32))
            self.shares.append((mass[a:b] / (mass[a:b].sum() + NEUTRAL)).astype(np.float32))


def train(bags: Bags, labels: np.ndarray, seed: int = 7) -> Model:
    """Vectors and softmax together, by adaptive gradient steps on the cross-entropy."""
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((BUCKETS, SIZE)) * 0.1).astype(np.float32)
    softmax = (rng.standard_normal((SIZE, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full_like(p, 1e-6) for p in (vectors, softmax, bias)]
    n = len(labels)
    if not n:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, NEVER)
    batch = min(BATCH, max(8, n * EPOCHS // STEPS))
    padded = np.array([1 - s.sum() for s in bags.shares], np.float32)
    clean = np.zeros(SIZE, np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        # The average clean n-gram follows the vectors, one epoch behind.
        clean = _mean_vector(vectors, bags, np.flatnonzero(labels == 0))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            sizes = np.array([len(bags.buckets[r]) for r in rows])
            bucket = np.concatenate([bags.buckets[r] for r in rows])
            share = np.concatenate([bags.shares[r] for r in rows])
            row = np.repeat(np.arange(len(rows)), sizes)
            used, where = np.unique(bucket, return_inverse=True)
            own = vectors[used]
            hidden = np.stack([np.bincount(row, weights=share * own[where, k], minlength=len(rows)) for k in range(SIZE)], axis=1)
            hidden = GAIN * (hidden + padded[rows, None] * clean)
            logits = hidden @ softmax + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            back = GAIN * (p @ softmax.T)
            slope = np.stack([np.bincount(where, weights=share * back[row, k], minlength=len(used)) for k in range(SIZE)], axis=1)
            seen[0][used] += slope**2
            vectors[used] = own - rate * slope / np.sqrt(seen[0][used])
            for p_, s_, g in ((softmax, seen[1], hidden.T @ p), (bias, seen[2], p.sum(axis=0))):
                s_ += g**2
                p_ -= rate * g / np.sqrt(s_)
    step = softmax[:, 1] - softmax[:, 0]
    return Model((vectors @ step).astype(np.float32), float(clean @ step), float(bias[1] - bias[0]))


def _mean_vector(vectors: np.ndarray, bags: Bags, rows: np.ndarray) -> np.ndarray:
    """The mean vector of the n-grams of some of the texts."""
    mass = np.zeros(BUCKETS)
    for r in rows:
        mass[bags.buckets[r]] += bags.shares[r]
    return ((mass @ vectors) / max(mass.sum(), 1e-9)).astype(np.float32)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows key, text, label (0 or 1); rows with a null label or key are no evidence.

    The `sample` rows with the least hash of their key are read, all by one task, which returns the model
    alone. Without any rows nothing is known to be toxic, and every text scores 0.
    """
    usable = labelled.where("label IS NOT NULL AND key IS NOT NULL")
    chosen = usable.select("key", F.col("label").cast("int").alias("label"), "text").orderBy(F.xxhash64("key"), "key").limit(sample)

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, labels = Bags(), []
        for part, texts in tb.slices(batches):
            bags.add(texts)
            labels += part.column(part.schema.get_field_index("label")).to_pylist()
        model = train(bags, np.array(labels, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.clean]), pa.array([model.bias])], names=["weights", "clean", "bias"]
        )

    row = chosen.select("label", "text").coalesce(1).mapInArrow(learn, "weights binary, clean double, bias double").first()
    return Model(np.frombuffer(row["weights"], np.float32), row["clean"], row["bias"]) if row else train(Bags(), np.zeros(0, np.int64))


def score(documents: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",), result: str = "toxicity") -> DataFrame:
    """The `carry` columns of each row and `result`: its score between 0 and 1.

    Defined results: a null, empty or wordless text scores like an average clean one; repeated rows
    score alike; no rows give none. Other columns are not read, and carried ones may have any names but the result's.
    """
    wanted = [c for c in carry if c != text]
    docs = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(wanted)], F.col(f"`{text}`").alias("text"))
    kept = [f"c{k}" for k in range(len(wanted))] + (["text"] if text in carry else [])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches):
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.score(texts))], names=[*kept, "score"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept) + ", score double"
    scored = docs.mapInArrow(apply, schema)
    place = {c: f"c{k}" for k, c in enumerate(wanted)} | {text: "text"}
    return scored.select(*[F.col(place[c]).alias(c) for c in carry], F.col("score").alias(result))


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """key, text, label of the rows that may be learned from: at most `SAMPLE` keys meet the texts."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    few = least_hashed(known, "doc_id", SAMPLE)
    return documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.col("doc_id").alias("key"), "text", "label")


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document rows that score below the threshold, with the columns of documents."""
    model = fit(labelled_documents(documents, labels))
    name = tb.fresh(documents.columns, "toxicity")
    scored = score(documents, model, carry=tuple(documents.columns), result=name)
    return scored.where(F.col(name) < threshold).drop(name)
