"""Language of a text by interpolated Kneser-Ney character models, one per language.

Training counts every four-character gram of every word of every row that may be learned from:
tasks pre-count, Spark sums. The lower orders count in how many different grams a shorter one
ends, as Kneser and Ney have it, and each order gives up a discount that the next lower
one shares out. These are joins and sums over gram tables, keyed by (language, gram).

The model of a language is a set of sorted arrays: gram, log probability; context, log of the
share it hands down. Every gram is kept. Tasks look grams up by binary search. Languages are sent in blocks
of bounded size, and a language with more entries in slices: all that a gram asks for but its last character
holds the character before that, so a slice has the entries of some of these. Each slice of texts goes through the blocks
one by one, and adds up the log probabilities of the slices of a language.

The answer is the language of least cross-entropy per character. A text that its language
predicts worse than almost all learnable rows of that answer is marked `rejected`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.ranking import blocked_running_sum
from textward.session import cut_lineage

from . import textbatch as tb

ORDER = 4
#: Entries of a block, and of a language in it that is not sliced. A slice has at least one character before the last.
BLOCK_ENTRIES = 3_000_000
SLICE_ENTRIES = 3_000_000
#: Share of the learnable rows that may be rejected, and the step of cross-entropy in which they are ranked.
REJECTED = 0.002
STEP = 0.001
#: A character takes 12 bits of a packed gram; rare ones beyond 4,093 share a code.
BITS, MASK, FOLD = 12, 0xFFF, 4093
_BEGIN, _END = 4094, 4095
#: Sharpness of the score.
SCALE = 6.0

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(tb.POINTS)), dtype=bool, count=tb.POINTS)
    return _letters


def _grams(texts: list[str | None], group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Owner and number of each word, and the word and packed gram of each gram of each distinct word.

    A word is a run of letters, lower-cased; it begins after `ORDER - 1` begin signs and closes with an end sign.
    """
    points = tb.Points([(t or "").lower() for t in texts])
    starts, ends, owner = points.runs(_letter_table())
    hashes = tb.span_hashes(points.points, starts, ends)
    _, pick, word = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts[pick], ends[pick]
    sizes = ends - starts + ORDER
    last = np.cumsum(sizes)
    first = last - sizes
    codes = np.full(int(last[-1]) if len(last) else 0, _BEGIN, np.int64)
    codes[tb.ragged(first + ORDER - 1, ends - starts)] = points.points[tb.ragged(starts, ends - starts)] % FOLD
    codes[last - 1] = _END
    count = sizes - ORDER + 1
    at = tb.ragged(first, count)
    gram = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        gram = gram << BITS | codes[at + k]
    return owner, word, np.repeat(np.arange(len(pick)), count), gram


def _counted(batches: Iterable[pa.RecordBatch], languages: str = "lang") -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), merged inside the task before it leaves."""
    names: dict[str, int] = {}
    keys, counts, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate(keys) if keys else np.zeros((0, 2), np.int64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        order = np.lexsort((key[:, 1], key[:, 0]))
        key, n = key[order], n[order]
        new = np.flatnonzero(np.any(np.diff(key, axis=0, prepend=np.full((1, 2), -1)), axis=1))
        return key[new], np.add.reduceat(n, new) if len(new) else n

    def batch(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = list(names)
        lang = pa.DictionaryArray.from_arrays(pa.array(key[:, 0].astype(np.int32)), pa.array(order, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, pa.array(key[:, 1]), pa.array(n)], names=["lang", "gram", "n"])

    for part, texts in tb.slices(batches):
        langs = part.column(part.schema.get_field_index(languages)).to_pylist()
        lang = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
        owner, word, gram_word, gram = _grams(texts)
        n_words = max(1, int(word.max(initial=-1)) + 1)
        pair, times = np.unique(lang[owner] * n_words + word, return_counts=True)
        first = np.searchsorted(gram_word, np.arange(n_words))
        size = np.bincount(gram_word, minlength=n_words)
        of, w = pair // n_words, pair % n_words
        at = tb.ragged(first[w], size[w])
        for x in np.unique(of):
            own = np.repeat(of == x, size[w])
            key, where = np.unique(gram[at[own]], return_inverse=True)
            total = np.bincount(where, weights=np.repeat(times, size[w])[own], minlength=len(key)).astype(np.int64)
            keys.append(np.column_stack([np.full(len(key), x, np.int64), key]))
            counts.append(total)
            held += len(key)
        if held > 1_500_000:
            key, n = merged()
            if len(key) > 750_000:
                yield batch(key, n)
                key, n = key[:0], n[:0]
            keys, counts, held = [key], [n], len(key)
    key, n = merged()
    if len(key):
        yield batch(key, n)


def model_tables(texts: DataFrame) -> DataFrame:
    """lang, level, context (or gram), key, value, n: all entries of all models.

    `texts` has lang and text. Null languages or texts say nothing.
    """
    known = texts.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    top = known.mapInArrow(_counted, "lang string, gram long, n long")
    level = cut_lineage(top.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    levels = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        levels[k] = levels[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    lower = None
    entries = []
    for k in range(1, ORDER + 1):
        grams = levels[k].withColumn("context", F.shiftright("gram", BITS)).withColumn(
            "tail", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))
        )
        once = levels[k].groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2"))
        # One row per language; the discount stays inside (0, 1) where counts of one or two are missing.
        discount = once.select("lang", ((F.col("n1") + 0.5) / (F.col("n1") + 2 * F.col("n2") + 1)).alias("d"))
        contexts = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(discount, "lang")
        contexts = contexts.withColumn("share", F.col("d") * F.col("kinds") / F.col("total"))
        seen = grams.join(contexts, ["lang", "context"])
        if lower is None:
            seen = seen.withColumn("p0", F.lit(1.0 / (1 << BITS)))
        else:
            seen = seen.join(lower, ["lang", "tail"])
        seen = cut_lineage(
            seen.select("lang", "gram", "n", ((F.col("n") - F.col("d")) / F.col("total") + F.col("share") * F.col("p0")).alias("p"))
        )
        lower = seen.select("lang", F.col("gram").alias("tail"), F.col("p").alias("p0"))
        entries.append(seen.select("lang", F.lit(k).alias("level"), F.lit(False).alias("context"), F.col("gram").alias("key"), F.log("p").alias("value"), "n"))
        entries.append(
            contexts.select("lang", F.lit(k).alias("level"), F.lit(True).alias("context"), F.col("context").alias("key"), F.log("share").alias("value"), F.col("total").alias("n"))
        )
    every = entries[0]
    for e in entries[1:]:
        every = every.unionByName(e)
    return every


def _before_last(level: Column, context: Column, key: Column) -> Column:
    """The character before the last one of the gram of an entry; null for a single character, which has none."""
    return F.when(context & (level > 1), key.bitwiseAND(F.lit(MASK))).when(~context & (level > 1), F.shiftright(key, BITS).bitwiseAND(F.lit(MASK)))


class Models:
    """A block of languages as sorted arrays.

    A language may be a slice: the grams whose character before the last lies in `ranges`, from the first to before the
    second. `last` tells whether no further slice follows.
    """

    def __init__(self, rows: pa.Table, ranges: dict[str, tuple[int, int]] | None = None, last: bool = True):
        self.languages = sorted(set(rows.column("lang").to_pylist()))
        self.ranges, self.last = ranges or {}, last
        lang = np.array(rows.column("lang").to_pylist(), dtype=object)
        level, context = rows.column("level").to_numpy(), rows.column("context").to_numpy()
        key, value = rows.column("key").to_numpy(), rows.column("value").to_numpy().astype(np.float32)
        self.tables = {}
        for x in self.languages:
            own = lang == x
            for k in range(1, ORDER + 1):
                for c in (False, True):
                    at = own & (level == k) & (context == c)
                    order = np.argsort(key[at])
                    self.tables[x, k, c] = key[at][order], value[at][order]

    def _find(self, table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[1][at]

    def log_p(self, lang: str, gram: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last character after the ones before it."""
        out = np.full(len(gram), -BITS * np.log(2.0))
        for k in range(1, ORDER + 1):
            key = gram & ((1 << (BITS * k)) - 1)
            known, share = self._find(self.tables[lang, k, True], key >> BITS)
            out += np.where(known, share, 0)
            seen, p = self._find(self.tables[lang, k, False], key)
            out = np.where(seen, p, out)
        return out

    def totals(self, texts: Grams) -> np.ndarray:
        """Per text and language: the log probability of the text's grams that are in the language's range."""
        out = np.zeros((texts.n, len(self.languages)))
        for j, lang in enumerate(self.languages):
            log_p = self.log_p(lang, texts.kinds)
            if lang in self.ranges:
                low, high = self.ranges[lang]
                before = texts.kinds >> BITS & MASK
                log_p = np.where((before >= low) & (before < high), log_p, 0)
            out[:, j] = texts.summed(log_p)
        return out


class Grams:
    """The grams of some texts, each distinct one once."""

    def __init__(self, texts: list[str | None]):
        self.n = len(texts)
        self.owner, self.word, self.gram_word, gram = _grams(texts)
        self.n_words = int(self.word.max(initial=-1)) + 1
        self.kinds, self.where = np.unique(gram, return_inverse=True)
        size = np.bincount(self.gram_word, minlength=self.n_words)
        self.length = np.bincount(self.owner, weights=size[self.word], minlength=self.n)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Per text: the sum of the values of its grams, given per distinct gram."""
        per_word = np.bincount(self.gram_word, weights=values[self.where], minlength=self.n_words)
        return np.bincount(self.owner, weights=per_word[self.word], minlength=self.n)


def _models(tables: DataFrame, languages: list[str]) -> Models:
    return Models(tables.where(F.col("lang").isin(languages)).drop("n").toArrow())


def _blocks(tables: DataFrame) -> Iterator[Models]:
    """Languages in blocks of at most `BLOCK_ENTRIES` entries; one with over `SLICE_ENTRIES` in blocks of its own."""
    sizes = [(r["lang"], r["count"]) for r in tables.groupBy("lang").count().orderBy("lang").collect()]
    block, held = [], 0
    for lang, n in sizes:
        if block and (held + n > BLOCK_ENTRIES or n > SLICE_ENTRIES):
            yield _models(tables, block)
            block, held = [], 0
        if n > SLICE_ENTRIES:
            yield from _sliced(tables.where(F.col("lang") == lang), lang)
        else:
            block.append(lang)
            held += n
    if block:
        yield _models(tables, block)


def _sliced(tables: DataFrame, lang: str) -> Iterator[Models]:
    """One language in slices of about `SLICE_ENTRIES` entries, and all single characters in each."""
    before = _before_last(F.col("level"), F.col("context"), F.col("key"))
    counts = tables.where(before.isNotNull()).groupBy(before.alias("before")).count().orderBy("before").collect()
    starts, held = [0], 0
    for r in counts:
        if held and held + r["count"] > SLICE_ENTRIES:
            starts.append(r["before"])
            held = 0
        held += r["count"]
    for low, high in zip(starts, [*starts[1:], MASK + 1], strict=True):
        rows = tables.where(before.isNull() | (before >= low) & (before < high)).drop("n").toArrow()
        yield Models(rows, {lang: (low, high)}, high > MASK)


def _one_by_one(shared: list[Broadcast]) -> Iterator[Models]:
    """The blocks; of several, a task holds one at a time and reads it again from its broadcast's file."""
    for block in shared:
        yield block.value
        if len(shared) > 1 and getattr(block, "_path", None) is not None:
            vars(block).pop("_value", None)


def _judged(rows: DataFrame, models: Iterable[Models]) -> DataFrame:
    """Rows with the best language, its cross-entropy, and the sum for the score."""
    shared = [rows.sparkSession.sparkContext.broadcast(m) for m in models]
    kept = rows.columns

    # Several blocks are read for each slice, so there are fewer slices.
    limit = tb.CHUNK * (8 if len(shared) > 1 else 1)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches, limit=limit):
            grams = Grams(texts)
            best = np.full(len(texts), None, object)
            lowest, mass, total = np.full(len(texts), np.inf), np.zeros(len(texts)), 0
            for block in _one_by_one(shared):
                total = total + block.totals(grams)
                if not block.last:
                    continue
                # Nats per character; infinite for a text without letters.
                ce = np.where(grams.length[:, None] > 0, -total / np.maximum(grams.length, 1)[:, None], np.inf)
                total = 0
                at = ce.argmin(axis=1)
                least, old = ce[np.arange(len(texts)), at], lowest
                better = least < old
                best[better] = np.array(block.languages, object)[at[better]]
                lowest = np.where(better, least, old)
                with np.errstate(invalid="ignore"):
                    mass = np.exp(-SCALE * (ce - lowest[:, None])).sum(axis=1) + mass * np.exp(-SCALE * (old - lowest))
                mass = np.where(np.isfinite(lowest), mass, 0)
            new = {"best": pa.array(best.tolist(), pa.string()), "ce": pa.array(lowest), "mass": pa.array(mass)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(part.schema.get_field_index(c)) for c in kept], names=kept)

    return rows.mapInArrow(judge, rows.schema)


def predict(
    documents: DataFrame, models: Iterable[Models], doc_id: str = "doc_id", text: str = "text", also: Iterable[str] = ()
) -> DataFrame:
    """doc_id, lang_pred, score and cross_entropy per row, and the columns `also`.

    Defined results: a null text or one without a letter is `und` with score 0 and no cross-entropy, and so is
    every text if nothing was learned; repeated rows are answered for each copy; no rows give
    none; other columns are not read.
    """
    also = list(also)
    rows = documents.select(
        *also,
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
        F.lit(None).cast("string").alias("best"),
        F.lit(float("inf")).alias("ce"),
        F.lit(0.0).alias("mass"),
    )
    rows = _judged(rows, models)
    return rows.select(
        "doc_id",
        F.coalesce("best", F.lit("und")).alias("lang_pred"),
        F.when(F.col("best").isNull(), 0.0).otherwise(1 / F.col("mass")).alias("score"),
        F.when(F.col("best").isNotNull(), F.col("ce")).alias("cross_entropy"),
        *also,
    )


def learnable() -> Column:
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()


def learned(documents: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return documents.where(learnable())


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def limits(found: DataFrame) -> DataFrame:
    """lang_pred and `most`: the least cross-entropy that all but `REJECTED` of the rows of each answer stay within.

    It is exact: distinct values with counts, whose running counts are cut into blocks of `STEP`.
    """
    known = found.where(F.col("cross_entropy").isNotNull())
    counted = known.groupBy("lang_pred", "cross_entropy").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("lang_pred").agg(F.sum("n").alias("total"))
    running = blocked_running_sum(
        counted, ["lang_pred"], F.floor(F.col("cross_entropy") / STEP), ["cross_entropy"], F.col("n"), "upto"
    )
    within = F.col("total") - F.col("upto") <= F.col("total") * REJECTED
    return running.join(totals, "lang_pred").where(within).groupBy("lang_pred").agg(F.min("cross_entropy").alias("most"))


def identify(documents: DataFrame) -> DataFrame:
    """predict() with models of the documents' own learnable rows, and `rejected`.

    The limit of each language is the cross-entropy that all but `REJECTED` of the learnable rows with this
    answer stay within; a language without such rows rejects nothing. Texts are read once for this.
    """
    models = _blocks(cut_lineage(model_tables(learned(documents))))
    own = tb.fresh(documents.columns, "own")
    found = cut_lineage(predict(documents.withColumn(own, learnable()), models, also=[own]))
    most_of = {r["lang_pred"]: r["most"] for r in limits(found.where(own)).collect()}
    most = F.coalesce(*[F.when(F.col("lang_pred") == x, F.lit(v)) for x, v in most_of.items()], F.lit(float("inf")))
    return found.drop(own).withColumn("rejected", F.coalesce(F.col("cross_entropy") > most, F.lit(True)))
