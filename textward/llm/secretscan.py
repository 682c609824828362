"""Secrets in texts through a trigram inverted index.

Each rule is a regular expression. From its syntax tree a Boolean query over trigrams is
derived that every match must satisfy: literal strings give all their trigrams, alternatives
an OR, sequences an AND. Texts are indexed in blocks: for each trigram that some query names, the
ascending list of the texts of the block that hold it. A query is answered by intersecting and
uniting these lists, and only the texts it leaves are searched with the expression itself. A
rule without a mandatory trigram (a run of hexadecimal digits) scans every text.

The lists stay beside the texts they point into, inside the task, so neither texts nor postings
are shuffled, a trigram that occurs everywhere costs one list per block, and a lost executor
repeats its own blocks only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from re import _constants as sre
from re import _parser as sre_parse
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb


class Rule(NamedTuple):
    kind: str
    pattern: str
    flags: int
    #: Shortest match, or shortest group 2 where `of` says so; shorter ones are dropped after matching.
    least: int
    of: int = 0


#: Fixed patterns and lengths of the three base kinds, then further kinds found by the same method.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", 0, 0),
    Rule("code_host", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
BASE = ("assign", "access", "hex")

#: A query is True (any text), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple
_EXACT = 48


def _and(parts: list[Query]) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _or(parts: list[Query]) -> Query:
    kept = list(dict.fromkeys(parts))
    return True if True in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _needed(strings: set[str]) -> Query:
    """What a text holding one of the strings must satisfy."""
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _characters(items: list) -> set[str] | None:
    """The characters of a small class, lower-cased; None if it is large or negated."""
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 8:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return out if len(out) <= 8 and all(c.isascii() for c in out) else None


def _sequence(nodes: Iterable) -> tuple[set[str] | None, Query]:
    """Of a sequence: all strings it can match, if these are few, and its query."""
    whole: set[str] | None = {""}
    open_: set[str] = {""}  # strings that end here, since the last part that is not exact
    found: list[Query] = []

    def close() -> None:
        nonlocal open_
        found.append(_needed(open_))
        open_ = {""}

    for node in nodes:
        strings, query = _node(node)
        if strings is None:
            close()
            found.append(query)
            whole = None
        else:
            if len(open_) * len(strings) > _EXACT:
                close()
                whole = None
            open_ = {a + b for a in open_ for b in strings}
            if whole is not None:
                whole = {a + b for a in whole for b in strings} if len(whole) * len(strings) <= _EXACT else None
    close()
    return whole, _and(found)


def _node(node: tuple) -> tuple[set[str] | None, Query]:
    op, value = node
    if op is sre.LITERAL:
        return ({chr(value).lower()}, True) if value < 128 else (None, True)
    if op is sre.IN:
        return _characters(value), True
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, True
    if op is sre.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in parts):
            union = set().union(*[strings for strings, _ in parts])
            if len(union) <= _EXACT:
                return union, True
        return None, _or([query if strings is None else _needed(strings) for strings, query in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, body = value
        strings, query = _sequence(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, True
        if low == high == 1:
            return strings, query
        return None, (True if low == 0 else query if strings is None else _needed(strings))
    return None, True


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """A query over lower-cased trigrams that every text with a match satisfies."""
    strings, query = _sequence(sre_parse.parse(pattern, flags))
    return _and([query, True if strings is None else _needed(strings)])


def _trigrams(query: Query) -> set[str]:
    if isinstance(query, tuple):
        return set().union(*[_trigrams(q) for q in query[1]])
    return {query} if isinstance(query, str) else set()


def _code(trigram: str) -> int:
    a, b, c = map(ord, trigram)
    return a << 14 | b << 7 | c


class Index:
    """Postings of one block of texts for the trigrams named in advance."""

    def __init__(self, texts: list[str | None], table: np.ndarray):
        points = tb.Points(texts)
        low = np.where(points.points < 128, tb.lower_ascii(points.points), np.uint32(128))
        packed = low[:-2] << np.uint32(14) | low[1:-1] << np.uint32(7) | low[2:]
        plain = low < 128
        at = np.flatnonzero(plain[:-2] & plain[1:-1] & plain[2:] & table[packed & np.uint32(0x1FFFFF)])
        owner = np.searchsorted(points.bounds, at, side="right") - 1
        pairs = np.unique(packed[at].astype(np.int64) * len(texts) + owner)
        codes, docs = pairs // max(1, len(texts)), pairs % max(1, len(texts))
        cuts = np.flatnonzero(np.diff(codes, prepend=-1, append=-1)) if len(codes) else np.zeros(1, np.int64)
        self.postings = {int(codes[a]): docs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
        self.all = np.arange(len(texts))

    def answer(self, query: Query) -> np.ndarray:
        """The texts that satisfy a query, ascending."""
        if query is True:
            return self.all
        if isinstance(query, str):
            return self.postings.get(_code(query), self.all[:0])
        parts = [self.answer(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        out = min(parts, key=len)
        for part in sorted(parts, key=len)[1:]:
            out = np.intersect1d(out, part, assume_unique=True)
        return out


class Scanner:
    """Compiled rules with their queries, and the table of the trigrams these name."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        self.table = np.zeros(1 << 21, dtype=bool)
        for _, _, query in self.rules:
            for t in _trigrams(query):
                self.table[_code(t)] = True

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text, (start, rule number, end) ascending."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        index = Index(texts, self.table)
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in index.answer(query).tolist():
                for m in pattern.finditer(texts[i] or ""):
                    if m.end(rule.of) - m.start(rule.of) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        return [sorted(found) for found in out]


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, stop in code points, end exclusive; by start, then rule order) per row.

    Matches of one rule are leftmost and do not overlap; those of different rules may. Defined
    results: a null or empty text has no spans; repeated rows are answered for each copy; no rows
    give none; columns besides the two named are not read.
    """
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for part, texts in tb.slices(batches):
            found = [[{"kind": rules[k].kind, "start": a, "stop": b} for a, k, b in s] for s in scanner.spans(texts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, span)], names=["doc_id", "spans"])

    return docs.mapInArrow(find, f"doc_id {kind}, spans array<struct<kind:string,start:long,stop:long>>")
