"""Personal data replaced by keyed surrogates of the same kind and form.

Detected are e-mail addresses, phone numbers, payment cards, IPv4 and IPv6 addresses, US social security
numbers, IBANs, and names after a title. A surrogate comes from a keyed hash of the kind and the
value alone, so one value has one surrogate everywhere (coreference), in whatever form it
is written; and it takes the form of what it replaces: letters for letters of the same script and
case, digits for digits, the same separators, valid check digits where the original had them, a
given name of the gender the title tells.

Two values must not meet in one surrogate, and no surrogate may be a value that really occurs.
The distinct values are a table of their own; values whose surrogate clashes take the next one of
their sequence, until none does. First surrogates are computed in place, so only the few values
that moved on have to be looked up: as a broadcast table while that is small, else joined to the
texts that hold them.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.session import cut_lineage

from . import textbatch as tb

#: Moved values that are broadcast at most; more are joined.
BROADCAST = 100_000
#: Further surrogates tried within the value's form; after these it grows longer.
TRIES = 24

EMAIL, PHONE, CARD, IPV4, IPV6, SSN, IBAN = "email", "phone", "card", "ipv4", "ipv6", "ssn", "iban"
GIVEN_F, GIVEN_M, GIVEN, FAMILY = "given_f", "given_m", "given", "family"


class Found(NamedTuple):
    start: int
    stop: int
    kind: str
    value: str  # the same for all spellings of one value


# ---------------------------------------------------------------- detection

_EMAIL = re.compile(r"(?<![\w.%+-])[\w%+-][\w.%+-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*+)\.)++[A-Za-z]{2,}(?![\w-])")
_DIGITS = re.compile(
    r"""(?<![\w.+-])(?:
      (?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))
    | (?P<ipv4>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d|\w))
    | (?P<card>(?:[2-6]\d{12,18}|[2-6]\d{3}(?:[ -]\d{4}){2,3}[ -]\d{1,4}|3[47]\d{2}[ -]\d{6}[ -]\d{5})(?![\w-]))
    | (?P<phone>(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]|\.\d))
    )""",
    re.VERBOSE,
)
_PLUS = re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d{2,5}){2,5}(?![\w-]|\.\d)|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![\w-])")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Titles and the gender they tell.
_TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "M.": "m", "Señor": "m", "Sr": "m", "Don": "m",
    "Signor": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f",
    "Mlle": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Doña": "f", "Signora": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "", "Prof": "", "Professor": "", "Doctor": "", "Доктор": "",
}
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞΑ-ΡΣ-ΫА-ЯЁ", "a-zß-öø-ÿά-ώа-яё"
_TITLED = re.compile(
    r"(?<!\w)(" + "|".join(sorted(map(re.escape, _TITLES), key=len, reverse=True)) + rf")\.? ((?:[{_UPPER}][{_LOWER}]++(?:[-'][{_UPPER}][{_LOWER}]++)?)(?: [{_UPPER}][{_LOWER}]++(?:-[{_UPPER}][{_LOWER}]++)?){{0,2}})(?!\w)"
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _ipv6(value: str) -> str | None:
    try:
        return ipaddress.IPv6Address(value).exploded
    except ValueError:
        return None


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def detect(text: str | None) -> list[Found]:
    """Non-overlapping entities by position. Longer kinds come first; a match inside an earlier one is none."""
    if not text:
        return []
    found: list[Found] = []
    if "@" in text:
        found += [Found(m.start(), m.end(), EMAIL, m[0].lower()) for m in _EMAIL.finditer(text)]
    for m in _PLUS.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            found.append(Found(m.start(), m.end(), PHONE, _digits(m[0])))
    for m in _DIGITS.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == CARD and not 13 <= len(_digits(value)) <= 19:
            continue
        found.append(Found(m.start(), m.end(), kind, value if kind == IPV4 else _digits(value)))
    if ":" in text:
        for m in _IPV6.finditer(text):
            value = _ipv6(m[0])
            if value:
                found.append(Found(m.start(), m.end(), IPV6, value))
    for m in _IBAN.finditer(text):
        value = m[0].replace(" ", "")
        if 15 <= len(value) <= 34 and _mod97(value) == 1:
            found.append(Found(m.start(), m.end(), IBAN, value))
    found += _names(text)
    found.sort(key=lambda f: (f.start, -f.stop))
    out: list[Found] = []
    for f in found:
        if not out or f.start >= out[-1].stop:
            out.append(f)
    return out


def _names(text: str) -> list[Found]:
    """Names after a title, and later or earlier mentions of the same name parts in the text."""
    kinds: dict[str, str] = {}
    for m in _TITLED.finditer(text):
        parts, gender = m[2].split(" "), _TITLES[m[1]] if m[1] in _TITLES else _TITLES[m[1] + "."]
        for part in parts[:-1]:
            kinds.setdefault(part, {"m": GIVEN_M, "f": GIVEN_F, "": GIVEN}[gender])
        kinds.setdefault(parts[-1], FAMILY)
    if not kinds:
        return []
    out = []
    for m in re.finditer("|".join(sorted(map(re.escape, kinds), key=len, reverse=True)), text):
        a, b = m.span()
        inside = (a and (text[a - 1].isalnum() or text[a - 1] == "_")) or (b < len(text) and (text[b].isalnum() or text[b] == "_"))
        if not inside:
            out.append(Found(a, b, kinds[m[0]], m[0]))
    return out


# ---------------------------------------------------------------- surrogates


def _stream(key: bytes, kind: str, value: str, attempt: int) -> Iterator[int]:
    """Keyed numbers, as many as are asked for."""
    block = 0
    while True:
        for byte in hmac.new(key, f"{kind}|{attempt}|{block}|{value}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest():
            yield byte
        block += 1


#: Consonants and vowels per script; a name is a sequence of both and ends as its gender's names do.
_SOUNDS = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"m": "norsk", "f": "a"}),
    "greek": ("βγδζκλμνπρστφχ", "αειου", {"m": "ς", "f": "α"}),
    "cyrillic": ("бвгдзклмнпрстф", "аеиоу", {"m": "нрвмк", "f": "а"}),
}


def script_of(value: str) -> str:
    for c in value:
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def _name(kind: str, value: str, numbers: Iterator[int], longer: int) -> str:
    hard, soft, endings = _SOUNDS[script_of(value)]
    syllables = max(3, min(5, len(value) // 2)) + longer
    out = "".join(hard[next(numbers) % len(hard)] + soft[next(numbers) % len(soft)] for _ in range(syllables))
    gender = {GIVEN_M: "m", GIVEN_F: "f"}.get(kind)
    if gender == "f":
        out = out[:-1] + endings["f"]
    elif gender == "m":
        out += endings["m"][next(numbers) % len(endings["m"])]
    return out.capitalize()


def _like(value: str, numbers: Iterator[int]) -> str:
    """Digits for digits and letters for letters; the first digit of a run stays non-zero if it was."""
    out = []
    for k, c in enumerate(value):
        n = next(numbers)
        if c.isdecimal():
            first = not k or not value[k - 1].isdecimal()
            out.append(str(1 + n % 9) if first and c != "0" else str(n % 10))
        elif c.isalpha():
            out.append("abcdefghijklmnopqrstuvwxyz"[n % 26])
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of a canonical value, canonical itself; never the value."""
    longer = max(0, attempt - TRIES)
    numbers = _stream(key, kind, value, attempt)
    if kind == EMAIL:
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        # A domain has its own surrogate, so that addresses of one domain keep sharing it.
        hidden = [_like(label, _stream(key, "label", label, 0)) for label in labels[:-1]]
        out = _like(local, numbers) + "".join("abcdefghijklmnopqrstuvwxyz"[next(numbers) % 26] for _ in range(longer)) + "@" + ".".join([*hidden, labels[-1]])
    elif kind == CARD:
        keep = 2 if value[0] == "3" else 1  # what tells the issuer
        out = value[:keep] + "".join(str(next(numbers) % 10) for _ in range(len(value) - keep + longer))
        if luhn(value) and not longer:
            out = next(out[:-1] + str(d) for d in range(10) if luhn(out[:-1] + str(d)))
    elif kind == PHONE:
        keep = 1 if len(value) > 10 else 0
        out = value[:keep] + _like(value[keep:], numbers) + "".join(str(next(numbers) % 10) for _ in range(longer))
    elif kind == SSN:
        out = f"{100 + (next(numbers) << 8 | next(numbers)) % 566:03d}{1 + next(numbers) % 99:02d}{1 + (next(numbers) << 8 | next(numbers)) % 9999:04d}" + "0" * longer
    elif kind == IPV4:
        out = ".".join(str(_octet(len(part), next(numbers))) for part in value.split(".")) if not longer else f"10.{next(numbers)}.{next(numbers)}.{next(numbers)}"
    elif kind == IPV6:
        out = ipaddress.IPv6Address(bytes([0xFD, *[next(numbers) for _ in range(15)]])).exploded
    elif kind == IBAN:
        body = "".join((str(next(numbers) % 10) if c.isdecimal() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[next(numbers) % 26]) for c in value[4:]) + "0" * longer
        out = f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
    else:
        out = _name(kind, value, numbers, longer)
    return out if out != value else surrogate(key, kind, value, attempt + 1)


def _octet(digits: int, n: int) -> int:
    low, size = {1: (1, 9), 2: (10, 90), 3: (100, 156)}[digits]
    return low + n % size


def spelled(kind: str, canonical: str, written: str) -> str:
    """The surrogate in the form of the mention it replaces: separators and letter case."""
    if kind in (PHONE, CARD, SSN, IBAN):
        rest = iter(canonical)
        out = "".join(next(rest, "") if c.isalnum() else c for c in written)
        return out + "".join(rest)
    if kind == IPV6:
        short = ipaddress.IPv6Address(canonical).compressed
        return short.upper() if written.upper() == written else short
    if kind == EMAIL:
        return canonical.upper() if written.isupper() else canonical
    return canonical


def rewrite(text: str, found: list[Found], key: bytes, moved: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for f in found:
        new = moved.get((f.kind, f.value)) or surrogate(key, f.kind, f.value)
        out += [text[at : f.start], spelled(f.kind, new, text[f.start : f.stop])]
        at = f.stop
    return "".join(out) + text[at:]


# ---------------------------------------------------------------- distinctness


def _group(kind: str) -> str:
    """Kinds whose values must differ from each other: names of all kinds are one."""
    return "name" if kind in (GIVEN, GIVEN_M, GIVEN_F, FAMILY) else kind


_VALUES = "kind string, value string, grp string"


def values(texts: DataFrame) -> DataFrame:
    """kind, value, grp: the distinct entities of the column `text`."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts_ in tb.slices(batches):
            seen = sorted({(f.kind, f.value) for t in texts_ for f in detect(t)})
            columns = [[k for k, _ in seen], [v for _, v in seen], [_group(k) for k, _ in seen]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "value", "grp"])

    return texts.select("text").mapInArrow(scan, _VALUES).distinct()


def _with_surrogates(rows: DataFrame, key: bytes) -> DataFrame:
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            new = pa.array([surrogate(key, r["kind"], r["value"], r["attempt"]) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, "surrogate"])

    return rows.mapInArrow(add, _VALUES + ", attempt int, surrogate string")


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, grp, attempt, surrogate: no surrogate twice in a group, none a real value.

    In each round the least value of every clash keeps its surrogate, unless that is a real value,
    and the others move on. A round only looks at groups of equal surrogates, which are short.
    """
    real = entities.select("grp", F.col("value").alias("surrogate")).distinct()
    rows = cut_lineage(_with_surrogates(entities.withColumn("attempt", F.lit(0)), key))
    while True:
        keepers = rows.groupBy("grp", "surrogate").agg(F.min(F.struct("attempt", "value", "kind")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        taken = keepers.join(real.withColumn("is_real", F.lit(True)), ["grp", "surrogate"], "left").where("n > 1 OR is_real")
        taken = cut_lineage(taken)
        if taken.isEmpty():
            return rows
        judged = rows.join(taken, ["grp", "surrogate"], "left")
        stays = F.col("n").isNull() | (F.col("is_real").isNull() & (F.col("keeper.value") == F.col("value")) & (F.col("keeper.kind") == F.col("kind")))
        judged = judged.select("kind", "value", "grp", F.when(stays, F.col("attempt")).otherwise(F.col("attempt") + 1).cast("int").alias("attempt"))
        rows = cut_lineage(_with_surrogates(judged, key))


def pseudonymized(documents: DataFrame, key: bytes, text: str = "text", carry: tuple[str, ...] = ("doc_id",), broadcast: int = BROADCAST, result: str = "entities") -> DataFrame:
    """The `carry` columns, the text with surrogates (under its own name), and `result` (kind, start, stop in the given text).

    Defined results: a null text stays null and an empty one empty, both without entities; texts without
    entities are returned unchanged; repeated rows are rewritten alike; no rows give none; other
    columns are not read, and carried ones may have any names but the result's.
    """
    wanted = [c for c in carry if c != text]
    docs = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(wanted)], F.col(f"`{text}`").alias("text"))
    kept = [f"c{k}" for k in range(len(wanted))]
    table = assigned(cut_lineage(values(docs)), key)
    moved = cut_lineage(table.where("attempt > 0").select("kind", "value", "surrogate"))
    if moved.count() <= broadcast:
        own = {(r["kind"], r["value"]): r["surrogate"] for r in moved.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(own)
        done = _rewritten(docs, kept, key, shared)
    else:
        done = _rewritten(_joined(docs, moved), kept, key, None)
    place = {c: f"c{k}" for k, c in enumerate(wanted)} | {text: "text"}
    return done.select(*[F.col(place[c]).alias(c) for c in dict.fromkeys([*carry, text])], F.col("entities").alias(result))


def _joined(docs: DataFrame, moved: DataFrame) -> DataFrame:
    """Each row with the moved values it holds."""

    def mention(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches):
            keys = part.column(part.schema.get_field_index("row_key")).to_pylist()
            seen = [(k, *kv) for k, t in zip(keys, texts, strict=True) for kv in sorted({(f.kind, f.value) for f in detect(t)})]
            columns = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["row_key", "kind", "value"])

    numbered = cut_lineage(docs.withColumn("row_key", F.expr("uuid()")))
    held = numbered.select("row_key", "text").mapInArrow(mention, "row_key string, kind string, value string")
    own = held.join(moved, ["kind", "value"]).groupBy("row_key").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("moved"))
    return numbered.join(own, "row_key", "left").drop("row_key")


def _rewritten(docs: DataFrame, kept: list[str], key: bytes, shared) -> DataFrame:
    entities = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tb.slices(batches):
            if shared is None:
                lists = part.column(part.schema.get_field_index("moved")).to_pylist()
                own = [{(m["kind"], m["value"]): m["surrogate"] for m in x or ()} for x in lists]
            else:
                own = [shared.value] * len(texts)
            found = [detect(t) for t in texts]
            new = [t if not f else rewrite(t, f, key, o) for t, f, o in zip(texts, found, own, strict=True)]
            spans = [[{"kind": f.kind, "start": f.start, "stop": f.stop} for f in fs] for fs in found]
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(new, pa.string()), pa.array(spans, entities)], names=[*kept, "text", "entities"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in [*kept, "text"])
    return docs.mapInArrow(apply, schema + ", entities array<struct<kind:string,start:long,stop:long>>")


def without_personal_data(documents: DataFrame, key: bytes) -> DataFrame:
    """All rows with surrogates in their texts, n_chars made to fit, and the columns of documents."""
    order = documents.columns
    name = tb.fresh(order, "entities")
    done = pseudonymized(documents, key, carry=tuple(order), result=name).drop(name)
    if "n_chars" in order:
        changed = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(documents.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", changed)
    return done.select(*[F.col(f"`{c}`") for c in order])
