"""Pattern scans that return match values with exact character and byte offsets.

A scan is one projection: the cheap `rlike` gate runs once per text, and only texts with
a hit pay for extraction. No Python and no shuffle are involved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH_FIELDS = (
    "value:string,char_start:int,char_end:int,start:int,end:int,before:string,after:string"
)
TAG_FIELDS = (
    "category:string,subtype:string,detector:string,confidence:double,detector_order:int,"
    "ip_version:string"
)


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# One left-to-right fold over (match, gap before it) pairs: the character and byte positions
# advance together. Written as SQL text because one parsed expression builds far faster than
# the same tree assembled call by call.
FOLD = """
aggregate(
  arrays_zip(regexp_extract_all({text}, {pattern}, 0), split({text}, {pattern}, -1)),
  named_struct('c', 0, 'b', 0, 'out', CAST(array() AS array<struct<{fields}>>)),
  (acc, p) -> named_struct(
    'c', acc.c + length(p.`1`) + coalesce(length(p.`0`), 0),
    'b', acc.b + octet_length(p.`1`) + coalesce(octet_length(p.`0`), 0),
    'out', CASE WHEN p.`0` IS NOT NULL AND {keep} THEN concat(acc.out, array(CAST(named_struct(
        'value', {value},
        'char_start', acc.c + length(p.`1`) + length(p.`0`) - length({value}),
        'char_end', acc.c + length(p.`1`) + length(p.`0`),
        'start', acc.b + octet_length(p.`1`) + octet_length(p.`0`) - octet_length({value}),
        'end', acc.b + octet_length(p.`1`) + octet_length(p.`0`),
        'before', CASE WHEN acc.c + length(p.`1`) > 0
                  THEN substr({text}, acc.c + length(p.`1`), 1) ELSE '' END,
        'after', substr({text}, acc.c + length(p.`1`) + length(p.`0`) + 1, 1){tags})
        AS struct<{fields}>)))
      ELSE acc.out END),
  acc -> acc.out)"""


def matches(
    text: str,
    pattern: str,
    needles: tuple[str, ...] = (),
    gate: str = "",
    guard: str = "",
    tail_group: bool = False,
    keep: str = "true",
    tags: str = "",
) -> Column:
    """All non-overlapping matches of `pattern` in the named column, left to right.

    `gate` (a boolean column), `needles` (any of these literals) and `guard` (a cheaper
    pattern) are necessary conditions checked in that order before the scan. With `tail_group` the span is the first capture group, which must end the match.
    `keep` is a condition on the candidate `p.0`; dropped candidates still consume their text.
    `tags` are constant fields every match carries.
    """
    fields = MATCH_FIELDS + ("," + TAG_FIELDS if tags else "")
    shown = "p.`0`"
    if tail_group:
        shown = f"regexp_extract(p.`0`, {sql_text(pattern)}, 1)"
    found = FOLD.format(
        text=text, pattern=sql_text(pattern), fields=fields, keep=keep, value=shown, tags=tags
    )
    hit = f"{text} RLIKE {sql_text(pattern)}"
    if guard:
        hit = f"{text} RLIKE {sql_text(guard)} AND {hit}"
    if needles:
        any_of = " OR ".join(f"contains({text}, {sql_text(n)})" for n in needles)
        hit = f"({any_of}) AND {hit}"
    if gate:
        hit = f"{gate} AND {hit}"
    return F.expr(f"CASE WHEN {hit} THEN {found} ELSE CAST(array() AS array<struct<{fields}>>) END")


@dataclass(frozen=True)
class Detector:
    """One registered detector: patterns, a check on each match, and what it reports."""

    name: str
    category: str
    subtype: str
    patterns: tuple[str, ...]
    confidence: float
    needles: tuple[str, ...] = ()
    gate: str | tuple[str, ...] = ""
    guard: str = ""
    tail_group: bool = False
    check: Callable[[Column], Column] | None = None
    keep: str = "true"
    label: str = "pattern"
    ip_version: str | None = None

    def findings(self, text: str, order: int, gate: str = "") -> Column:
        """Array of finding structs of this detector for one text column."""
        found = []
        for rank, pattern in enumerate(self.patterns):
            tags = self._tags(order * 10 + rank)
            hits = matches(
                text, pattern, self.needles, gate, self.guard, self.tail_group, self.keep, tags
            )
            found.append(hits if self.check is None else F.filter(hits, self.check))
        return found[0] if len(found) == 1 else F.concat(*found)

    def _tags(self, order: int) -> str:
        version = sql_text(self.ip_version) if self.ip_version else "NULL"
        return (
            f", 'category', {sql_text(self.category)}, 'subtype', {sql_text(self.subtype)}, "
            f"'detector', {sql_text(self.label)}, 'confidence', {self.confidence}, "
            f"'detector_order', {order}, 'ip_version', {version}"
        )


def with_gates(df: DataFrame, detectors: Iterable[Detector], text: str) -> tuple[DataFrame, dict]:
    """Columns for the conditions detectors share, so each runs once per text.

    A gate is a pattern, or a tuple of lower-case words looked up in the lowered text: byte
    searches, several times cheaper than one case-insensitive pattern.
    """
    gates = dict.fromkeys(d.gate for d in detectors if d.gate)
    rows = df
    if any(isinstance(g, tuple) for g in gates):
        rows = rows.withColumn("_lower", F.lower(text))
    names, columns = {}, []
    for i, gate in enumerate(gates):
        names[gate] = f"_gate{i}"
        if isinstance(gate, tuple):
            test = " OR ".join(f"contains(_lower, {sql_text(w)})" for w in gate)
        else:
            test = f"{text} RLIKE {sql_text(gate)}"
        columns.append(F.expr(test).alias(names[gate]))
    return rows.select(*df.columns, *columns), names


def finding_array(
    df: DataFrame, detectors: Iterable[Detector], name: str, text: str = "text"
) -> DataFrame:
    """`df` with one array column holding all findings of its text."""
    detectors = tuple(detectors)
    gated, gates = with_gates(df, detectors, text)
    found = [
        d.findings(text, order, gates.get(d.gate, "")) for order, d in enumerate(detectors)
    ]
    array = found[0] if len(found) == 1 else F.concat(*found)
    return gated.select(*df.columns, array.alias(name))


def explode_rows(df: DataFrame, keep: Iterable, array, name: str) -> DataFrame:
    """One row per array element; rows with an empty array go.

    An outer explode plus a filter: for a plain explode the optimizer adds a size filter
    below it, which would compute a costly array a second time for every row.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())


def computed_once(df: DataFrame, keep: Iterable, **columns) -> DataFrame:
    """`keep` and the named costly columns, which later filters use without computing them again.

    The optimizer pushes a filter through a projection and repeats its expressions there, but
    not through an explode, here of one struct.
    """
    keep = list(keep)
    once = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select(*keep, once).select(*keep, *[F.col(f"_once.{n}").alias(n) for n in columns])


def with_findings(df: DataFrame, detectors: Iterable[Detector], text: str = "text") -> DataFrame:
    """One row per finding `f` beside the columns of `df`."""
    return explode_rows(finding_array(df, detectors, "_found", text), df.columns, "_found", "f")
