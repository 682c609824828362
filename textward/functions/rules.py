"""Rule tables: small configuration, size-checked before it is broadcast or inlined."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 10_000


def _checked(rows: Iterable) -> list:
    rows = list(rows)
    if len(rows) > MAX_RULES:
        raise ValueError(f"{len(rows)} rules exceed the {MAX_RULES} a broadcast rule table may hold")
    return rows


def rule_frame(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """A frame of configuration rows, marked for broadcast up to MAX_RULES of them; joins give the same either way."""
    rows = list(rows)
    frame = spark.createDataFrame(rows, ddl)
    return F.broadcast(frame) if len(rows) <= MAX_RULES else frame


def small_side(frame: DataFrame) -> DataFrame:
    """A given rule table, marked for broadcast if it has at most MAX_RULES rows; reads no more of it to find out."""
    return F.broadcast(frame) if frame.limit(MAX_RULES + 1).count() <= MAX_RULES else frame


def rule_list(rows: Iterable[Mapping], ddl: str) -> Column:
    """Rules as one constant array, folded to a literal at planning time."""
    return F.from_json(F.lit(json.dumps(_checked(rows))), f"array<struct<{ddl}>>")


INLINE_RULES = 256


def attach(df: DataFrame, name: str, key: Column, table: Mapping[str, Mapping], ddl: str) -> DataFrame:
    """`df` with the struct `name` looked up by key; NULL where the table has no entry.

    Small tables become a constant map in the projection, larger ones a broadcast join.
    """
    if len(table) <= INLINE_RULES:
        constant = F.from_json(F.lit(json.dumps(dict(table))), f"map<string,struct<{ddl}>>")
        return df.withColumn(name, F.try_element_at(constant, key))
    fields = [f.split()[0] for f in ddl.split(",")]
    rows = [(k, *[v.get(f) for f in fields]) for k, v in table.items()]
    frame = rule_frame(df.sparkSession, rows, f"_key string, {ddl}")
    frame = frame.select(F.col("_key").alias(f"_key_{name}"), F.struct(*fields).alias(name))
    return df.join(frame, key == F.col(f"_key_{name}"), "left").drop(f"_key_{name}")


def first_rule(rules: Column, applies: Callable[[Column], Column]) -> Column:
    """First rule of an ordered list that applies to the row, else NULL. No join, no shuffle."""
    return F.get(F.filter(rules, applies), F.lit(0))


def open_or_equal(pattern: Column, value: Column) -> Column:
    """An absent matcher accepts every value."""
    return pattern.isNull() | (pattern == value)


def wildcard(pattern: Column, value: Column) -> Column:
    """'', '*' and NULL accept every value; else equal without regard to case."""
    return pattern.isNull() | pattern.isin("", "*") | (F.lower(pattern) == F.lower(value))


def specificity(rule: Mapping, dimensions: Iterable[str]) -> int:
    return sum(1 for d in dimensions if rule.get(d) not in (None, "", "*"))


def most_specific_first(rules: Iterable[Mapping], dimensions: Iterable[str]) -> list[dict]:
    """Stable order by falling specificity, so the earliest rule wins ties."""
    dimensions = tuple(dimensions)
    rows = [dict(r, position=i) for i, r in enumerate(rules)]
    return sorted(rows, key=lambda r: (-specificity(r, dimensions), r["position"]))


def case_map(value: Column, table: Mapping, default=None) -> Column:
    out = None
    for key, result in table.items():
        cond = value == key
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return out if default is None else out.otherwise(default)
