"""Ranks and running totals that stay spread when one key holds most rows.

A plain window puts a whole key into one task. Here a key is cut into blocks by a coarse
form of its order (an hour, a score step, a message range). Totals per block are a small
aggregate, their prefix sums give each block its base, and only one block's rows meet in a
task.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK = "_block"
BASE = "_base"


def null_safe_join(rows: DataFrame, bases: DataFrame, on: Iterable[str]) -> DataFrame:
    """Inner join on columns that may hold NULL, which equals NULL here: no row is lost."""
    on = list(on)
    right = bases.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in bases.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return rows.join(right, same).drop(*[f"_on_{c}" for c in on])


def block_bases(
    df: DataFrame, keys: Iterable[str], measures: dict[str, Column]
) -> DataFrame:
    """Per (keys, block): the total of each measure over all earlier blocks of the key."""
    keys = list(keys)
    totals = df.groupBy(*keys, BLOCK).agg(*[m.alias(n) for n, m in measures.items()])
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *keys,
        BLOCK,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{BASE}_{n}") for n in measures],
    )


#: Places of a block, where rows have places.
PLACES = 4096
PLACE = "_place"


def placed(rows: DataFrame, order: Iterable) -> DataFrame:
    """Rows with `_place`, ascending in `order`, as a written table.

    Ranges of the order are sorted apart, so no key, hour or value, however many rows it has, meets in one task;
    `place_block()` then cuts places into blocks of like size.
    """
    order = list(order)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn(PLACE, F.monotonically_increasing_id()))


def place_block() -> Column:
    return F.floor(F.col(PLACE) / PLACES)


def blocked_row_number(
    df: DataFrame, keys: Iterable[str], block: Column, order: Iterable, name: str
) -> DataFrame:
    """Row number per key in `order`; `block` must be monotone in that order."""
    keys = list(keys)
    rows = df.withColumn(BLOCK, block)
    bases = block_bases(rows, keys, {"n": F.count(F.lit(1))})
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    out = null_safe_join(rows, bases, [*keys, BLOCK])
    number = F.col(f"{BASE}_n") + F.row_number().over(within)
    return out.withColumn(name, number.cast("long")).drop(BLOCK, f"{BASE}_n")


def blocked_running_sum(
    df: DataFrame, keys: Iterable[str], block: Column, order: Iterable, value: Column, name: str
) -> DataFrame:
    """Running sum per key including the current row."""
    keys = list(keys)
    rows = df.withColumn(BLOCK, block).withColumn("_v", value)
    bases = block_bases(rows, keys, {"n": F.sum("_v")})
    within = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = null_safe_join(rows, bases, [*keys, BLOCK])
    total = F.col(f"{BASE}_n") + F.sum("_v").over(within)
    return out.withColumn(name, total).drop(BLOCK, f"{BASE}_n", "_v")


def blocked_sums_before(
    df: DataFrame, keys: Iterable[str], block: Column, order: Iterable, values: dict[str, Column]
) -> DataFrame:
    """Sums of several values over all earlier rows of the key."""
    keys = list(keys)
    rows = df.withColumn(BLOCK, block).withColumns({f"_v_{n}": v for n, v in values.items()})
    bases = block_bases(rows, keys, {n: F.sum(f"_v_{n}") for n in values})
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = null_safe_join(rows, bases, [*keys, BLOCK])
    sums = {n: F.col(f"{BASE}_{n}") + F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) for n in values}
    return out.select(*df.columns, *[c.alias(n) for n, c in sums.items()])


def blocked_last(
    df: DataFrame, keys: Iterable[str], block: Column, order: Iterable, values: dict[str, Column]
) -> DataFrame:
    """Last non-null value strictly before each row, per key.

    Each value column is looked up inside the row's block first, then in earlier blocks.
    """
    keys = list(keys)
    rows = df.withColumn(BLOCK, block)
    for n, v in values.items():
        rows = rows.withColumn(f"_v_{n}", v)
    order = list(order)
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    ends = rows.groupBy(*keys, BLOCK).agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_e_{n}")
            for n in values
        ]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = ends.select(
        *keys,
        BLOCK,
        *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in values],
    )
    within = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = null_safe_join(rows, bases, [*keys, BLOCK])
    return out.select(
        *df.columns,
        *[
            F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(within), F.col(f"_b_{n}")).alias(n)
            for n in values
        ],
    )
