"""Ordered folds that hold one state, never a group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Fold = Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]]


def carry_fold(rows: DataFrame, key: str, order: Iterable[str], fold: Fold, schema: str) -> DataFrame:
    """Fold each key's rows in order: `fold(state, rows) -> (state, output rows)`.

    Rows arrive partitioned by key and sorted, and pass through in Arrow batches, so memory
    stays constant however many rows a key has. Used where a state is inherently sequential,
    on pre-reduced rows wherever the maps of whole blocks compose.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, begun = None, None, False
        for batch in batches:
            for value, part in batch.groupby(key, sort=False, dropna=False):
                same = begun and (value == current or (pd.isna(value) and pd.isna(current)))
                if not same:
                    current, state, begun = value, None, True
                state, out = fold(state, part)
                yield out

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
