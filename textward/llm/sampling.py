"""Bounded samples that do not depend on how the rows are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 30


def least_hashed(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About the `n` rows with the least hash of their key, at most `n`.

    Rows beyond twice the wanted share of hashes are dropped where they are read, so what meets in
    the last task is a few times `n` rows however many there are.
    """
    place = F.pmod(F.xxhash64(key), F.lit(_SPACE))
    total = rows.count()
    near = rows.where(place < int(_SPACE * 2 * n / total) + 1) if total > 2 * n else rows
    return near.orderBy(place, key).limit(n)
