"""Time helpers; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(value) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    column = value if isinstance(value, Column) else F.col(value)
    return F.unix_micros(column.cast("timestamp"))
