"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed at this place, once a row. Left to a projection, an expression would be
    repeated where a later one uses it, and inside a lambda once for each element."""
    made = F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.select(*(F.col(c) for c in df.columns if c not in columns), made)
