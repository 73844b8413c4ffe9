"""ORDER BY with the standard's nulls, LIMIT and OFFSET."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_key(spec: str) -> Column:
    """'name', 'name desc', optionally with 'nulls first' or 'nulls last'; ascending has nulls last, descending first."""
    words = spec.split()
    name, rest = words[0], " ".join(words[1:]).lower()
    down = rest.startswith("desc")
    first = "nulls first" in rest or (down and "nulls last" not in rest)
    column = F.col(name)
    return (column.desc_nulls_first() if first else column.desc_nulls_last()) if down else (column.asc_nulls_first() if first else column.asc_nulls_last())


def sort(df: DataFrame, *specs: str) -> DataFrame:
    return df.orderBy(*map(order_key, specs))


def limit_offset(df: DataFrame, limit: int | None, offset: int | None = None) -> DataFrame:
    """LIMIT NULL has no limit, OFFSET NULL is 0; negative numbers fail."""
    if limit is not None and limit < 0:
        raise ValueError("LIMIT must not be negative")
    if offset is not None and offset < 0:
        raise ValueError("OFFSET must not be negative")
    out = df.offset(offset) if offset else df
    return out if limit is None else out.limit(limit)
