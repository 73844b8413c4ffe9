"""Row policies and masked columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_policy(df: DataFrame, *policies: Column) -> DataFrame:
    """Rows that at least one policy lets through (none without a policy); a policy that is null lets nothing through."""
    allowed = F.lit(False)
    for p in policies:
        allowed = allowed | F.coalesce(p, F.lit(False))
    return df.filter(allowed)


def masked(df: DataFrame, masks: dict[str, Column], unless: Column | None = None) -> DataFrame:
    """Columns replaced by their masks, but for rows for which ``unless`` is true; types stay."""
    free = F.lit(False) if unless is None else F.coalesce(unless, F.lit(False))
    return df.select(*[F.when(free, F.col(c)).otherwise(masks[c].cast(t)).alias(c) if c in masks else F.col(c) for c, t in df.dtypes])


def keep_last(c: Column, n: int, sign: str = "*", width: int = 3) -> Column:
    """A mask that shows the last n signs only."""
    return F.concat(F.lit(sign * width), F.right(c, F.lit(n)))
