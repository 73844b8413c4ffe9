"""Constraints: checks of rows in the plan, and rows that break keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enforce(df: DataFrame, checks: dict[str, Column] | None = None, not_null: list[str] | None = None) -> DataFrame:
    """CHECK and NOT NULL: the table as it is; reading a row that breaks one fails. A check that is null passes."""
    names = df.columns
    broken = F.lit(None).cast("string")
    for c in not_null or []:
        broken = F.when(F.col(c).isNull(), F.lit(f'null value in column "{c}" violates not-null constraint')).otherwise(broken)
    for name, condition in (checks or {}).items():
        broken = F.when(~condition, F.lit(f'new row violates check constraint "{name}"')).otherwise(broken)
    passed = F.when(broken.isNotNull(), F.raise_error(broken).cast("boolean")).otherwise(True)
    return df.filter(passed).select(*names)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """UNIQUE and PRIMARY KEY: keys that several rows have, and how many; null keys never collide."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(df: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """FOREIGN KEY: rows whose keys (none of them null) no row of the parent has."""
    known = parent.select(*[F.col(p).alias(k) for k, p in zip(keys, parent_keys)]).distinct()
    return df.dropna(subset=keys).join(known, keys, "left_anti").select(*df.columns)


def excluded(df: DataFrame, keys: list[str], lower: str, upper: str) -> DataFrame:
    """EXCLUDE (keys WITH =, range WITH &&): rows that begin before another row of their keys has ended (half-open ranges).

    Of rows with one range the later ones by their other columns are reported.
    """
    from pyspark.sql import Window

    ties = [c for c in df.columns if c not in (*keys, lower, upper)]
    over = Window.partitionBy(*keys).orderBy(lower, upper, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_until", F.max(upper).over(over)).filter(F.col("_until") > F.col(lower)).drop("_until")


def require_none(violations: DataFrame, message: str) -> None:
    """Fail before a write if there is a violating row."""
    if violations.limit(1).count():
        raise ValueError(message)
