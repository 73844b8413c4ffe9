"""TABLESAMPLE, and samples of a given size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checked(percent: float) -> float:
    if percent is None or math.isnan(percent) or not 0 <= percent <= 100:
        raise ValueError("sample percentage must be between 0 and 100")
    return percent


def bernoulli(df: DataFrame, percent: float, seed: int, keys: list[str] | None = None) -> DataFrame:
    """Each row by itself with the given percentage; rows are chosen by a hash of their keys, so a seed repeats."""
    if seed is None:
        raise ValueError("TABLESAMPLE REPEATABLE parameter cannot be null")
    cutoff = round(_checked(percent) / 100 * 2**32)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *(keys or df.columns)), F.lit(2**32)) < F.lit(cutoff))


def system(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """Whole blocks: input splits are chosen by a hash of their number."""
    if seed is None:
        raise ValueError("TABLESAMPLE REPEATABLE parameter cannot be null")
    cutoff = round(_checked(percent) / 100 * 2**32)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.spark_partition_id()), F.lit(2**32)) < F.lit(cutoff))


def system_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all if there are fewer): the n least hashes, so no full sort."""
    if n < 0:
        raise ValueError("sample size must not be negative")
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *df.columns)).orderBy("_h").limit(n).drop("_h")
