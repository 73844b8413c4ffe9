"""Interval partitions: BEGIN, STEP and PARTITIONS of a range-partitioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("int", "hour", "day", "month", "year")


def interval_partition(value: Column, begin, step: int, unit: str, partitions: int) -> Column:
    """Number of the partition (from 0) that a value falls in; values outside all partitions fail, null stays null."""
    if unit not in UNITS or step <= 0 or partitions <= 0:
        raise ValueError("step and number of partitions must be positive, and the unit one of " + ", ".join(UNITS))
    if unit == "int":
        number = F.floor((value - F.lit(begin)) / step)
    else:
        start = F.lit(begin).cast("timestamp_ntz")
        if unit in ("hour", "day"):
            seconds = step * (3600 if unit == "hour" else 86400)
            number = F.floor(F.timestamp_diff("MICROSECOND", start, value) / (seconds * 1_000_000))
        else:
            months = step * (12 if unit == "year" else 1)
            whole = (F.year(value) - F.year(start)) * 12 + F.month(value) - F.month(start)
            # months are counted up to the start's place in the month
            whole = whole - F.when(value < F.timestamp_add("MONTH", whole, start), 1).otherwise(0)
            number = F.floor(whole / months)
    error = F.raise_error(F.lit("inserted value is not in range of partitioned table"))
    return F.when(value.isNull(), F.lit(None).cast("int")).when((number >= 0) & (number < partitions), number.cast("int")).otherwise(error.cast("int"))


def write_partitioned(df: DataFrame, path: str, column: str, begin, step: int, unit: str, partitions: int) -> None:
    """Write a table with a folder per interval partition (_part); readers prune by it."""
    df.withColumn("_part", interval_partition(F.col(column), begin, step, unit, partitions)).write.partitionBy("_part").parquet(path)


def partition_bounds(low, high, begin: int, step: int) -> tuple[int, int]:
    """First and last partition that values from low to high (integers) can be in."""
    return (low - begin) // step, (high - begin) // step


def hash_partition(keys: list[str], modulus: int) -> Column:
    """Partition of a row by hash of its keys; satisfies_hash_partition is equality with a remainder."""
    return F.pmod(F.xxhash64(*keys), F.lit(modulus)).cast("int")


def _routed(value: Column, cases: list[tuple[Column, int]], default: int | None) -> Column:
    out = F.lit(default) if default is not None else F.raise_error(F.lit("no partition found for row")).cast("int")
    for met, k in reversed(cases):
        out = F.when(met, k).otherwise(out)
    return out.cast("int")


def list_partition(value: Column, lists: list[list], default: int | None = None) -> Column:
    """PARTITION BY LIST: number of the list that holds the value (None in a list holds null).

    Other values, null too, go to partition ``default``; without one they fail.
    """
    met = [F.coalesce(value.isin([x for x in held if x is not None]), F.lit(False)) | (value.isNull() & F.lit(None in held)) for held in lists]
    return _routed(value, [(m, k) for k, m in enumerate(met)], default)


def range_partition(value: Column, bounds: list, default: int | None = None) -> Column:
    """PARTITION BY RANGE: k for bounds[k] <= value < bounds[k + 1]; None as first or last bound is without end.

    Null and values outside go to partition ``default``; without one they fail.
    """
    cases = []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        inside = value.isNotNull()
        inside = inside if low is None else inside & (value >= F.lit(low))
        cases.append((F.coalesce(inside if high is None else inside & (value < F.lit(high)), F.lit(False)), k))
    return _routed(value, cases, default)


def shard_group(keys: list[str], slots: int, groups: list[int]) -> Column:
    """DISTRIBUTE BY SHARD: the group that owns the row's slot; rows are hashed into slots, slots are dealt to groups in turn."""
    return F.get(F.array(*map(F.lit, groups)), hash_partition(keys, slots) % len(groups))
