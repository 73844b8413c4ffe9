"""Aggregation beyond groupBy: ordered and hypothetical sets, grouping sets over empty input, DISTINCT ON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(over)).filter("_rn = 1").drop("_rn")


def array_agg(value: Column, order: Column) -> Column:
    """Values in order, nulls kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def string_agg(value: Column, separator: str, order: Column) -> Column:
    """Non-null values in order, joined."""
    return F.array_join(array_agg(value.cast("string"), order), separator)


def hypothetical_rank(value: Column, probe) -> dict[str, Column]:
    """rank, dense_rank, percent_rank and cume_dist that ``probe`` would have among the values, ascending."""
    below, n = F.count_if(value < probe), F.count(value)
    upto = F.count_if(value <= probe)
    return {
        "rank": below + 1,
        "dense_rank": F.count_distinct(F.when(value < probe, value)) + 1,
        "percent_rank": F.when(n == 0, 0.0).otherwise(below / n),
        "cume_dist": (upto + 1) / (n + 1),
    }


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """GROUP BY GROUPING SETS with one row for each empty set even where the input is empty.

    The non-empty sets are one Expand and one aggregation; each empty set is a plain aggregation of its own.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    types = dict(df.dtypes)
    filled = [s for s in sets if s]
    parts = []
    if filled:
        parts.append(df.groupingSets([[F.col(c) for c in s] for s in filled], *names).agg(*aggregates))
    for _ in range(len(sets) - len(filled)):
        total = df.agg(*aggregates)
        parts.append(total.select(*[F.lit(None).cast(types[c]).alias(c) for c in names], *total.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def crosstab(df: DataFrame, row: str, category: str, value: str, categories: list[str]) -> DataFrame:
    """Rows to columns: a row per ``row``, a column per listed category, its least value (null where there is none)."""
    return df.groupBy(row).pivot(category, categories).agg(F.min(value))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark keeps at most k rows per key and task before the shuffle."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(over)).filter(F.col("_rn") <= k).drop("_rn")
