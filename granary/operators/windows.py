"""Window functions with arguments that Spark wants as constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shift_by(df: DataFrame, keys: list[str], order: list[Column], value: str, offset: Column, out: str, default=None) -> DataFrame:
    """lag(value, offset) with an offset per row (negative: lead): null offset gives null, outside the partition the default.

    A self-join on (keys, row number): each row asks for one other row.
    """
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    asked = numbered.withColumn("_want", F.col("_rn") - offset)
    found = numbered.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_rn").alias("_at"), F.col(value).alias("_v"), F.lit(True).alias("_hit"))
    on = [asked[k].eqNullSafe(found[f"_k{i}"]) for i, k in enumerate(keys)] + [asked["_want"] == found["_at"]]
    joined = asked.join(found, on, "left")
    shifted = F.when(F.col("_hit"), F.col("_v")).when(F.col("_want").isNotNull(), F.lit(default))
    return joined.select(*df.columns, shifted.alias(out))


def ntile(buckets: Column, keys: list[str], order: list[Column]) -> Column:
    """ntile with a number of buckets per row: larger buckets first, null for null, an error if not positive."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    small, extra = F.floor(n / buckets), n % buckets
    edge = extra * (small + 1)
    tile = F.when(rn < edge, F.floor(rn / (small + 1))).otherwise(extra + F.floor((rn - edge) / F.greatest(small, F.lit(1)))) + 1
    return F.when(buckets <= 0, F.raise_error(F.lit("argument of ntile must be greater than zero")).cast("int")).otherwise(tile.cast("int"))
