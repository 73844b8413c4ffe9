"""Gapless numbers over a whole table."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sets import _written


def number(df: DataFrame, order: list[Column], out: str, start: int = 1) -> DataFrame:
    """nextval in the given order: rows are range-partitioned and written, partitions are counted, only counts meet."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _written(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row per partition
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_w", within).join(F.broadcast(before), "_p").withColumn(out, F.col("_before") + F.col("_w") + (start - 1)).drop("_p", "_w", "_before")
