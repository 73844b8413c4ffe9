"""Recursion and hierarchies."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def _written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage by way of the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, max_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE: ``step`` sees the rows that the last round added; ends when a round adds none.

    With ``distinct`` rows that any round had are dropped (nulls equal nulls), so cycles end.
    """
    spark, base = seed.sparkSession, f"{shared_dir(seed.sparkSession)}/recursion-{uuid.uuid4().hex}"
    start = seed.distinct() if distinct else seed
    # all rounds are folders of one table, so what was seen is one scan and each round has one anti-join
    seen = lambda: spark.read.schema(start.schema).parquet(f"{base}/round=*")
    start.write.parquet(f"{base}/round=0")
    for k in range(max_rounds):
        new = spark.read.schema(start.schema).parquet(f"{base}/round={k}")
        if not new.limit(1).count():
            return seen()
        found = step(new).toDF(*start.columns)
        if distinct:
            found, old = found.distinct(), seen()
            found = found.join(old, [found[c].eqNullSafe(old[c]) for c in start.columns], "left_anti")
        found.select(*[F.col(c).cast(t) for c, t in start.dtypes]).write.parquet(f"{base}/round={k + 1}")
    raise RuntimeError("recursion did not end")


def connect_by(df: DataFrame, key: str, parent: str, start, max_depth: int = 0, delimiter: str = "~") -> DataFrame:
    """Hierarchy below ``start``: key, parent, level and branch (the keys on the way); ``max_depth`` 0 has no limit."""
    links = df.select(F.col(key).cast("string").alias("_key"), F.col(parent).cast("string").alias("_parent"))
    seed = df.sparkSession.range(1).select(F.lit(str(start)).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.lit(str(start)).alias("branch"))

    def step(rows: DataFrame) -> DataFrame:
        below = rows.join(links, rows["key"] == links["_parent"])
        if max_depth:
            below = below.filter(F.col("level") + 1 < max_depth)
        on_branch = F.array_contains(F.split("branch", F.concat(F.lit("\\Q"), F.lit(delimiter), F.lit("\\E"))), F.col("_key"))
        checked = F.when(on_branch, F.raise_error(F.lit("infinite recursion detected"))).otherwise(F.col("_key"))
        return below.select(checked.alias("key"), F.col("_parent").alias("parent"), (F.col("level") + 1).alias("level"), F.concat_ws(delimiter, "branch", "_key").alias("branch"))

    return recursive_union(seed, step, distinct=False)
