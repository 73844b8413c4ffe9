"""Prepared statements and cursors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession


class Prepared:
    """PREPARE: SQL with parameter markers (:name or ?) over tables given by name; EXECUTE binds values, never text."""

    def __init__(self, spark: SparkSession, sql: str, **tables: DataFrame):
        self.spark, self.sql, self.tables = spark, sql, tables

    def execute(self, *positional, **named) -> DataFrame:
        return self.spark.sql(self.sql, args=list(positional) or named, **self.tables)


class Cursor:
    """DECLARE, FETCH and MOVE forward: rows come to the client a partition at a time."""

    def __init__(self, df: DataFrame):
        self.rows: Iterator[Row] = df.toLocalIterator(prefetchPartitions=True)

    def fetch(self, n: int = 1) -> list[Row]:
        return [r for _, r in zip(range(n), self.rows)]

    def move(self, n: int = 1) -> int:
        return len(self.fetch(n))
