"""Null counting and rounding rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def num_nulls(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, [v.isNull().cast("int") for v in values])


def num_nonnulls(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])


def to_int(value: Column, kind: str = "double") -> Column:
    """Cast to int as the standard rounds: doubles half to even, decimals half away from zero."""
    return (F.rint(value) if kind == "double" else F.round(value)).cast("int")
