"""User-defined functions, aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sql_function(spark, name: str, arguments: str, returns: str, body: str) -> None:
    """CREATE FUNCTION ... LANGUAGE sql: a temporary function that the optimizer inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def strict(f: Callable[..., Column]) -> Callable[..., Column]:
    """STRICT: null for any null argument."""

    def wrapped(*arguments: Column) -> Column:
        known = F.lit(True)
        for a in arguments:
            known = known & a.isNotNull()
        return F.when(known, f(*arguments))

    return wrapped


def aggregate(df: DataFrame, keys: list[str], value: str, out: str, kind: str, *, step: Callable[[pd.Series], object], combine: Callable[[pd.Series], object]) -> DataFrame:
    """CREATE AGGREGATE with a combine function: a state per key and Arrow batch first, then the states of a key are combined.

    ``step`` turns a series of values into a state, ``combine`` a series of states into one (also of combined ones). No
    task holds more of a key than a batch, however hot it is; its states (one for each batch of rows) are combined in
    two rounds, first by partition.
    """
    names = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)
    schema = f"{names}, `{out}` {kind}"

    def reduced(frame: pd.DataFrame, column: str, f) -> pd.DataFrame:
        rows = [[*(k if isinstance(k, tuple) else (k,)), f(part[column])] for k, part in frame.groupby(keys, dropna=False, sort=False)]
        return pd.DataFrame(rows, columns=[*keys, out])

    def partial(frames):
        held = None
        for frame in frames:
            if len(frame):
                states = reduced(frame, value, step)
                held = states if held is None else reduced(pd.concat([held, states]), out, combine)
        if held is not None:
            yield held

    def final(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, combine(frame[out])]], columns=[*keys, out])

    states = df.select(*keys, value).mapInPandas(partial, schema)
    return states.groupBy(*keys).applyInPandas(final, schema)


def table_function(spark, name: str, schema: str, rows: Callable) -> None:
    """RETURNS TABLE: a Python generator of rows as a table function for SQL and lateral joins."""

    class Generated:
        def eval(self, *arguments):
            yield from rows(*arguments)

    spark.udtf.register(name, F.udtf(Generated, returnType=schema))


def window_function(kind: str, f: Callable[[pd.Series], object]):
    """A user function over a window's frame: a vectorised function of the frame's values."""

    def run(values: pd.Series):
        return f(values)

    run.__annotations__ = {"values": pd.Series, "return": float if kind == "double" else int}
    return F.pandas_udf(run, kind)
