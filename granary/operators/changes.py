"""Row changes as whole-table rewrites: update, delete, upsert, and application of a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE: rows for which the condition is true get the values, all from the old row."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c].cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in df.dtypes])


def update_from(df: DataFrame, other: DataFrame, keys: list[str], values: list[str], order: list[Column] | None = None) -> DataFrame:
    """UPDATE ... FROM: columns ``values`` are taken from a row of ``other`` with the same keys, if there is one.

    Of several matches the first by ``order`` (by the values themselves if none is given) counts, so no row of ``df`` is
    multiplied and the outcome repeats. Null keys match nothing.
    """
    new = other.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*(order or values))).alias("_new"))
    joined = df.join(new.withColumn("_hit", F.lit(True)), keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def insert(df: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT ... SELECT or VALUES: columns that ``rows`` doesn't have get their default, null without one."""
    return df.unionByName(inserted(df, rows, defaults))


def inserted(df: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The rows as they enter the table: the RETURNING of an insert."""
    unknown = set(rows.columns) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    value = lambda c: F.col(c) if c in rows.columns else (defaults or {}).get(c, F.lit(None))
    return rows.select(*[value(c).cast(t).alias(c) for c, t in df.dtypes])


def update_returning(df: DataFrame, where: Column, values: dict[str, Column], returning: list[str]) -> DataFrame:
    """RETURNING of an update: the new values of the rows for which the condition is true."""
    return update(df.filter(where), F.lit(True), values).select(*returning)


def delete_returning(df: DataFrame, where: Column, returning: list[str]) -> DataFrame:
    """RETURNING of a delete: the rows that go."""
    return df.filter(where).select(*returning)


def truncate(df: DataFrame) -> DataFrame:
    """TRUNCATE: the table without rows, its schema kept."""
    return df.limit(0)


def delete(df: DataFrame, where: Column) -> DataFrame:
    """DELETE ... WHERE: rows for which the condition is false or null stay."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def upsert(df: DataFrame, rows: DataFrame, keys: list[str], on_conflict: str = "update", order: list[Column] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO UPDATE | NOTHING: one shuffle by key, the new row wins or loses as a whole.

    Rows with a null in a key conflict with nothing: all of them stay, old and new. New rows that repeat a key fail with
    DO UPDATE; with DO NOTHING the first by ``order`` (by their columns if none is given) is inserted.
    """
    others = [c for c in df.columns if c not in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    free = df.filter(~known).unionByName(rows.filter(~known))
    ranked = rows.filter(known).withColumn("_rank", F.struct(F.lit(1), *(order or [F.col(c) for c in others])))
    tagged = df.filter(known).withColumn("_new", F.lit(0)).unionByName(rows.filter(known).withColumn("_new", F.lit(1)))
    if on_conflict == "update":
        twice = F.raise_error(F.lit("ON CONFLICT DO UPDATE command cannot affect row a second time"))
        grouped = tagged.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("_new")).alias("_r"), F.sum("_new").alias("_n"))
        grouped = grouped.withColumn("_r", F.when(F.col("_n") > 1, twice).otherwise(F.col("_r")))
        picked = grouped.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])
    else:
        first = ranked.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col("_rank")).alias("_r")).select(*keys, "_r.*")
        picked = df.filter(known).unionByName(first.join(df.select(*keys), keys, "left_anti"))
    return picked.unionByName(free)


def apply_changes(df: DataFrame, log: DataFrame, keys: list[str], sequence: str, operation: str) -> DataFrame:
    """Replay a change log (operation: insert, update or delete) in order of ``sequence``: the last change of a key holds."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in log.columns if c not in keys]), F.col(sequence)).alias("_l"))
    untouched = df.join(last, keys, "left_anti")
    changed = last.filter(F.col(f"_l.{operation}") != "delete").select(*[F.col(c) if c in keys else F.col(f"_l.{c}").alias(c) for c in df.columns])
    return untouched.unionByName(changed)
