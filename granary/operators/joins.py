"""Joins that Spark has no single operator for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all column names in common, which appear once; without any in common a cross join."""
    common = [c for c in left.columns if c in set(right.columns)]
    return left.join(right, common, how) if common else left.crossJoin(right)


def scalar_left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails if a left row has a second match: a scalar subquery in the select list.

    The right side is reduced by key before the join (with partial aggregation), so the check needs no extra shuffle.
    """
    values = [c for c in right.columns if c not in keys]
    counted = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
    joined = left.join(counted, keys, "left")
    error = F.raise_error(F.lit("more than one row returned by a subquery used as an expression"))
    checked = [F.when(F.col("_n") > 1, error).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select(*left.columns, *checked)


def first_match_left_join(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left join that takes the first match of each left row by ``order`` and gives nulls where there is none."""
    values = [c for c in right.columns if c not in keys]
    first = right.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_m"))
    return left.join(first, keys, "left").select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in values])


def null_aware_anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """NOT IN: no row if the right side has a null; rows with a null key stay only if the right side is empty."""
    values = right.select(F.col(right_key).alias("_k"))
    facts = values.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("_k").isNull()).alias("_nulls"))
    kept = left.join(F.broadcast(facts), F.lit(True))  # one row
    kept = kept.filter((F.col("_rows") == 0) | ((F.col("_nulls") == 0) & F.col(left_key).isNotNull())).drop("_rows", "_nulls")
    return kept.join(values.distinct(), F.col(left_key) == F.col("_k"), "left_anti")


#: Bins that an interval of a range join is spread over at most, at its level.
MOST_BINS = 64


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Rows with low <= point < high: intervals are spread over bins of ``width`` and joined on the bin.

    An equi-join on bins instead of a nested loop; a bin holds what starts, ends or lies in it. An interval of more than
    MOST_BINS bins is joined at a coarser level, whose bins are MOST_BINS times as wide, so a wide one isn't copied more
    than MOST_BINS times. Inner, left, semi and anti joins; rows of the right side without a match need bins of their own,
    so right and full joins are refused.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("range_join is inner, left, left_semi or left_anti")
    span = F.greatest((F.col(high) - F.col(low)) / width, F.lit(1.0))
    level = F.floor(F.log(span) / F.log(F.lit(float(MOST_BINS)))).cast("int")
    levelled = right.filter(F.col(low) < F.col(high)).withColumn("_level", level)
    # a point has a bin at each level that some interval has
    levels = [r["_level"] for r in levelled.select("_level").distinct().collect()] or [0]
    sized = lambda k: F.lit(float(width)) * F.pow(F.lit(float(MOST_BINS)), k)
    keyed = left.withColumn("_pid", F.monotonically_increasing_id()) if how != "inner" else left
    wide = F.array(*[F.struct(F.lit(k).alias("l"), F.floor(F.col(point) / sized(F.lit(k))).alias("b")) for k in levels])
    binned = keyed.withColumn("_at", F.explode(wide)).select("*", F.col("_at.l").alias("_l"), F.col("_at.b").alias("_bin")).drop("_at")
    spread = levelled.withColumn("_rbin", F.explode(F.sequence(F.floor(F.col(low) / sized(F.col("_level"))), F.floor(F.col(high) / sized(F.col("_level"))))))
    near = (F.col("_l") == F.col("_level")) & (F.col("_bin") == F.col("_rbin")) & (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    if how == "inner" or len(levels) == 1:
        return binned.join(spread, near, how).drop("_l", "_bin", "_level", "_rbin", "_pid")
    if how == "left_semi":
        return binned.join(spread, near, how).dropDuplicates(["_pid"]).select(*left.columns)
    # a point is without a match if it has none at any level
    hits = binned.join(spread, near, "inner").drop("_l", "_bin", "_level", "_rbin")
    found = hits.select("_pid", *right.columns) if how == "left" else hits.select("_pid").distinct()
    return keyed.join(found, "_pid", how).drop("_pid")


#: Stretches of time that an as-of join cuts the histories of its keys into.
STRETCHES = 32


def _stretch(df: DataFrame, time: str) -> list:
    """Times that cut the rows of ``df`` into STRETCHES parts of about the same size (fewer where times repeat)."""
    shares = [k / STRETCHES for k in range(1, STRETCHES)]
    cuts = df.agg(F.percentile_approx(time, shares, 1000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each left row the values of the latest right row of its key at or before its time; nulls if there is none.

    Times are numbers, dates or timestamps. Time is cut into STRETCHES stretches of about as many rows each, so a key's
    rows are sorted in as many tasks, however hot it is: inside a stretch the last right row is carried forward, and what
    a stretch inherits is the last value of the stretches before it, of which a key has at most STRETCHES. Right rows
    without a time match nothing, left rows without a time or with a null key get nulls. Of right rows of one key and
    time the greatest by ``values`` counts.
    """
    names, missing = left.columns, F.lit(None)
    v = F.struct(*[F.col(c) for c in values])
    a = left.select(*[F.col(k) for k in keys], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), missing.alias("_v"))
    b = right.filter(F.col(right_time).isNotNull()).select(*[F.col(k) for k in keys], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), missing.alias("_row"), v.alias("_v"))
    for k in keys:  # a null key equals nothing
        b = b.filter(F.col(k).isNotNull())
    both = a.unionByName(b)
    stretch = F.lit(0)
    for cut in _stretch(both.select("_t"), "_t"):
        stretch = stretch + F.coalesce((F.col("_t") > F.lit(cut)).cast("int"), F.lit(-STRETCHES))
    both = both.withColumn("_stretch", F.greatest(stretch, F.lit(-1)))  # -1: without a time
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).filter("_side = 1")
    last = b.withColumn("_stretch", F.greatest(stretch, F.lit(-1))).groupBy(*keys, "_stretch").agg(F.max_by("_v", F.struct("_t", "_v")).alias("_last"))
    ahead = Window.partitionBy(*keys).orderBy("_stretch")
    # what the next stretches inherit, up to the next stretch that has a right row of its own
    spans = last.withColumn("_next", F.coalesce(F.lead("_stretch").over(ahead), F.lit(STRETCHES)))
    spans = spans.select(*keys, F.explode(F.sequence(F.col("_stretch") + 1, F.col("_next"))).alias("_stretch"), "_last")
    out = near.join(spans, [*keys, "_stretch"], "left").withColumn("_v", F.coalesce("_v", "_last"))
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in names], *[F.col(f"_v.{c}").alias(f"{c}_as_of") for c in values])


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "inner", hot_share: float = 0.01) -> DataFrame:
    """Equi-join whose hot left keys are spread: only right rows of hot keys are repeated, once per salt. Inner and left joins.

    A key is hot if it has more than ``hot_share`` of the left rows: at most 1 / hot_share keys, found by a count with
    partial aggregation and broadcast. Rows of the other keys have salt 0 on both sides.
    """
    assert how in ("inner", "left", "left_semi", "left_anti") and 0 < hot_share <= 1
    counted = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    hot = counted.filter(F.col("_n") > hot_share * total).select(*keys, F.lit(True).alias("_hot")).limit(int(1 / hot_share) + 1)
    own = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(0)
    a = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", own).drop("_hot")
    every = F.when(F.col("_hot"), F.array(*[F.lit(i) for i in range(salts)])).otherwise(F.array(F.lit(0)))
    b = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def exists_any(left: DataFrame, subqueries: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows for which one of the (right, left key, right key) EXISTS: each right side is reduced to its keys first."""
    out, flags = left, []
    for i, (right, left_key, right_key) in enumerate(subqueries):
        keys = right.select(F.col(right_key).alias(f"_k{i}")).distinct().withColumn(f"_e{i}", F.lit(True))
        out = out.join(keys, F.col(left_key) == F.col(f"_k{i}"), "left")
        flags.append(F.coalesce(F.col(f"_e{i}"), F.lit(False)))
    return out.filter(reduce(lambda a, b: a | b, flags)).select(*[F.col(c) for c in left.columns])


def broadcast_if_small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a table that has at most ``most_rows`` rows (counted up to there), else the table as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
