"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, of_row, packed, text_of, unpacked

#: Rounds of the Feistel network, and steps of a cycle walk after which we give up with an error.
ROUNDS, MAX_WALK = 6, 256


#: Rows of a bucket that are sorted together, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 4096


def number_rows(df: DataFrame, order: list[str], buckets: int | None = None) -> DataFrame:
    """Add row_no (0-based, gapless) and n_rows.

    The order is that of the hash buckets of ``order`` and, in a bucket, of the columns themselves, so it depends on
    the rows alone and not on how they are partitioned. Each bucket is sorted by itself; only ``buckets`` counts meet
    in one task; without a number given it is a power of two that grows with the number of rows. Nulls are values like
    others; rows equal in ``order`` get neighbouring numbers in any order.
    """
    if buckets is None:
        buckets = max(LEAST_BUCKETS, 1 << (max(df.count(), 1) // BUCKET_ROWS).bit_length())
    keys = [of_row(c) for c in order]
    bucketed = packed(df).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.orderBy("_bucket")  # at most ``buckets`` rows
    starts = counts.select(
        "_bucket",
        (F.sum("_n").over(over) - F.col("_n")).alias("_start"),
        F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*[k.asc_nulls_first() for k in keys]))
    numbered = bucketed.withColumn("_within", within.cast("long") - 1).join(F.broadcast(starts), "_bucket")
    return unpacked(numbered, (F.col("_start") + F.col("_within")).alias("row_no"), F.col("_all").alias("n_rows"))


def feistel(x: Column, n: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 .. n-1: an unbalanced Feistel network on a x b >= n cells, and cycle walking back below n.

    a is the root of n rounded up and b = ceil(n / a), so fewer than a cells lie beyond n and a walk is seldom needed.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    b = F.greatest(F.ceil(n / a.cast("double")).cast("long"), F.lit(1))

    def one_round(s: Column, r: Column) -> Column:
        moved = F.xxhash64(s["right"], r, F.lit(seed))
        modulus = s["m_left"]
        return F.struct(
            s["right"].alias("left"), F.pmod(s["left"] + F.pmod(moved, modulus), modulus).alias("right"),
            s["m_right"].alias("m_left"), s["m_left"].alias("m_right"),
        )

    def once(v: Column) -> Column:
        start = F.struct(F.call_function("div", v, b).alias("left"), F.pmod(v, b).alias("right"), a.alias("m_left"), b.alias("m_right"))
        # an even number of rounds leaves the halves in their places
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one_round, lambda s: s["left"] * s["m_right"] + s["right"])

    def walk(v: Column, _: Column) -> Column:
        return F.when(v < n, v).otherwise(once(v))

    def walked(y: Column) -> Column:
        end = F.aggregate(F.sequence(F.lit(2), F.lit(MAX_WALK)), y, walk)
        return F.when(end < n, end).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))

    # few positions lie beyond n; only those walk
    return F.aggregate(F.array(once(x)), F.lit(None).cast("long"), lambda _, y: F.when(y < n, y).otherwise(walked(y)))


def shard_rows(df: DataFrame, order: list[str], n_shards: int = 8, seed: int = 20, buckets: int | None = None) -> DataFrame:
    """Deal rows into shards by a reproducible shuffle: adds row_no, position, shard and slot.

    position = feistel(row_no); shard = position mod n_shards, slot = position div n_shards. Shard sizes differ by one
    row at most and slots are gapless from 0. Where a row goes can be computed from its number alone. Rows that are
    equal in ``order`` may be swapped among themselves, nulls in ``order`` are values; an empty table gives an empty
    result; other columns are carried along (row_no, position, shard, slot and n_rows are replaced if present).
    """
    assert ROUNDS % 2 == 0 and n_shards > 0
    plain = df.drop("row_no", "position", "shard", "slot", "n_rows")
    placed = number_rows(plain, order, buckets).withColumn("position", feistel(F.col("row_no"), F.col("n_rows"), seed))
    return placed.withColumns({
        "shard": F.pmod(F.col("position"), F.lit(n_shards)).cast("int"),
        "slot": F.call_function("div", F.col("position"), F.lit(n_shards)),
    }).drop("n_rows")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: every row of documents by the law ``rows`` (counts at most one apart)."""
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    dealt = shard_rows(rows, ["doc_id", "size", "text_crc32"])
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_no", "position",
    )
