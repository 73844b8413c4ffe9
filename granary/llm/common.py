"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line contracts: blank, and \x09 to \x0D.
SPACES = " \t\n\x0b\f\r"
#: The same as a Java and RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own (local runs and tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def materialize(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Shuffle partitions for whole rows of a table: the session's number, more where its estimated size asks for more."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-estimate // bytes_each), 100_000))


#: A key with more than this share of a table's rows is dealt over several tasks by join_facts.
HOT_SHARE = 1 / 4096


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int, by: list[str | Column]) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row per key, so that no key's rows meet in one task.

    ``size`` is the column of ``facts`` that counts the key's rows in ``rows`` (it is dropped), ``total`` at least the
    number of all rows. A key with more than HOT_SHARE of them is cut into pieces of that many by a hash of ``by``, and
    its facts are repeated for each piece. There are fewer than 1 / HOT_SHARE such keys whatever the data, so their table
    (key and number of pieces) is broadcast. Keys are not null.
    """
    limit = max(total * HOT_SHARE, 1.0)
    hot = facts.filter(F.col(size) > limit).select(*keys, F.ceil(F.col(size) / limit).cast("int").alias("_pieces"))
    piece = F.when(F.col("_pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("_pieces").cast("long"))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_piece", piece).drop("_pieces")
    pieces = F.when(F.col(size) > limit, F.ceil(F.col(size) / limit)).otherwise(1).cast("int")
    spread = facts.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop(size)
    return dealt.join(spread, [*keys, "_piece"]).drop("_piece")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, as an array."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; together they stand for equality of texts."""
    return F.xxhash64(text), F.xxhash64(F.lit(0x5DEECE66D), text)


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """All columns but some as one struct column _row, so that no name of ours can meet one of theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without]).alias("_row"))


def of_row(name: str) -> Column:
    return F.col("_row").getField(name)


def unpacked(df: DataFrame, *more: Column, instead: dict[str, Column] | None = None) -> DataFrame:
    """The columns of _row again, some replaced, and more columns behind them."""
    names = df.schema["_row"].dataType.names
    return df.select(*[(instead or {}).get(c, of_row(c)).alias(c) for c in names], *more)
