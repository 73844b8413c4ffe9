"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, of_row, packed, text_of, unpacked

#: Poisson means above this are drawn as the sum of several draws of equal, smaller means (Poisson variables add up).
STEP = 16.0
#: Terms kept of one draw's distribution; for a mean of at most STEP less than 1e-40 of the mass lies beyond.
TERMS = 120
#: Source tables of at most this many rows are broadcast.
BROADCAST_SOURCES = 50_000
#: Sources' salts where the source table is too large to broadcast.
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1): the first 52 bits of an md5 digest of the parts, joined by '|'."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_rates(df: DataFrame, source: str, mass: Column, alpha: float, epochs: float, targets: DataFrame | None = None) -> DataFrame:
    """One row per source: its mass, target weight, mean repetition rate, and the distribution function of one draw.

    Without ``targets`` (columns source, weight) the weight is mass ** alpha. rate = epochs * weight share / mass share.
    Targets count in proportion to the largest, down to 2 ** -40 of it, so they may be shares, percents or masses.
    """
    sums = df.groupBy(F.col(source).alias("_source")).agg(F.sum(mass).alias("_mass"))
    if targets is None:
        weighed = sums.withColumn("_weight", F.when(F.col("_mass") > 0, F.sqrt("_mass") if alpha == 0.5 else F.pow("_mass", F.lit(alpha))).otherwise(0.0))
    else:
        t = targets.groupBy(F.col("source").alias("_to")).agg(F.sum("weight").cast("double").alias("_to_weight"))
        t = t.join(F.broadcast(t.agg(F.max("_to_weight").alias("_top"))))  # one row
        t = t.select("_to", F.when(F.col("_top") > 0, F.col("_to_weight") / F.col("_top") * 2**30).otherwise(0.0).alias("_weight"))
        weighed = sums.join(t, F.col("_source").eqNullSafe(F.col("_to")), "left").drop("_to").na.fill(0.0, ["_weight"])
    totals = weighed.agg(F.sum("_mass").alias("_all_mass"), F.sum(F.round(F.col("_weight") * 1024).cast("long")).alias("_all_weight"))
    shares = weighed.join(F.broadcast(totals))  # one row
    rate = F.lit(epochs) * (F.round(F.col("_weight") * 1024) / F.col("_all_weight")) * (F.col("_all_mass") / F.col("_mass"))
    rated = shares.withColumn("_rate", F.when((F.col("_mass") > 0) & (F.col("_all_weight") > 0), rate).otherwise(0.0))
    rated = rated.withColumn("_draws", F.greatest(F.lit(1), F.ceil(F.col("_rate") / STEP).cast("int"))).withColumn("_mean", F.col("_rate") / F.col("_draws"))
    start = F.struct(F.exp(-F.col("_mean")).alias("p"), F.array(F.exp(-F.col("_mean"))).alias("cdf"))

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * F.col("_mean") / k
        return F.struct(p.alias("p"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + p).alias("cdf"))

    return rated.select("_source", "_rate", "_draws", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda s: s["cdf"]).alias("_cdf"))


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", *,
    alpha: float = 0.5, epochs: float = 1.0, seed: int = 5, targets: DataFrame | None = None, partitions: int | None = None,
) -> DataFrame:
    """Repeat documents so that sources reach their target weights, and shuffle the copies globally.

    A source's mass is the UTF-8 bytes of its texts. A document is repeated as often as the Poisson distribution with
    its source's mean rate has it at the document's own uniform hash of (seed, id, text digest): 0 times or more. Adds
    copy_no (from 0), rate and shuffle_key; rows are dealt by shuffle_key and sorted by it within each partition.

    Null texts are empty and have no mass; a null source is a source of its own; equal rows (same id and text) get
    equal counts and keys; a source without mass has rate 0; an empty table gives an empty result. Columns called
    copy_no, rate or shuffle_key are replaced, others are carried along.
    """
    spark: SparkSession = df.sparkSession
    df = df.drop("copy_no", "rate", "shuffle_key")
    rows = packed(df)
    t = F.coalesce(of_row(text), F.lit(""))
    slim = df.select(F.col(source).alias("_s"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_m"))
    rates = source_rates(slim, "_s", F.col("_m"), alpha, epochs, targets)
    n_sources = slim.select("_s").distinct().count()
    if n_sources <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), of_row(source).eqNullSafe(F.col("_source")), "left")
    else:  # hot sources are spread over the salts
        salted = rates.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        left = rows.withColumn("_own", F.pmod(F.xxhash64(of_row(id_col), of_row(text)), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, of_row(source).eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt")), "left")
    drawn = joined.withColumn("_digest", F.md5(t.cast("binary")))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("_draws")), F.lit(0),
        lambda n, k: n + F.aggregate(
            F.array(uniform(F.lit(seed), of_row(id_col), F.col("_digest"), k)), F.lit(0),
            lambda _, u: F.size(F.filter("_cdf", lambda c: c <= u))),
    )
    copies = (
        drawn.withColumn("_n", F.when(F.col("_rate") > 0, count).otherwise(0)).filter("_n > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select("_row", "copy_no", F.col("_rate").alias("rate"), uniform(F.lit(seed), F.lit("order"), of_row(id_col), F.col("_digest"), F.col("copy_no")).alias("shuffle_key"))
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.repartitionById(n, F.floor(F.col("shuffle_key") * n).cast("int")).sortWithinPartitions("shuffle_key")
    return unpacked(dealt, F.col("copy_no"), F.col("rate"), F.col("shuffle_key"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: documents mixed to weights of mass ** 0.5 at one epoch; a row per copy, without its text."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix_sources(docs).select(
        "doc_id", "source", "copy_no", F.round("rate", 9).alias("rate"), "shuffle_key",
        F.octet_length(text_of()).cast("long").alias("n_bytes"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT source, sum(octet_length(encode(t)))::BIGINT AS mass FROM d GROUP BY source),
w AS (SELECT *, round(sqrt(mass) * 1024) AS w FROM m),
r AS (SELECT source, CASE WHEN mass > 0 THEN 1.0::DOUBLE * (w / (SELECT sum(w::BIGINT)::DOUBLE FROM w)) * ((SELECT sum(mass)::DOUBLE FROM m) / mass) ELSE 0 END AS rate FROM w),
k AS (SELECT *, greatest(1, ceil(rate / 16.0)::INT) AS draws FROM r),
pmf AS (SELECT source, 0 AS k, exp(-rate / draws) AS p FROM k UNION ALL
  SELECT source, i, exp(-rate / draws + i * ln(rate / draws) - lgamma(i + 1.0)) FROM k, range(1, 121) q(i) WHERE rate > 0),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
v AS (SELECT d.doc_id, d.source, d.t, k.rate, unnest(range(1, k.draws + 1)) AS i FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
u AS (SELECT *, ('0x' || substr(md5('5|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(t) || '|' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM v),
n AS (SELECT u.doc_id, u.source, u.t, u.rate, count(c.k) AS n FROM u LEFT JOIN cdf c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u
  WHERE rate > 0 GROUP BY u.doc_id, u.source, u.t, u.rate),
e AS (SELECT *, unnest(range(0, n)) AS copy_no FROM n)
SELECT doc_id, source, copy_no::INT AS copy_no, round(rate, 9) AS rate,
  ('0x' || substr(md5('5|order|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(t) || '|' || copy_no), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key,
  octet_length(encode(t))::BIGINT AS n_bytes FROM e
"""
