"""Further queries: casts, lock-step functions, round trips, intervals, identifiers and case-insensitive text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import arrays, compat, datetimes, similarity, strings, values
from ..operators import joins, sampling
from ..operators.sets import shared_dir
from ..sources import files
from .registry import query

col, lit = F.col, F.lit


def scratch(spark) -> str:
    """A new folder that all executors see."""
    return f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, unnest([1, 2, 3]) AS a, unnest([n_name, n_name || '!']) AS b FROM nation")
def p02_lock_step_functions(t, spark):
    both = F.arrays_zip(F.array(lit(1), lit(2), lit(3)).alias("a"), F.array(col("n_name"), F.concat("n_name", lit("!"))).alias("b"))
    return t("nation").select("n_nationkey", F.explode_outer(both).alias("z")).select("n_nationkey", "z.a", "z.b")


@query("SELECT o_orderkey, (NULLIF(o_orderstatus, 'F') IS NULL AND NULLIF(o_custkey % 2, 0) IS NULL) AS all_null, (NULLIF(o_orderstatus, 'F') IS NOT NULL AND NULLIF(o_custkey % 2, 0) IS NOT NULL) AS none_null FROM orders")
def p08_row_null_tests(t, spark):
    a, b = F.nullif("o_orderstatus", lit("F")), F.nullif(col("o_custkey") % 2, lit(0))
    return t("orders").select("o_orderkey", (a.isNull() & b.isNull()).alias("all_null"), (a.isNotNull() & b.isNotNull()).alias("none_null"))


@query("SELECT l_orderkey, l_linenumber, l_quantity::INT::VARCHAR AS q, l_orderkey::DOUBLE AS d, (l_linenumber::VARCHAR || '7')::INT AS i, (l_linenumber % 2)::BOOLEAN AS b, l_shipdate::DATE::VARCHAR AS s, '1996-02-28'::DATE < l_shipdate AS later FROM lineitem")
def p22_casts(t, spark):
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.rint("l_quantity").cast("int").cast("string").alias("q"), col("l_orderkey").cast("double").alias("d"), F.concat(col("l_linenumber").cast("string"), lit("7")).cast("int").alias("i"),
        (col("l_linenumber") % 2).cast("boolean").alias("b"), col("l_shipdate").cast("date").cast("string").alias("s"), (lit("1996-02-28").cast("date") < col("l_shipdate")).alias("later"),
    )


@query("SELECT n_nationkey, n_name, NULLIF(n_regionkey, 2) AS r FROM nation")
def s30_copy_round_trip(t, spark):
    path = scratch(spark)
    files.copy_to(t("nation").select("n_nationkey", "n_name", F.nullif("n_regionkey", lit(2)).alias("r")), path, format="text")
    return files.copy_from(spark, path, "n_nationkey int, n_name string, r int", format="text")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY 1")
def s35_create_table_as(t, spark):
    path = scratch(spark)
    return files.materialized_view(t("customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("a")), path)


@query("SELECT count(*) AS n FROM nation")
def s05_system_sample(t, spark):
    return sampling.system(t("nation"), 100, 5).agg(F.count(lit(1)).alias("n"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j04_broadcast_join(t, spark):
    return t("supplier").join(joins.broadcast_if_small(t("nation")), col("s_nationkey") == col("n_nationkey")).select("s_suppkey", "n_name")


@query("SELECT min(o_orderdate)::DATE::VARCHAR AS first, max(o_orderdate)::DATE::VARCHAR AS last, min(o_orderpriority) AS lo, max(o_orderkey) AS hi FROM orders")
def a10_min_max(t, spark):
    return t("orders").agg(F.min("o_orderdate").cast("date").cast("string").alias("first"), F.max("o_orderdate").cast("date").cast("string").alias("last"), F.min("o_orderpriority").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT o_custkey, array_to_string(array_agg(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY 1")
def a38_integer_aggregate(t, spark):
    return t("orders").groupBy("o_custkey").agg(arrays.array_to_string(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("keys"))


@query("SELECT l_partkey, min(l_quantity) AS lower, max(l_quantity + l_tax) AS upper FROM lineitem GROUP BY 1")
def a19_range_merge(t, spark):
    return t("lineitem").groupBy("l_partkey").agg(F.min("l_quantity").alias("lower"), F.max(col("l_quantity") + col("l_tax")).alias("upper"))


@query("SELECT user_id, sum(event_id % 5)::BIGINT AS months, sum(event_id % 40)::BIGINT AS days FROM events GROUP BY 1")
def dt16_interval_sum(t, spark):
    i = datetimes.interval(col("event_id") % 5, col("event_id") % 40)
    return t("events").select("user_id", i.alias("i")).groupBy("user_id").agg(F.sum("i.months").alias("months"), F.sum("i.days").alias("days"))


@query("SELECT event_id, (event_id % 3) * 30 + event_id % 50 AS days FROM events ORDER BY days DESC, event_id")
def dt16_interval_order(t, spark):
    i = datetimes.interval(col("event_id") % 3, col("event_id") % 50)
    return t("events").select("event_id", (datetimes.interval_key(i) / datetimes.DAY).cast("long").alias("days")).orderBy(col("days").desc(), "event_id")


@query("SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '-X Y' AS i FROM customer")
def str04_initcap(t, spark):
    return t("customer").select("c_custkey", strings.initcap(F.concat("c_mktsegment", lit("-x y"))).alias("i"))


@query("""
SELECT doc_id, md5(translate(text, 'ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÇçÑñÝýÿ',
  'AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOOooooooUUUUuuuuCcNnYyy')) AS m FROM documents""")
def ex10_unaccent(t, spark):
    return t("documents").select("doc_id", F.md5(similarity.unaccent(col("text")).cast("binary")).alias("m"))


@query("SELECT c_custkey, lower(c_mktsegment) = 'building' AS same, strpos(lower(c_name), 'customer') AS p FROM customer")
def ex09_case_insensitive_text(t, spark):
    low = F.collate("c_mktsegment", "UTF8_LCASE")
    return t("customer").select("c_custkey", (low == F.collate(lit("bUiLdInG"), "UTF8_LCASE")).alias("same"), F.position(lit("customer"), F.lower("c_name")).cast("long").alias("p"))


@query("SELECT n_nationkey, rpad(n_name, 10, '.') AS r, lpad(n_name, 10, '-=') AS l FROM nation")
def or01_display_padding(t, spark):
    return t("nation").select("n_nationkey", compat.rpad(col("n_name"), 10, ".").alias("r"), compat.lpad(col("n_name"), 10, "-=").alias("l"))


HALF = "".join(map(chr, range(0x20, 0x7F))).replace("'", "''")
FULL = "\u3000" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


@query(f"SELECT doc_id, md5(translate(text, '{HALF}', '{FULL}')) AS multi, md5(translate(text, '{FULL}', '{HALF}')) AS single FROM documents")
def or05_full_width_round_trip(t, spark):
    x = col("text")
    digest = lambda c: F.md5(c.cast("binary"))
    return t("documents").select("doc_id", digest(compat.to_multi_byte(x)).alias("multi"), digest(compat.to_single_byte(compat.to_multi_byte(x))).alias("single"))


@query("SELECT event_id, (event_id * 7919) % 4294967296 AS n FROM events")
def nd02_network_numbers(t, spark):
    n = (col("event_id") * 7919) % 4294967296
    return t("events").select("event_id", values.inet_number(values.number_inet(n)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey % 4 = 1 AS r FROM lineitem")
def sy08_modulo_partition(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", (F.pmod("l_orderkey", lit(4)) == 1).alias("r"))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r <= 2")
def w02_top_two_per_group(t, spark):
    from ..operators.aggregates import top_k

    counted = t("events").groupBy("user_id", "event_type").agg(F.count(lit(1)).alias("n"))
    return top_k(counted, ["user_id"], [col("n").desc(), col("event_type")], 2)


@query("SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2")
def w13_sessions_by_gap(t, spark):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), col("ts"))
    flagged = t("events").withColumn("new", F.when(gap <= 3_600_000_000, 0).otherwise(1))
    return flagged.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count(lit(1)).alias("n"))
