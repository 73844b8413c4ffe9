"""Queries of partition routing, integer arrays, boxes, maps, bit strings, lexemes and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, search, values
from ..operators import partitions
from .registry import query

col, lit = F.col, F.lit


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 9 END AS by_list,
  CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 ELSE 2 END AS by_range FROM orders""")
def d04_list_and_range_routing(t, spark):
    by_list = partitions.list_partition(col("o_orderstatus"), [["F"], ["O", None]], default=9)
    by_range = partitions.range_partition(col("o_totalprice"), [None, 50000, 150000, None])
    return t("orders").select("o_orderkey", by_list.alias("by_list"), by_range.alias("by_range"))


@query("SELECT c_nationkey AS k, count(*) AS n, TRUE AS one FROM customer GROUP BY 1")
def d02_distribute_by_shard(t, spark):
    """All rows of a key are in one slot, so one group owns them."""
    dealt = t("customer").withColumn("g", partitions.shard_group(["c_nationkey"], 4096, [3, 5, 8]))
    return dealt.groupBy(col("c_nationkey").alias("k")).agg(F.count(lit(1)).alias("n"), ((F.count_distinct("g") == 1) & F.bool_and(col("g").isin(3, 5, 8))).alias("one"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(a || b)), ',') AS u, array_to_string(list_sort(list_distinct(list_intersect(a, b))), ',') AS i,
  array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS e, array_to_string(a[2:3], ',') AS s, array_to_string(a[3:4], ',') AS l
FROM (SELECT p_partkey, [p_size % 5, 7, p_size % 5, 3] AS a, [3, p_size % 7] AS b FROM part)""")
def ex08_integer_array_algebra(t, spark):
    n = col("p_size")
    a, b = F.array(n % 5, lit(7), n % 5, lit(3)), F.array(lit(3), n % 7)
    shown = lambda x: F.array_join(x.cast("array<string>"), ",")
    return t("part").select(
        "p_partkey", shown(arrays.union_ints(a, b)).alias("u"), shown(arrays.intersect_ints(a, b)).alias("i"), shown(arrays.except_ints(a, b)).alias("e"),
        shown(arrays.subarray(a, 2, -1)).alias("s"), shown(arrays.subarray(a, -2)).alias("l"))


@query("""
SELECT p_partkey, p_size >= 15 AND p_size + 10 <= 40 AS inside, least(p_size, 15)::DOUBLE AS low, greatest(p_size + 10, 40)::DOUBLE AS high,
  greatest(p_size, 15)::DOUBLE AS shared, 50.0::DOUBLE AS size, 84.0::DOUBLE AS larger FROM part""")
def ex03_boxes(t, spark):
    n = col("p_size").cast("double")
    a, b = (F.array(n, lit(0.0)), F.array(n + 10, lit(5.0))), (F.array(lit(15.0), lit(0.0)), F.array(lit(40.0), lit(9.0)))
    wide = arrays.cube_enlarge(*a, 1.0)
    return t("part").select(
        "p_partkey", arrays.cube_contains(*b, *a).alias("inside"), F.get(arrays.cube_union(*a, *b)["low"], lit(0)).alias("low"), F.get(arrays.cube_union(*a, *b)["high"], lit(0)).alias("high"),
        F.get(arrays.cube_inter(*a, *b)["low"], lit(0)).alias("shared"), arrays.cube_size(*a).alias("size"), arrays.cube_size(wide["low"], wide["high"]).alias("larger"))


@query("""
SELECT n_nationkey, 'a,c' AS keys, CASE WHEN n_regionkey = 2 THEN 'a,c' ELSE 'a,b,c' END AS rest, TRUE AS a, FALSE AS c FROM nation""")
def ex01_map_algebra(t, spark):
    m = F.create_map(lit("a"), col("n_name"), lit("b"), col("n_regionkey").cast("string"), lit("c"), lit(None).cast("string"))
    keys = lambda x: F.array_join(F.sort_array(F.map_keys(x)), ",")
    return t("nation").select(
        "n_nationkey", keys(values.map_slice(m, ["a", "c", "z"])).alias("keys"), keys(values.map_minus(m, F.create_map(lit("b"), lit("2")))).alias("rest"),
        values.map_defined(m, "a").alias("a"), values.map_defined(m, "c").alias("c"))


@query("""
SELECT p_partkey, substr(b, 1, 1)::INT AS first, substr(b, 1, 2) || '1' || substr(b, 4) AS put
FROM (SELECT p_partkey, lpad(bin(p_size), 6, '0') AS b FROM part)""")
def nd06_bits_by_place(t, spark):
    b = F.lpad(F.bin("p_size"), 6, "0")
    return t("part").select("p_partkey", values.bit_at(b, lit(0)).alias("first"), values.bit_put(b, lit(2), lit(1)).alias("put"))


@query("""
SELECT p_partkey, d || ',brand' AS lexemes, d AS rest, 'brand' AS weighed FROM (SELECT p_partkey, split_part(p_brand, '#', 2) AS d FROM part)""")
def ft04_lexemes_and_weights(t, spark):
    v = search.to_tsvector(col("p_brand"))
    weighed = search.filter_weights(search.set_weight(v, "A", ["brand"]), ["A", "B"])
    return t("part").select(
        "p_partkey", F.array_join(search.strip(v), ",").alias("lexemes"), F.array_join(search.strip(search.delete(v, ["brand"])), ",").alias("rest"),
        F.array_join(search.strip(weighed), ",").alias("weighed"))


@query("""
SELECT p_partkey, substr((p_partkey * 1000003)::VARCHAR, 1, 6) AS cut, CASE p_size % 3 WHEN 0 THEN 'w0,zero,nil' WHEN 1 THEN 'w1,one' END AS lexemes FROM part""")
def ex16_dictionaries(t, spark):
    lexemes = search.synonym_dictionary(F.concat(lit("W"), (col("p_size") % 3).cast("string")), {"w0": ["zero", "nil"], "w1": ["one"]})
    cut = search.int_dictionary((col("p_partkey").cast("long") * 1000003).cast("string"))
    return t("part").select("p_partkey", F.array_join(cut, ",").alias("cut"), F.array_join(lexemes, ",").alias("lexemes"))
