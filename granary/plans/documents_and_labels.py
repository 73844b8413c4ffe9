"""Queries of XML rows, XPath, path patterns, segments and serial numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers, segments, values, xml
from .registry import query

col, lit = F.col, F.lit


@query("""
SELECT '<row><n_nationkey>' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name>'
  || coalesce('<r>' || NULLIF(n_regionkey, 2) || '</r>', '') || '</row>' AS xml FROM nation""")
def jx10_rows_to_xml(t, spark):
    return xml.row_elements(t("nation").select("n_nationkey", "n_name", F.nullif("n_regionkey", lit(2)).alias("r")))


@query("SELECT n_nationkey, n_name || '|' || n_regionkey AS l, n_name AS first, n_regionkey > 1 AS big FROM nation")
def ex14_xpath(t, spark):
    doc = xml.element("n", xml.forest(v=col("n_name")), xml.forest(v=col("n_regionkey")))
    return t("nation").select("n_nationkey", xml.xpath_list(doc, "/n/v/text()", "|").alias("l"), xml.xpath(doc, "/n/v/text()")[0].alias("first"), xml.xpath_exists(doc, "/n[v[2] > 1]").alias("big"))


@query("""
SELECT n_nationkey, n_nationkey::VARCHAR LIKE '1%' OR n_nationkey = 2 AS labels, n_regionkey <> 1 AS others, n_regionkey = 3 AS words
FROM nation""")
def ex02_path_patterns(t, spark):
    path = F.concat_ws(".", lit("Top"), F.concat(lit("region_"), col("n_regionkey").cast("string"), lit("_x")), F.concat(lit("n"), col("n_nationkey").cast("string")))
    return t("nation").select(
        "n_nationkey", values.path_matches(path, "top@.*{1}.N1*@|n2").alias("labels"),
        values.path_matches(path, "Top.!region_1_x.*").alias("others"), values.path_matches(path, "*.region_3%.*{1,}").alias("words"),
    )


@query("""
SELECT p_partkey, (p_size <= 20 AND p_size + 5 >= 10) AS meets, (p_size >= 10 AND p_size + 5 <= 20) AS inside,
  p_size + 5 < 10 AS before, (p_size + 2.5)::DOUBLE AS middle,
  CASE WHEN p_size <= 20 AND p_size + 5 >= 10 THEN (least(p_size + 5, 20) - greatest(p_size, 10))::DOUBLE END AS shared
FROM part""")
def ex04_segments(t, spark):
    a = segments.parse(F.concat(lit("~"), col("p_size").cast("string"), lit(" .. "), (col("p_size") + 5).cast("string")))
    b = segments.parse(lit("15 (+-) 5"))
    return t("part").select(
        "p_partkey", segments.overlaps(a, b).alias("meets"), segments.contains(b, a).alias("inside"), segments.left_of(a, b).alias("before"),
        segments.center(a).alias("middle"), segments.size(segments.intersection(a, b)).alias("shared"),
    )


@query("""
SELECT o_orderkey, TRUE AS right_digit, FALSE AS wrong_digit, (10 - s % 10) % 10 AS digit FROM (SELECT o_orderkey,
  list_sum(list_transform(range(1, 12), lambda i: substr(lpad(o_orderkey::VARCHAR, 11, '0'), i, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) AS s FROM orders)""")
def ex15_upc(t, spark):
    core = F.lpad(col("o_orderkey").cast("string"), 11, "0")
    digit = identifiers.ean13_check_digit(F.concat(lit("0"), core))
    upc, other = F.concat(core, digit.cast("string")), F.concat(core, ((digit + 1) % 10).cast("string"))
    return t("orders").select("o_orderkey", identifiers.is_upc(upc).alias("right_digit"), identifiers.is_upc(other).alias("wrong_digit"), digit.alias("digit"))
