"""Queries of search, value types, user functions, streams and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests, identifiers, search, user, values, xml
from ..streaming.changes import tumbling_counts
from .registry import query

col, lit = F.col, F.lit


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])license([^\\p{L}\\p{N}]|$)') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])mit([^\\p{L}\\p{N}]|$)')")
def ft02_match(t, spark):
    return t("documents").select("doc_id", search.to_tsvector(col("text")).alias("v")).filter(search.matches(col("v"), "license & mit")).select("doc_id")


@query("""
SELECT doc_id, round(coalesce(list_sum(list_transform(range(1, n + 1), lambda k: 0.1 / (k * k))), 0) / 1.64493406685, 9) AS rank FROM
  (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w IN ('license', 'licenses'))) AS n FROM documents)""")
def ft03_rank(t, spark):
    v = search.to_tsvector(col("text"))
    return t("documents").select("doc_id", F.round(search.rank(v, ["license"]), 9).alias("rank"))


@query("SELECT user_id, '10.' || user_id % 256 || '.' || event_id % 256 || '.7/24' AS a, '10.' || user_id % 256 || '.' || event_id % 256 || '.0/24' AS net, '10.' || user_id % 256 || '.' || event_id % 256 || '.255/24' AS bc, user_id % 256 = 7 AS inside FROM events")
def nd01_networks(t, spark):
    a = F.concat_ws(".", lit("10"), (col("user_id") % 256).cast("string"), (col("event_id") % 256).cast("string"), lit("7/24"))
    return t("events").select("user_id", a.alias("a"), values.network(a).alias("net"), values.broadcast(a).alias("bc"), values.inside_network(a, lit("10.7.0.0/16")).alias("inside"))


@query("SELECT p_partkey, lpad(bin(p_size & 42), 6, '0') AS a, lpad(bin(p_size | 42), 6, '0') AS o, lpad(bin(xor(p_size, 42)), 6, '0') AS x, lpad(bin((p_size << 2) & 63), 6, '0') AS s FROM part")
def nd06_bit_strings(t, spark):
    b = F.lpad(F.bin("p_size"), 6, "0")
    m = lit("101010")
    return t("part").select("p_partkey", values.bit_combine(b, m, "&").alias("a"), values.bit_combine(b, m, "|").alias("o"), values.bit_combine(b, m, "#").alias("x"), values.bit_shift(b, 2).alias("s"))


@query("SELECT min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END)::INT AS lo, max(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END)::INT AS hi, o_custkey FROM orders GROUP BY o_custkey")
def nd08_enum_order(t, spark):
    e = values.Enum("P", "O", "F")
    return t("orders").groupBy("o_custkey").agg(F.min(e.ordinal(col("o_orderstatus"))).alias("lo"), F.max(e.ordinal(col("o_orderstatus"))).alias("hi"))


@query("SELECT p_partkey, round(sqrt(pow(p_size - 3, 2) + 16), 6) AS d, (sqrt(pow(p_size - 3, 2) + 16) <= 20) AS c, (p_size * 2.0)::DOUBLE AS area FROM part")
def nd04_geometry(t, spark):
    p = values.point(col("p_size"), lit(4))
    square = F.array(values.point(lit(0), lit(0)), values.point(col("p_size"), lit(0)), values.point(col("p_size"), lit(2)), values.point(lit(0), lit(2)))
    q = values.point(lit(3), lit(0))
    return t("part").select("p_partkey", F.round(values.distance(p, q), 6).alias("d"), values.in_circle(p, q, lit(20)).alias("c"), values.polygon_area(square).alias("area"))


@query("SELECT n_nationkey, 3 AS levels, 'top.' || n_regionkey AS sub, n_regionkey = 1 AS anc, CASE WHEN n_regionkey = 1 THEN 'top.1' ELSE 'top' END AS lca FROM nation")
def ex02_label_paths(t, spark):
    path = F.concat_ws(".", lit("top"), col("n_regionkey").cast("string"), F.concat(lit("n"), col("n_nationkey").cast("string")))
    return t("nation").select("n_nationkey", values.nlevel(path).alias("levels"), values.subpath(path, 0, 2).alias("sub"), values.is_ancestor(lit("top.1"), path).alias("anc"), values.lca(path, lit("top.1.x")).alias("lca"))


@query("SELECT n_nationkey, 'a,k' AS keys, n_name AS k, n_regionkey = 2 AS has FROM nation")
def ex01_maps(t, spark):
    m = values.map_concat(F.create_map(lit("a"), lit("old"), lit("z"), lit("gone")), F.create_map(lit("k"), col("n_name"), lit("a"), col("n_regionkey").cast("string")))
    m = values.map_delete(m, "z")
    return t("nation").select("n_nationkey", F.array_join(F.sort_array(F.map_keys(m)), ",").alias("keys"), F.element_at(m, "k").alias("k"), values.map_contains(m, F.create_map(lit("a"), lit("2"))).alias("has"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def f01_sql_function(t, spark):
    user.sql_function(spark, "net_price", "p DOUBLE, d DOUBLE", "DOUBLE", "p * (1 - d)")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.expr("net_price(l_extendedprice, l_discount)"), 4).alias("net"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def f05_user_aggregate(t, spark):
    squares = user.aggregate(t("lineitem"), ["l_returnflag"], "l_quantity", "q", "double", step=lambda v: float((v * v).sum()), combine=lambda s: float(s.sum()))
    return squares.withColumn("q", F.round("q", 2))


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def f07_table_function(t, spark):
    return spark.sql("SELECT p_partkey, word FROM {parts}, LATERAL explode(split(p_type, ' ')) AS w(word)", parts=t("part"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st06_tumbling_window(t, spark):
    return tumbling_counts(t("events"), "ts", ["event_type"], "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("SELECT c_custkey, '***' || right(c_name, 4) AS name FROM customer WHERE c_acctbal > 0")
def p32_masking_view(t, spark):
    """A view with a row policy and a masked column."""
    from ..operators import policies

    allowed = policies.row_policy(t("customer"), col("c_acctbal") > 0)
    return policies.masked(allowed.select("c_custkey", col("c_name").alias("name")), {"name": policies.keep_last(col("name"), 4)})


@query("SELECT row_number() OVER (ORDER BY c_custkey) + 99 AS id, c_custkey FROM customer")
def sy01_sequence(t, spark):
    from ..operators.sequences import number

    return number(t("customer").select("c_custkey"), [col("c_custkey")], "id", start=100)


@query("SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s, sha1(p_brand) AS s1 FROM part")
def ex12_digests(t, spark):
    return t("part").select("p_partkey", digests.digest(col("p_name"), "md5").alias("m"), digests.digest(col("p_name"), "sha256").alias("s"), digests.digest(col("p_brand"), "sha1").alias("s1"))


@query("SELECT n_regionkey, string_agg('<n id=\"' || n_nationkey || '\">' || n_name || '</n>', '' ORDER BY n_nationkey) AS x FROM nation GROUP BY 1")
def a18_xml_agg(t, spark):
    e = xml.element("n", xml.escape(col("n_name")), attributes={"id": col("n_nationkey")})
    return t("nation").groupBy("n_regionkey").agg(xml.agg(e, col("n_nationkey")).alias("x"))


@query("SELECT n_regionkey, n_nationkey AS id, n_name AS name FROM nation")
def s15_xml_table(t, spark):
    e = xml.element("n", xml.forest(name=col("n_name")), attributes={"id": col("n_nationkey")})
    docs = t("nation").groupBy("n_regionkey").agg(F.concat(lit("<r>"), xml.agg(e, col("n_nationkey")), lit("</r>")).alias("doc"))
    return xml.table_rows(docs, "doc", "/r/n", {"id": ("@id", "int", None), "name": ("name", "string", "?")})


@query("SELECT o_orderkey, CASE WHEN o_orderkey * 1000 < 10240 THEN (o_orderkey * 1000)::VARCHAR || ' bytes' WHEN floor(o_orderkey * 1000 / 1024.0 + 0.5) < 10240 THEN floor(o_orderkey * 1000 / 1024.0 + 0.5)::BIGINT::VARCHAR || ' kB' ELSE floor(o_orderkey * 1000 / 1048576.0 + 0.5)::BIGINT::VARCHAR || ' MB' END AS size FROM orders")
def sy06_size_pretty(t, spark):
    return t("orders").select("o_orderkey", identifiers.size_pretty(col("o_orderkey") * 1000).alias("size"))
