"""Queries of scans, predicates, joins, aggregation, windows, sorting, sets and recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, changes, joins, limits, partitions, sampling, sets, windows
from .registry import query

col, lit = F.col, F.lit


def money(c):
    return F.round(F.sum(c), 2)


# scans and sources


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity < 5")
def s01_seq_scan(t, spark):
    return t("lineitem").filter((col("l_shipdate") >= F.to_timestamp_ntz(lit("1996-01-01 00:00:00"))) & (col("l_quantity") < 5)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 32, 4000) OR o_custkey = 10")
def s10_bitmap_or(t, spark):
    return t("orders").filter(col("o_orderkey").isin(1, 7, 32, 4000) | (col("o_custkey") == 10)).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) FILTER (WHERE k = 0) AS n_none, count(*) FILTER (WHERE k = 100) AS n_all FROM (SELECT 100 AS k FROM orders)")
def s04_bernoulli(t, spark):
    o = t("orders").select("o_orderkey")
    none = sampling.bernoulli(o, 0, 3).agg(F.count(lit(1)).alias("n_none"))
    return none.crossJoin(sampling.bernoulli(o, 100, 3).agg(F.count(lit(1)).alias("n_all")))


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 50)")
def s06_system_rows(t, spark):
    return sampling.system_rows(t("orders").select("o_orderkey"), 50).agg(F.count(lit(1)).alias("n"))


@query("SELECT n, n * n AS square FROM (SELECT unnest(range(1, 21)) AS n) WHERE n % 3 = 0")
def s14_function_scan(t, spark):
    return spark.range(1, 21).select(col("id").alias("n"), (col("id") * col("id")).alias("square")).filter("n % 3 = 0")


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) v(id, name)")
def s16_values(t, spark):
    return spark.sql("SELECT * FROM VALUES (1, 'one'), (2, 'two'), (3, NULL) AS v(id, name)")


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT a.o_custkey, round(a.total, 2) AS total FROM big a WHERE a.total > (SELECT 2 * avg(total) FROM big)")
def s17_cte_scan(t, spark):
    big = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    mean = big.agg((2 * F.avg("total")).alias("m"))
    return big.join(F.broadcast(mean), col("total") > col("m")).select("o_custkey", F.round("total", 2).alias("total"))


# predicates


@query("SELECT o_orderkey, (o_totalprice > 100000 AND NULLIF(o_orderstatus, 'P') = 'F') AS both_true, (o_totalprice > 100000 OR NULLIF(o_orderstatus, 'P') = 'F') AS any_true, (NOT (NULLIF(o_orderstatus, 'P') = 'F')) AS neither FROM orders")
def p05_three_valued_logic(t, spark):
    known = F.nullif("o_orderstatus", lit("P")) == "F"
    high = col("o_totalprice") > 100000
    return t("orders").select("o_orderkey", (high & known).alias("both_true"), (high | known).alias("any_true"), (~known).alias("neither"))


@query("SELECT o_orderkey, ((NULLIF(o_orderstatus, 'P') = 'F') IS TRUE) AS is_true, ((NULLIF(o_orderstatus, 'P') = 'F') IS NOT TRUE) AS is_not_true, ((NULLIF(o_orderstatus, 'P') = 'F') IS NULL) AS is_unknown FROM orders")
def p07_is_true(t, spark):
    known = F.nullif("o_orderstatus", lit("P")) == "F"
    return t("orders").select("o_orderkey", known.eqNullSafe(lit(True)).alias("is_true"), (~known.eqNullSafe(lit(True))).alias("is_not_true"), known.isNull().alias("is_unknown"))


@query("SELECT count(*) AS n FROM orders a WHERE NULLIF(o_orderstatus, 'P') IS DISTINCT FROM NULLIF(o_orderpriority, '5-LOW')")
def p09_is_distinct_from(t, spark):
    return t("orders").filter(~F.nullif("o_orderstatus", lit("P")).eqNullSafe(F.nullif("o_orderpriority", lit("5-LOW")))).agg(F.count(lit(1)).alias("n"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 15 AND NOT (p_retailprice BETWEEN 1000 AND 1200)")
def p10_between(t, spark):
    return t("part").filter(col("p_size").between(10, 15) & ~col("p_retailprice").between(1000, 1200)).select("p_partkey", "p_size")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#22') GROUP BY p_brand")
def p11_in_list(t, spark):
    return t("part").filter(col("p_size").isin(1, 5, 9) & ~col("p_brand").isin("Brand#11", "Brand#22")).groupBy("p_brand").agg(F.count(lit(1)).alias("n"))


@query("SELECT p_partkey, list_contains([1, 5, p_size // 2], p_size % 7) AS any_eq, (p_size > 3 AND p_size > 10) AS all_gt FROM part")
def p12_any_all_array(t, spark):
    some = F.array(lit(1), lit(5), F.expr("cast(p_size div 2 as int)"))
    return t("part").select("p_partkey", F.exists(some, lambda x: x == col("p_size") % 7).alias("any_eq"), F.forall(F.array(lit(3), lit(10)), lambda x: col("p_size") > x).alias("all_gt"))


@query("SELECT count(*) AS n FROM lineitem WHERE (l_suppkey, l_quantity) < (50, 25.0)")
def p13_row_comparison(t, spark):
    return t("lineitem").filter(F.struct(col("l_suppkey"), col("l_quantity")) < F.struct(lit(50).cast("long"), lit(25.0))).agg(F.count(lit(1)).alias("n"))


@query("SELECT p_partkey, p_name LIKE '%a%e%' AS l, p_name ILIKE '%A_E%' AS il, p_type LIKE '%!%%' ESCAPE '!' AS e FROM part")
def p14_like(t, spark):
    return t("part").select("p_partkey", col("p_name").like("%a%e%").alias("l"), col("p_name").ilike("%A_E%").alias("il"), F.expr("p_type LIKE '%!%%' ESCAPE '!'").alias("e"))


@query("SELECT p_partkey, regexp_full_match(p_brand, '(Brand)#[1-3]([1-5])') AS s FROM part")
def p16_similar_to(t, spark):
    from ..functions.regexes import similar_to

    return t("part").select("p_partkey", similar_to(col("p_brand"), "(Brand)#[1-3]([1-5])").alias("s"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[a-m].*e') AS m, NOT regexp_matches(p_name, '[xyz]') AS nm, regexp_matches(p_type, '(?i)steel|tin') AS im FROM part")
def p17_regex_match(t, spark):
    return t("part").select("p_partkey", col("p_name").rlike("^[a-m].*e").alias("m"), (~col("p_name").rlike("[xyz]")).alias("nm"), col("p_type").rlike("(?i)steel|tin").alias("im"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, coalesce(NULLIF(o_orderstatus, 'F'), '-') AS st, greatest(o_custkey, o_orderkey // 4, NULL) AS g, least(o_custkey, NULL, 77) AS l FROM orders")
def p18_case_coalesce_greatest(t, spark):
    price = col("o_totalprice")
    none = lit(None).cast("long")
    return t("orders").select(
        "o_orderkey", F.when(price > 200000, "high").when(price > 50000, "middle").otherwise("low").alias("band"),
        F.when(col("o_orderstatus") == "F", 1).when(col("o_orderstatus") == "O", 2).alias("code"),
        F.coalesce(F.nullif("o_orderstatus", lit("F")), lit("-")).alias("st"),
        F.greatest(col("o_custkey"), F.expr("o_orderkey div 4"), none).alias("g"), F.least(col("o_custkey"), none, lit(77).cast("long")).alias("l"),
    )


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '1995-06-01' AND TIMESTAMP '1995-01-01' < o_orderdate + INTERVAL 90 DAY AS overlaps FROM orders")
def p24_overlaps(t, spark):
    from ..functions.datetimes import overlaps

    start = col("o_orderdate")
    ts = lambda s: F.to_timestamp_ntz(lit(s))
    return t("orders").select("o_orderkey", overlaps(start, start + F.expr("INTERVAL 90 DAYS"), ts("1995-01-01 00:00:00"), ts("1995-06-01 00:00:00")).alias("overlaps"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def p25_scalar_subquery(t, spark):
    per = t("orders").groupBy("o_custkey").agg(F.count(lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return t("customer").join(per, col("c_custkey") == col("o_custkey"), "left").select("c_custkey", F.coalesce("n", lit(0)).alias("n"), "top")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def p26_exists(t, spark):
    o = t("orders")
    on = col("c_custkey") == col("o_custkey")
    return t("customer").join(o.filter("o_totalprice > 200000"), on, "left_semi").join(o.filter("o_orderstatus = 'P'"), on, "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def p27_not_in_null_aware(t, spark):
    return joins.null_aware_anti_join(t("customer"), t("orders").filter("o_totalprice > 250000"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT p_partkey FROM part p WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part q WHERE q.p_brand = p.p_brand)")
def p28_quantified_all(t, spark):
    top = t("part").groupBy("p_brand").agg(F.max("p_retailprice").alias("m"))
    return t("part").join(top, "p_brand").filter("p_retailprice >= m").select("p_partkey")


@query("SELECT o_orderkey, (NULLIF(o_orderstatus, 'F') IS NULL)::INT + (NULLIF(o_custkey, 10) IS NULL)::INT AS n_null, (NULLIF(o_orderstatus, 'F') IS NOT NULL)::INT + (NULLIF(o_custkey, 10) IS NOT NULL)::INT AS n_not_null FROM orders")
def p29_num_nulls(t, spark):
    from ..functions.general import num_nonnulls, num_nulls

    a, b = F.nullif("o_orderstatus", lit("F")), F.nullif("o_custkey", lit(10))
    return t("orders").select("o_orderkey", num_nulls(a, b).alias("n_null"), num_nonnulls(a, b).alias("n_not_null"))


# joins


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY n_name")
def flagship_revenue_by_nation(t, spark):
    """Fact to dimension joins, aggregated map-side before the shuffle."""
    o = t("orders").filter((col("o_orderdate") >= F.to_timestamp_ntz(lit("1994-01-01 00:00:00"))) & (col("o_orderdate") < F.to_timestamp_ntz(lit("1996-01-01 00:00:00"))))
    joined = t("lineitem").join(o, col("l_orderkey") == col("o_orderkey")).join(t("customer"), col("o_custkey") == col("c_custkey")).join(t("nation"), col("c_nationkey") == col("n_nationkey"))
    return joined.groupBy("n_name").agg(money(col("l_extendedprice") * (1 - col("l_discount"))).alias("revenue"), F.count(lit(1)).alias("n"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j07_inner_join(t, spark):
    return t("supplier").join(t("nation"), col("s_nationkey") == col("n_nationkey")).join(t("region"), col("n_regionkey") == col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000")
def j08_left_join(t, spark):
    return t("customer").join(t("orders").filter("o_totalprice > 150000"), col("o_custkey") == col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def j08_right_join(t, spark):
    return t("orders").filter("o_orderstatus = 'P'").join(t("customer"), col("o_custkey") == col("c_custkey"), "right").select("o_orderkey", "c_custkey")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 5 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 15 GROUP BY 1) b USING (k)")
def j09_full_join_using(t, spark):
    a = t("customer").filter("c_nationkey > 5").groupBy(col("c_nationkey").alias("k")).agg(F.count(lit(1)).alias("n_customers"))
    b = t("supplier").filter("s_nationkey < 15").groupBy(col("s_nationkey").alias("k")).agg(F.count(lit(1)).alias("n_suppliers"))
    return a.join(b, "k", "full")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b WHERE a.r_regionkey <> b.r_regionkey")
def j10_cross_join(t, spark):
    r = t("region")
    return r.alias("a").crossJoin(r.alias("b")).filter("a.r_regionkey <> b.r_regionkey").select(col("a.r_name").alias("a"), col("b.r_name").alias("b"))


@query("SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def j11_natural_join(t, spark):
    return joins.natural_join(t("nation").select(col("n_regionkey").alias("k"), "n_name"), t("region").select(col("r_regionkey").alias("k"), "r_name"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)")
def j13_lateral_top3(t, spark):
    top = aggregates.top_k(t("orders"), ["o_custkey"], [col("o_totalprice").desc(), col("o_orderkey")], 3)
    return t("customer").join(top, col("o_custkey") == col("c_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)")
def j14_semi_join(t, spark):
    return t("supplier").join(t("lineitem").filter("l_quantity > 45"), col("s_suppkey") == col("l_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def j15_anti_join(t, spark):
    return t("part").join(t("lineitem").filter("l_quantity > 40"), col("p_partkey") == col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT n_nationkey AS k, n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS r_name FROM nation")
def j16_scalar_checked_join(t, spark):
    n = t("nation").select(col("n_nationkey").alias("k"), "n_name", col("n_regionkey").alias("rk"))
    return joins.scalar_left_join(n, t("region").select(col("r_regionkey").alias("rk"), "r_name"), ["rk"]).select("k", "n_name", "r_name")


@query("SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN (SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey) o ON o_custkey = c_custkey")
def j17_first_match_join(t, spark):
    o = t("orders").select(col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return joins.first_match_left_join(t("customer").select("c_custkey"), o, ["c_custkey"], [col("o_orderdate"), col("o_orderkey")]).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT p_partkey, b.band FROM part JOIN (SELECT i AS band, 800.0 + i * 75 AS lo, 800.0 + i * 75 + 75 AS hi FROM (SELECT unnest(range(0, 20)) AS i)) b ON p_retailprice >= lo AND p_retailprice < hi")
def j19_range_join(t, spark):
    bands = spark.range(20).select(col("id").alias("band"), (800.0 + col("id") * 75).alias("lo"), (800.0 + col("id") * 75 + 75).alias("hi"))
    return joins.range_join(t("part"), bands, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "band")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j21_self_join(t, spark):
    n = t("nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (col("a.n_regionkey") == col("b.n_regionkey")) & (col("a.n_nationkey") < col("b.n_nationkey"))).select(col("a.n_name").alias("a"), col("b.n_name").alias("b"))


@query("SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts <= e.ts)) AS event_id_as_of FROM events e WHERE e.event_type = 'click'")
def j22_as_of_join(t, spark):
    e = t("events")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return joins.as_of_join(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "ts", ["event_id"]).select("event_id", "event_id_as_of")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0)")
def j17_exists_or(t, spark):
    o = t("orders").filter("o_totalprice > 250000")
    return joins.exists_any(t("customer"), [(o, "c_custkey", "o_custkey"), (t("supplier").filter("s_acctbal < 0"), "c_nationkey", "s_nationkey")]).select("c_custkey")


@query("SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def j06_salted_join(t, spark):
    o = t("orders").select(col("o_orderkey").alias("k"), "o_orderpriority")
    return joins.salted_join(t("lineitem").select(col("l_orderkey").alias("k"), "l_linenumber"), o, ["k"]).groupBy("o_orderpriority").agg(F.count(lit(1)).alias("n"))


# aggregation


@query("SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0")
def a01_plain_aggregate_empty(t, spark):
    return t("orders").filter("o_orderkey < 0").agg(F.count(lit(1)).alias("n"), F.sum("o_totalprice").alias("s"), F.min("o_orderkey").alias("lo"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def a02_hash_aggregate(t, spark):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        money("l_quantity").alias("sum_qty"), money(col("l_extendedprice") * (1 - col("l_discount")) * (1 + col("l_tax"))).alias("sum_charge"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(lit(1)).alias("n"))


@query("SELECT p_type, min(p_size) AS lo, max(p_name) AS hi, sum(p_size)::BIGINT AS s, round(avg(p_size), 6) AS a FROM part GROUP BY p_type")
def a08_sum_avg_min_max(t, spark):
    return t("part").groupBy("p_type").agg(F.min("p_size").alias("lo"), F.max("p_name").alias("hi"), F.sum("p_size").alias("s"), F.round(F.avg("p_size"), 6).alias("a"))


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(stddev_pop(l_discount), 6) AS sp, round(var_samp(l_tax), 9) AS vs FROM lineitem GROUP BY 1")
def a11_stddev_variance(t, spark):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("vp"), F.round(F.stddev_pop("l_discount"), 6).alias("sp"), F.round(F.var_samp("l_tax"), 9).alias("vs"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_extendedprice), 3) AS cv, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def a12_regression(t, spark):
    y, x = col("l_extendedprice"), col("l_quantity")
    return t("lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr(x, y), 6).alias("c"), F.round(F.covar_samp(x, y), 3).alias("cv"), F.round(F.regr_slope(y, x), 4).alias("slope"),
        F.round(F.regr_intercept(y, x), 3).alias("icpt"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.regr_count(y, x).alias("n"))


@query("SELECT o_custkey, bool_and(o_totalprice > 50000) AS b_and, bool_or(o_orderstatus = 'P') AS b_or FROM orders GROUP BY 1")
def a13_bool_and_or(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.bool_and(col("o_totalprice") > 50000).alias("b_and"), F.bool_or(col("o_orderstatus") == "P").alias("b_or"))


@query("SELECT p_brand, bit_and(p_size) AS ba, bit_or(p_size) AS bo FROM part GROUP BY 1")
def a14_bit_and_or(t, spark):
    return t("part").groupBy("p_brand").agg(F.bit_and("p_size").alias("ba"), F.bit_or("p_size").alias("bo"))


@query("SELECT o_custkey, array_agg(NULLIF(o_orderstatus, 'O') ORDER BY o_orderkey)::VARCHAR AS l FROM orders GROUP BY 1")
def a15_array_agg_nulls(t, spark):
    g = t("orders").groupBy("o_custkey").agg(aggregates.array_agg(F.nullif("o_orderstatus", lit("O")), col("o_orderkey")).alias("l"))
    return g.select("o_custkey", F.concat(lit("["), F.array_join("l", ", ", "NULL"), lit("]")).alias("l"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1")
def a16_string_agg_ordered(t, spark):
    g = t("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name"), asc=False).alias("l"))
    return g.select("n_regionkey", F.array_join("l", ", ").alias("names"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS ns, count(DISTINCT l_partkey) AS np, sum(DISTINCT l_linenumber)::BIGINT AS sl FROM lineitem GROUP BY 1")
def a20_distinct_aggregates(t, spark):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("ns"), F.count_distinct("l_partkey").alias("np"), F.sum_distinct("l_linenumber").alias("sl"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS s, count(*) AS n FROM orders GROUP BY 1")
def a21_filter_clause(t, spark):
    return t("orders").groupBy("o_orderpriority").agg(F.count_if(col("o_orderstatus") == "F").alias("f"), money(F.when(col("o_totalprice") > 100000, col("o_totalprice"))).alias("s"), F.count(lit(1)).alias("n"))


@query("SELECT p_brand, percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS d, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice), 6) AS c FROM part GROUP BY 1")
def a23_percentiles(t, spark):
    median = F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS INT)")
    quarter = F.expr("percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice)")
    return t("part").groupBy("p_brand").agg(median.alias("d"), F.round(quarter, 6).alias("c"))


@query("SELECT c_mktsegment, k AS mode FROM (SELECT c_mktsegment, c_nationkey AS k, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, c_nationkey) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
def a24_mode(t, spark):
    counted = t("customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(lit(1)).alias("n"))
    return counted.groupBy("c_mktsegment").agg(F.max_by("c_nationkey", F.struct(col("n"), -col("c_nationkey"))).alias("mode"))


@query("SELECT p_brand, count(*) FILTER (WHERE p_size < 25) + 1 AS rank, count(DISTINCT p_size) FILTER (WHERE p_size < 25) + 1 AS dense_rank, count(*) FILTER (WHERE p_size < 25) / count(*) AS percent_rank, (count(*) FILTER (WHERE p_size <= 25) + 1) / (count(*) + 1) AS cume_dist FROM part GROUP BY 1")
def a25_hypothetical_rank(t, spark):
    return t("part").groupBy("p_brand").agg(*[c.alias(k) for k, c in aggregates.hypothetical_rank(col("p_size"), 25).items()])


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def a26_grouping_sets(t, spark):
    return aggregates.grouping_sets(t("lineitem"), [["l_returnflag", "l_linestatus"], ["l_linenumber"], []], [F.count(lit(1)).alias("n")])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, (grouping(o_orderstatus) * 2 + grouping(o_orderpriority))::BIGINT AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a27_rollup(t, spark):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(lit(1)).alias("n"), F.grouping_id().alias("g"))


@query("SELECT p_brand, p_size % 3 AS k, count(*) AS n, round(sum(p_retailprice), 2) AS s FROM part GROUP BY CUBE (p_brand, p_size % 3)")
def a28_cube(t, spark):
    return t("part").withColumn("k", col("p_size") % 3).cube("p_brand", "k").agg(F.count(lit(1)).alias("n"), money("p_retailprice").alias("s"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY GROUPING SETS ((o_custkey), (), ())")
def a29_empty_grouping_sets(t, spark):
    return aggregates.grouping_sets(t("orders").filter("o_orderkey < 0").select("o_custkey"), [["o_custkey"], [], []], [F.count(lit(1)).alias("n")])


@query("SELECT o_orderstatus AS a, o_orderpriority AS b, o_custkey % 2 AS c, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority), GROUPING SETS ((o_custkey % 2), ())")
def a30_concatenated_sets(t, spark):
    abc = t("orders").select(col("o_orderstatus").alias("a"), col("o_orderpriority").alias("b"), (col("o_custkey") % 2).alias("c"))
    return spark.sql("SELECT a, b, c, count(*) AS n FROM {abc} GROUP BY ROLLUP (a, b), GROUPING SETS ((c), ())", abc=abc)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 290000")
def a32_having(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.count(lit(1)).alias("n"), F.max("o_totalprice").alias("m")).filter("n > 12 AND m > 290000").select("o_custkey", "n")


@query("SELECT DISTINCT NULLIF(l_returnflag, 'N') AS f, l_linestatus FROM lineitem")
def a33_distinct(t, spark):
    return t("lineitem").select(F.nullif("l_returnflag", lit("N")).alias("f"), "l_linestatus").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def a34_distinct_on(t, spark):
    return aggregates.distinct_on(t("orders"), ["o_custkey"], [col("o_totalprice").desc(), col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, any_value(c_name) AS c_name, round(sum(o_totalprice), 2) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def a35_group_by_primary_key(t, spark):
    return t("customer").join(t("orders"), col("o_custkey") == col("c_custkey")).groupBy("c_custkey").agg(F.first("c_name").alias("c_name"), money("o_totalprice").alias("s"))


# windows


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def w02_rank_family(t, spark):
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t("orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.round(F.percent_rank().over(v), 9).alias("pr"), F.round(F.cume_dist().over(v), 9).alias("cd"))


@query("SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS q FROM part")
def w07_ntile(t, spark):
    return t("part").select("p_partkey", windows.ntile(lit(4), ["p_brand"], [col("p_partkey")]).alias("q"))


@query("SELECT event_id, lag(value) OVER w AS prev, lead(value, 2, -1.0) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w08_lag_lead(t, spark):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.lag("value").over(w).alias("prev"), F.lead("value", 2, -1.0).over(w).alias("next2"))


@query("SELECT o_orderkey, lag(o_totalprice, (o_orderkey % 3)::INT, -1.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders")
def w08_lag_by_expression(t, spark):
    return windows.shift_by(t("orders"), ["o_custkey"], [col("o_orderkey")], "o_totalprice", col("o_orderkey") % 3, "p", -1.0).select("o_orderkey", "p")


@query("SELECT l_orderkey, l_linenumber, first_value(l_quantity) OVER w AS f, last_value(l_quantity) OVER w AS l, nth_value(l_quantity, 2) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def w10_first_last_nth(t, spark):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.first("l_quantity").over(w).alias("f"), F.last("l_quantity").over(w).alias("l"), F.nth_value("l_quantity", 2).over(w).alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, sum(count(*)) OVER (PARTITION BY o_orderpriority)::BIGINT AS n, rank() OVER (ORDER BY count(*) DESC, o_orderpriority, o_orderstatus) AS r FROM orders GROUP BY 1, 2")
def w13_window_over_aggregate(t, spark):
    g = t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(lit(1)).alias("c"))
    return g.select("o_orderpriority", "o_orderstatus", F.sum("c").over(Window.partitionBy("o_orderpriority")).alias("n"), F.rank().over(Window.orderBy(col("c").desc(), "o_orderpriority", "o_orderstatus")).alias("r"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind FROM events")
def w14_rows_frame(t, spark):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-3, 0)), 4).alias("s"), F.count(lit(1)).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("behind"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part")
def w14_range_frame(t, spark):
    return t("part").select("p_partkey", F.count(lit(1)).over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)).alias("n"))


# sorting and limits


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def o02_top_n(t, spark):
    return limits.limit_offset(limits.sort(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal desc", "c_custkey"), 25)


@query("SELECT k, c_custkey FROM (SELECT NULLIF(c_nationkey, 3) AS k, c_custkey FROM customer) ORDER BY k DESC NULLS FIRST, c_custkey LIMIT 40 OFFSET 10")
def o03_limit_offset_nulls(t, spark):
    c = t("customer").select(F.nullif("c_nationkey", lit(3)).alias("k"), "c_custkey")
    return limits.limit_offset(limits.sort(c, "k desc", "c_custkey"), 40, 10)


@query("SELECT lower(c_mktsegment) AS s, count(*) AS n FROM customer GROUP BY 1")
def p23_collation(t, spark):
    mixed = t("customer").select(F.collate(F.when(col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(col("c_mktsegment")), "UTF8_LCASE").alias("s"))
    return mixed.groupBy("s").agg(F.count(lit(1)).alias("n")).select(F.lower(F.collate("s", "UTF8_BINARY")).alias("s"), "n")


# set operations and recursion


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u02_union(t, spark):
    return t("customer").select(col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT o_orderkey AS k, 'o' AS s FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT l_orderkey, 'l' FROM lineitem WHERE l_quantity > 49")
def u01_union_all(t, spark):
    return t("orders").filter("o_totalprice > 200000").select(col("o_orderkey").alias("k"), lit("o").alias("s")).union(t("lineitem").filter("l_quantity > 49").select("l_orderkey", lit("l")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def u03_intersect(t, spark):
    return t("customer").filter("c_acctbal < 0").select(col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def u04_intersect_all(t, spark):
    return t("customer").select(col("c_nationkey").alias("k")).intersectAll(t("supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def u05_except(t, spark):
    return t("part").select(col("p_partkey").alias("k")).subtract(t("lineitem").filter("l_quantity > 49").select("l_partkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def u06_except_all(t, spark):
    return t("customer").select(col("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@query("WITH RECURSIVE r AS (SELECT 1 AS n, 1::BIGINT AS f UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT * FROM r")
def u08_recursive_all(t, spark):
    seed = spark.range(1).select(lit(1).alias("n"), lit(1).cast("long").alias("f"))
    return sets.recursive_union(seed, lambda r: r.filter("n < 15").select((col("n") + 1).alias("n"), (col("f") * (col("n") + 1)).alias("f")), distinct=False)


@query("WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 7 + n_regionkey) % 25 AS b FROM nation), r AS (SELECT 0 AS x UNION SELECT b FROM r JOIN e ON a = x) SELECT * FROM r")
def u08_recursive_distinct(t, spark):
    e = t("nation").select(col("n_nationkey").alias("a"), ((col("n_nationkey") * 7 + col("n_regionkey")) % 25).alias("b"))
    return sets.recursive_union(spark.range(1).select(lit(0).alias("x")), lambda r: r.join(e, col("a") == col("x")).select(col("b").alias("x")))


@query("WITH RECURSIVE e AS (SELECT n_nationkey::VARCHAR AS k, ((n_nationkey - 1) // 3)::VARCHAR AS p FROM nation WHERE n_nationkey > 0), r AS (SELECT '0' AS key, NULL::VARCHAR AS parent, 0 AS level, '0' AS branch UNION ALL SELECT k, p, level + 1, branch || '~' || k FROM r JOIN e ON p = key) SELECT * FROM r")
def u09_connect_by(t, spark):
    e = t("nation").filter("n_nationkey > 0").select(col("n_nationkey").alias("k"), F.expr("(n_nationkey - 1) div 3").alias("p"))
    return sets.connect_by(e, "k", "p", 0)


@query("SELECT o_orderpriority, min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS \"F\", min(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS \"O\", min(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def u10_crosstab(t, spark):
    return aggregates.crosstab(t("orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])


# changes and partitions


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT c_mktsegment = 'BUILDING'")
def s33_update_delete(t, spark):
    c = changes.update(t("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), col("c_acctbal") < 0, {"c_acctbal": lit(0)})
    return changes.delete(c, col("c_mktsegment") == "BUILDING").drop("c_mktsegment")


@query("SELECT k, v FROM (SELECT DISTINCT ON (k) k, v FROM (SELECT n_nationkey AS k, n_name AS v, 0 AS p FROM nation UNION ALL SELECT i::INT, 'new ' || i, 1 FROM range(20, 30) q(i)) ORDER BY k, p DESC)")
def s34_upsert(t, spark):
    new = spark.range(20, 30).select(col("id").cast("int").alias("k"), F.concat(lit("new "), col("id").cast("string")).alias("v"))
    return changes.upsert(t("nation").select(col("n_nationkey").alias("k"), col("n_name").alias("v")), new, ["k"])


@query("SELECT user_id, value FROM (SELECT DISTINCT ON (user_id) user_id, value, event_type FROM events ORDER BY user_id, event_id DESC) WHERE event_type <> 'error'")
def st01_apply_changes(t, spark):
    e = t("events")
    op = F.when(col("event_type") == "error", "delete").otherwise("update")
    log = e.select("user_id", "value", "event_id", op.alias("op"))
    return changes.apply_changes(e.filter("event_id < 0").select("user_id", "value"), log, ["user_id"], "event_id", "op")


@query("SELECT ((extract(year FROM o_orderdate) - 1992) * 12 + extract(month FROM o_orderdate) - 1)::INT // 3 AS part, count(*) AS n FROM orders GROUP BY 1")
def d03_interval_partition(t, spark):
    p = partitions.interval_partition(col("o_orderdate"), "1992-01-01 00:00:00", 3, "month", 60)
    return t("orders").groupBy(p.alias("part")).agg(F.count(lit(1)).alias("n"))
