"""Faults that showed on larger tables."""

import re
import time

import duckdb
from pyspark.sql import functions as F

from compare import DATA, same
from granary.functions import compat, formatting, values
from granary.plans import QUERIES, SQL


def test_padding_costs_little_a_row(spark):
    df = spark.range(400).repartition(4).select(F.concat(F.lit("漢字 "), F.col("id").cast("string")).alias("s")).cache()
    df.count()
    start = time.perf_counter()
    got = df.select("s", compat.lpad(F.col("s"), 200, "*-").alias("l"), compat.rpad(F.col("s"), 200, "漢").alias("r"), compat.instr(F.col("s"), F.lit(" "), -1).alias("i")).collect()
    took = time.perf_counter() - start
    for s, left, right, i in got:
        room = 200 - len(s) - 2
        assert (left, right, i) == (("*-" * 100)[:room] + s, s + "漢" * (room // 2) + " " * (room % 2), 3)
    assert took < 10


def test_numbers_wider_than_five_digits_keep_their_digits(spark, tmp_path):
    keys = [0, 7, -42, 99999, 100000, 123456, 899999, 1234567, 9007199254740993, None]
    rows = spark.createDataFrame([(i, k, 12.5) for i, k in enumerate(keys)], "o_orderkey long, o_custkey long, o_totalprice double")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    same(QUERIES["or02_to_char_number"](spark, str(tmp_path)), con, SQL["or02_to_char_number"])


def test_wide_templates_of_numbers(spark):
    df = spark.createDataFrame([(1234567,), (-12,), (None,)], "x long")
    got = df.select(formatting.to_char_number(F.col("x"), "9,999,999,999,999,999,999").alias("a"), formatting.to_char_number(F.col("x"), "FM9,999,999").alias("b")).collect()
    assert [tuple(r) for r in got] == [("1,234,567".rjust(26), "1,234,567"), ("-12".rjust(26), "-12"), (None, None)]


def test_sketches_are_not_kept_for_pairs(spark):
    plan = QUERIES["a36_approximate_distinct"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    by_pair = [line for line in plan.splitlines() if re.search(r"keys=\[l_returnflag#\d+, l_partkey#", line)]
    assert by_pair and not any("approx_count_distinct" in line for line in by_pair)


def test_bits_of_an_address_are_worked_out_once(spark):
    plan = spark.range(1).select(values.inet6_network(F.concat(F.col("id").cast("string"), F.lit("::5/48"))).alias("n"))
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("split(") <= 3 and plan.first()["n"] == "0:0:0:0:0:0:0:0/48"
    odd = [value(spark, values.inet6_network(F.lit(a))) for a in ("1:2:3:4:5:6:7:8", "::", "a::b/33")]
    assert odd == ["1:2:3:4:5:6:7:8/128", "0:0:0:0:0:0:0:0/128", "a:0:0:0:0:0:0:0/33"]
    assert value(spark, values.inet6_network(F.lit(None).cast("string"))) is None


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]
