"""Literal fixtures for operators that SQL elsewhere does otherwise or not at all."""

import pytest
from pyspark.sql import functions as F

from granary.operators import aggregates, changes, joins, limits, partitions, sampling, sets, windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_scalar_join_fails_on_a_second_match(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert rows(joins.scalar_left_join(left, right.filter("v = 'a'"), ["k"])) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="more than one row"):
        joins.scalar_left_join(left, right, ["k"]).collect()


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some = spark.createDataFrame([(2,)], "v int")
    assert rows(joins.null_aware_anti_join(left, some, "k", "v")) == [(1,)]
    assert rows(joins.null_aware_anti_join(left, some.union(spark.sql("SELECT CAST(NULL AS INT)")), "k", "v")) == []
    assert len(rows(joins.null_aware_anti_join(left, some.filter("v > 9"), "k", "v"))) == 3


def test_natural_join_without_common_names_is_a_cross_join(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(3,)], "b int")
    assert rows(joins.natural_join(a, b)) == [(1, 3), (2, 3)]


def test_as_of_join_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, t int, v string")
    assert rows(joins.as_of_join(left, right, ["k"], "t", "t", ["v"])) == [("a", 1, None), ("a", 5, "y"), ("b", 5, None)]


def test_empty_grouping_sets_give_a_row_each(spark):
    empty = spark.createDataFrame([], "a int, v int")
    out = aggregates.grouping_sets(empty, [["a"], [], []], [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")])
    assert rows(out) == [(None, 0, None), (None, 0, None)]


def test_array_agg_keeps_nulls_in_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, None), (1, 2, "b")], "g int, o int, v string")
    assert rows(df.groupBy("g").agg(aggregates.array_agg(F.col("v"), F.col("o")).alias("l"))) == [(1, [None, "b", "c"])]


def test_recursive_union_ends_on_cycles_and_nulls(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, None)], "a int, b int")
    seed = spark.createDataFrame([(1,)], "x int")
    out = sets.recursive_union(seed, lambda r: r.join(e, r["x"] == e["a"]).select(F.col("b").alias("x")))
    assert rows(out) == [(1,), (2,), (3,), (None,)]


def test_connect_by_levels_branches_and_loops(spark):
    tree = spark.createDataFrame([("r2", "r1"), ("r3", "r1"), ("r4", "r2")], "k string, p string")
    assert rows(sets.connect_by(tree, "k", "p", "r1")) == [("r1", None, 0, "r1"), ("r2", "r1", 1, "r1~r2"), ("r3", "r1", 1, "r1~r3"), ("r4", "r2", 2, "r1~r2~r4")]
    assert len(rows(sets.connect_by(tree, "k", "p", "r1", max_depth=2))) == 3
    with pytest.raises(Exception, match="infinite recursion"):
        sets.connect_by(tree.union(spark.createDataFrame([("r1", "r4")], "k string, p string")), "k", "p", "r1").collect()


def test_upsert_and_update_from(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(changes.upsert(t, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(changes.upsert(t, new, ["k"], "nothing")) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(changes.update_from(t, new, ["k"], ["v"])) == [(1, "a"), (2, "B")]
    assert rows(changes.delete(spark.createDataFrame([(1,), (None,)], "k int"), F.col("k") == 1)) == [(None,)]


def test_samples(spark):
    df = spark.range(1000)
    assert rows(sampling.bernoulli(df, 30, 7)) == rows(sampling.bernoulli(df.repartition(5), 30, 7))
    assert 200 < sampling.bernoulli(df, 30, 7).count() < 400
    assert sampling.system(df, 100, 1).count() == 1000 and sampling.system(df, 0, 1).count() == 0
    for bad in (-1, 101, float("nan"), None):
        with pytest.raises(ValueError):
            sampling.bernoulli(df, bad, 1)


def test_limits(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert [r[0] for r in limits.sort(df, "k").collect()] == [1, 2, None]
    assert [r[0] for r in limits.sort(df, "k desc").collect()] == [None, 2, 1]
    assert [r[0] for r in limits.limit_offset(limits.sort(df, "k desc nulls last"), None, 1).collect()] == [1, None]
    with pytest.raises(ValueError):
        limits.limit_offset(df, -1)


def test_lag_by_row_and_ntile(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 0, "b"), (3, None, "c"), (4, -1, "d"), (5, 9, "e")], "i int, o int, v string")
    assert rows(windows.shift_by(df, [], [F.col("i")], "v", F.col("o"), "w", "?").select("i", "w")) == [(1, "?"), (2, "b"), (3, None), (4, "e"), (5, "?")]
    five = spark.range(5)
    assert [r[0] for r in five.select(windows.ntile(F.lit(3), [], [F.col("id")])).collect()] == [1, 1, 2, 2, 3]
    with pytest.raises(Exception, match="greater than zero"):
        five.select(windows.ntile(F.lit(0), [], [F.col("id")])).collect()


def test_interval_partitions(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2020-01-31 10:00:00' AS t UNION ALL SELECT timestamp_ntz'2020-03-31 09:00:00' UNION ALL SELECT NULL")
    number = partitions.interval_partition(F.col("t"), "2020-01-31 09:30:00", 1, "month", 4)
    assert rows(df.select(number)) == [(0,), (1,), (None,)]
    with pytest.raises(Exception, match="not in range"):
        spark.range(3).select(partitions.interval_partition(F.col("id"), 0, 1, "int", 2)).collect()
    partitions.write_partitioned(spark.range(100), str(tmp_path / "t"), "id", 0, 10, "int", 10)
    plan = spark.read.parquet(str(tmp_path / "t")).filter("_part = 3")
    assert plan.count() == 10 and "PartitionFilters: [isnotnull(_part" in plan._jdf.queryExecution().toString()


def test_as_of_join_over_stretches_of_time(spark):
    import random

    pick = random.Random(5)
    time = lambda: None if pick.random() < 0.05 else pick.randrange(300)
    key = lambda: pick.choice(["hot"] * 8 + ["a", "b", None])
    left = [(i, key(), time()) for i in range(400)]
    right = [(key(), time(), pick.choice([None, 1, 2, 3])) for _ in range(150)]
    a, b = spark.createDataFrame(left, "id long, k string, t int"), spark.createDataFrame(right, "k string, u int, v int")
    got = {r["id"]: r["v_as_of"] for r in joins.as_of_join(a, b, ["k"], "t", "u", ["v"]).collect()}
    want = {}
    for i, k, t in left:
        before = [(u, -1 if v is None else v) for x, u, v in right if None not in (x, u, t) and x == k and u <= t]
        v = max(before)[1] if before else None
        want[i] = None if v == -1 else v
    assert got == want
    assert joins.as_of_join(a, b.limit(0), ["k"], "t", "u", ["v"]).filter("v_as_of IS NULL").count() == 400
    assert joins.as_of_join(a.limit(0), b.limit(0), ["k"], "t", "u", ["v"]).count() == 0
