"""Literal fixtures of sources, changes, joins, templates, JSON, ranges, addresses and search."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import arrays, datetimes, formatting, jsons, numbers, ranges, search, similarity, strings, user, values
from granary.operators import changes, constraints, joins, partitions, policies, sets, statements
from granary.sources import files

L = F.lit


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("kind", ["text", "csv"])
def test_copy_gives_back_every_cell(spark, tmp_path, kind):
    cells = ["ends with \\", "\\", "\\\\", "a\\tb", "tab\there", "line\nbreak", "cr\rhere", "", "\\N", "\\n", 'q"uo"te', "a,b", ",", "", " ", "\b\f\v", "é漢", "\\.", "x\\,y"]
    cells = [c for c in cells if kind == "text" or "\r" not in c]  # csv reads a carriage return as a line break
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)] + [(99, None)], "k int, v string")
    files.copy_to(df, str(tmp_path / "t"), format=kind)
    back = dict(map(tuple, files.copy_from(spark, str(tmp_path / "t"), "k int, v string", format=kind).collect()))
    assert back == dict(map(tuple, df.collect()))


def test_text_escapes_and_malformed_rows(spark, tmp_path):
    (tmp_path / "t").write_text("1\t\\101\\x42\\q\n2\t\\N\n3\ta\\\tb\n")
    read = lambda **o: rows(files.copy_from(spark, str(tmp_path / "t"), "k int, v string", format="text", **o))
    assert read() == [(1, "ABq"), (2, None), (3, "a\tb")]
    (tmp_path / "t").write_text("1\ta\n2\n")
    assert read(bad_rows="drop") == [(1, "a")]
    with pytest.raises(Exception, match="wrong number"):
        read()


def test_jdbc_source_pushes_filters(spark, tmp_path):
    url = f"jdbc:derby:memory:granary{random.randrange(10**9)};create=true"
    df = spark.createDataFrame([(i, f"n{i % 3}") for i in range(50)], "k int, v string")
    try:
        df.write.format("jdbc").option("url", url).option("dbtable", "t").option("createTableColumnTypes", "v VARCHAR(9)").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    except Exception as e:  # no embedded database on the class path
        pytest.skip(str(e)[:100])
    got = files.jdbc_table(spark, url, "t", partition=("k", 0, 50, 4)).filter("k > 40 AND v = 'n2'")
    assert rows(got) == [(41, "n2"), (44, "n2"), (47, "n2")] and "PushedFilters: [*" in got._jdf.queryExecution().toString()
    assert files.remote_query(spark, url, "SELECT count(*) AS n FROM t").first()[0] == 50


def test_large_objects(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00\x01\x02")
    got = files.large_objects(spark, str(tmp_path / "a.bin")).select("length", F.substring("content", 2, 1).alias("c")).first()
    assert got["length"] == 3 and bytes(got["c"]) == b"\x01"


def test_upsert_with_null_keys_and_repeated_rows(spark):
    t = spark.createDataFrame([(None, "x"), (None, "y"), (1, "a")], "k int, v string")
    assert rows(changes.upsert(t, spark.createDataFrame([(None, "z"), (1, "A")], "k int, v string"), ["k"])) == [(1, "A"), (None, "x"), (None, "y"), (None, "z")]
    twice = spark.createDataFrame([(2, "c"), (2, "b"), (1, "q")], "k int, v string")
    assert rows(changes.upsert(t, twice, ["k"], "nothing")) == [(1, "a"), (2, "b"), (None, "x"), (None, "y")]
    with pytest.raises(Exception, match="second time"):
        changes.upsert(t, twice, ["k"]).collect()


def test_update_from_takes_one_match(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    other = spark.createDataFrame([(1, "y"), (1, "x"), (None, "z")], "k int, v string")
    assert rows(changes.update_from(t, other, ["k"], ["v"])) == [(1, "x"), (2, "b"), (None, "n")]


def test_insert_defaults_and_returning(spark):
    t = spark.createDataFrame([(1, "a", 5)], "k int, v string, d int")
    new = spark.createDataFrame([(2,)], "k int")
    assert rows(changes.insert(t, new, {"d": L(42)})) == [(1, "a", 5), (2, None, 42)]
    assert rows(changes.inserted(t, new, {"d": L(42)})) == [(2, None, 42)] and changes.truncate(t).count() == 0
    with pytest.raises(ValueError, match="no such column"):
        changes.insert(t, new.withColumn("zz", L(1)))


def test_constraints(spark):
    t = spark.createDataFrame([(1, 5), (2, None), (2, 7)], "k int, v int")
    assert rows(constraints.enforce(t, {"small": F.col("v") < 9})) == rows(t)
    for broken in ({"checks": {"small": F.col("v") < 6}}, {"not_null": ["v"]}):
        with pytest.raises(Exception, match="violates"):
            constraints.enforce(t, **broken).collect()
    assert rows(constraints.duplicates(t, ["k"])) == [(2, 2)]
    assert rows(constraints.orphans(t, ["v"], spark.createDataFrame([(5,)], "id int"), ["id"])) == [(2, 7)]
    with pytest.raises(ValueError, match="double"):
        constraints.require_none(constraints.duplicates(t, ["k"]), "double")


def test_prepared_statements_bind_values_only(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = statements.Prepared(spark, "SELECT k FROM {t} WHERE v = :v", t=t)
    assert rows(s.execute(v="b")) == [(2,)] and rows(s.execute(v="b' OR '1' = '1")) == []
    assert rows(statements.Prepared(spark, "SELECT k FROM {t} WHERE k > ?", t=t).execute(1)) == [(2,)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_range_join_with_wide_and_empty_intervals(spark, how):
    points = [(i, i * 1.5) for i in range(40)]
    spans = [(0, 3.0, 4.0), (1, 0.0, 1e6), (2, 5.0, 5.0), (3, 9.0, 2.0), (4, 10.0, 55.0)] if how == "inner" else [(0, 3.0, 4.0), (4, 10.0, 55.0), (5, 20.0, 800.0)]
    a, b = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(spans, "j int, lo double, hi double")
    hits = [(p, s) for p in points for s in spans if s[1] <= p[1] < s[2]]
    met = {p for p, _ in hits}
    want = {
        "inner": [p + s for p, s in hits], "left": [p + s for p, s in hits] + [p + (None,) * 3 for p in points if p not in met],
        "left_semi": sorted(met), "left_anti": [p for p in points if p not in met],
    }[how]
    assert rows(joins.range_join(a, b, "x", "lo", "hi", 0.5, how)) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        joins.range_join(a, b, "x", "lo", "hi", 0.5, "right")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_join(spark, how):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "k int, i int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 200, 2)] + [(0, "again")], "k int, v string")
    assert rows(joins.salted_join(left, right, ["k"], how=how)) == rows(left.join(right, ["k"], how))


def test_recursion_keeps_one_table_of_seen_rows(spark):
    e = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)], "a int, b int")
    out = sets.recursive_union(spark.createDataFrame([(0,)], "x int"), lambda r: r.join(e, r["x"] == e["a"]).select(F.col("b").alias("x")))
    assert rows(out) == sorted([(i,) for i in range(12)], key=repr)


def test_policies(spark):
    t = spark.createDataFrame([(1, "secret"), (2, "hidden"), (None, "x")], "k int, v string")
    assert rows(policies.row_policy(t)) == [] and rows(policies.row_policy(t, F.col("k") == 1, F.col("k") > 1)) == [(1, "secret"), (2, "hidden")]
    assert rows(policies.masked(t, {"v": policies.keep_last(F.col("v"), 2)}, F.col("k") == 1)) == [(1, "secret"), (2, "***en"), (None, "***x")]


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: formatting.to_char_number(L(-485), "999"), "-485"),
        (lambda: formatting.to_char_number(L(485), "9 9 9"), " 4 8 5"),
        (lambda: formatting.to_char_number(L(1485), "9,999"), " 1,485"),
        (lambda: formatting.to_char_number(L(12), "9990999.9"), "    0012.0"),
        (lambda: formatting.to_char_number(L(12), "FM9990999.9"), "0012."),
        (lambda: formatting.to_char_number(L(0.1), "99.99"), "   .10"),
        (lambda: formatting.to_char_number(L(-0.1), "FM9.99"), "-.1"),
        (lambda: formatting.to_char_number(L(-0.1), "99.99"), "  -.10"),
        (lambda: formatting.to_char_number(L(0.1), "0.9"), " 0.1"),
        (lambda: formatting.to_char_number(L(-12), "99S"), "12-"),
        (lambda: formatting.to_char_number(L(-485), "999MI"), "485-"),
        (lambda: formatting.to_char_number(L(485), "PL999"), "+485"),
        (lambda: formatting.to_char_number(L(-485), "999PR"), "<485>"),
        (lambda: formatting.to_char_number(L(148.5), "999.999"), " 148.500"),
        (lambda: formatting.to_char_number(L(12345), "999"), " ###"),
        (lambda: formatting.to_char_number(L(0), "999"), "   0"),
        (lambda: formatting.to_date(L("05 Dec 2000"), "DD Mon YYYY").cast("string"), "2000-12-05"),
        (lambda: formatting.to_timestamp(L("20200229T235901"), 'YYYYMMDD"T"HH24MISS').cast("string"), "2020-02-29 23:59:01"),
        (lambda: formatting.to_timestamp(L("1/2/99 11:05 PM"), "MM/DD/YY HH12:MI AM").cast("string"), "1999-01-02 23:05:00"),
        (lambda: formatting.to_date(L("2020 060"), "YYYY DDD").cast("string"), "2020-02-29"),
        (lambda: formatting.to_date(L(None).cast("string"), "YYYY").cast("string"), None),
        (lambda: formatting.to_char_interval(datetimes.make_interval(hours=15, mins=2, secs=12), "HH24:MI:SS"), "15:02:12"),
        (lambda: datetimes.to_char(F.to_timestamp_ntz(L("2020-05-01 15:04:05")), "Day|Month"), "Friday   |May      "),
        (lambda: datetimes.make_interval(years=1, weeks=2, secs=1.5), (12, 14, 1_500_000)),
        (lambda: datetimes.justify_interval(datetimes.make_interval(months=1, hours=-1)), (0, 29, 82_800_000_000)),
        (lambda: strings.substring_pattern(L("foobar"), "o(.)b"), "o"),
        (lambda: strings.parse_ident(L('"Some""Schema".someTable')), ['Some"Schema', "sometable"]),
        (lambda: strings.to_ascii(L("Kärl 漢")), "Karl  "),
        (lambda: strings.convert_from(strings.set_byte(L("Th\u0000omas").cast("binary"), L(4), L(64)), "UTF-8"), "Th\u0000o@as"),
        (lambda: strings.get_bit(L("Thomas").cast("binary"), L(45)), 1),
        (lambda: strings.encode(L("a\\b").cast("binary"), "escape"), "a\\\\b"),
        (lambda: arrays.array_append(L(None).cast("array<int>"), L(1)), [1]),
        (lambda: arrays.array_cat(F.array(L(1)), L(None).cast("array<int>")), [1]),
        (lambda: arrays.string_to_array(L("xx~^~yy~^~zz"), "~^~", "yy"), ["xx", None, "zz"]),
        (lambda: arrays.string_to_array(L("abc"), None), ["a", "b", "c"]),
        (lambda: arrays.array_dims(F.array(F.array(L(1), L(2), L(3)), F.array(L(4), L(5), L(6))), 2), "[1:2][1:3]"),
        (lambda: numbers.atan2d(L(1.0), L(1.0)), 45.0),
        (lambda: ranges.difference(ranges.make(L(5), L(15)), ranges.make(L(10), L(20))), (5, 10, True, False, False)),
        (lambda: ranges.difference(ranges.make(L(5), L(15)), ranges.make(L(1), L(20)))["empty"], True),
        (lambda: ranges.make(L(3), L(4), "()", discrete=True)["empty"], True),
        (lambda: ranges.not_right_of(ranges.make(L(1), L(20)), ranges.make(L(18), L(20))), True),
        (lambda: ranges.not_left_of(ranges.make(L(7), L(20)), ranges.make(L(5), L(10))), True),
        (lambda: ranges.upper_inf(ranges.make(L(1), L(None).cast("int"))), True),
        (lambda: jsons.exists(L('["foo", "bar"]'), "bar"), True),
        (lambda: jsons.exists(L('"foo"'), "foo"), True),
        (lambda: jsons.exists(L('["1", 2]'), "2"), False),
        (lambda: jsons.strip_nulls(L('{"a":1,"b":null,"c":[2,null,{"d":null}]}')), '{"a":1,"c":[2,null,{}]}'),
        (lambda: jsons.set_path(L('[{"f1":1},2]'), [0, "f1"], "[2]"), '[{"f1":[2]},2]'),
        (lambda: jsons.set_path(L('{"a":1}'), ["b"], "2", False), '{"a":1}'),
        (lambda: jsons.insert_path(L('{"a":[0,1,2]}'), ["a", 1], '"new"', True), '{"a":[0,1,"new",2]}'),
        (lambda: jsons.elements(L('[1,{"a":2}]')), ["1", '{"a":2}']),
        (lambda: jsons.type_of(L("-1.5")), "number"),
        (lambda: jsons.populate_record(L('{"a": 1}'), "a int, b string"), (1, None)),
        (lambda: jsons.compare(L('{"a":1}'), L("[1,2,3]")), 1),
        (lambda: jsons.compare(L("true"), L("5")), 1),
        (lambda: values.mac_trunc(L("12-34-56-78-90-ab")), "12:34:56:00:00:00"),
        (lambda: values.mac_not(L("12:34:56:78:90:ab")), "ed:cb:a9:87:6f:54"),
        (lambda: values.mac_combine(L("12:34:56:78:90:ab"), L("ff:00:ff:00:ff:00"), "&"), "12:00:56:00:90:00"),
        (lambda: values.mac8_set7bit(values.mac_to_mac8(L("08:00:2b:01:02:03"))), "0a:00:2b:ff:fe:01:02:03"),
        (lambda: values.inet6_network(L("2001:4f8:3:ba::1/64")), "2001:4f8:3:ba:0:0:0:0/64"),
        (lambda: values.inside_network6(L("::1"), L("::/96")), True),
        (lambda: values.uuid_key(L("{A0EEBC99-9c0b4ef8-bb6d6bb9-bd380a11}")), "a0eebc999c0b4ef8bb6d6bb9bd380a11"),
        (lambda: values.path_length(F.array(values.point(L(0), L(0)), values.point(L(3), L(4)))), 5.0),
        (lambda: F.round(search.rank_cd(search.to_tsvector(L("fat cats and fat rats")), ["fat", "rat"]), 6), 0.1),
        (lambda: search.matches(search.to_tsvector(L("The fat cats")), search.query_and("cat", search.query_not("rat"))), True),
        (lambda: F.round(similarity.word_similarity(L("word"), L("two words")), 6), 0.8),
    ],
)
def test_literal(spark, make, want):
    got = value(spark, make())
    assert (tuple(got) if isinstance(want, tuple) else got) == want


def test_queries_as_texts():
    assert search.plain_query("The Fat Rats") == "fat & rats" and search.phrase_query("cat of the rats") == "cat <3> rats"
    assert search.numnode("(fat & rat) | cat") == 5 and search.query_or("a", "b") == "( a ) | ( b )"


@pytest.mark.parametrize("make", [
    lambda: ranges.make(L(5), L(1), "[]", discrete=True)["lower"], lambda: ranges.difference(ranges.make(L(1), L(9)), ranges.make(L(3), L(5)))["lower"], lambda: strings.parse_ident(L("1a.b")),
    lambda: strings.get_byte(L("ab").cast("binary"), L(2)), lambda: formatting.to_date(L("x"), "YYYY"), lambda: values.uuid_key(L("zz")), lambda: jsons.insert_path(L('{"a":1}'), ["a"], "2"),
])
def test_literal_fails(spark, make):
    with pytest.raises(Exception):
        value(spark, make())


@pytest.mark.parametrize("a, b, want", [
    ('{"a": {"b": 1, "c": 2}}', '{"a": {"b": 1}}', True), ("[1, [2, 3]]", "[[3]]", True), ('["foo", "bar"]', '"bar"', True), ('{"a": 1}', "[]", False), ("[1, 2]", "[2, 2, 1]", True),
    ("1", "true", False), ('{"a": [{"x": 1, "y": null}]}', '{"a": [{"y": null}]}', True), ('{"a": 1.0}', '{"a": 1}', True), ("[[1]]", "1", False), ('{"b": 1}', '{"a": null}', False),
])
def test_json_containment_of_constants(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(jsons.contains_constant(F.col("a"), b).alias("x"), jsons.contains("a", "b").alias("y"), jsons.contained(F.col("b"), F.col("a")).alias("z")).first()
    assert tuple(got) == (want, want, want)


def test_user_aggregates_by_batch(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 2, float(i)) for i in range(1000)], "k int, v double")
    out = user.aggregate(df.repartition(7), ["k"], "v", "s", "double", step=lambda v: float(v.sum()), combine=lambda s: float(s.sum()))
    assert rows(out) == rows(df.groupBy("k").agg(F.sum("v").alias("s")))


def test_hash_partitions_and_similar_pairs(spark):
    df = spark.range(50).select(F.col("id").alias("k"))
    parts = [df.filter(partitions.hash_partition(["k"], 4) == r).count() for r in range(4)]
    assert sum(parts) == 50 and all(parts)
    words = [f"word {i % 7} of {i % 5}" for i in range(35)] + ["other", ""]
    a, b = spark.createDataFrame([(w,) for w in words], "a string"), spark.createDataFrame([(w,) for w in words], "b string")
    got = rows(similarity.similar_pairs(a, b, "a", "b", 0.6).select("a", "b"))
    want = rows(a.crossJoin(b).filter(similarity.similarity(F.col("a"), F.col("b")) >= 0.6).select("a", "b"))
    assert got == want
