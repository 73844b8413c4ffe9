"""Literal fixtures of functions."""

import json

import pytest
from pyspark.sql import functions as F

from granary.functions import arrays, compat, datetimes, digests, general, identifiers, jsons, numbers, ranges, regexes, search, similarity, strings, values, xml
from granary.operators.sequences import number
from granary.sources import files
from granary.streaming import changes as streams

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: strings.initcap(L("hi-there x'y ÉTÉ")), "Hi-There X'Y Été"),
        (lambda: strings.left(L("abc"), L(-1)), "ab"),
        (lambda: strings.right(L("abc"), L(-1)), "bc"),
        (lambda: strings.substring(L("abcdef"), L(-1), L(4)), "ab"),
        (lambda: strings.concat(L("a"), L(None), L(1)), "a1"),
        (lambda: strings.format_text("%2$s-%1$L|%I|%5s|%-4s|%%", L("a'b"), L("X y"), L("q"), L("r")), "X y-'a''b'|\"X y\"|    q|r   |%"),
        (lambda: strings.quote_literal(L("a\\b")), " E'a\\\\b'"),
        (lambda: strings.encode_escape(F.unhex(L("00415cff"))), "\\000A\\\\\\377"),
        (lambda: regexes.similar_to(L("abc"), "(a|z)b_"), True),
        (lambda: regexes.similar_to(L("abc"), "a"), False),
        (lambda: regexes.regexp_replace(L("xaayaa"), "a+", "Z"), "xZyaa"),
        (lambda: regexes.regexp_replace(L("xaayaa"), "(a)(a)", r"<\2\1>"), "x<aa>yaa"),
        (lambda: regexes.regexp_match(L("foobar"), "(b)(a.)"), ["b", "ar"]),
        (lambda: general.to_int(L(2.5)), 2),
        (lambda: general.to_int(L("2.5").cast("decimal(4,1)"), "decimal"), 3),
        (lambda: general.num_nulls(L(None), L(1), L(None)), 2),
        (lambda: numbers.sind(L(30.0)), 0.5),
        (lambda: numbers.cosd(L(60.0)), 0.5),
        (lambda: numbers.tand(L(225.0)), 1.0),
        (lambda: numbers.asind(L(0.5)), 30.0),
        (lambda: numbers.acosd(L(0.5)), 60.0),
        (lambda: numbers.generate_series(L(5), L(1), L(-2)), [5, 3, 1]),
        (lambda: numbers.generate_series(L(5), L(1)), []),
        (lambda: datetimes.justify_hours(datetimes.interval(0, 1, -3_600_000_000)), (0, 0, 82_800_000_000)),
        (lambda: datetimes.interval_times(datetimes.interval(1, 1, 0), L(1.5)), (1, 16, 43_200_000_000)),
        (lambda: datetimes.to_char(F.to_timestamp_ntz(L("2020-05-01 15:04:05")), "MONTH|HH12:MI PM"), "MAY      |03:04 PM"),
        (lambda: datetimes.overlaps(L(1), L(3), L(3), L(5)), False),
        (lambda: datetimes.overlaps(L(3), L(1), L(2), L(2)), True),
        (lambda: arrays.subscript(F.array(L(1), L(2)), L(5)), None),
        (lambda: arrays.slice_of(F.array(L(1), L(2), L(3)), L(0), L(2)), [1, 2]),
        (lambda: arrays.array_positions(F.array(L(1), L(2), L(1)), L(1)), [1, 3]),
        (lambda: arrays.query_int(F.array(L(1), L(4)), "1&(2|!3)"), True),
        (lambda: arrays.cube_distance(F.array(L(0), L(0)), F.array(L(3), L(4)), "taxicab"), 7.0),
        (lambda: arrays.box_overlap(F.array(L(0)), F.array(L(2)), F.array(L(2)), F.array(L(5))), True),
        (lambda: ranges.adjacent(ranges.make(L(1), L(3)), ranges.make(L(3), L(5))), True),
        (lambda: ranges.overlaps(ranges.make(L(1), L(3)), ranges.make(L(3), L(5))), False),
        (lambda: ranges.contains(ranges.make(L(None).cast("int"), L(9)), ranges.make(L(3), L(5))), True),
        (lambda: ranges.make(L(3), L(3), "[)")["empty"], True),
        (lambda: ranges.make(L(3), L(3), "[]", discrete=True)["upper"], 4),
        (lambda: ranges.intersection(ranges.make(L(1), L(5)), ranges.make(L(3), L(9), "(]")), (3, 5, False, False, False)),
        (lambda: similarity.trigrams(L("Cat")), ["  c", " ca", "at ", "cat"]),
        (lambda: F.round(similarity.similarity(L("word"), L("two words")), 6), 0.363636),
        (lambda: similarity.levenshtein_less_equal(L("extensive"), L("exhaustive"), 2), 3),
        (lambda: similarity.difference(L("Anne"), L("Andrew")), 2),
        (lambda: similarity.unaccent(L("Hôtel")), "Hotel"),
        (lambda: compat.instr(L("corporate floor"), L("or"), 3, 2), 14),
        (lambda: compat.instr(L("corporate floor"), L("or"), -3, 2), 2),
        (lambda: compat.instr(L("abc"), L("z")), 0),
        (lambda: compat.lpad(L("漢"), 5, "xy"), "xyx漢"),
        (lambda: compat.rpad(L("漢字漢"), 5, "*"), "漢字"),
        (lambda: compat.to_number(L(""), ""), None),
        (lambda: compat.to_single_byte(compat.to_multi_byte(L("a b!"))), "a b!"),
        (lambda: values.network(L("192.168.1.77/20")), "192.168.0.0/20"),
        (lambda: values.netmask(L("192.168.1.5/20")), "255.255.240.0"),
        (lambda: values.broadcast(L("192.168.1.5/24")), "192.168.1.255/24"),
        (lambda: values.inside_network(L("192.168.1.5"), L("192.168.1.0/24")), True),
        (lambda: values.bit_combine(L("1100"), L("1010"), "#"), "0110"),
        (lambda: values.bit_shift(L("1101"), -2), "0011"),
        (lambda: values.bit_not(L("10")), "01"),
        (lambda: values.Enum("red", "green").ordinal(L("green")), 2),
        (lambda: values.polygon_area(F.array(values.point(L(0), L(0)), values.point(L(4), L(0)), values.point(L(0), L(3)))), 6.0),
        (lambda: values.subpath(L("Top.Child1.Child2"), 1), "Child1.Child2"),
        (lambda: values.subpath(L("Top.Child1.Child2"), -2, 1), "Child1"),
        (lambda: values.lca(L("1.2.2.3"), L("1.2.3")), "1.2"),
        (lambda: values.map_contains(F.create_map(L("a"), L("1"), L("b"), L("2")), F.create_map(L("b"), L("2"))), True),
        (lambda: search.matches(search.to_tsvector(L("The fat cats sat on a mat")), "fat <-> cat & !dog"), True),
        (lambda: search.matches(search.to_tsvector(L("The fat and grey cats")), "fat <-> cat"), False),
        (lambda: search.matches(search.to_tsvector(L("The fat and grey cats")), "fat <3> cat | dog"), True),
        (lambda: search.headline(L("a cat sat"), ["cat"]), "a <b>cat</b> sat"),
        (lambda: digests.hmac(L("what do ya want for nothing?"), b"Jefe", "sha256"), "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
        (lambda: digests.uuid_of_name("dns", L("www.example.com")), "2ed6657d-e927-568b-95e1-2665a8aea6a2"),
        (lambda: digests.uuid_of_name("dns", L("www.example.com"), 3), "5df41881-3aed-3515-88a7-2f4a814cf09e"),
        (lambda: digests.decrypt(digests.encrypt(L("abc"), L("0123456789abcdef")), L("0123456789abcdef")), "abc"),
        (lambda: identifiers.size_pretty(L(10239)), "10239 bytes"),
        (lambda: identifiers.size_pretty(L(1_000_000)), "977 kB"),
        (lambda: identifiers.size_bytes(L("1.5 GB")), 1_610_612_736),
        (lambda: identifiers.isbn13(L("0-306-40615-2")), "9780306406157"),
        (lambda: identifiers.is_isbn10(L("0-8044-2957-X")), True),
        (lambda: identifiers.cash_words(L("-1234.01").cast("decimal(19,2)")), "Minus one thousand two hundred thirty four dollars and one cent"),
        (lambda: xml.element("a", xml.forest(b=L("x<y"), c=L(None)), attributes={"k": L('q"')}), '<a k="q&quot;"><b>x&lt;y</b></a>'),
        (lambda: xml.concat(L(None).cast("string"), L("<a/>")), "<a/>"),
        (lambda: jsons.exists(L('{"a": 1}'), "a"), True),
        (lambda: jsons.exists_all(L('{"a": 1}'), ["a", "b"]), False),
        (lambda: jsons.path_text(L('{"a": [{"b": "x"}]}'), "a", 0, "b"), "x"),
    ],
)
def test_literal(spark, make, want):
    got = value(spark, make())
    assert (tuple(got) if isinstance(want, tuple) else got) == want


@pytest.mark.parametrize("make", [lambda: numbers.sqrt(L(-1.0)), lambda: numbers.ln(L(0.0)), lambda: numbers.power(L(0.0), L(-1.0)), lambda: ranges.make(L(3), L(1))["lower"], lambda: values.Enum("a").ordinal(L("z")), lambda: datetimes.make_time(L(25), L(0), L(0))])
def test_literal_fails(spark, make):
    with pytest.raises(Exception):
        value(spark, make())


@pytest.mark.parametrize("a, b, want", [('{"a": {"b": 1, "c": 2}}', '{"a": {"b": 1}}', True), ("[1, [2, 3]]", "[[3]]", True), ('["foo", "bar"]', '"bar"', True), ('{"a": 1}', "[]", False), ("[1, 2]", "[2, 2, 1]", True), ("1", "true", False)])
def test_json_containment(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(jsons.contains("a", "b")).first()[0] is want and json.loads(a) is not None


def test_copy_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None), (3, "x\ty")], "k int, v string")
    for kind in ("csv", "text"):
        files.copy_to(df, str(tmp_path / kind), format=kind)
        back = files.copy_from(spark, str(tmp_path / kind), "k int, v string", format=kind).orderBy("k").collect()
        assert [r[0] for r in back] == [1, 2, 3] and back[1][1] is None
    (tmp_path / "bad.csv").write_text("1,a\nx,b\n")
    with pytest.raises(Exception):
        files.copy_from(spark, str(tmp_path / "bad.csv"), "k int, v string").collect()
    assert files.copy_from(spark, str(tmp_path / "bad.csv"), "k int, v string", bad_rows="drop").collect() == [(1, "a")]


def test_numbers_are_gapless(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "g int, i int")
    out = number(df, [F.col("g"), F.col("i")], "n", start=10).orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(10, 60)) and [(r["g"], r["i"]) for r in out] == sorted((i % 7, i) for i in range(50))


def test_subscriber_applies_changes(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "log")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(f"{path}/0")
    spark.createDataFrame([(1, "A", 1, "update"), (2, None, 2, "delete"), (3, "c", 3, "insert")], "k int, v string, seq int, op string").write.parquet(source)
    stream = spark.readStream.schema("k int, v string, seq int, op string").parquet(source)
    q = streams.subscribe(stream, path, ["k"], "seq", "op", str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(f"{path}/1").collect())) == [(1, "A"), (3, "c")]


def test_xml_table(spark):
    doc = "<r><h><n id='1'><a>x</a><b><c>7</c></b></n><n id='2'/><n><a>z</a></n></h></r>"
    df = spark.createDataFrame([(5, doc)], "k int, d string")
    columns = {"id": ("@id", "int", None), "a": ("a", "string", "none"), "c": ("b/c", "int", None)}
    got = sorted(map(tuple, xml.table_rows(df, "d", "/r/h/n", columns, ordinality="o").collect()), key=lambda r: r[-1])
    assert got == [(5, 1, "x", 7, 1), (5, 2, "none", None, 2), (5, None, "z", None, 3)]
    with pytest.raises(Exception, match="null is not allowed"):
        xml.table_rows(df, "d", "/r/h/n", columns, required=("id",)).collect()
    with pytest.raises(ValueError):
        xml.table_rows(df, "d", None, columns)
