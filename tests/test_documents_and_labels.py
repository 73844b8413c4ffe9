import pytest
from pyspark.sql import functions as F

from granary.functions import identifiers, segments, values


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "pattern", "wanted"),
    [
        ("a.b.c", "a.b.c", True), ("a.b.c", "a.b", False), ("a.b.c", "a.*", True), ("a", "a.*", True), ("a", "a.*{1,}", False),
        ("a.b.c.d", "a.*{2}.d", True), ("a.b.c.d", "a.*{,1}.d", False), ("a.b.c.d", "*.c|x.*", True), ("a.b", "a.!b", False), ("a.bc", "a.!b", True),
        ("Foo_bar.x", "foo_bar@.x", True), ("foo_bar_baz", "foo_bar%", True), ("foo_barbaz", "foo_bar%", False), ("foo1_bar2_z", "foo_bar%*", True), ("foobar", "foo*", True),
        ("", "*", True), ("", "a", False), (None, "a", None),
    ],
)
def test_path_patterns(spark, path, pattern, wanted):
    assert one(spark, values.path_matches(F.lit(path).cast("string"), pattern)) is wanted


def test_path_pattern_with_a_wrong_label():
    with pytest.raises(ValueError):
        values.path_matches(F.lit("a"), "a.b-c")


def test_segments(spark):
    read = lambda s: one(spark, segments.parse(F.lit(s).cast("string")))
    inf = float("inf")
    assert [tuple(read(s)) for s in ("5", "<5.5", "1..2", "1 ... 2", "1.5e-2 ..", ".. >0")] == [(5, 5), (5.5, 5.5), (1, 2), (1, 2), (0.015, inf), (-inf, 0)]
    assert tuple(read("5 (+-) 0.25")) == (4.75, 5.25)
    assert read(None) is None
    for wrong in ("", "..", "a", "2 .. 1"):
        with pytest.raises(Exception, match="segment"):
            read(wrong)


def test_serial_numbers(spark):
    check = lambda f, s: one(spark, f(F.lit(s)))
    assert check(identifiers.is_issn, "1436-4522") and check(identifiers.is_issn, "0378-5955") and not check(identifiers.is_issn, "0378-5954")
    assert check(identifiers.is_upc, "036000291452") and not check(identifiers.is_upc, "036000291453") and not check(identifiers.is_upc, "36000291452")
    assert check(identifiers.is_ean13, "978-0-306-40615-7") and not check(identifiers.is_ean13, "978-0-306-40615-8")
