"""Literal cases of partition routing, arrays, bits, lexemes and dictionaries."""

import pytest
from pyspark.sql import functions as F

from granary.functions import arrays, search, values
from granary.operators import partitions

L = F.lit


def none():
    return F.lit(None).cast("int")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ints(*xs):
    return F.array(*map(F.lit, xs))


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: partitions.list_partition(none(), [[1], [2, None]]), 1),
        (lambda: partitions.list_partition(L(3), [[1], [2]], default=7), 7),
        (lambda: partitions.list_partition(none(), [[1], [2]], default=7), 7),
        (lambda: partitions.range_partition(L(5), [None, 5, 9]), 1),
        (lambda: partitions.range_partition(L(9), [None, 5, 9], default=4), 4),
        (lambda: partitions.range_partition(none(), [None, None], default=4), 4),
        (lambda: arrays.subarray(ints(1, 2, 3, 2, 1), 2, 3), [2, 3, 2]),
        (lambda: arrays.subarray(ints(1, 2, 3, 2, 1), -2, 1), [2]),
        (lambda: arrays.subarray(ints(1, 2, 3), 3, -1), []),
        (lambda: arrays.subarray(ints(1, 2, 3), 9), []),
        (lambda: arrays.except_ints(ints(4, 4, 1, 2), ints(2)), [1, 4]),
        (lambda: arrays.cube_enlarge(F.array(L(0.0)), F.array(L(2.0)), -3.0)["low"], [1.0]),
        (lambda: values.bit_at(L("101"), L(3)), None),
        (lambda: values.bit_put(L("101"), L(1), L(1)), "111"),
        (lambda: values.map_defined(F.create_map(L("a"), L(1)), "z"), False),
        (lambda: search.int_dictionary(L("12345678")), ["123456"]),
        (lambda: search.int_dictionary(L("12345678"), reject_long=True), []),
        (lambda: search.int_dictionary(L("123"), reject_long=True), ["123"]),
        (lambda: search.synonym_dictionary(L("Sn"), {"supernova": ["sn"]}), None),
        (lambda: search.synonym_dictionary(L("Sn"), {"supernova": ["sn"]}, match_synonyms=True), ["supernova", "sn"]),
        (lambda: search.synonym_dictionary(L("supernova"), {"supernova": ["sn"]}, keep_original=False), ["sn"]),
        (lambda: search.synonym_dictionary(L("a"), {}), None),
    ],
)
def test_literal(spark, make, want):
    assert value(spark, make()) == want


@pytest.mark.parametrize("make", [lambda: partitions.list_partition(L(3), [[1], [2]]), lambda: partitions.range_partition(none(), [1, 9]), lambda: values.bit_put(L("1"), L(1), L(0))])
def test_literal_fails(spark, make):
    with pytest.raises(Exception, match="no partition found|out of valid range"):
        value(spark, make())
