"""Ranges as struct(lower, upper, lower_inc, upper_inc, empty); a null bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, bounds: str = "[)", discrete: bool = False) -> Column:
    """A range; lower > upper as they are given fails. Discrete ranges become [lower, upper)."""
    low_inc, high_inc = bounds[0] == "[", bounds[1] == "]"
    wrong = lower > upper
    if discrete:
        lower = lower if low_inc else lower + 1
        upper = upper + 1 if high_inc else upper
        low_inc, high_inc = True, False
    error = F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast("boolean")
    nothing = (lower > upper) | ((lower == upper) & F.lit(not (low_inc and high_inc)))
    empty = F.when(wrong, error).otherwise(F.coalesce(nothing, F.lit(False)))
    return F.struct(
        F.when(~empty, lower).alias("lower"), F.when(~empty, upper).alias("upper"),
        (~empty & lower.isNotNull() & F.lit(low_inc)).alias("lower_inc"), (~empty & upper.isNotNull() & F.lit(high_inc)).alias("upper_inc"), empty.alias("empty"),
    )


def contains_value(r: Column, x: Column) -> Column:
    """r @> x"""
    above = r["lower"].isNull() | (x > r["lower"]) | (r["lower_inc"] & (x == r["lower"]))
    below = r["upper"].isNull() | (x < r["upper"]) | (r["upper_inc"] & (x == r["upper"]))
    return ~r["empty"] & above & below


def _starts_before_end(a: Column, b: Column) -> Column:
    """a's lower bound isn't beyond b's upper bound."""
    return a["lower"].isNull() | b["upper"].isNull() | (a["lower"] < b["upper"]) | ((a["lower"] == b["upper"]) & a["lower_inc"] & b["upper_inc"])


def overlaps(a: Column, b: Column) -> Column:
    """a && b"""
    return ~a["empty"] & ~b["empty"] & _starts_before_end(a, b) & _starts_before_end(b, a)


def _low_not_above(a: Column, b: Column) -> Column:
    """a begins where b does, or before."""
    return a["lower"].isNull() | (b["lower"].isNotNull() & ((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))))


def _high_not_below(a: Column, b: Column) -> Column:
    return a["upper"].isNull() | (b["upper"].isNotNull() & ((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))))


def contains(a: Column, b: Column) -> Column:
    """a @> b"""
    return b["empty"] | (~a["empty"] & _low_not_above(a, b) & _high_not_below(a, b))


def left_of(a: Column, b: Column) -> Column:
    """a << b"""
    return ~a["empty"] & ~b["empty"] & ~_starts_before_end(b, a)


def right_of(a: Column, b: Column) -> Column:
    """a >> b"""
    return left_of(b, a)


def not_right_of(a: Column, b: Column) -> Column:
    """a &< b: a doesn't reach beyond b's end."""
    return ~a["empty"] & ~b["empty"] & _high_not_below(b, a)


def not_left_of(a: Column, b: Column) -> Column:
    """a &> b: a doesn't begin before b."""
    return ~a["empty"] & ~b["empty"] & _low_not_above(b, a)


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lower"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["upper"].isNull()


def difference(a: Column, b: Column) -> Column:
    """a - b; fails where b lies within a and leaves two parts."""
    cut_low, cut_high = _low_not_above(b, a), _high_not_below(b, a)  # b takes a's beginning, a's end
    none = F.struct(a["lower"].alias("lower"), a["upper"].alias("upper"), F.lit(False).alias("lower_inc"), F.lit(False).alias("upper_inc"), F.lit(True).alias("empty"))
    none = F.struct(F.nullif(none["lower"], none["lower"]).alias("lower"), F.nullif(none["upper"], none["upper"]).alias("upper"), none["lower_inc"].alias("lower_inc"), none["upper_inc"].alias("upper_inc"), none["empty"].alias("empty"))
    tail = F.struct(b["upper"].alias("lower"), a["upper"].alias("upper"), (~b["upper_inc"]).alias("lower_inc"), a["upper_inc"].alias("upper_inc"), F.lit(False).alias("empty"))
    head = F.struct(a["lower"].alias("lower"), b["lower"].alias("upper"), a["lower_inc"].alias("lower_inc"), (~b["lower_inc"]).alias("upper_inc"), F.lit(False).alias("empty"))
    gap = F.raise_error(F.lit("result of range difference would not be contiguous"))
    return F.when(~overlaps(a, b), a).when(cut_low & cut_high, none).when(cut_low, tail).when(cut_high, head).otherwise(gap)


class RangeType:
    """CREATE TYPE ... AS RANGE: ranges over any ordered type, discrete ones with a step of one."""

    def __init__(self, subtype: str, discrete: bool = False):
        self.subtype, self.discrete = subtype, discrete

    def __call__(self, lower: Column, upper: Column, bounds: str = "[)") -> Column:
        return make(lower.cast(self.subtype), upper.cast(self.subtype), bounds, self.discrete)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b: they touch without a common value."""
    def touch(x, y):
        return F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))

    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def intersection(a: Column, b: Column) -> Column:
    """a * b"""
    low, high = F.when(_low_not_above(a, b), b).otherwise(a), F.when(_high_not_below(a, b), b).otherwise(a)
    some = overlaps(a, b)
    return F.struct(
        F.when(some, low["lower"]).alias("lower"), F.when(some, high["upper"]).alias("upper"),
        (some & low["lower_inc"]).alias("lower_inc"), (some & high["upper_inc"]).alias("upper_inc"), (~some).alias("empty"),
    )


def merge(a: Column, b: Column) -> Column:
    """The least range that holds both."""
    low, high = F.when(_low_not_above(a, b), a).otherwise(b), F.when(_high_not_below(a, b), a).otherwise(b)
    both = F.struct(low["lower"].alias("lower"), high["upper"].alias("upper"), low["lower_inc"].alias("lower_inc"), high["upper_inc"].alias("upper_inc"), F.lit(False).alias("empty"))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(both)


def union(a: Column, b: Column) -> Column:
    """a + b; fails if the result has a gap."""
    joined = a["empty"] | b["empty"] | overlaps(a, b) | adjacent(a, b)
    return F.when(joined, merge(a, b)).otherwise(F.raise_error(F.lit("result of range union would not be contiguous")))
