"""Segments: intervals of measured numbers, as a struct of lower and upper (infinite where open)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number that may carry a mark of certainty, which no operator looks at.
NUMBER = r"[<>~]?([+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


def make(lower: Column, upper: Column) -> Column:
    """The segment from lower to upper; a null end is open; lower above upper fails."""
    low, high = F.coalesce(lower.cast("double"), F.lit(float("-inf"))), F.coalesce(upper.cast("double"), F.lit(float("inf")))
    swapped = F.raise_error(F.lit("swapped boundaries of a segment"))
    return F.struct(F.when(low > high, swapped).otherwise(low).alias("lower"), high.alias("upper"))


def parse(text: Column) -> Column:
    """'5', '~5', '1 .. 2', '1 ..', '.. 2' and '5 (+-) 0.3' as segments; null for null, other texts fail."""
    plain = F.regexp_replace(text, r"\s", "")
    deviation, span = rf"^{NUMBER}\(\+-\){NUMBER}$", rf"^(?:{NUMBER})?\.\.\.?(?:{NUMBER})?$"
    part = lambda pattern, k: F.regexp_extract(plain, pattern, k).try_cast("double")
    centre, by = part(deviation, 1), part(deviation, 2)
    point = part(f"^{NUMBER}$", 1)
    wrong = F.raise_error(F.concat(F.lit("not a segment: "), text))
    known = F.when(plain.rlike(f"^{NUMBER}$"), make(point, point)).when(plain.rlike(deviation), make(centre - by, centre + by)).when(plain.rlike(span) & plain.rlike("[0-9]"), make(part(span, 1), part(span, 2)))
    return F.when(text.isNotNull(), known.otherwise(wrong))


def overlaps(a: Column, b: Column) -> Column:
    return (a["lower"] <= b["upper"]) & (b["lower"] <= a["upper"])


def contains(a: Column, b: Column) -> Column:
    return (a["lower"] <= b["lower"]) & (b["upper"] <= a["upper"])


def left_of(a: Column, b: Column) -> Column:
    return a["upper"] < b["lower"]


def not_right_of(a: Column, b: Column) -> Column:
    """a &< b: a ends no later than b."""
    return a["upper"] <= b["upper"]


def not_left_of(a: Column, b: Column) -> Column:
    """a &> b: a starts no earlier than b."""
    return a["lower"] >= b["lower"]


def union(a: Column, b: Column) -> Column:
    """The least segment that holds both."""
    return F.struct(F.least(a["lower"], b["lower"]).alias("lower"), F.greatest(a["upper"], b["upper"]).alias("upper"))


def intersection(a: Column, b: Column) -> Column:
    """What both share; null if they don't meet."""
    return F.when(overlaps(a, b), F.struct(F.greatest(a["lower"], b["lower"]).alias("lower"), F.least(a["upper"], b["upper"]).alias("upper")))


def size(a: Column) -> Column:
    return a["upper"] - a["lower"]


def center(a: Column) -> Column:
    return (a["lower"] + a["upper"]) / 2
