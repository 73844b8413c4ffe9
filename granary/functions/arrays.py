"""Array functions, and the integer-array and cube operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subscript(a: Column, i: Column) -> Column:
    """a[i], 1-based, null outside."""
    return F.when((i >= 1) & (i <= F.size(a)), F.get(a, i - 1))


def slice_of(a: Column, low: Column, high: Column) -> Column:
    """a[low:high], cut to the array's bounds."""
    first = F.greatest(low, F.lit(1))
    n = F.least(high, F.size(a)) - first + 1
    return F.when(n > 0, F.slice(a, first, n)).otherwise(F.slice(a, 1, 0))


def contains_all(a: Column, b: Column) -> Column:
    """a @> b: every element of b is in a; nulls are contained in nothing."""
    return F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False)))


def array_to_string(a: Column, separator: str, null_text: str | None = None) -> Column:
    return F.array_join(a, separator) if null_text is None else F.array_join(a, separator, null_text)


def array_positions(a: Column, value: Column) -> Column:
    """All 1-based places of a value; null is found too."""
    return F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda p: p["x"].eqNullSafe(value)), lambda p: p["i"])


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def uniq(a: Column) -> Column:
    """Without elements equal to the one before."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def idx(a: Column, value: Column) -> Column:
    return F.array_position(a, value).cast("int")


def query_int(a: Column, expression: str) -> Column:
    """Boolean query over integers: '1&(2|!3)'."""
    import re

    tokens = re.findall(r"\d+|[&|!()]", expression)

    def or_level(i):
        left, i = and_level(i)
        while i < len(tokens) and tokens[i] == "|":
            right, i = and_level(i + 1)
            left = left | right
        return left, i

    def and_level(i):
        left, i = atom(i)
        while i < len(tokens) and tokens[i] == "&":
            right, i = atom(i + 1)
            left = left & right
        return left, i

    def atom(i):
        if tokens[i] == "!":
            inner, i = atom(i + 1)
            return ~inner, i
        if tokens[i] == "(":
            inner, i = or_level(i + 1)
            return inner, i + 1
        return F.array_contains(a, int(tokens[i])), i + 1

    return or_level(0)[0]


def cube_distance(a: Column, b: Column, kind: str = "euclidean") -> Column:
    """Distance of points given as arrays of one length: euclidean <->, taxicab <#>, chebyshev <=>."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if kind == "euclidean":
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))
    if kind == "taxicab":
        return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)
    return F.array_max(gaps)


def box_overlap(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """n-dimensional boxes share a point."""
    sides = F.zip_with(F.arrays_zip(low1.alias("a"), high1.alias("b")), F.arrays_zip(low2.alias("c"), high2.alias("d")), lambda p, q: (p["a"] <= q["d"]) & (q["c"] <= p["b"]))
    return F.forall(sides, lambda x: x)


def array_append(a: Column, x: Column) -> Column:
    """The array with one more element; a null array is empty."""
    return F.concat(F.coalesce(a, F.array()), F.array(x))


def array_prepend(x: Column, a: Column) -> Column:
    return F.concat(F.array(x), F.coalesce(a, F.array()))


def array_cat(a: Column, b: Column) -> Column:
    """Both arrays; a null one is passed over, null if both are."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, b)).otherwise(F.coalesce(a, b))


def string_to_array(s: Column, separator: str | None, null_text: str | None = None) -> Column:
    """Parts between separators (each sign without one); empty text gives an empty array, parts equal to ``null_text`` null."""
    import re

    parts = F.filter(F.split(s, ""), lambda c: c != "") if separator is None else F.split(s, re.escape(separator)) if separator else F.array(s)
    parts = F.when(s == "", F.array().cast("array<string>")).otherwise(parts)
    return parts if null_text is None else F.transform(parts, lambda p: F.nullif(p, F.lit(null_text)))


def array_dims(a: Column, dimensions: int = 1) -> Column:
    """'[1:n]' for each dimension; null for an empty array."""
    out, level = [], a
    for _ in range(dimensions):
        out.append(F.concat(F.lit("[1:"), F.size(level).cast("string"), F.lit("]")))
        level = F.get(level, F.lit(0))
    return F.when(F.size(a) > 0, F.concat(*out))


def union_ints(a: Column, b: Column) -> Column:
    """a | b: sorted, each once."""
    return F.array_sort(F.array_union(a, b))


def intersect_ints(a: Column, b: Column) -> Column:
    """a & b: sorted, each once."""
    return F.array_sort(F.array_intersect(a, b))


def except_ints(a: Column, b: Column) -> Column:
    """a - b: elements of a that aren't in b, sorted, each once."""
    return F.array_sort(F.array_except(a, b))


def subarray(a: Column, start: int, length: int | None = None) -> Column:
    """Elements from place ``start`` on (from the end if negative); a negative length leaves off that many at the end."""
    n = F.size(a)
    first = F.lit(max(start, 1)) if start >= 0 else F.greatest(n + start, F.lit(0)) + 1
    count = n - first + 1 if not length else F.lit(length) if length > 0 else n - first + 1 + length
    return F.when(count > 0, F.slice(a, first, count)).otherwise(F.slice(a, 1, 0))


# n-dimensional boxes: arrays of low and high corners of one length


def cube_contains(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """a @> b"""
    return F.forall(F.zip_with(low1, low2, lambda x, y: x <= y), lambda x: x) & F.forall(F.zip_with(high1, high2, lambda x, y: x >= y), lambda x: x)


def cube_union(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    return F.struct(F.zip_with(low1, low2, lambda x, y: F.least(x, y)).alias("low"), F.zip_with(high1, high2, lambda x, y: F.greatest(x, y)).alias("high"))


def cube_inter(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """The shared part; corners are crossed where boxes don't meet."""
    return F.struct(F.zip_with(low1, low2, lambda x, y: F.greatest(x, y)).alias("low"), F.zip_with(high1, high2, lambda x, y: F.least(x, y)).alias("high"))


def cube_size(low: Column, high: Column) -> Column:
    """Volume."""
    return F.aggregate(F.zip_with(low, high, lambda x, y: F.abs(y - x).cast("double")), F.lit(1.0), lambda v, side: v * side)


def cube_enlarge(low: Column, high: Column, r: float) -> Column:
    """All sides moved outwards by r; sides that would cross meet in their middle."""
    moved = F.zip_with(low, high, lambda x, y: F.struct(F.least(x - r, (x + y) / 2).alias("a"), F.greatest(y + r, (x + y) / 2).alias("b")))
    return F.struct(F.transform(moved, lambda s: s["a"]).alias("low"), F.transform(moved, lambda s: s["b"]).alias("high"))
