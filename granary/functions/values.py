"""Networks, bit strings, enumerations, money, geometry, label paths and key-value maps."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formatting import _once

# networks: IPv4 text 'a.b.c.d[/n]'


def host(inet: Column) -> Column:
    return F.split_part(inet, F.lit("/"), F.lit(1))


def masklen(inet: Column) -> Column:
    bits = F.split_part(inet, F.lit("/"), F.lit(2))
    return F.coalesce(bits.try_cast("int"), F.lit(32))


def inet_number(inet: Column) -> Column:
    parts = F.split(host(inet), r"\.")
    return reduce(lambda a, b: a * 256 + b, [F.get(parts, F.lit(i)).cast("long") for i in range(4)])


def number_inet(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def _mask(bits: Column) -> Column:
    return F.lit(2**32) - F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")


def netmask(inet: Column) -> Column:
    return number_inet(_mask(masklen(inet)))


def network(inet: Column) -> Column:
    return F.concat(number_inet(inet_number(inet).bitwiseAND(_mask(masklen(inet)))), F.lit("/"), masklen(inet).cast("string"))


def broadcast(inet: Column) -> Column:
    top = inet_number(inet).bitwiseAND(_mask(masklen(inet))) + F.pow(F.lit(2.0), F.lit(32) - masklen(inet)).cast("long") - 1
    return F.concat(number_inet(top), F.when(masklen(inet) < 32, F.concat(F.lit("/"), masklen(inet).cast("string"))).otherwise(F.lit("")))


def inside_network(a: Column, b: Column) -> Column:
    """a <<= b"""
    return (masklen(a) >= masklen(b)) & (inet_number(a).bitwiseAND(_mask(masklen(b))) == inet_number(b).bitwiseAND(_mask(masklen(b))))


# bit strings: text of 0 and 1


def bit_combine(a: Column, b: Column, kind: str) -> Column:
    """& | # of bit strings of one length."""
    one = {"&": lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"), "|": lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"), "#": lambda x, y: F.when(x != y, "1").otherwise("0")}[kind]
    bits = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != "", one(x, y)).otherwise("")), "")
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("cannot combine bit strings of different sizes")).cast("string")).otherwise(bits)


def bit_not(a: Column) -> Column:
    return F.translate(a, "01", "10")


def bit_shift(a: Column, n: int) -> Column:
    """<< for positive n, >> for negative: bits fall off, zeros come in."""
    zeros = F.repeat(F.lit("0"), F.least(F.length(a), F.lit(abs(n))))
    kept = F.greatest(F.length(a) - abs(n), F.lit(0))
    return F.concat(F.substring(a, F.lit(abs(n) + 1), kept), zeros) if n >= 0 else F.concat(zeros, F.substring(a, F.lit(1), kept))


# enumerations


class Enum:
    """Labels in declared order."""

    def __init__(self, *labels: str):
        self.labels = list(labels)

    def ordinal(self, value: Column) -> Column:
        known = F.array_position(F.array(*map(F.lit, self.labels)), value).cast("int")
        return F.when(known == 0, F.raise_error(F.lit("invalid input value for enum")).cast("int")).otherwise(known)

    def label(self, ordinal: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.labels)), ordinal - 1)

    def range(self, first: str | None = None, last: str | None = None) -> list[str]:
        a = self.labels.index(first) if first else 0
        b = self.labels.index(last) if last else len(self.labels) - 1
        return self.labels[a : b + 1]


# geometry: points struct(x, y), polygons array of them


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def polygon_area(points: Column) -> Column:
    """Shoelace formula."""
    n = F.size(points)
    cross = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, c: a + c)) / 2


def in_circle(p: Column, center: Column, radius: Column) -> Column:
    return distance(p, center) <= radius


def box_of(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


# label paths 'a.b.c'


def nlevel(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, r"\.")))


def subpath(path: Column, offset: int, length: int | None = None) -> Column:
    labels = F.split(path, r"\.")
    start = F.lit(offset) if offset >= 0 else F.greatest(F.size(labels) + offset, F.lit(0))
    n = F.size(labels) - start if length is None else F.least(F.lit(length), F.size(labels) - start) if length >= 0 else F.size(labels) - start + length
    return F.array_join(F.slice(labels, start + 1, F.greatest(n, F.lit(0))), ".")


def is_ancestor(a: Column, b: Column) -> Column:
    """a @> b"""
    return (a == "") | (a == b) | F.startswith(b, F.concat(a, F.lit(".")))


def _label_pattern(label: str) -> str:
    """A label of a path pattern with its marks: @ for any case, * for a prefix, % for whole words between underscores."""
    name = label.rstrip("@*%")
    marks = label[len(name) :]
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a label of a path pattern: {label!r}")
    tail = r"[^._]*" if "*" in marks else ""
    found = "_".join(w + tail for w in name.split("_")) + "(?:_[^.]*)?" if "%" in marks else name + ("[^.]*" if "*" in marks else "")
    return f"(?iu:{found})" if "@" in marks else found


def path_matches(path: Column, pattern: str) -> Column:
    """ltree ~ lquery: items between dots are labels, alternatives a|b, their negation !a|b, or * with {n}, {n,}, {n,m}, {,m}.

    The pattern is a constant, so it becomes one regular expression; null paths give null.
    """
    out = []
    for item in re.split(r"\.(?![^{]*\})", pattern):
        star = re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", item)
        if star:
            least, comma, most = star.groups()
            times = "*" if comma is None else "{%s}" % least if not comma else "{%s,%s}" % (least or "0", most)
            out.append(r"(?:\.[^.]+)" + times)
        else:
            any_of = "|".join(map(_label_pattern, item.removeprefix("!").split("|")))
            out.append(rf"\.(?!(?:{any_of})(?:\.|$))[^.]+" if item.startswith("!") else rf"\.(?:{any_of})")
    dotted = F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("."), path))
    return dotted.rlike(f"^{''.join(out)}$")


def lca(a: Column, b: Column) -> Column:
    """Longest common ancestor of two paths (a proper ancestor of both)."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, False)
    n = F.least(F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int"), F.size(x) - 1, F.size(y) - 1)
    return F.array_join(F.slice(x, F.lit(1), F.greatest(n, F.lit(0))), ".")


# key-value maps (hstore)


def map_contains(a: Column, b: Column) -> Column:
    """a @> b"""
    return F.forall(F.map_entries(b), lambda e: F.element_at(a, e["key"]).eqNullSafe(e["value"]) & F.map_contains_key(a, e["key"]))


def map_delete(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_concat(a: Column, b: Column) -> Column:
    """a || b: b's values win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


# MAC addresses: text 'aa:bb:cc:dd:ee:ff' (or eight bytes)


def _mac_bytes(mac: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(mac, "[:.-]", "")), F.lit("([0-9a-f]{2})"), 1)


def mac_text(mac: Column) -> Column:
    """The usual form of an address written with colons, hyphens, points or nothing."""
    return F.array_join(_mac_bytes(mac), ":")


def mac_trunc(mac: Column) -> Column:
    """The maker's three bytes, zeros behind."""
    return F.array_join(F.transform(_mac_bytes(mac), lambda b, i: F.when(i < 3, b).otherwise("00")), ":")


def _byte(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("int")


def _hex2(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n)), 2, "0")


def mac_not(mac: Column) -> Column:
    return F.array_join(F.transform(_mac_bytes(mac), lambda b: _hex2(F.lit(255) - _byte(b))), ":")


def mac_combine(a: Column, b: Column, kind: str) -> Column:
    """& or | of two addresses of one length."""
    one = (lambda x, y: x.bitwiseAND(y)) if kind == "&" else (lambda x, y: x.bitwiseOR(y))
    return F.array_join(F.zip_with(_mac_bytes(a), _mac_bytes(b), lambda x, y: _hex2(one(_byte(x), _byte(y)))), ":")


def mac8_set7bit(mac: Column) -> Column:
    """The address with the seventh bit of its first byte set (for IPv6 host parts)."""
    return F.array_join(F.transform(_mac_bytes(mac), lambda b, i: F.when(i == 0, _hex2(_byte(b).bitwiseOR(2))).otherwise(b)), ":")


def mac_to_mac8(mac: Column) -> Column:
    """Six bytes as eight, ff:fe in the middle."""
    b = _mac_bytes(mac)
    return F.array_join(F.concat(F.slice(b, 1, 3), F.array(F.lit("ff"), F.lit("fe")), F.slice(b, 4, 3)), ":")


# IPv6: text 'a::b[/n]', worked on as its 128 bits


def inet6_bits(inet: Column) -> Column:
    """The 128 bits of an address as text of 0 and 1."""
    groups = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")

    def joined(p: Column) -> Column:
        gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(p["left"]) - F.size(p["right"]), F.lit(0)))
        return F.array_join(F.transform(F.concat(p["left"], gap, p["right"]), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")

    def sides(h: Column) -> Column:
        return _once(F.struct(groups(F.get(h, F.lit(0))).alias("left"), groups(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("right")), joined)

    return _once(F.split(F.lower(host(inet)), "::"), sides)


def inet6_text(bits: Column) -> Column:
    """Eight groups of hexadecimal digits, none left out."""
    group = lambda b, i: F.lower(F.conv(F.substring(b, F.lit(i * 16 + 1), F.lit(16)), 2, 16))
    return _once(bits, lambda b: F.when(b.isNotNull(), F.array_join(F.array(*[group(b, i) for i in range(8)]), ":")))


def inet6_network(inet: Column) -> Column:
    n = F.coalesce(F.split_part(inet, F.lit("/"), F.lit(2)).try_cast("int"), F.lit(128))
    return F.concat(inet6_text(F.rpad(F.substring(inet6_bits(inet), F.lit(1), n), 128, "0")), F.lit("/"), n.cast("string"))


def inside_network6(a: Column, b: Column) -> Column:
    """a <<= b"""
    n = F.coalesce(F.split_part(b, F.lit("/"), F.lit(2)).try_cast("int"), F.lit(128))
    m = F.coalesce(F.split_part(a, F.lit("/"), F.lit(2)).try_cast("int"), F.lit(128))
    return (m >= n) & (F.substring(inet6_bits(a), F.lit(1), n) == F.substring(inet6_bits(b), F.lit(1), n))


# uuids: text in any of the usual forms


def uuid_key(u: Column) -> Column:
    """32 hexadecimal digits, in whose order uuids sort and compare; a bad one fails."""
    plain = F.lower(F.regexp_replace(u, "[{}-]", ""))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), plain).otherwise(F.when(u.isNotNull(), F.raise_error(F.lit("invalid input syntax for type uuid")).cast("string")))


# boxes, circles and bit strings


def box_center(box: Column) -> Column:
    return point((box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2)


def box_area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def box_overlaps(a: Column, b: Column) -> Column:
    """a && b"""
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def box_contains(a: Column, b: Column) -> Column:
    """a @> b"""
    return (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])


def path_length(points: Column, closed: bool = False) -> Column:
    """@-@ : the length of a path through points."""
    n = F.size(points)
    steps = F.sequence(F.lit(0), n - (1 if closed else 2))
    gap = lambda i: distance(F.get(points, i), F.get(points, (i + 1) % n))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(F.transform(steps, gap), F.lit(0.0), lambda a, x: a + x))


def circle_area(radius: Column) -> Column:
    return F.pi() * radius * radius


def bit_at(bits: Column, n: Column) -> Column:
    """get_bit: the n-th bit from 0 on; null outside."""
    return F.when((n >= 0) & (n < F.length(bits)), F.substring(bits, n + 1, F.lit(1)).cast("int"))


def bit_put(bits: Column, n: Column, bit: Column) -> Column:
    """set_bit: with the n-th bit from 0 on replaced; fails outside."""
    bad = F.raise_error(F.lit("bit index out of valid range")).cast("string")
    return F.when((n < 0) | (n >= F.length(bits)), bad).otherwise(F.overlay(bits, bit.cast("string"), n + 1, F.lit(1)))


# more of key-value maps


def map_slice(m: Column, keys: list[str]) -> Column:
    """The pairs of some keys."""
    return F.map_filter(m, lambda k, _: k.isin(keys))


def map_minus(a: Column, b: Column) -> Column:
    """a - b: without the pairs that b has with the same value (nulls are the same)."""
    return F.map_filter(a, lambda k, v: ~(F.map_contains_key(b, k) & F.element_at(b, k).eqNullSafe(v)))


def map_defined(m: Column, key: str) -> Column:
    """Whether the key has a value that isn't null."""
    return F.coalesce(F.element_at(m, key).isNotNull(), F.lit(False))
