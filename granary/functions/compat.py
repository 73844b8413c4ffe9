"""Compatibility names: instr with direction and occurrence, padding by display width, conversions, full-width letters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widest result of padding.
PAD_MAX = 4000
#: Characters that take two columns: the usual East Asian wide and full-width blocks (fixed values).
WIDE = r"[\u1100-\u115F\u2E80-\u303E\u3041-\uA4CF\uAC00-\uD7A3\uF900-\uFAFF\uFE30-\uFE6F\uFF00-\uFF60\uFFE0-\uFFE6]"


def instr(s: Column, sub: Column, start: int = 1, nth: int = 1) -> Column:
    """1-based place of the nth occurrence from ``start`` on (from the end backward if negative); 0 if there is none."""
    if nth <= 0:
        raise ValueError("argument '%d' is out of range" % nth)
    n, m = F.length(s), F.length(sub)
    if start > 0:
        hit, empty = _nth(s, sub, F.lit(start), nth), F.lit(start + nth - 1)
    elif start < 0:
        # the last place in a text is the first one in the reversed text
        back = _nth(F.reverse(s), F.reverse(sub), F.greatest(1 - start - m, F.lit(1)), nth)
        hit, empty = F.when(back > 0, n - m + 2 - back).otherwise(0), n + start + 2 - nth
    else:
        hit, empty = F.lit(0), F.lit(0)
    # an empty text is found at every place and behind the last
    found = F.when(m > 0, hit).when((empty > 0) & (empty <= n + 1), empty).otherwise(0)
    return F.when(s.isNotNull() & sub.isNotNull(), found)


def _nth(s: Column, sub: Column, start: Column, nth: int) -> Column:
    """Place of the nth occurrence from ``start`` on, 0 if there is none; occurrences may overlap."""
    first = F.position(sub, s, start)
    if nth == 1:
        return first
    return F.aggregate(F.array_repeat(F.lit(0), nth - 1), first, lambda at, _: F.when(at > 0, F.position(sub, s, at + 1)).otherwise(0))


def width(s: Column) -> Column:
    return F.length(s) + F.regexp_count(s, F.lit(WIDE))


def _columns(s: Column) -> Column:
    """A text's columns: n for a narrow character, ww for a wide one."""
    return F.regexp_replace(F.regexp_replace(s, WIDE.replace("[", "[^"), "n"), WIDE, "ww")


def _fit(s: Column, columns: Column, shape: Column) -> Column:
    """The longest beginning that fits; ``shape`` has the columns of the text."""
    cut = F.left(shape, columns)
    narrow = F.length(F.replace(cut, F.lit("w"), F.lit("")))
    return F.left(s, narrow + F.floor((F.length(cut) - narrow) / 2).cast("int"))


def _pad(s: Column, columns: int, fill: str, on_left: bool) -> Column:
    """Padding by display columns; what a wide character leaves open is a blank."""
    target = min(columns, PAD_MAX)
    room = F.lit(target) - width(s)
    if fill and target > 0:
        repeated = (fill * (target // len(fill) + 1))[:target]
        shape = "".join("ww" if re.match(WIDE, c) else "n" for c in repeated)
        filled = _fit(F.lit(repeated), room, F.lit(shape))
        if "w" in shape:
            gap = F.repeat(F.lit(" "), F.length(F.replace(F.left(F.lit(shape), room), F.lit("n"), F.lit(""))) % 2)
        else:
            gap = F.lit("")
        whole = F.concat(gap, filled, s) if on_left else F.concat(s, filled, gap)
    else:
        whole = s
    return F.when(width(s) > target, _fit(s, F.lit(target), _columns(s))).otherwise(whole)


def lpad(s: Column, columns: int, fill: str = " ") -> Column:
    return _pad(s, columns, fill, True)


def rpad(s: Column, columns: int, fill: str = " ") -> Column:
    return _pad(s, columns, fill, False)


def to_number(s: Column, template: str | None = None) -> Column:
    """Text to decimal; null for empty text. A template of 9, 0, ',', 'G', '.', 'D' tells the separators."""
    if template == "":
        return F.lit(None).cast("decimal(38,10)")
    plain = F.trim(s if template is None else F.regexp_replace(s, "[,\\s]", ""))
    return F.when(plain == "", F.lit(None)).otherwise(plain).cast("decimal(38,10)")


def to_char_number(x: Column) -> Column:
    """A number as plain text, without trailing zeros behind the point."""
    return F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1").substr(F.lit(1), F.lit(60))


_HALF = "".join(map(chr, range(0x21, 0x7F)))
_FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def to_multi_byte(s: Column) -> Column:
    return F.translate(s, " " + _HALF, "\u3000" + _FULL)


def to_single_byte(s: Column) -> Column:
    return F.translate(s, "\u3000" + _FULL, " " + _HALF)
