"""Sizes in words, product numbers, and amounts of money in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["bytes", "kB", "MB", "GB", "TB"]


def size_pretty(n: Column) -> Column:
    """pg_size_pretty: the unit in which the number is below 10240, rounded half up."""
    out = F.when(F.abs(n) < 10 * 1024, F.concat(n.cast("string"), F.lit(" bytes")))
    for k, unit in enumerate(UNITS[1:], 1):
        value = F.floor(n / 1024**k + 0.5)
        text = F.concat(value.cast("string"), F.lit(f" {unit}"))
        out = out.when(F.abs(value) < 10 * 1024, text) if k < len(UNITS) - 1 else out.otherwise(text)
    return out


def size_bytes(text: Column) -> Column:
    """pg_size_bytes: '1.5 GB' to a number."""
    number, unit = F.regexp_extract(text, r"^\s*([+-]?[0-9.]+)", 1).cast("decimal(38,6)"), F.lower(F.regexp_extract(text, r"([A-Za-z]*)\s*$", 1))
    scale = F.when(unit.isin("", "bytes"), 1)
    for k, u in enumerate(UNITS[1:], 1):
        scale = scale.when(unit == u.lower(), 1024**k)
    return (number * F.coalesce(scale, F.raise_error(F.lit("invalid size unit")).cast("long"))).cast("long")


def ean13_check_digit(first12: Column) -> Column:
    """The digit that makes 12 digits an EAN13 (ISBN-13) number."""
    digits = F.transform(F.filter(F.split(first12, ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 3)), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


def isbn13(isbn10: Column) -> Column:
    """ISBN-13 of an ISBN-10 (with or without hyphens)."""
    core = F.concat(F.lit("978"), F.substring(F.regexp_replace(isbn10, "-", ""), 1, 9))
    return F.concat(core, ean13_check_digit(core).cast("string"))


def is_isbn10(isbn: Column) -> Column:
    """Whether the check sign (X is 10) fits."""
    plain = F.upper(F.regexp_replace(isbn, "-", ""))
    digits = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.when(c == "X", 10).otherwise(c.try_cast("int")))
    total = F.aggregate(F.transform(digits, lambda d, i: d * (10 - i)), F.lit(0), lambda a, x: a + x)
    return plain.rlike("^[0-9]{9}[0-9X]$") & (total % 11 == 0)


def is_issn(issn: Column) -> Column:
    """Whether the check sign (X is 10) of an ISSN (with or without hyphen) fits."""
    plain = F.upper(F.replace(issn, F.lit("-"), F.lit("")))
    digits = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.when(c == "X", 10).otherwise(c.try_cast("int")))
    total = F.aggregate(F.transform(digits, lambda d, i: d * (8 - i)), F.lit(0), lambda a, x: a + x)
    return plain.rlike("^[0-9]{7}[0-9X]$") & (total % 11 == 0)


def is_ean13(ean: Column) -> Column:
    """Whether the check digit of an EAN13 (with or without hyphens) fits."""
    plain = F.replace(ean, F.lit("-"), F.lit(""))
    return plain.rlike("^[0-9]{13}$") & (ean13_check_digit(F.substring(plain, 1, 12)).cast("string") == F.substring(plain, 13, 1))


def is_upc(upc: Column) -> Column:
    """Whether the check digit of a UPC fits: an EAN13 without its leading zero."""
    return F.length(F.replace(upc, F.lit("-"), F.lit(""))).eqNullSafe(12) & is_ean13(F.concat(F.lit("0"), upc))


#: English number words (fixed values).
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()


def _below_thousand(n: Column) -> Column:
    small, tens = F.array(*map(F.lit, SMALL)), F.array(*map(F.lit, TENS))
    rest = n % 100
    two = F.when(rest < 20, F.get(small, rest)).otherwise(F.concat(F.get(tens, F.floor(rest / 10).cast("int")), F.when(rest % 10 > 0, F.concat(F.lit(" "), F.get(small, rest % 10))).otherwise("")))
    hundreds = F.concat(F.get(small, F.floor(n / 100).cast("int")), F.lit(" hundred"))
    return F.when(n < 100, two).when(rest == 0, hundreds).otherwise(F.concat(hundreds, F.lit(" "), two))


def cash_words(amount: Column) -> Column:
    """An amount of money in words, up to 10**15."""
    cents = F.round(F.abs(amount.cast("decimal(19,2)")) * 100).cast("long")
    whole, part = F.floor(cents / 100), (cents % 100).cast("int")
    groups = []
    for name, size in (("trillion", 10**12), ("billion", 10**9), ("million", 10**6), ("thousand", 10**3), ("", 1)):
        n = (F.floor(whole / size) % 1000).cast("int")
        groups.append(F.when(n > 0, F.concat(_below_thousand(n), F.lit(f" {name}" if name else ""))))
    dollars = F.when(whole == 0, F.lit("zero")).otherwise(F.concat_ws(" ", *groups))
    text = F.concat(F.when(amount < 0, "minus ").otherwise(""), dollars, F.when(whole == 1, " dollar and ").otherwise(" dollars and "), _below_thousand(part), F.when(part == 1, " cent").otherwise(" cents"))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
