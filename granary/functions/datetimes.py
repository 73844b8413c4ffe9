"""Dates, times and intervals. An interval is struct(months int, days int, micros long)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def overlaps(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """OVERLAPS: half-open periods given in either order; an empty period is its instant."""
    a, b, c, d = F.least(start1, end1), F.greatest(start1, end1), F.least(start2, end2), F.greatest(start2, end2)
    return F.when(a == c, True).otherwise(F.when(a < c, c < b).otherwise(a < d))


def century(t: Column) -> Column:
    y = F.year(t)
    return F.when(y > 0, F.floor((y + 99) / 100)).otherwise(-F.floor((100 - y) / 100)).cast("int")


def millennium(t: Column) -> Column:
    return F.floor((F.year(t) + 999) / 1000).cast("int")


def decade(t: Column) -> Column:
    return F.floor(F.year(t) / 10).cast("int")


def date_trunc(unit: str, t: Column) -> Column:
    """date_trunc including decade, century and millennium."""
    spans = {"decade": 10, "century": 100, "millennium": 1000}
    if unit not in spans:
        return F.date_trunc(unit, t)
    n, shift = spans[unit], 0 if unit == "decade" else 1
    first = F.floor((F.year(t) - shift) / n) * n + shift
    return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")


def make_time(hours: Column, minutes: Column, seconds: Column) -> Column:
    """Time of day in microseconds."""
    bad = (hours < 0) | (hours > 24) | (minutes < 0) | (minutes > 59) | (seconds < 0) | (seconds > 60)
    value = (hours * 3600 + minutes * 60).cast("long") * 1_000_000 + F.round(seconds * 1_000_000).cast("long")
    return F.when(bad, F.raise_error(F.lit("time field value out of range")).cast("long")).otherwise(value)


def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(months).cast("int").alias("months"), as_column(days).cast("int").alias("days"), as_column(micros).cast("long").alias("micros"))


def interval_key(i: Column) -> Column:
    """Sort and comparison key: microseconds with months of 30 days and days of 24 hours."""
    return (i["months"].cast("decimal(38,0)") * 30 + i["days"]) * DAY + i["micros"]


def interval_add(a: Column, b: Column) -> Column:
    return interval(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"])


def interval_times(i: Column, factor: Column) -> Column:
    """Product with a number: fractions of months become days, fractions of days time."""
    months = i["months"] * factor
    whole_months = F.when(months < 0, F.ceil(months)).otherwise(F.floor(months))
    days = i["days"] * factor + (months - whole_months) * 30
    whole_days = F.when(days < 0, F.ceil(days)).otherwise(F.floor(days))
    return interval(whole_months, whole_days, F.round(i["micros"] * factor + (days - whole_days) * DAY))


def justify_hours(i: Column) -> Column:
    days = F.when(i["micros"] < 0, -F.floor(-i["micros"] / DAY)).otherwise(F.floor(i["micros"] / DAY))
    rest, total = i["micros"] - days * DAY, i["days"] + days
    up = F.when((total > 0) & (rest < 0), -1).when((total < 0) & (rest > 0), 1).otherwise(0)
    return interval(i["months"], total + up, rest - up * DAY)


def justify_days(i: Column) -> Column:
    months = F.when(i["days"] < 0, -F.floor(-i["days"] / 30)).otherwise(F.floor(i["days"] / 30))
    rest, total = i["days"] - months * 30, i["months"] + months
    up = F.when((total > 0) & (rest < 0), -1).when((total < 0) & (rest > 0), 1).otherwise(0)
    return interval(total + up, rest - up * 30, i["micros"])


def add_interval(t: Column, i: Column) -> Column:
    """timestamp + interval: months first (clamped to the month's end), then days, then time."""
    return F.timestamp_add("MICROSECOND", i["micros"], F.timestamp_add("DAY", i["days"], F.timestamp_add("MONTH", i["months"], t)))


def age(later: Column, earlier: Column) -> Column:
    """Symbolic difference: years and months, then days, then time; negative if ``later`` is earlier."""
    flip = later < earlier
    a, b = F.greatest(later, earlier), F.least(later, earlier)
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    months = months - F.when(F.timestamp_add("MONTH", months, b) > a, 1).otherwise(0)
    base = F.timestamp_add("MONTH", months, b)
    micros = F.timestamp_diff("MICROSECOND", base, a)
    days = F.floor(micros / DAY)
    sign = F.when(flip, -1).otherwise(1)
    return interval(sign * months, sign * days, sign * (micros - days * DAY))


#: Template patterns and Java's for them (fixed values), longest first.
PATTERNS = {
    "YYYY": "yyyy", "YYY": "yyy", "YY": "yy", "MONTH": "'MONTH'", "Month": "MMMM", "Mon": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "Day": "EEEE", "Dy": "EEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Q": "Q",
}


def to_char(t: Column, template: str) -> Column:
    """to_char(timestamp, template) by Java's patterns; null for an empty template; unknown signs stand for themselves."""
    if not template:
        return F.lit(None).cast("string")
    out, i = [], 0
    while i < len(template):
        found = next((k for k in sorted(PATTERNS, key=len, reverse=True) if template.startswith(k, i)), None)
        if found in ("MONTH", "Month", "Day"):  # names are padded to nine signs
            name = F.date_format(t, "EEEE" if found == "Day" else "MMMM")
            out.append(F.rpad(F.upper(name) if found == "MONTH" else name, 9, " "))
        elif found:
            out.append(F.date_format(t, PATTERNS[found]))
        else:
            out.append(F.lit(template[i]))
        i += len(found) if found else 1
    return F.concat(*out)


def make_interval(years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0.0) -> Column:
    """make_interval with named arguments."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    years, months, weeks, days, hours, mins, secs = map(as_column, (years, months, weeks, days, hours, mins, secs))
    micros = (hours * 3600 + mins * 60).cast("long") * 1_000_000 + F.round(secs * 1_000_000).cast("long")
    return interval(years * 12 + months, weeks * 7 + days, micros)


def justify_interval(i: Column) -> Column:
    """Hours to days, days to months, all parts of one sign."""
    total = i["months"].cast("long") * 30 * DAY + i["days"].cast("long") * DAY + i["micros"]
    sign, size = F.signum(total.cast("double")).cast("int"), F.abs(total)
    days = F.expr("1") * F.floor(size / DAY)
    return interval(sign * F.floor(days / 30), sign * (days % 30), sign * (size - days * DAY))


def isfinite(t: Column) -> Column:
    """False for the least and the greatest timestamps, which stand for infinity."""
    s = t.cast("timestamp_ntz")
    return (s > F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))) & (s < F.to_timestamp_ntz(F.lit("9999-12-31 23:59:59")))
