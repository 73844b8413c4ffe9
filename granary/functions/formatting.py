"""Templates: numbers and intervals to text, text to dates and timestamps."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of number templates (fixed values), longest first.
NUMBER_SIGNS = re.compile(r"FM|MI|PL|SG|PR|[90.,DGS]|\"[^\"]*\"|.", re.IGNORECASE)
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def to_char_number(x: Column, template: str) -> Column:
    """to_char(number, template) with 9 0 . , D G S MI PL SG PR FM and quoted text.

    Rounds half away from zero; a number that doesn't fit gives '#' for its digits. 9 leaves leading zeros blank, but the
    last place before the point only if decimals follow; FM takes blanks and trailing zeros of 9s away.
    """
    tokens = [t.upper() if not t.startswith('"') else t for t in NUMBER_SIGNS.findall(template)]
    fill = "FM" not in tokens
    body = [t for t in tokens if t != "FM"]
    point = next((i for i, t in enumerate(body) if t in ".D"), len(body))
    whole = [t for t in body[:point] if t in "90"]
    decimals = [t for t in body[point:] if t in "90"]
    n, m = len(whole), len(decimals)
    value = F.round(x.cast("decimal(38,10)"), m)
    scaled = F.struct((value < 0).alias("negative"), (F.abs(value) * 10**m).cast("decimal(38,0)").cast("string").alias("plain"))

    def put(v: Column) -> Column:
        plain = v["plain"]
        overflow = F.length(plain) > n + m
        integer = F.when(plain == "0", 0).otherwise(F.greatest(F.length(plain) - m, F.lit(0)))  # its places without leading zeros
        forced = next((i for i, t in enumerate(whole) if t == "0"), n)
        # the first place that is shown; a zero shows its last place unless decimals follow; all are if the number doesn't fit
        first = F.when(overflow, -1).otherwise(F.least(n - integer, F.lit(forced), F.lit(n if m else max(n - 1, 0))))
        digits = F.when(overflow, "#" * (n + m)).otherwise(F.concat(F.repeat(F.lit("0"), n + m - F.length(plain)), plain))
        state = F.struct(v["negative"].alias("negative"), overflow.alias("overflow"), first.alias("first"), digits.alias("digits"))
        return _once(state, lambda w: _written(w["negative"], w["overflow"], w["first"], w["digits"], body, point, fill))

    return F.when(x.isNotNull(), _once(scaled, put))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the value is worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _written(negative: Column, overflow: Column, first: Column, digits: Column, body: list[str], point: int, fill: bool) -> Column:
    """Digits put into a template."""
    decimals = [t for t in body[point:] if t in "90"]
    n, m = sum(t in "90" for t in body[:point]), len(decimals)
    marked = any(t in ("S", "SG", "MI", "PR", "PL") for t in body)
    minus = F.when(negative, "-").otherwise(" " if fill else "")
    out: list[Column] = []
    k, run = 0, []
    for t in [*body[:point], None]:
        if t is not None and ((t in "90" and len(t) == 1) or (t in ",G" and k + len(run) > 0)):
            run.append(t)
            continue
        if run:
            out.append(_places(run, k, digits, first, "" if marked else minus, fill))
            k, run = k + sum(r in "90" for r in run), []
        if t is not None:
            out.append(F.when(overflow, ",").otherwise(" " if fill else "") if t in ",G" else _sign(t, negative, fill))
    if point < len(body):
        lead = F.when(~overflow & (first == n), minus).otherwise("") if not marked else F.lit("")
        tail = F.substring(digits, n + 1, m) if m else F.lit("")
        kept = max((i + 1 for i, t in enumerate(decimals) if t == "0"), default=0)
        if not fill:  # trailing zeros of 9s go
            tail = F.concat(F.substring(tail, 1, kept), F.rtrim(F.substring(tail, kept + 1, m), F.lit("0"))) if m else tail
        out += [lead, F.lit("."), F.when(overflow, "#" * m).otherwise(tail)]
        out += [_sign(t, negative, fill) for t in body[point + 1 :] if t not in ("9", "0")]
    text = F.concat(*out)
    if "PR" in body:
        around = F.when(negative, "$1<$2>").otherwise(" $1$2 " if fill else "$1$2")
        text = F.regexp_replace(text, F.lit("(?s)^( *)(.*)$"), around)
    return text if fill else F.trim(text)


def _places(run: list[str], k: int, digits: Column, first: Column, minus: Column | str, fill: bool) -> Column:
    """Adjoining places and separators from place ``k`` on; those before the first that is shown are blank."""
    parts, hidden, end = [], [0] * k, k
    for comma, group in itertools.groupby(enumerate(run), lambda p: p[1] in ",G"):
        at = [i for i, _ in group]
        if comma:
            parts.append(F.lit("," * len(at)))
        else:
            parts.append(F.substring(digits, end + 1, len(at)))
            hidden += at
            end += len(at)
    sign = F.lit(minus) if isinstance(minus, str) else F.when((first >= (k if k else -1)) & (first < end), minus).otherwise("")
    # signs of the run before the first place, by that place
    before = F.get(F.array(*map(F.lit, [0, *hidden, len(run)])), F.least(first, F.lit(end)) + 1)
    full = F.concat(*parts)
    return _once(before, lambda b: F.concat(F.repeat(F.lit(" "), b) if fill else F.lit(""), sign, F.substring(full, b + 1, F.lit(len(run)))))


def _sign(t: str, negative: Column, fill: bool) -> Column:
    if t in ("S", "SG"):
        return F.when(negative, "-").otherwise("+")
    if t == "MI":
        return F.when(negative, "-").otherwise(" " if fill else "")
    if t == "PL":
        return F.when(negative, " " if fill else "").otherwise("+")
    return F.lit("" if t == "PR" else t.strip('"'))


def to_char_interval(i: Column, template: str) -> Column:
    """to_char(interval, template) with YYYY MM DD HH24 HH12 MI SS MS US; parts keep their sign."""
    micros = F.abs(i["micros"])
    sign = F.when(i["micros"] < 0, -1).otherwise(1)
    hours = F.expr("1") * F.floor(micros / 3_600_000_000) * sign
    parts = {
        "YYYY": (F.floor(F.abs(i["months"]) / 12) * F.signum(i["months"].cast("double")), 4), "MM": (i["months"] % 12, 2), "DD": (i["days"], 2), "HH24": (hours, 2), "HH12": ((hours + 11) % 12 + 1, 2),
        "MI": (F.floor(micros / 60_000_000) % 60 * sign, 2), "SS": (F.floor(micros / 1_000_000) % 60 * sign, 2), "MS": (F.floor(micros / 1000) % 1000, 3), "US": (micros % 1_000_000, 6),
    }

    def padded(v: Column, n: int) -> Column:
        whole = v.cast("long")
        digits = F.abs(whole).cast("string")
        return F.concat(F.when(whole < 0, "-").otherwise(""), F.when(F.length(digits) < n, F.lpad(digits, n, "0")).otherwise(digits))

    out = [padded(*parts[t]) if t in parts else F.lit(t) for t in re.findall(r"YYYY|HH24|HH12|MM|DD|MI|SS|MS|US|.", template)]
    return F.concat(*out)


#: Fields of date templates: most digits of each (fixed values).
FIELDS = {"YYYY": 4, "YYY": 3, "YY": 2, "HH24": 2, "HH12": 2, "HH": 2, "MI": 2, "SS": 2, "MS": 3, "US": 6, "MM": 2, "DDD": 3, "DD": 2}


def _fields(text: Column, template: str) -> dict[str, Column]:
    """The fields that a template finds in a text; fails if the text doesn't follow it."""
    tokens = re.findall(r"YYYY|YYY|YY|HH24|HH12|HH|MI|SS|MS|US|MONTH|Month|month|MON|Mon|mon|MM|DDD|DD|AM|PM|am|pm|\"[^\"]*\"|FM|.", template)
    pattern, names = r"^\s*", []
    for k, t in enumerate(tokens):
        following = tokens[k + 1] if k + 1 < len(tokens) else ""
        if t in FIELDS:
            # digits end at a sign or, if another number follows at once, after as many as the field has
            pattern += rf"(\d{{{FIELDS[t]}}})" if following in FIELDS else rf"(\d{{1,{9 if t == 'YYYY' else FIELDS[t]}}})"
            names.append(t)
        elif t.upper() in ("MONTH", "MON", "AM", "PM"):
            pattern += r"([A-Za-z.]+)"
            names.append("MON" if t.upper() in ("MONTH", "MON") else "AM")
        elif t != "FM":
            sign = t.strip('"') if t.startswith('"') else t
            pattern += r"[^A-Za-z0-9]*" if not sign.isalnum() else re.escape(sign)
    found = F.regexp_extract(text, pattern, 0)
    error = F.raise_error(F.concat(F.lit("invalid value for the template: "), text)).cast("string")
    checked = F.when(text.isNotNull() & (found == "") & (text != ""), error)
    return {n: F.coalesce(checked, F.regexp_extract(text, pattern, i + 1)) for i, n in enumerate(names)}


def to_timestamp(text: Column, template: str) -> Column:
    """to_timestamp(text, template): YYYY YY MM Mon Month DD DDD HH24 HH12 MI SS MS US AM, any sign for any sign; null for null."""
    f = _fields(text, template)
    number = lambda name, default: f[name].cast("int") if name in f else F.lit(default)
    year = number("YYYY", 1)
    if "YY" in f:
        year = F.when(number("YY", 0) < 70, number("YY", 0) + 2000).otherwise(number("YY", 0) + 1900)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.substring(f["MON"], 1, 3))).cast("int") if "MON" in f else number("MM", 1)
    hour = number("HH24", 0)
    for h in ("HH12", "HH"):
        if h in f:
            hour = number(h, 0)
            if "AM" in f:
                hour = hour % 12 + F.when(F.upper(f["AM"]).startswith("P"), 12).otherwise(0)
    fraction = F.rpad(f["US"], 6, "0") if "US" in f else F.rpad(f["MS"], 6, "0") if "MS" in f else F.lit("0")
    seconds = number("SS", 0) + fraction.cast("int") / 1_000_000
    stamp = F.make_timestamp_ntz(year, month, number("DD", 1), hour, number("MI", 0), seconds.cast("decimal(16,6)"))
    if "DDD" in f:
        stamp = F.timestamp_add("DAY", number("DDD", 1) - 1, F.make_timestamp_ntz(year, F.lit(1), F.lit(1), hour, number("MI", 0), seconds.cast("decimal(16,6)")))
    return F.when(text.isNotNull() & (text != ""), stamp)


def to_date(text: Column, template: str) -> Column:
    """to_date(text, template); see to_timestamp."""
    return to_timestamp(text, template).cast("date")
