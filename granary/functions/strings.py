"""String functions where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*values: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat(*[F.coalesce(v.cast("string"), F.lit("")) for v in values])


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """substring(s from start for length): a window over 1-based places that may begin before the string."""
    if length is None:
        return F.substring(s, F.greatest(start, F.lit(1)), F.length(s))
    end = start + length  # exclusive
    first = F.greatest(start, F.lit(1))
    checked = F.when(length < 0, F.raise_error(F.lit("negative substring length not allowed")).cast("string"))
    return checked.otherwise(F.substring(s, first, F.greatest(end - first, F.lit(0))))


def left(s: Column, n: Column) -> Column:
    """The first n characters; with a negative n all but the last -n."""
    return F.substring(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0))))


def right(s: Column, n: Column) -> Column:
    """The last n characters; with a negative n all but the first -n."""
    size = F.when(n >= 0, F.least(n, F.length(s))).otherwise(F.greatest(F.length(s) + n, F.lit(0)))
    return F.substring(s, F.length(s) - size + 1, size)


def initcap(s: Column) -> Column:
    """First letter of each word in upper case, the rest lower; words are runs of letters and digits."""
    parts = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def position(sub: Column, s: Column) -> Column:
    """1-based place of the first occurrence, 0 if there is none."""
    return F.when(sub == "", 1).otherwise(F.locate_column(sub, s) if hasattr(F, "locate_column") else F.position(sub, s))


def quote_ident(s: Column) -> Column:
    """An SQL identifier: in double quotes unless it is lower-case letters, digits and underscores."""
    return F.when(s.rlike("^[a-z_][a-z0-9_]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(s: Column) -> Column:
    """An SQL literal: quotes doubled, backslashes doubled with a leading E."""
    quoted = F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(F.contains(s, F.lit("\\")), F.concat(F.lit(" E"), quoted)).otherwise(quoted)


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def format_text(pattern: str, *values: Column) -> Column:
    """format(): %s, %I (identifier) and %L (literal), with 'n$' positions and '-' and width; %% is a percent sign."""
    import re

    out, at, used = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?(-)?(\d+)?([sIL%])", pattern):
        out.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if m[4] == "%":
            out.append(F.lit("%"))
            continue
        index = int(m[1]) - 1 if m[1] else used
        used = index + 1
        value = values[index].cast("string")
        piece = {"s": F.coalesce(value, F.lit("")), "I": quote_ident(value), "L": quote_nullable(value)}[m[4]]
        if m[3]:
            pad = F.repeat(F.lit(" "), F.greatest(F.lit(int(m[3])) - F.length(piece), F.lit(0)))
            piece = F.concat(piece, pad) if m[2] else F.concat(pad, piece)
        out.append(piece)
    return F.concat(*out, F.lit(pattern[at:]))


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def encode_escape(b: Column) -> Column:
    """bytea escape format: zero and high bytes as three octal digits behind a backslash, backslashes doubled."""
    pairs = F.regexp_extract_all(F.hex(b), F.lit("(..)"), 1)

    def one(h: Column) -> Column:
        n = F.conv(h, 16, 10).cast("int")
        octal = F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0"))
        return F.when((n == 0) | (n > 127), octal).when(n == 92, F.lit("\\\\")).otherwise(F.decode(F.unhex(h), "UTF-8"))

    return F.array_join(F.transform(pairs, one), "")


def substring_pattern(s: Column, pattern: str) -> Column:
    """substring(s from pattern): the first group of the first match, the whole match without groups, null without a match."""
    import re

    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1 if re.compile(pattern).groups else 0))


def parse_ident(s: Column) -> Column:
    """A qualified name as an array of identifiers: quoted parts as they are, others lower-cased; a bad name fails."""
    part = r'"(?:[^"]|"")+"|[\\p{L}_][\\p{L}\\p{N}_$]*'.replace("\\\\", "\\")
    whole = rf"^\s*({part})\s*(\.\s*({part})\s*)*$"
    found = F.regexp_extract_all(s, F.lit(f"({part})"), 1)
    plain = lambda p: F.when(F.startswith(p, F.lit('"')), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(F.lower(p))
    error = F.raise_error(F.concat(F.lit("string is not a valid identifier: "), s)).cast("array<string>")
    return F.when(s.isNull(), F.lit(None)).when(s.rlike(whole), F.transform(found, plain)).otherwise(error)


def to_ascii(s: Column) -> Column:
    """Letters with marks as their ASCII letters, other signs beyond ASCII as blanks."""
    from .similarity import unaccent

    return F.regexp_replace(unaccent(s), r"[^\x00-\x7F]", " ")


def convert_to(s: Column, encoding: str) -> Column:
    return F.encode(s, encoding)


def convert_from(b: Column, encoding: str) -> Column:
    return F.decode(b, encoding)


def convert(b: Column, source: str, target: str) -> Column:
    return F.encode(F.decode(b, source), target)


def get_byte(b: Column, n: Column) -> Column:
    """Byte n (from 0) as a number; outside fails."""
    bad = F.raise_error(F.lit("index out of valid range")).cast("int")
    value = F.conv(F.hex(F.substring(b, n + 1, F.lit(1))), 16, 10).cast("int")
    return F.when((n < 0) | (n >= F.octet_length(b)), bad).otherwise(value)


def set_byte(b: Column, n: Column, value: Column) -> Column:
    """The bytes with byte n (from 0) replaced by the low eight bits of a value."""
    one = F.unhex(F.lpad(F.hex(value.bitwiseAND(255)), 2, "0"))
    bad = F.raise_error(F.lit("index out of valid range")).cast("binary")
    changed = F.concat(F.substring(b, F.lit(1), n), one, F.substring(b, n + 2, F.octet_length(b)))
    return F.when((n < 0) | (n >= F.octet_length(b)), bad).otherwise(changed)


def get_bit(b: Column, n: Column) -> Column:
    """Bit n: bits of a byte are counted from its lowest."""
    return F.shiftright(get_byte(b, F.floor(n / 8).cast("int")), 0).bitwiseAND(F.pow(F.lit(2), n % 8).cast("int")).cast("boolean").cast("int")


def set_bit(b: Column, n: Column, value: Column) -> Column:
    at, mask = F.floor(n / 8).cast("int"), F.pow(F.lit(2), n % 8).cast("int")
    old = get_byte(b, at)
    return set_byte(b, at, F.when(value == 1, old.bitwiseOR(mask)).otherwise(old.bitwiseAND(F.lit(255) - mask)))


def encode(b: Column, kind: str) -> Column:
    """encode(bytes, hex | base64 | escape)."""
    return {"hex": lambda: F.lower(F.hex(b)), "base64": lambda: F.base64(b), "escape": lambda: encode_escape(b)}[kind]()


def decode(s: Column, kind: str) -> Column:
    return {"hex": lambda: F.unhex(s), "base64": lambda: F.unbase64(s)}[kind]()
