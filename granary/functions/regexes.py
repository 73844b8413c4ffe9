"""Regular-expression functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def similar_to(s: Column, pattern: str, escape: str = "\\") -> Column:
    """SQL SIMILAR TO: the whole string matches; % and _ are wildcards, | * + ? {m,n} ( ) [ ] as in regular expressions."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif inside:
            inside = c != "]"
            out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
        else:
            out.append({"%": ".*", "_": ".", "(": "(?:", ".": r"\.", "^": r"\^", "$": r"\$"}.get(c, c))
        i += 1
    return s.rlike(f"(?s)^(?:{''.join(out)})$")


def _flagged(pattern: str, flags: str) -> str:
    inline = "".join(f for f in ("i", "s", "m", "x") if (f == "i" and "i" in flags) or (f == "m" and "n" in flags) or (f == "x" and "x" in flags))
    return f"(?{inline}){pattern}" if inline else pattern


def regexp_match(s: Column, pattern: str, flags: str = "") -> Column:
    """The groups of the first match as an array (the whole match if there are none); null without a match."""
    p = _flagged(pattern, flags)
    groups = re.compile(pattern).groups
    found = F.array(*[F.regexp_extract(s, p, g) for g in (range(1, groups + 1) if groups else [0])])
    return F.when(s.rlike(p), found)


def regexp_matches(s: Column, pattern: str) -> Column:
    """The whole matches, in order (flag g, for explode)."""
    return F.regexp_extract_all(s, F.lit(pattern), 0)


def regexp_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    r"""Replace the first match, or with flag g all; \1 .. \9 and \& stand for groups and the match."""
    java = re.sub(r"\\(\d)", lambda m: f"${int(m[1])}", replacement.replace("$", r"\$")).replace(r"\&", "$0")
    p = _flagged(pattern, flags)
    if "g" in flags:
        return F.regexp_replace(s, p, java)
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 2}", java)
    return F.regexp_replace(s, f"(?s)^(.*?)({p})", f"$1{shifted}".replace("$2", "$2"))


def regexp_split_to_array(s: Column, pattern: str) -> Column:
    return F.split(s, pattern)
