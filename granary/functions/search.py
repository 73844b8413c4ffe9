"""Full-text search: lexemes with places, queries with phrases, rank and headline."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words (fixed values).
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def stem(word: Column) -> Column:
    """A light English stemmer: plural, -ing, -ed and -ly endings."""
    w = F.regexp_replace(word, "(?<=..)(sses)$", "ss")
    w = F.regexp_replace(w, "(?<=..)ies$", "i")
    w = F.regexp_replace(w, "(?<=[^s].)(?<![su])s$", "")
    w = F.regexp_replace(w, "(?<=...)(ing|ed|ly)$", "")
    return F.regexp_replace(w, "(?<=..)([^aeioulsz])\\1$", "$1")


def to_tsvector(text: Column) -> Column:
    """Lexemes with their 1-based word places, stop words left out (they count as places)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("p")))
    return F.transform(F.filter(placed, lambda x: ~x["w"].isin(STOP)), lambda x: F.struct(stem(x["w"]).alias("lexeme"), x["p"].alias("place")))


def _has(vector: Column, word: str) -> Column:
    return F.size(_places(vector, word)) > 0


def _places(vector: Column, word: str) -> Column:
    found = F.filter(vector, lambda x: x["lexeme"] == stem(F.lit(word.lower())))
    return F.transform(found, lambda x: x["place"])


def _phrase(vector: Column, words: list[str], gap: int = 1) -> Column:
    """The words in a row, each ``gap`` places behind the one before."""
    ends = _places(vector, words[0])
    for w in words[1:]:
        ends = F.array_intersect(F.transform(ends, lambda p: p + gap), _places(vector, w))
    return F.size(ends) > 0


def matches(vector: Column, query: str) -> Column:
    """vector @@ query: words with & | ! <-> <n> and parentheses."""
    tokens = re.findall(r"<-?>|<\d+>|<->|[&|!()]|[^\s&|!()<>]+", query)

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
        words, gap = [tokens[i]], 1
        while i + 2 < len(tokens) + 1 and i + 1 < len(tokens) and tokens[i + 1].startswith("<"):
            gap = 1 if tokens[i + 1] == "<->" else int(tokens[i + 1][1:-1])
            words.append(tokens[i + 2])
            i += 2
        return (_has(vector, words[0]) if len(words) == 1 else _phrase(vector, words, gap)), i + 1

    return or_level(0)[0]


def rank(vector: Column, words: list[str]) -> Column:
    """Sum over the words of 0.1 * (1 + 1/4 + 1/9 + ...) for their occurrences, over the sum of the series."""
    parts = []
    for w in words:
        n = F.size(_places(vector, w))
        parts.append(F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, k: a + 0.1 / (k * k))).otherwise(0.0))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / (1.64493406685 * len(words))


def headline(text: Column, words: list[str], start: str = "<b>", stop: str = "</b>") -> Column:
    """The text with the words marked."""
    pattern = "(?i)\\b(" + "|".join(re.escape(w) for w in words) + ")\\b"
    return F.regexp_replace(text, pattern, f"{start}$1{stop}")


# queries as texts


def query_and(a: str, b: str) -> str:
    return f"( {a} ) & ( {b} )"


def query_or(a: str, b: str) -> str:
    return f"( {a} ) | ( {b} )"


def query_not(a: str) -> str:
    return f"!( {a} )"


def plain_query(text: str) -> str:
    """plainto_tsquery: all words but stop words, in any order."""
    return " & ".join(w for w in re.findall(r"\w+", text.lower()) if w not in STOP)


def phrase_query(text: str) -> str:
    """phraseto_tsquery: the words in a row; stop words widen the gap."""
    out, gap = "", 1
    for w in re.findall(r"\w+", text.lower()):
        if w in STOP:
            gap += bool(out)
        else:
            out += (f" <{gap}> " if gap > 1 else " <-> ") * bool(out) + w
            gap = 1
    return out


def numnode(query: str) -> int:
    """Words and operators of a query."""
    return len(re.findall(r"<-?>|<\d+>|[&|!]|[^\s&|!()<>]+", query))


def rank_cd(vector: Column, words: list[str]) -> Column:
    """Cover density of two or more words: the sum over the shortest stretches that hold all of 0.1 per word over their length.

    A stretch ends at each occurrence of a word and begins at the latest place from which all are in it.
    """
    lists = [_places(vector, w) for w in words]
    every = F.array_sort(F.array_distinct(F.concat(*lists)))

    def begin(end: Column) -> Column:
        latest = [F.array_max(F.filter(p, lambda x: x <= end)) for p in lists]
        known = latest[0].isNotNull()
        for x in latest[1:]:
            known = known & x.isNotNull()
        return F.when(known, F.least(*latest) if len(latest) > 1 else latest[0])

    covers = F.filter(F.transform(every, lambda e: F.struct(begin(e).alias("a"), e.alias("b"))), lambda c: c["a"].isNotNull())
    # of stretches with one beginning the first is the shortest
    least = F.filter(covers, lambda c, i: (i == 0) | (F.get(covers, i - 1)["a"] != c["a"]))
    return F.aggregate(least, F.lit(0.0), lambda s, c: s + F.lit(0.1) * len(words) / (c["b"] - c["a"] + 1))


# lexemes and weights


def strip(vector: Column) -> Column:
    """tsvector_to_array(strip(vector)): the lexemes, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(vector, lambda x: x["lexeme"])))


def delete(vector: Column, lexemes: list[str]) -> Column:
    """ts_delete: without some lexemes."""
    return F.filter(vector, lambda x: ~x["lexeme"].isin(lexemes))


def set_weight(vector: Column, weight: str, lexemes: list[str] | None = None) -> Column:
    """setweight: every place (of some lexemes) gets a weight A to D; D is the weight of places without one."""
    chosen = (lambda x: F.lit(True)) if lexemes is None else (lambda x: x["lexeme"].isin(lexemes))
    return F.transform(vector, lambda x: F.struct(x["lexeme"].alias("lexeme"), x["place"].alias("place"), F.when(chosen(x), weight).otherwise("D").alias("weight")))


def filter_weights(vector: Column, weights: list[str]) -> Column:
    """ts_filter of a vector with weights: the places that have one of them."""
    return F.filter(vector, lambda x: x["weight"].isin(weights))


# dictionaries


def int_dictionary(token: Column, max_digits: int = 6, reject_long: bool = False) -> Column:
    """dict_int: a longer number is cut to its first digits, or is a stop word (an empty array)."""
    kept = F.array(F.substring(token, 1, max_digits))
    return F.when(F.length(token) > max_digits, F.array().cast("array<string>")).otherwise(kept) if reject_long else kept


def synonym_dictionary(
    token: Column, rules: dict[str, list[str]], *, keep_original: bool = True, match_original: bool = True,
    keep_synonyms: bool = True, match_synonyms: bool = False,
) -> Column:
    """dict_xsyn: the lexemes for a word of the rules (and for its synonyms, if they match too); null for other words."""
    found: dict[str, list[str]] = {}
    for word, synonyms in rules.items():
        lexemes = [word] * keep_original + synonyms * keep_synonyms
        for name in [word] * match_original + synonyms * match_synonyms:
            found.setdefault(name.lower(), lexemes)
    if not found:
        return F.lit(None).cast("array<string>")
    pairs = [c for name, lexemes in found.items() for c in (F.lit(name), F.array(*map(F.lit, lexemes)).cast("array<string>"))]
    return F.try_element_at(F.create_map(*pairs), F.lower(token))
