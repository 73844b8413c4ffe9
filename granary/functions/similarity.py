"""Trigrams, edit distance and sounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(s: Column) -> Column:
    """show_trgm: the set of three-character windows of the lower-case words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def windows(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, windows))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams (0 if there are none)."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def levenshtein_less_equal(a: Column, b: Column, most: int) -> Column:
    """The distance if it is at most ``most``, else a number above it."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def difference(a: Column, b: Column) -> Column:
    """Equal places of the two soundex codes, 0 to 4."""
    x, y = F.soundex(a), F.soundex(b)
    places = [F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 1).otherwise(0) for i in (1, 2, 3, 4)]
    return places[0] + places[1] + places[2] + places[3]


def unaccent(s: Column) -> Column:
    """Without diacritics (Latin letters; fixed values)."""
    return F.translate(s, "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÇçÑñÝýÿ", "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOOooooooUUUUuuuuCcNnYyy")


def earth_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 3958.747716) -> Column:
    """Great-circle distance in statute miles (haversine)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def word_similarity(a: Column, b: Column) -> Column:
    """The greatest share of a's trigrams that a run of b's words has in common with it: over all single words and pairs of b."""
    words = F.filter(F.split(F.lower(b), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = F.concat(words, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))
    x = trigrams(a)
    return F.when((F.size(x) == 0) | (F.size(words) == 0), 0.0).otherwise(F.array_max(F.transform(runs, lambda r: F.size(F.array_intersect(x, trigrams(r))) / F.size(x))))


def similar_pairs(left, right, a: str, b: str, threshold: float = 0.3):
    """left a % right b: pairs of rows with a similarity of ``threshold`` or more, joined on shared trigrams.

    Only the trigrams that come first in the order of their hashes are joined, as many as a pair above the threshold must
    share one of, so common trigrams don't make all pairs. Adds ``similarity``.
    """
    def keyed(df, column, name):
        grams = F.array_sort(F.transform(trigrams(F.col(column)), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
        prefix = F.slice(grams, F.lit(1), F.size(grams) - F.ceil(F.size(grams) * threshold).cast("int") + 1)
        return df.withColumn(f"_{name}", F.monotonically_increasing_id()).withColumn("_g", F.explode(F.transform(prefix, lambda x: x["g"])))

    met = keyed(left, a, "l").join(keyed(right, b, "r"), "_g").dropDuplicates(["_l", "_r"]).drop("_g", "_l", "_r")
    return met.withColumn("similarity", similarity(F.col(a), F.col(b))).filter(F.col("similarity") >= threshold)
