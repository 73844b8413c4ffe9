"""Document fingerprints: SpotSigs, chains of content words behind common words, compared by pruned Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, partitions_for, text_of

#: Common words of English, French, German and Spanish (fixed values): the anchors.
ANCHORS = """
a an and are as at be by for from had has have he her his in is it its not of on or she that the their they this to was
were which will with you
au aux avec ce ces cette dans de des du elle en est et il ils la le les leur lui mais ne nous ou où par pas pour qu que
qui sa se ses son sont sur un une vous
aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach
nicht noch nur oder sich sie sind so über und von vor war wie wird zu zum zur
al como con del el ella ellos era es esta este fue ha las lo los más me mi no nos o para pero por se si sin su sus te
una uno y ya
""".split()
#: Words behind an anchor among which its chain of two content words is looked for.
REACH = 8
#: What separates words: anything but letters, marks and digits of any script.
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
#: Words of more characters than this (unspaced scripts, long tokens) are taken apart into windows of WINDOW characters.
LONG, WINDOW = 24, 4


def once(value: Column, result: str, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed a single time, however often it is used; ``result`` is the outcome's type."""
    return F.aggregate(F.array(value), F.lit(None).cast(result), lambda _, v: use(v))


def words_of_spots(text: Column) -> Column:
    """Lower-cased words; overlapping windows stand for a word of more than LONG characters."""

    def apart(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.length(w) - WINDOW + 1), lambda i: F.substring(w, i, F.lit(WINDOW)))
        return F.when(F.length(w) > LONG, windows).otherwise(F.array(w))

    words = F.array_remove(F.split(F.lower(text), NOT_WORD), "")
    return once(words, "array<string>", lambda w: F.when(F.exists(w, lambda x: F.length(x) > LONG), F.flatten(F.transform(w, apart))).otherwise(w))


def spots(text: Column) -> Column:
    """The sorted set of a text's spot signatures (array<bigint>), by one rule for texts of any length.

    Every anchor makes a spot: its chain is the first two content words (those that are no anchors) among the REACH
    words behind it, one if there is only one, and no spot if there is none. A content word without an anchor among the
    REACH words before it is a spot of its own, with the next content word in reach, so texts in other languages and
    scripts have spots too. A text without a spot (no content word) has one: the hash of the text; the empty text has
    none. Signatures are 64-bit hashes of anchor and chain.
    """
    none = F.array().cast("array<bigint>")

    def chains(w: Column, c: Column) -> Column:
        def of(s: Column, k: Column) -> Column:
            place, behind = s["p"], F.get(c, k + 1)
            # the anchors that stand between the content word before and this one have this one as their first
            first = F.greatest(F.coalesce(F.get(c, k - 1)["p"], F.lit(-1)) + 1, place - REACH)
            chain = lambda a, anchor: F.xxhash64(anchor, s["x"], F.when(behind["p"] - a <= REACH, behind["x"]))
            # all of the REACH words before are content words, or all there are
            free = F.when(k >= REACH, place - F.get(c, k - REACH)["p"] == REACH).otherwise(place == k)
            run = F.transform(F.sequence(first, place - 1), lambda a: chain(a, F.get(w, a)))
            return F.when(first < place, run).when(free, F.array(chain(place, F.lit("")))).otherwise(none)

        return F.flatten(F.transform(c, of))

    def by_words(w: Column) -> Column:
        content = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("p"))), lambda s: ~s["x"].isin(ANCHORS))
        return once(content, "array<bigint>", lambda c: chains(w, c))

    found = once(words_of_spots(text), "array<bigint>", by_words)
    some = once(found, "array<bigint>", lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.xxhash64(text))))
    return F.when(text == "", none).otherwise(F.sort_array(F.array_distinct(some)))


def fingerprint(sets: Column) -> Column:
    """A set of spots as text: its length, then its members as 16 hexadecimal digits each."""
    members = F.array_join(F.transform(sets, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.concat_ws(":", F.size(sets).cast("string"), members)


def length_partition(sets: Column, at_least: float) -> Column:
    """The partition of a set by its length: sets whose likeness reaches ``at_least`` lie in one or in neighbours."""
    return F.floor(F.log(F.greatest(F.size(sets), F.lit(1)).cast("double")) / F.log(F.lit(1 / at_least)) + 1e-9).cast("int")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two sets. Two empty sets are alike (1), an empty one and another aren't (0).

    With ``at_least`` above 0 the comparison is pruned and anything below it is given as 0: sets whose length partitions
    aren't neighbours are never intersected, nor those with min(|A|, |B|) / max(|A|, |B|), the most that the similarity
    can be, below it. At 0 every pair gets its true value.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = once(F.size(F.array_intersect(a, b)), "double", lambda n: n / (F.size(a) + F.size(b) - n))
    pruned = F.when(large == 0, 1.0).when(small == 0, 0.0)
    if at_least > 0:
        apart = F.abs(length_partition(a, at_least) - length_partition(b, at_least)) > 1
        pruned = pruned.when(apart | (small < at_least * large), 0.0)
        exact = once(exact, "double", lambda x: F.when(x >= at_least, x).otherwise(0.0))
    return pruned.otherwise(exact)


def successors(ids: DataFrame, order: list[Column], carried: list[str]) -> DataFrame:
    """Each row with the row before it in the order as to_<column> (the first gets the last).

    Rows are range-partitioned and written with their partition; only each partition's last row meets in one task.
    """
    n = partitions_for(ids)
    dealt = materialize(ids.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "order")
    row = F.struct(*carried)
    inside = dealt.withColumn("_to", F.lag(row).over(Window.partitionBy("_p").orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*[_reverse(c) for c in ("doc", "h")]))
    lasts = dealt.withColumn("_last", rank).filter("_last = 1").select("_p", row.alias("_end"))
    over = Window.orderBy("_p")  # a row per partition
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = lasts.select("_p", F.coalesce(F.lag("_end").over(over), F.last("_end").over(whole)).alias("_before"))
    joined = inside.join(F.broadcast(ends), "_p").withColumn("_to", F.coalesce("_to", "_before"))
    return joined.select(*carried, *[F.col(f"_to.{c}").alias(f"to_{c}") for c in carried])


def _reverse(name: str) -> Column:
    """The reverse of the order by descending doc, then ascending h."""
    return F.col(name).asc_nulls_first() if name == "doc" else F.col(name).desc()


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms: the last third replaced by the next document's beginning.

    Returns id, n_chars, edited (the edited text), fingerprint, edited_fingerprint, near_edited, near_next and n_spots.
    The next document is that of the next smaller id, after the smallest the largest. Null texts are empty; a null id
    comes last; rows of one id stand in the order of their texts' hashes; rows equal in id and text count as one document
    in the order and each gets its result. Texts of any length are taken whole by one rule (see spots). An empty table
    gives an empty result; other columns don't matter.

    Texts are shuffled once, by id and hash; the next document's head (as long as the edit) and set follow them.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("_text"))
    known = rows.select("doc", "h", F.length("_text").alias("n")).groupBy("doc", "h", "n").agg(F.count(F.lit(1)).alias("c"))
    known = materialize(known, "ids")
    order = [F.col("doc").desc_nulls_last(), F.col("h").asc()]
    asked = successors(known.drop("c"), order, ["doc", "h", "n"])
    asked = asked.select(F.col("doc").alias("d"), F.col("h").alias("dh"), "to_doc", "to_h", "to_n")
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh"))
    given = rows.join(asked.hint("shuffle_hash"), same)
    if known.filter("c > 1").limit(1).count():
        given = given.dropDuplicates(["to_doc", "to_h"])
    head = F.substring("_text", F.lit(1), F.expr("cast(to_n div 3 as int)"))
    given = given.select("to_doc", "to_h", head.alias("_head"), spots(F.col("_text")).alias("_next"))
    met = rows.join(given.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("to_doc")) & (F.col("h") == F.col("to_h")))
    n = F.length("_text")
    edited = F.concat(F.substring("_text", F.lit(1), n - F.expr("cast(length(_text) div 3 as int)")), F.col("_head"))
    # a generated one-element array keeps the sets from being computed at each use
    marked = met.select("doc", n.cast("long").alias("n_chars"), edited.alias("edited"), "_text", "_next")
    marked = marked.withColumn("_s", F.explode(F.array(F.struct(spots(F.col("_text")).alias("a"), spots(F.col("edited")).alias("b")))))
    a, b = F.col("_s.a"), F.col("_s.b")
    return marked.select(
        F.col("doc").alias(id_col), "n_chars", "edited", fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, F.col("_next")).alias("near_next"), F.size(a).cast("long").alias("n_spots"))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Contract query over every row of documents."""
    found = compare_with_edits(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "n_spots")
