"""Quality rules: base word rules, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, materialize, of_row, packed, text_of, unpacked, words_of

#: A line is boilerplate on its host if more than this many of the host's documents hold it, however large the host is.
LINE_DOCS = 5
#: A document is depleted if more than this share of its words lies in such lines.
LOST_SHARE = 0.25
SYMBOLS = "[#*$%&|<>]"


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are hashed; only texts in which the hashes aren't all different sort them with their places, and a window
    equal to its neighbour in that order marks its three places.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)),
    )

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(
            F.array(pairs), F.array().cast("array<int>"),
            lambda _, s: F.transform(
                F.filter(
                    s,
                    lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
                ),
                lambda x: x["i"],
            ),
        )

    def covered(hashes: Column) -> Column:
        return F.aggregate(
            F.array(places(hashes)), F.lit(0),
            lambda _, p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))),
        )

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    return F.when(n < 4, 0).otherwise(F.aggregate(F.array(windows), F.lit(0), lambda _, h: count(h)))


def line_text(line: Column) -> Column:
    """The line as it is compared: without white space at both ends, lower-cased."""
    return F.lower(F.trim(line, F.lit(SPACES)))


def line_stats(df: DataFrame, text: str, host: str, id_col: str) -> DataFrame:
    """Base figures of every row, and per line of it that has a word its hash (of 64 and 32 bits) and number of words."""
    t = text_of(text)
    cut = df.select(
        F.col(id_col).alias("_id"), F.col(host).alias("_host"), t.alias("_text"), F.xxhash64(t).alias("_text_hash"), words_of(t).alias("_words"),
        F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("_lines"))

    def entry(x: Column) -> Column:
        return F.struct(F.xxhash64(line_text(x)).alias("h"), F.hash(line_text(x)).alias("g"), F.size(words_of(x)).alias("w"))

    return cut.select(
        "_id", "_host", "_text_hash",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.transform("_lines", entry).alias("_hashes"),
    )


def verdicts(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", *,
    min_words: int = 50, max_repeat_percent: int = 50, line_docs: int = LINE_DOCS, lost_share: float = LOST_SHARE,
) -> DataFrame:
    """One row per row of ``df``: id, figures, base_failed, kept, n_removed_words, host, text_hash and removed_lines.

    Base rule: fewer than ``min_words`` words, or over ``max_repeat_percent`` % of them in repeated windows of three.
    Method: lines are trimmed, lower-cased and hashed, and the distinct documents (ids) of each host that hold a line are
    counted, in whatever rows; a line that more than ``line_docs`` of them hold is boilerplate there and is removed; a
    document that loses more than ``lost_share`` of its words so is depleted and rejected. The limit is a number, so a
    line is judged alike on small and large hosts. removed_lines holds the 64-bit hashes of the row's boilerplate lines,
    null where it has none.

    A null text is empty (fails the base rule); a null host is a host of its own; null ids are one document; equal rows
    and equal ids each get their own row; an empty table gives an empty result. Other columns don't matter.
    """
    rated = materialize(line_stats(df, text, host, id_col).withColumn("_row", F.monotonically_increasing_id()), "quality-lines")
    lines = rated.select("_row", "_host", "_id", F.explode("_hashes").alias("_l")).select("_row", "_host", "_id", "_l.h", "_l.g", "_l.w")
    # a row per host, line and document first, so that no line's documents meet in one task
    held = lines.select("_host", "h", "g", "_id").distinct().groupBy("_host", "h", "g").agg(F.count(F.lit(1)).alias("_docs"))
    flagged = held.filter(F.col("_docs") > line_docs).select(F.col("_host").alias("_fh"), F.col("h").alias("_f"), F.col("g").alias("_g"))
    same = (lines["h"] == flagged["_f"]) & (lines["g"] == flagged["_g"]) & lines["_host"].eqNullSafe(flagged["_fh"])
    removed = lines.join(flagged, same).groupBy("_row").agg(F.sum("w").alias("_removed"), F.collect_set("h").alias("_removed_lines"))
    out = rated.join(removed, "_row", "left")
    gone = F.coalesce(F.col("_removed"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (gone <= lost_share * F.col("n_words"))).alias("kept"),
        gone.alias("n_removed_words"), F.col("_host").alias("host"), F.col("_text_hash").alias("text_hash"), F.col("_removed_lines").alias("removed_lines"),
    )


def keep_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of ``df`` that the rules (see verdicts) keep, with all their columns, without their boilerplate lines.

    Texts without such lines stay as they are, null texts too; a column n_chars isn't touched.
    """
    found = verdicts(df, id_col, text, host, **limits).filter("NOT kept OR removed_lines IS NOT NULL")
    found = found.select(
        F.col(id_col).alias("_found_id"), F.col("host").alias("_found_host"), F.col("text_hash").alias("_found_hash"), F.col("kept").alias("_kept"), F.col("removed_lines").alias("_lost"),
    ).dropDuplicates(["_found_id", "_found_host", "_found_hash"])
    same = of_row(id_col).eqNullSafe(F.col("_found_id")) & of_row(host).eqNullSafe(F.col("_found_host")) & (F.xxhash64(F.coalesce(of_row(text), F.lit(""))) == F.col("_found_hash"))
    rows = packed(df).join(found.hint("shuffle_hash"), same, "left").filter(F.coalesce("_kept", F.lit(True)))
    stay = F.filter(F.split(of_row(text), "\n"), lambda x: (F.trim(x, F.lit(SPACES)) == "") | ~F.array_contains("_lost", F.xxhash64(line_text(x))))
    return unpacked(rows, instead={text: F.when(F.col("_lost").isNull(), of_row(text)).otherwise(F.array_join(stay, "\n"))})


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query over every row of documents; hosts are the values of ``source``."""
    return verdicts(documents(spark, sf_dir)).drop("host", "text_hash", "removed_lines")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, host, lower(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) AS h,
  len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT doc_id, host, unnest(ls) AS x FROM w)),
flagged AS (SELECT host, h FROM l GROUP BY host, h HAVING count(DISTINCT doc_id) > 5),
gone AS (SELECT doc_id, sum(n)::BIGINT AS n FROM l JOIN flagged f ON l.h = f.h AND l.host IS NOT DISTINCT FROM f.host GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_removed_words <= 0.25 * n_words AS kept, n_removed_words FROM b
"""
