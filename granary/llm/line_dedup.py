"""Line dedup: two Bloom filters find suspected repeats; only those shuffle for exact confirmation."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, materialize, of_row, packed, shared_dir, unpacked

#: Bits of a filter per line, and bounds of a filter's size in bits. A filter of 2**30 bits (128 MB) is the largest that
#: is sent to workers (building takes two); more lines are dealt into ranges of their hashes, each with filters of its own.
BITS_PER_LINE, MIN_BITS, MAX_BITS = 12, 1 << 20, 1 << 30
PROBES = 3
#: Bits of a chunk, the piece in which filters are merged, and of a stretch that is sent at a time.
CHUNK, SEGMENT = 1 << 16, 1 << 22

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, LOWER)


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers, one column per probe (double hashing over a power of two)."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def seen_once_and_twice(bits: int):
    """Builds both filters over a partition: yields (chunk, which, positions) with the chunk's bits that are set.

    ``which`` is 0 for keys seen once or more, 1 for keys seen twice or more here. Positions are 16-bit offsets, so a
    partition sends two bytes per set bit and never more than its own lines need.
    """

    def build(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

        def has(f, p):
            return ((f[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1)

        def put(f, p):
            p = p.ravel()
            np.bitwise_or.at(f, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))

        for batch in batches:
            lists = batch.column(0)
            hashes, counts = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            if not len(hashes):
                continue
            p = probes(hashes, bits)
            again = has(once, p) | (counts > 1)
            put(twice, p[again])
            put(once, p)
        part = SEGMENT // 8
        for which, f in enumerate((once, twice)):
            for start in range(0, len(f), part):  # a stretch at a time, so that positions stay few
                numbers = np.flatnonzero(np.unpackbits(f[start : start + part], bitorder="little"))
                if not len(numbers):
                    continue
                chunk = numbers // CHUNK
                edges = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk[edges] + start * 8 // CHUNK, pa.int32()),
                        pa.array(np.full(len(edges), which), pa.int32()),
                        pa.array([(numbers[a:b] % CHUNK).astype("<u2").tobytes() for a, b in zip(edges, np.r_[edges[1:], len(numbers)])], pa.binary()),
                    ],
                    names=["chunk", "which", "positions"],
                )

    return build


def merge_chunks(batches):
    """Unites the chunks of a partition: a bit is set in ``twice`` if a partition's twice-filter or two once-filters set it."""
    once, twice = {}, {}
    for batch in batches:
        for chunk, which, raw in zip(*(c.to_pylist() for c in batch.columns)):
            bits = np.zeros(CHUNK, bool)
            bits[np.frombuffer(raw, "<u2")] = True
            packed = np.packbits(bits, bitorder="little")
            if which:
                twice[chunk] = twice.get(chunk, 0) | packed
            else:
                if chunk in once:
                    twice[chunk] = twice.get(chunk, 0) | (once[chunk] & packed)
                once[chunk] = once.get(chunk, 0) | packed
    found = sorted(c for c in twice if np.any(twice[c]))
    for i in range(0, len(found), 128):
        part = found[i : i + 128]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array([np.asarray(twice[c]).tobytes() for c in part], pa.binary())], names=["chunk", "bitmap"]
        )


def twice_filter(hashes: DataFrame, n_lines: int) -> np.ndarray:
    """The merged twice-seen filter, as bytes; its size is bounded by MAX_BITS."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << int(n_lines * BITS_PER_LINE - 1).bit_length() if n_lines else 0))
    pieces = hashes.mapInArrow(seen_once_and_twice(bits), "chunk int, which int, positions binary")
    n = max(1, min(bits // CHUNK // 8, int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    merged = pieces.repartition(n, "chunk").mapInArrow(merge_chunks, "chunk int, bitmap binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row.chunk * CHUNK // 8 : (row.chunk + 1) * CHUNK // 8] = np.frombuffer(bytes(row.bitmap), np.uint8)
    return out


def repeated_keys(rows: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keep): keys in at least ``min_docs`` documents, and the largest id that holds each.

    ``rows`` has _id and _keys, an array of (h1, h2) of the row's distinct keys.
    """
    n_lines = rows.agg(F.coalesce(F.sum(F.size("_keys")), F.lit(0)).alias("n")).first()["n"]
    n_ranges = -(-n_lines * BITS_PER_LINE // MAX_BITS)
    if n_ranges <= 1:
        return repeated_in(rows, n_lines, min_docs)
    # each range is a folder, so that a round reads its own lines only; filters stay full of true hits at any size
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/line-ranges-{uuid.uuid4().hex}"
    keyed = rows.select("_id", F.explode("_keys").alias("k"))
    number = F.pmod(F.shiftrightunsigned(F.col("k.h1"), 40), F.lit(n_ranges)).cast("int")
    keyed.select("_id", F.array("k").alias("_keys"), number.alias("_range")).write.partitionBy("_range").parquet(f"{path}/lines")
    for r in range(n_ranges):
        part = spark.read.schema(rows.schema).parquet(f"{path}/lines/_range={r}")
        repeated_in(part, part.count(), min_docs).write.parquet(f"{path}/repeats/round={r}")
    return spark.read.schema("h1 long, h2 long, keep long").parquet(f"{path}/repeats/round=*")


def repeated_in(rows: DataFrame, n_lines: int, min_docs: int) -> DataFrame:
    """The same for rows of so many lines, by one pair of filters."""
    spark = rows.sparkSession
    firsts = rows.select(F.transform("_keys", lambda k: k["h1"]).alias("hashes"))
    shared = spark.sparkContext.broadcast(twice_filter(firsts, n_lines))

    def suspects(batches):
        bitmap = shared.value
        bits = len(bitmap) * 8
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            keys = lists.flatten()
            h1 = keys.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
            p = probes(h1, bits)
            hit = np.flatnonzero(((bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1)) if len(h1) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner[hit])), pa.array(h1[hit]), keys.field(1).take(pa.array(hit))], names=["_id", "h1", "h2"])

    suspected = rows.select("_id", "_keys").mapInArrow(suspects, "_id long, h1 long, h2 long")
    distinct = suspected.distinct()  # an id may come in several rows
    return distinct.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("keep")).filter(F.col("_docs") >= min_docs).drop("_docs")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop repeated lines: adds n_lines, n_dropped and replaces ``text`` by the lines that stay, joined by \\n.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses all its lines but those
    in the largest id that holds it. Documents are told apart by id: rows of one id (or of none: null ids count as one
    document that is smaller than all others) are one document. A null or empty text is one empty line. Equal rows each
    get their own result, an empty table gives an empty one. Columns n_lines and n_dropped are replaced, others kept.
    """
    df = df.drop("n_lines", "n_dropped")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    keys = F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_chars)
    rows = df.select(
        F.col(id_col).cast("long").alias("_id"),
        F.transform(F.array_distinct(keys), lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(0x5DEECE66D), k).alias("h2"))).alias("_keys"),
    ).filter(F.size("_keys") > 0)
    rows = materialize(rows, "line-keys")
    repeated = materialize(repeated_keys(rows, min_docs), "line-repeats")
    held = rows.select("_id", F.explode("_keys").alias("k")).select("_id", F.col("k.h1").alias("a"), F.col("k.h2").alias("b"))
    lost = (
        held.join(repeated, (F.col("a") == F.col("h1")) & (F.col("b") == F.col("h2")))
        .filter(~F.col("_id").eqNullSafe(F.col("keep"))).groupBy("_id").agg(F.collect_set("a").alias("_lost"))
    )
    joined = packed(df).join(lost, of_row(id_col).cast("long").eqNullSafe(F.col("_id")), "left")
    split = F.split(F.coalesce(of_row(text), F.lit("")), "\n")
    stays = F.when(F.col("_lost").isNull(), split).otherwise(
        F.filter(split, lambda x: (F.length(x) < min_chars) | (F.length(line_key(x)) < min_chars) | ~F.array_contains(F.col("_lost"), F.xxhash64(line_key(x))))
    )
    out = joined.select("_row", F.size(split).cast("long").alias("_n"), stays.alias("_stays"))
    return unpacked(out, F.col("_n").alias("n_lines"), (F.col("_n") - F.size("_stays")).alias("n_dropped"), instead={text: F.array_join("_stays", "\n")})


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over every row of documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
r AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id <> keep AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""
