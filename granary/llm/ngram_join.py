"""N-gram Jaccard join: MinHash bands propose, a Bayesian test on MinHash values prunes, exact sets verify."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, join_facts, materialize, of_row, packed, text_keys, unpacked
from .graphs import connected_components
from .pieces import slices

#: Words of a shingle; the similarity from which two texts are linked.
WORDS, THRESHOLD = 5, 0.8
#: MinHash values: BANDS bands of ROWS. At the threshold a pair shares no band with probability (1 - 0.8**4)**28 < 1e-6.
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
#: Values compared at a time; a pair is dropped once its posterior probability of reaching the threshold is below TOLERANCE.
STEP, TOLERANCE = 8, 1e-9
#: Texts of a block when a bucket or a component is split; a task holds two blocks.
BUCKET_BLOCK, TEXT_BLOCK = 2048, 512
#: Shingles of all texts of a component's block together, and of the texts that one text is compared with at a time.
SHINGLE_BLOCK, SHINGLES_AT_ONCE = 500_000, 500_000

_rng = np.random.default_rng(20240501)
_MULTIPLY = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles in order, and how many each text has (repeats counted).

    Words are runs of bytes other than [\\x20\\x09-\\x0D]. A text of one to four words has one shingle of all of them, a
    text without words has none.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    power, inverse = _powers(_BASE, len(raw)), _powers(_BASE_INVERSE, len(raw))
    total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)]
    word = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    bounds = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    first = np.searchsorted(start, bounds)  # of the words of each text
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n_words)
    value = np.zeros(len(word), np.uint64)
    for k in range(WORDS):  # of the words from here on, those of the same text
        value = value * np.uint64(0xD6E8FEB86659FD93)
        here = np.zeros(len(word), np.uint64)
        if k < len(word):
            same = owner[k:] == owner[: len(owner) - k]
            here[: len(word) - k][same] = word[k:][same]
        value = mix(value + here + np.uint64(k))
    place = np.arange(len(word)) - np.repeat(first[:-1], n_words)
    left = np.repeat(n_words, n_words) - place
    return value[(left >= WORDS) | (place == 0)], np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))


def shingle_sets(texts: list[bytes]) -> list[bytes]:
    """The distinct hashes of each text's shingles in ascending order, as bytes."""
    hashes, counts = shingles(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    ends = np.cumsum(np.bincount(owner[fresh], minlength=len(texts)))
    hashes = hashes[fresh]
    return [hashes[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]


def signatures(texts: list[bytes]) -> tuple[list[bytes | None], np.ndarray]:
    """HASHES MinHash values of 16 bits for each text, None without shingles; and its number of shingles."""
    hashes, counts = shingles(texts)
    some = np.flatnonzero(counts)
    out: list[bytes | None] = [None] * len(texts)
    if not len(some):
        return out, counts
    starts = (np.cumsum(counts) - counts)[some]
    table = np.empty((len(some), HASHES), np.uint16)
    for k in range(HASHES):
        least = np.minimum.reduceat((hashes ^ _XOR[k]) * _MULTIPLY[k], starts)
        table[:, k] = (least >> np.uint64(24)).astype(np.uint16)
    for i, row in zip(some.tolist(), table):
        out[i] = row.tobytes()
    return out, counts


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest matches at which P(similarity >= threshold | matches of n) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its tail is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(table: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Places in (a, b), rows of ``table``, of the pairs that no step of the test drops."""
    at, matches = np.arange(len(a)), np.zeros(len(a), np.int16)
    for k, m in enumerate(least):
        if not len(at):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (table[a[at], part] == table[b[at], part]).sum(axis=1, dtype=np.int16)
        stay = matches >= m
        at, matches = at[stay], matches[stay]
    return at


def link_components(table: np.ndarray, least: list[int]) -> np.ndarray:
    """For each row the least row that surviving pairs connect it to. Rows already reached aren't compared again."""
    n = len(table)
    root = np.arange(n)
    free = np.arange(n)
    while len(free) > 1:
        seed, free = free[0], free[1:]
        queue = [seed]
        while queue and len(free):
            row = queue.pop()
            near = survivors(table, np.full(len(free), row), free, least)
            if len(near):
                found = free[near]
                root[found] = seed
                queue.extend(found.tolist())
                free = np.delete(free, near)
    return root


def runs_of(batches, keys: list[str]):
    """Record batches cut where the sorted key columns change: yields one table per key, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0].item() for c in columns)
        change[0] = first != last
        cuts = np.flatnonzero(change)
        if held and (not len(cuts) or cuts[0] > 0):
            held.append(batch.slice(0, cuts[0] if len(cuts) else batch.num_rows))
        if len(cuts):
            if held:
                yield pa.Table.from_batches(held)
            for x, y in zip(cuts[:-1], cuts[1:]):
                yield pa.Table.from_batches([batch.slice(x, y - x)])
            held = [batch.slice(cuts[-1])]
        last = tuple(c[-1].item() for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def signature_table(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def sign(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(_id, h1, h2, sig, n_shingles) of every row."""
    h1, h2 = text_keys(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), h1.alias("h1"), h2.alias("h2"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(3)
            for a, b in slices(pa.compute.binary_length(texts).to_pylist(), 2_000_000):
                part = batch.slice(a, b - a)
                made, counts = signatures(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(part.columns[:3] + [pa.array(made, pa.binary()), pa.array(counts, pa.int64())], names=["_id", "h1", "h2", "sig", "n_shingles"])

    return rows.mapInArrow(run, "_id long, h1 long, h2 long, sig binary, n_shingles long")


def bands(classes: DataFrame) -> DataFrame:
    """(key, node): BANDS rows for each text that has shingles."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                table = signature_table(batch.column(1))
                keys = mix(table.view(np.uint64) ^ salt).view(np.int64)  # four 16-bit values are one key
                nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], names=["key", "node"])

    return classes.filter("sig IS NOT NULL").select("node", "sig").mapInArrow(run, "key long, node long")


def in_blocks(df: DataFrame, blocks: Column, by: str, own: bool) -> DataFrame:
    """Split what shares a key into its number of ``blocks``: adds i, j (the blocks of a task) and side (the row's own block).

    A key of one block has the one task (0, 0); others have a task for each two blocks i < j, and for each block by
    itself (i, i) if ``own``.
    """
    cut = df.withColumn("_n", blocks.cast("int")).withColumn("side", F.pmod(F.xxhash64(by), F.col("_n").cast("long")).cast("int"))
    other = F.sequence(F.lit(0), F.col("_n") - 1)
    if not own:
        other = F.when(F.col("_n") == 1, F.array(F.lit(0))).otherwise(F.filter(other, lambda x: x != F.col("side")))
    spread = cut.withColumn("_other", F.explode(other))
    return spread.withColumns({"i": F.least("side", "_other"), "j": F.greatest("side", "_other")}).drop("_n", "_other")


def candidate_components(classes: DataFrame) -> DataFrame:
    """(node, root): texts that pairs surviving the Bayesian test connect."""
    spark = classes.sparkSession
    keyed = bands(classes)
    # a bucket per set of texts: buckets of other bands with just the same texts add nothing
    buckets = (
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lo"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.sum(F.xxhash64(F.lit(7), "node").cast("decimal(38,0)")).alias("s2"))
        .filter("size > 1").groupBy("size", "lo", "s1", "s2").agg(F.min("key").alias("key")).select("key", "size", F.col("size").alias("_rows"))
    )
    found = join_facts(keyed, buckets, ["key"], "_rows", classes.filter("sig IS NOT NULL").count() * BANDS, by=["node"])
    members = in_blocks(found, F.ceil(F.col("size") / BUCKET_BLOCK), "node", own=False).select("key", "i", "j", "node")
    signed = members.join(classes.select("node", "sig"), "node")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = signed.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node").select("key", "i", "j", "node", "sig")
    least = least_matches()

    def run(batches):
        out_a, out_b = [], []
        for group in runs_of(batches, ["key", "i", "j"]):
            nodes = group.column("node").to_numpy()
            if len(nodes) > 1:
                root = link_components(signature_table(group.column("sig")), least)
                linked = np.flatnonzero(root != np.arange(len(root)))
                out_a.append(nodes[linked])
                out_b.append(nodes[root[linked]])
            if len(out_a) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return connected_components(dealt.mapInArrow(run, "a long, b long"))


def count_links(table: np.ndarray, values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None, least: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row, and the least row that links connect it to, among pairs of rows ``left`` x ``right`` (None: within left).

    ``values`` are the rows' shingle sets one after another, of ``sizes`` hashes each.
    """
    n = len(table)
    ids = np.unique(values, return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(len(values) + 1, np.int32)
    links, root = np.zeros(n, np.int64), np.arange(n)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, a in enumerate(left.tolist()):
        others = left[k + 1 :] if right is None else right
        if not len(others) or not sizes[a]:
            continue
        near = others[survivors(table, np.full(len(others), a), others, least)]
        # |A and B| >= t (|A| + |B|) / (1 + t) needs sizes alike
        near = near[(sizes[near] >= threshold * sizes[a]) & (sizes[near] * threshold <= sizes[a]) & (sizes[near] > 0)]
        if not len(near):
            continue
        mine = ids[starts[a] : ends[a]]
        mark[mine] = 1
        lengths, common = sizes[near], np.zeros(len(near), np.int64)
        for x, y in slices(lengths.tolist(), SHINGLES_AT_ONCE):
            each = lengths[x:y]
            before = np.cumsum(each) - each
            at = np.repeat(starts[near[x:y]] - before, each) + np.arange(each.sum())
            common[x:y] = np.add.reduceat(mark[ids[at]], before)
        mark[mine] = 0
        # exact: common / union >= threshold, in whole numbers
        percent = round(threshold * 1_000_000)
        linked = near[common * 1_000_000 >= percent * (sizes[a] + lengths - common)]
        links[a] += len(linked)
        links[linked] += 1
        for b in linked.tolist():
            x, y = top(a), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    return links, np.array([top(x) for x in range(n)], np.int64)


def with_sets(texts: DataFrame) -> DataFrame:
    """(root, blocks, node, sig, _text) with the set of shingles of every text instead of it."""

    def run(batches):
        for batch in batches:
            text = batch.column(4)
            for a, b in slices(pa.compute.binary_length(text).to_pylist(), 1_000_000):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(part.columns[:4] + [pa.array(shingle_sets(text.slice(a, b - a).to_pylist()), pa.binary())], names=["root", "blocks", "node", "sig", "shingles"])

    return texts.select("root", "blocks", "node", "sig", "_text").mapInArrow(run, "root long, blocks int, node long, sig binary, shingles binary")


def verified_links(texts: DataFrame, threshold: float) -> DataFrame:
    """(node, links, low, split) per text and task, from (root, blocks, node, sig, _text): low is a node it's linked with.

    Each text is cut into shingles once; its set is what goes to the tasks of its component's blocks.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_blocks(with_sets(texts), F.col("blocks"), "node", own=True).repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    least = least_matches(threshold)

    def run(batches):
        for group in runs_of(batches, ["root", "i", "j"]):
            nodes, once = np.unique(group.column("node").to_numpy(), return_index=True)  # a repeated row comes once
            if len(nodes) < 2:
                continue
            group = group.take(pa.array(once))
            i, j, side = (group.column(c).to_numpy() for c in ("i", "j", "side"))
            sets = group.column("shingles").to_pylist()
            sizes = np.array([len(x) // 8 for x in sets], np.int64)
            left = np.flatnonzero(side == i)
            right = None if i[0] == j[0] else np.flatnonzero(side == j)
            links, low = count_links(signature_table(group.column("sig")), np.frombuffer(b"".join(sets), np.uint64), sizes, left, right, least, threshold)
            some = np.flatnonzero(links)
            split = group.column("blocks").to_numpy()[some] > 1
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[low[some]]), pa.array(split)], names=["node", "links", "low", "split"])

    return dealt.select("root", "i", "j", "side", "blocks", "node", "sig", "shingles").mapInArrow(run, "node long, links long, low long, split boolean")


def similarity_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All links between texts whose sets of five-word shingles have a Jaccard similarity of ``threshold`` (0.8 at least) or more.

    Returns one row per row of ``df``: id, class_id (the least id of all rows that links and equal texts connect with
    it), copy_of (the least id of the rows with the same text), n_links (other different texts that are linked with its
    text), and h1, h2, the text's keys, and first: whether the row stands for its class.

    Equal texts are one text; pairs of copies are never formed. Null texts are empty; texts without words have no links
    but equal ones are of one class. Ids may be null or repeated: null ids are passed over when the least is taken (a
    class of null ids has class_id null). An empty table gives an empty result; other columns don't matter.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"bands and the test propose pairs of {THRESHOLD} or more")
    signed = materialize(sign(df, id_col, text), "signatures")
    classes = signed.groupBy("h1", "h2").agg(F.min("_id").alias("copy_of"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    near = materialize(candidate_components(classes), "candidates")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / TEXT_BLOCK, F.sum("n_shingles") / SHINGLE_BLOCK))
    sizes = near.join(classes.select("node", "n_shingles"), "node").groupBy("root").agg(blocks.cast("int").alias("blocks"), F.count(F.lit(1)).alias("_rows"))
    sized = join_facts(near, sizes, ["root"], "_rows", near.count(), by=["node"])
    members = sized.join(classes.drop("copies", "n_shingles"), "node").withColumnRenamed("copy_of", "_of")
    h1, h2 = text_keys(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), h1.alias("t1"), h2.alias("t2"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    held = rows.join(members.hint("shuffle_hash"), (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")) & F.col("_id").eqNullSafe(F.col("_of")))
    links = materialize(verified_links(held, threshold), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    # components that fit one task are settled; those of split ones meet here
    settled = links.filter("NOT split").select("node", F.col("low").alias("top"))
    met = connected_components(links.filter("split AND node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    tops = settled.union(met.select("node", F.col("root").alias("top")))
    rated = classes.drop("sig").join(counts, "node", "left").join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    heads = rated.groupBy("top").agg(F.min(F.struct(F.col("copy_of").isNull().alias("none"), "copy_of", "h1", "h2")).alias("head"), F.count(F.lit(1)).alias("_n"))
    rated = join_facts(rated, heads, ["top"], "_n", classes.count(), by=["node"])
    rated = materialize(rated.select("h1", "h2", "copy_of", F.coalesce("n_links", F.lit(0)).alias("n_links"), "head", "copies"), "rated")
    # copies of one text may be a third of all rows; ids may be null or repeated, so rows are dealt by their place too
    out = join_facts(signed.drop("sig", "n_shingles"), rated, ["h1", "h2"], "copies", signed.count(), by=["_id", F.monotonically_increasing_id()])
    first = F.col("_id").eqNullSafe(F.col("head.copy_of")) & (F.col("h1") == F.col("head.h1")) & (F.col("h2") == F.col("head.h2"))
    return out.select(F.col("_id").alias(id_col), F.col("head.copy_of").alias("class_id"), "copy_of", "n_links", "h1", "h2", first.alias("first"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that stand for their classes (see similarity_classes): one of each, with all its columns."""
    firsts = similarity_classes(df, id_col, text, threshold).filter("first").select(F.col(id_col).alias("_first"), F.col("h1").alias("_f1"), F.col("h2").alias("_f2"))
    counted = materialize(firsts.groupBy("_first", "_f1", "_f2").agg(F.count(F.lit(1)).alias("_rows")), "firsts")
    h1, h2 = text_keys(F.coalesce(of_row(text), F.lit("")))
    marked = packed(df).select("_row", of_row(id_col).cast("long").alias("_i"), h1.alias("_h1"), h2.alias("_h2"))
    same = F.col("_i").eqNullSafe(F.col("_first")) & (F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2"))
    kept = marked.join(counted.drop("_rows").hint("shuffle_hash"), same, "left_semi")
    if counted.filter("_rows > 1").limit(1).count():  # rows that are equal in id and text
        kept = kept.dropDuplicates(["_i", "_h1", "_h2"])
    return unpacked(kept)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """One row per document: class id, the least id with the same text, and the number of different texts it's linked with."""
    return similarity_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "copy_of", "n_links")


OP1_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT text, min(doc_id) AS copy_of FROM t GROUP BY text),
w AS (SELECT copy_of, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM c),
s AS (SELECT DISTINCT copy_of, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS s
  FROM (SELECT copy_of, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT copy_of, count(*) AS n FROM s GROUP BY copy_of),
k AS (SELECT a.copy_of AS a, b.copy_of AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.copy_of <> b.copy_of GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.copy_of = a JOIN n y ON y.copy_of = b WHERE m * 1000000 >= 800000 * (x.n + y.n - m)),
r AS (SELECT copy_of AS node, copy_of AS top FROM c UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node),
f AS (SELECT node, min(top) AS class_id FROM r GROUP BY node),
q AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT t.doc_id, f.class_id, c.copy_of, coalesce(q.n_links, 0) AS n_links
FROM t JOIN c USING (text) JOIN f ON f.node = c.copy_of LEFT JOIN q ON q.a = c.copy_of
"""
