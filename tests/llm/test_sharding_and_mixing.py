import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import DATA
from granary.llm import mixing, sharding
from odd import ROWS, empty, key, table


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.feistel(F.col("id"), F.lit(n).cast("long"), 3)).collect()]
    assert sorted(got) == list(range(n)) and (n < 50 or got != list(range(n)))


def test_shards_are_even_gapless_and_repeatable(spark):
    rows = sharding.op4_sharding(spark, str(DATA)).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = sharding.op4_sharding(spark, str(DATA)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert key(rows) == key(again)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    import zlib

    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


def test_placement_is_that_of_plain_integers(spark):
    """Positions of all documents by a Feistel network in plain Python, with Spark's hash of (right half, round, seed)."""
    rows = sharding.op4_sharding(spark, str(DATA)).collect()
    n = len(rows)
    a = math.ceil(math.sqrt(n))
    b = math.ceil(n / a)
    halves = [(r, k) for r in range(max(a, b)) for k in range(1, 7)]
    hashed = spark.createDataFrame(halves, "r long, k int").select("r", "k", F.xxhash64("r", "k", F.lit(20)).alias("h")).collect()
    h = {(x["r"], x["k"]): x["h"] for x in hashed}

    def once(v):
        left, right, ml, mr = v // b, v % b, a, b
        for k in range(1, 7):
            left, right, ml, mr = right, (left + h[right, k] % ml) % ml, mr, ml
        return left * mr + right

    def place(v):
        v = once(v)
        while v >= n:
            v = once(v)
        return v

    assert sorted(r["row_no"] for r in rows) == list(range(n))
    assert all((r["position"], r["shard"], r["slot"]) == (place(r["row_no"]), place(r["row_no"]) % 8, place(r["row_no"]) // 8) for r in rows)


def test_shards_of_odd_rows(spark):
    out = sharding.shard_rows(table(spark), ["doc_id", "text"], n_shards=3)
    rows = out.collect()
    assert sorted(r["position"] for r in rows) == list(range(len(ROWS))) and key((r["doc_id"], r["text"]) for r in rows) == key((i, t) for i, t, _ in ROWS)
    assert all(r["_row"] == 7 and r["_bucket"] == 7 for r in rows)
    assert sharding.shard_rows(empty(spark), ["doc_id", "text"]).count() == 0


def brute_copies(rows, alpha=0.5, epochs=1.0, seed=5):
    import hashlib

    mass = Counter()
    for _, t, s in rows:
        mass[s] += len((t or "").encode())
    weight = {s: round(math.sqrt(m) * 1024) if m else 0 for s, m in mass.items()}
    out = Counter()
    for i, t, s in rows:
        if not mass[s]:
            continue
        rate = epochs * weight[s] / sum(weight.values()) * sum(mass.values()) / mass[s]
        draws, count = max(1, math.ceil(rate / 16)), 0
        digest = hashlib.md5((t or "").encode()).hexdigest()
        for k in range(1, draws + 1):
            u = int(hashlib.md5(f"{seed}|{'-' if i is None else i}|{digest}|{k}".encode()).hexdigest()[:13], 16) / 2**52
            p = total = math.exp(-rate / draws)
            j = 0
            while total <= u and j < 500:
                j += 1
                p *= rate / draws / j
                total += p
                count += 1
        out[(i, t, s)] += count
    return +out


def test_copies_are_those_of_the_distribution(spark):
    out = mixing.mix_sources(table(spark))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect()) == brute_copies(ROWS)
    assert out.columns == [c for c in table(spark).columns if c not in ("copy_no", "rate", "shuffle_key")] + ["copy_no", "rate", "shuffle_key"]
    assert out.filter("_source <> 7 OR _row <> 7").count() == 0 and mixing.mix_sources(empty(spark)).count() == 0


def test_large_rates_and_the_salted_join(spark, monkeypatch):
    rows = [(i, "t" * 10, "small" if i < 3 else "large") for i in range(400)]
    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    want = brute_copies(rows, epochs=8.0)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mix_sources(df, epochs=8.0).collect()) == want
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mix_sources(df, epochs=8.0).collect()) == want
    small = sum(n for (_, _, s), n in want.items() if s == "small")
    assert small > 3 * 16 * 3  # means beyond STEP are drawn in parts


def test_targets(spark):
    df = spark.createDataFrame([(i, "abcdefghij", "a" if i % 4 else "b") for i in range(2000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    got = {r["source"]: r["count"] for r in mixing.mix_sources(df, targets=targets).groupBy("source").count().collect()}
    assert abs(got["a"] - 1000) < 120 and abs(got["b"] - 1000) < 120


def test_targets_count_in_proportion_whatever_their_scale(spark):
    docs = spark.createDataFrame([(i, "x" * 9, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    shares = [("s0", 1.0), ("s1", 2.0), ("s2", 0.5)]
    rates = []
    for scale in (1.0, 1e-7, 1e9):
        targets = spark.createDataFrame([(s, w * scale) for s, w in shares], "source string, weight double")
        got = mixing.source_rates(docs, "source", F.length("text"), 0.5, 1.0, targets).select("_source", F.round("_rate", 6)).collect()
        rates.append(dict(map(tuple, got)))
    assert rates[0] == rates[1] == rates[2] == {"s0": 0.857143, "s1": 1.714286, "s2": 0.428571}
