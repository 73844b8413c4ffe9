import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import fingerprints, graphs, ngram_join
from odd import ROWS, empty, key, table


def shingle_set(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    """(id, class id, copy of, links) by comparing all texts with each other."""
    texts = sorted({t or "" for _, t, *_ in rows})
    sets = [shingle_set(t) for t in texts]
    ids = {t: min((i for i, u, *_ in rows if (u or "") == t and i is not None), default=None) for t in texts}
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(texts)
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common * 10 >= 8 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, t in enumerate(texts):
        if ids[t] is not None:
            least[top(k)] = min(least.get(top(k), ids[t]), ids[t])
    at = {t: k for k, t in enumerate(texts)}
    return [(i, least.get(top(at[t or ""])), ids[t or ""], links[at[t or ""]]) for i, t, *_ in rows]


def near_copies(n, edits, length=80, seed=0):
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 9999)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[draw.randrange(length)] = f"v{draw.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_links_of_odd_rows(spark):
    got = ngram_join.similarity_classes(table(spark)).select("doc_id", "class_id", "copy_of", "n_links").collect()
    assert key(got) == key(brute_classes(ROWS))
    assert ngram_join.similarity_classes(empty(spark)).count() == 0
    kept = ngram_join.keep_one_of_each(table(spark))
    assert kept.columns == table(spark).columns and ngram_join.keep_one_of_each(empty(spark)).count() == 0
    assert kept.count() == 9  # id 1 has two texts, each in a class of its own


@pytest.mark.parametrize("texts_each, shingles_each", [(16, 500_000), (512, 1_000)])
def test_no_link_is_lost_among_near_copies(spark, monkeypatch, texts_each, shingles_each):
    monkeypatch.setattr(ngram_join, "TEXT_BLOCK", texts_each)
    monkeypatch.setattr(ngram_join, "SHINGLE_BLOCK", shingles_each)
    monkeypatch.setattr(ngram_join, "SHINGLES_AT_ONCE", shingles_each)
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 16)
    texts = near_copies(60, 1) + near_copies(40, 2, seed=1) + near_copies(40, 4, seed=2) + near_copies(5, 0, seed=3)
    texts += [" ".join(f"u{k}x{j}" for j in range(50)) for k in range(30)]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = ngram_join.similarity_classes(table(spark, rows)).select("doc_id", "class_id", "copy_of", "n_links").collect()
    want = brute_classes(rows)
    assert key(got) == key(want) and max(x[3] for x in want) > 20


def test_least_matches_keeps_pairs_at_the_threshold():
    least = ngram_join.least_matches()
    draw = np.random.default_rng(1)
    matches = (draw.random((200_000, ngram_join.HASHES)) < 0.8).cumsum(axis=1)
    steps = matches[:, ngram_join.STEP - 1 :: ngram_join.STEP]
    assert (steps >= np.array(least)).all(axis=1).mean() > 0.9999
    assert least == sorted(least) and least[-1] > 50


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (200, 200), (102, 100), (50, 10)]
    got = graphs.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert key(got) == key([(i, 0) for i in range(51)] + [(i, 100) for i in (100, 101, 102)])
    assert graphs.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_edits(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    return out


def test_edits_and_fingerprints(spark):
    rows = [r for r in ROWS[3:] if r[0] is not None] + [(50, ROWS[0][1], "a"), (49, ROWS[0][1], "a"), (48, "a" * 500 + " the end of it", "a")]
    out = fingerprints.compare_with_edits(table(spark, rows)).withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)).collect()
    assert key((r["doc_id"], r["n_chars"], r["sha"]) for r in out) == key(brute_edits(rows))
    by = {r["doc_id"]: r for r in out}
    assert by[50]["fingerprint"] == by[49]["fingerprint"] and by[50]["near_next"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    for r in out:  # likeness is that of the sets in the fingerprints
        a, b = (members(r[c]) for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(jaccard(a, b)) and r["n_spots"] == len(a)


def members(fingerprint):
    n, _, digits = fingerprint.partition(":")
    found = {digits[i : i + 16] for i in range(0, len(digits), 16)}
    assert len(found) == int(n)
    return found


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_spots(text):
    """Spots as (anchor, first, second), by looking at every anchor and every word."""
    import regex

    words = []
    for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower()):
        words += [w] if len(w) <= fingerprints.LONG else [w[i : i + 4] for i in range(len(w) - 3)]
    anchor, out = set(fingerprints.ANCHORS), set()
    for i, w in enumerate(words):
        behind = [x for x in words[i + 1 : i + 9] if x not in anchor]
        if w in anchor:
            if behind:
                out.add((w, *behind[:2]))
        elif not any(x in anchor for x in words[max(0, i - 8) : i]):
            out.add(("", w, *behind[:1]))
    return out or ({text} if text else set())


def test_spots_are_those_of_plain_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [r["text"] for r in rows] + ["", "!!!", "of the", "the cat", "Der Hund; die Katze—das Haus“und”der Wald。漢字", "the " * 30 + "end", "x" * 30, "a1 b2 c3 d4 e5 f6 g7 h8 i9 the j10 k11"]
    sets = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fingerprints.spots(F.col("t")).alias("s"))
    got = {r["i"]: r["s"] for r in sets.collect()}
    for i, t in enumerate(texts):
        want = brute_spots(t)
        assert len(got[i]) == len(want) and got[i] == sorted(got[i])
        for other in range(max(0, i - 5), i):  # signatures are equal where chains are
            common = len(set(got[i]) & set(got[other]))
            assert common == len(want & brute_spots(texts[other]))


def test_likeness_of_all_documents_is_that_of_plain_python(spark):
    rows = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.op8_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        nxt, n = rows[(k + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        assert got[i]["near_edited"] == pytest.approx(jaccard(brute_spots(t), brute_spots(edited)))
        assert got[i]["near_next"] == pytest.approx(jaccard(brute_spots(t), brute_spots(nxt)))
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_short_and_longer_texts_are_compared_by_one_rule(spark):
    text = " ".join(f"word{k} stands" for k in range(12)) + " here at last."
    text = text.ljust(157, "x")[:157]
    out = fingerprints.compare_with_edits(table(spark, [(2, text, "a"), (1, text + " end", "a")])).collect()
    assert all(r["near_next"] > 0.8 for r in out)


def test_pruning_leaves_out_only_what_is_below_the_bound(spark):
    draw = random.Random(4)
    pairs = [([*range(n)], sorted(draw.sample(range(60), m))) for n in range(0, 40, 3) for m in range(0, 40, 3)]
    a, b = F.col("a"), F.col("b")
    for bound in (0.0, 0.3, 0.8):
        for r in spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>").select("a", "b", fingerprints.likeness(a, b, bound).alias("x")).collect():
            want = jaccard(set(r["a"]), set(r["b"]))
            assert r["x"] == pytest.approx(want if want >= bound else 0.0)


def test_fingerprints_of_odd_rows(spark):
    out = fingerprints.compare_with_edits(table(spark)).collect()
    assert len(out) == len(ROWS)
    assert fingerprints.compare_with_edits(empty(spark)).count() == 0
    one = fingerprints.compare_with_edits(table(spark, [(1, "abcdef", "a")])).collect()[0]
    assert one["edited"] == "abcdab" and one["near_next"] == 1.0


def test_long_texts_without_spots_by_anchors_have_fingerprints(spark):
    texts = {
        "anchorless": " ".join(f"stem{k}" for k in range(40)),
        "anchors": " ".join(["the", "of", "and", "to"] * 20),
        "unspaced": "".join(chr(0x4E00 + 37 * k % 5000) for k in range(300)),
        "unspaced, ascii words": "".join(chr(0x4E00 + 37 * k % 5000) for k in range(600)) + " one two",
        "one token": "".join(chr(97 + k * k % 26) for k in range(400)),
    }
    sets = {r["name"]: set(r["s"]) for r in spark.createDataFrame(list(texts.items()), "name string, text string").select("name", fingerprints.spots(F.col("text")).alias("s")).collect()}
    assert len(sets["anchorless"]) == 40 and len(sets["anchors"]) == 1
    assert len(sets["unspaced"]) > 250 and len(sets["unspaced, ascii words"]) > 550 and len(sets["one token"]) > 5
    assert not sets["unspaced"] & sets["one token"]


def test_join_facts_gives_the_rows_of_a_join(spark):
    from granary.llm.common import join_facts

    rows = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id % 500 END AS k", "id AS v")
    facts = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS f")
    got = join_facts(rows, facts, ["k"], "n", 9000, by=["v"])
    want = rows.join(facts.drop("n"), "k")
    assert sorted(got.columns) == sorted(want.columns)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 9000
    assert join_facts(rows.limit(0), facts.limit(0), ["k"], "n", 0, by=["v"]).count() == 0
