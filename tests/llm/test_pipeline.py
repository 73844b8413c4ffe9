from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from compare import DATA
from granary.llm import pieces
from odd import empty, key, table
from test_lines_and_rules import brute_lines, brute_verdicts
from test_sharding_and_mixing import brute_copies
from test_similarity import brute_classes

STAGES = dict(corpus_pipeline.STAGES)


def test_each_stage_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    original = {r["doc_id"]: r for r in docs.collect()}

    def stage(name):
        nonlocal docs
        STAGES[name](spark, docs, str(DATA)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        return docs.collect()

    want = brute_verdicts([(r["doc_id"], r["text"], r["source"]) for r in original.values()])
    rows = stage("quality_rules")
    assert key((r["doc_id"], r["text"], r["n_chars"]) for r in rows) == key((i, t, len(t)) for i, k, t in want if k) and 0.5 * len(original) < len(rows) < len(original)
    want = brute_lines([(r["doc_id"], r["text"], r["source"]) for r in rows])
    rows = stage("line_dedup")
    assert key((r["doc_id"], r["text"], r["n_chars"]) for r in rows) == key((i, t, len(t)) for i, _, _, t in want)
    classes = brute_classes([(r["doc_id"], r["text"]) for r in rows])
    rows = stage("ngram_jaccard_join")
    assert sorted(r["doc_id"] for r in rows) == sorted({c for _, c, *_ in classes})
    copies = brute_copies([(r["doc_id"], r["text"], r["source"]) for r in rows])
    rows = stage("source_mixing")
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == copies and rows[0].asDict().keys() == set(corpus_pipeline.COLUMNS)
    before = rows
    rows = stage("sentencepiece")
    model = pieces.load_model(pieces.default_model())
    assert key((r["doc_id"], bytes(r["ids"])) for r in rows) == key((r["doc_id"], model.encode([r["text"]])[0]) for r in before)
    assert all(np.frombuffer(r["ids"], "<u4").size == r["n_tokens"] for r in rows)
    assert key(corpus_pipeline.run(spark, str(DATA)).collect()) == key(rows)


@pytest.mark.parametrize("make", [table, empty])
def test_stages_take_odd_and_empty_tables(spark, make, tmp_path):
    docs = make(spark)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, "")
        assert out.count() >= 0
        if name != "sentencepiece":
            assert out.columns == corpus_pipeline.COLUMNS
