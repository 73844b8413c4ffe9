import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import labelled, line_quality, toxicity
from odd import ROWS, empty, table

DATA = "/root/testdata/sf0.1"


def held_out(spark, column, n, r):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = docs.join(labelled.labels_of(spark, DATA, column), "doc_id").withColumn("out", labelled.remainder("doc_id", n) == r).orderBy("doc_id").toPandas()
    learn, test = rows[~rows["out"]], rows[rows["out"]]
    return learn["text"].tolist(), learn["label"].to_numpy(), test["text"].tolist(), test["label"].to_numpy()


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity_on_held_out_rows_and_against_the_vote(spark):
    x, y, tx, ty = held_out(spark, "toxic", 5, 0)
    model = toxicity.ToxicityModel(x, y)
    score = np.array(model.scorer()(tx))
    assert ((score >= 0.5) == ty).mean() > 0.97 and (score >= 0.5)[ty == 1].mean() > 0.85 and auc(score, ty) > 0.95
    assert model.scorer()([""])[0] < 0.5
    bags = [toxicity.words_in(t) for t in tx]
    votes = model.votes(bags, [toxicity.patterns_of(t, b) for t, b in zip(tx, bags)])
    assert ((score >= 0.5) == ty).mean() > ((votes.sum(axis=1) > 0) == ty).mean() + 0.02


def test_quality_on_held_out_rows(spark):
    x, y, tx, ty = held_out(spark, "quality", 3, 1)
    score = np.array(line_quality.QualityModel(x[:500], y[:500]).scorer()(tx))
    assert ((score >= 0.5) == ty).mean() > 0.98 and auc(score, ty) > 0.99


@pytest.mark.parametrize("alone", [4096, 2])
def test_chain_marginals_are_those_of_all_labelings(monkeypatch, alone):
    monkeypatch.setattr(line_quality, "ALONE", alone)  # longer documents pass their messages alone
    draw = np.random.default_rng(0)
    chain = line_quality.Chain(3)
    chain.weights, chain.bias, chain.pairs = draw.normal(size=3), 0.3, draw.normal(size=(2, 2))
    docs = [draw.normal(size=(n, 3)) for n in (1, 4, 2, 6)]
    counts = np.array([len(d) for d in docs])
    marginals, pairs = chain.passes(chain.scores(np.concatenate(docs)), counts)
    expected_pairs = np.zeros((2, 2))
    for d, m in zip(docs, np.split(marginals, np.cumsum(counts)[:-1])):
        n, total, good, both = len(d), 0.0, np.zeros(len(d)), np.zeros((2, 2))
        for bits in range(2**n):
            y = [(bits >> i) & 1 for i in range(n)]
            p = np.exp(sum((d[i] @ chain.weights + chain.bias) * y[i] for i in range(n)) + sum(chain.pairs[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            good += p * np.array(y)
            for i in range(n - 1):
                both[y[i], y[i + 1]] += p
        assert m == pytest.approx(good / total)
        expected_pairs += both / total
    assert pairs == pytest.approx(expected_pairs)


def plain_features(lines):
    """Features of a document's lines, each line by itself."""
    own = []
    for i, line in enumerate(lines):
        raw, words = line.encode() + b"\n", line.split()
        share = lambda f: sum(map(f, raw)) / len(raw)
        space = [0x20, *range(9, 14)]
        row = [share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57), share(lambda c: c in space)]
        row += [share(lambda c: c < 128 and not chr(c).isalnum() and c not in space), share(lambda c: c > 127)]
        n = len(words)
        if n:
            row += [1 - len(set(words)) / n, min(1, sum(map(len, words)) / n / 20), min(1, np.log1p(n) / 6), min(1, line.count("!") / n), min(1, line.count("|") / n)]
            row += [min(1, sum(line.count(s) for s in "&$%*#<>{}=\\_@") / (2 * n)), line.rstrip()[-1] in ".!?…", line[0].isupper(), 0]
        else:
            row += [0] * 8 + [1]
        own.append([*map(float, row), float(line in lines[:i])])
    none = [0.0] * 16
    return [
        [*x, *(v * v for v in x[:12]), *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), float(i == 0), float(i + 1 == len(own))]
        for i, x in enumerate(own)
    ]


def test_line_features_are_those_of_plain_python(spark, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()] + ["", "\n\n", "A\nb!\nA\n|x| é…"]
    split = [t.split("\n") for t in texts]
    want = np.array([row for lines in split for row in plain_features(lines)])
    assert line_quality.document_features(split) == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(line_quality, "STRETCH", 3)
    got = np.concatenate([line_quality.in_stretches(lines, lambda f: f) for lines in split])
    assert got == pytest.approx(want, abs=1e-5)


def test_document_scores_are_those_of_length_weighted_marginals(spark, monkeypatch):
    x, y, tx, _ = held_out(spark, "quality", 3, 1)
    model = line_quality.QualityModel(x[:300], y[:300])
    whole = model.scorer()(tx[:80])
    for t, s in zip(tx[:80], whole):
        f = np.array(plain_features(t.split("\n")))
        good = model.chain.marginals(f @ model.chain.weights + model.chain.bias, np.array([len(f)]))
        size = np.array([len(line) + 1 for line in t.split("\n")])
        share = min(max((good * size).sum() / size.sum(), 1e-4), 1 - 1e-4)
        odds = share * model.document[0] + np.log(share / (1 - share)) / 5 * model.document[1] + model.document[2]
        assert s == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-4)
    monkeypatch.setattr(line_quality, "STRETCH", 7)
    monkeypatch.setattr(line_quality, "ALONE", 3)
    assert model.scorer()(tx[:80]) == pytest.approx(whole, abs=1e-4)


def test_a_text_of_very_many_lines_is_scored_in_bounded_memory(spark):
    import tracemalloc

    x, y, *_ = held_out(spark, "quality", 3, 1)
    score = line_quality.QualityModel(x[:200], y[:200]).scorer()
    text = "A line.\n" * 200_000
    tracemalloc.start()
    assert 0 <= score([text])[0] <= 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # the lines themselves and a few numbers each; their features alone would take 100 MB


def test_label_model_weighs_voters_by_accuracy_and_repeats_little():
    draw = np.random.default_rng(1)
    y = (draw.random(4000) < 0.15).astype(int)
    vote = lambda hit, false: np.where(draw.random(4000) < np.where(y == 1, hit, false), 1.0, 0.0)
    good, weak, other = vote(0.8, 0.01), vote(0.4, 0.15), vote(0.7, 0.02)
    votes = np.stack([good, weak, other, vote(0.6, 0.03), weak, weak], axis=1)
    model = toxicity.LabelModel(votes, votes[:, [0, 2, 3]].sum(axis=1) > 1)
    p = model.posterior(votes)
    assert ((p >= 0.5) == y).mean() > 0.96 and abs(p.mean() - 0.15) < 0.03
    # a hit of the weak voter and its two copies counts about once; a good voter's hits count more
    seen = model.posterior(np.array([[0, 1, 0, 0, 1, 1], [0, 0, 1, 0, 0, 0]], float))
    assert seen[0] < 0.3 and (model.parents[[1, 4, 5]] >= 0).sum() >= 2
    assert model.accuracy[1:, 0, 2].max() > 0.6 and model.accuracy[0, 0, 2] < 0.05


@pytest.mark.parametrize("fit", [toxicity.fit_toxicity, line_quality.fit_quality])
def test_scores_of_odd_rows_and_without_labels(spark, fit):
    labels = spark.createDataFrame([(1, 0), (4, 1), (7, 0), (9, 1), (None, 1)], "doc_id long, label int")
    for given in (labels, labels.filter("label = 0"), labels.limit(0)):
        out = toxicity.score_texts(table(spark), fit(table(spark), given))
        rows = out.collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["_row"] == 7 for r in rows)
        assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert toxicity.score_texts(empty(spark), fit(table(spark), labels)).count() == 0


def test_sample_is_bounded_and_labels_are_settled(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    n = labelled.bounded_sample(labels, F.lit(True), 500).count()
    assert 350 < n < 650
    mixed = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 0), (3, 0)], "doc_id long, label int")
    assert sorted(map(tuple, labelled.bounded_sample(mixed, F.lit(True), 500).collect())) == [(1, 1), (3, 0)]


def test_quality_learns_from_whole_texts(monkeypatch):
    good = lambda i: f"Sentence{i} tells{i} of{i} quiet{i} walks{i} along{i} rivers{i}."
    junk = lambda i: f"BUY{i} |{i} NOW{i} |{i} $$${i} !!!{i} |{i} CLICK{i}"
    texts = [f"start{i} of a text\n" + "\n".join([good(i)] * 210 + [(junk if i % 2 else good)(i)] * 210) for i in range(20)]
    seen = []
    features = line_quality.document_features
    monkeypatch.setattr(line_quality, "document_features", lambda t, *a: seen.append(t) or features(t, *a))
    model = line_quality.QualityModel(texts, np.array([1 - i % 2 for i in range(20)]))
    assert all(len(d) == 421 for d in seen[0])
    assert [x >= 0.5 for x in model.scorer()(texts)] == [i % 2 == 0 for i in range(20)]
    assert line_quality.whole_texts(["a\nb", "a\n" * 9, "c"], [0, 1, 2], 3) == [0, 2]


def test_toxicity_has_rare_terms_and_rules_as_features():
    code = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    clean = [f"calm walk {i} along rivers" for i in range(3000)]
    toxic = [f"{code(i // 8)} {i} idiot" for i in range(1600)]
    model = toxicity.ToxicityModel(clean + toxic, np.r_[np.zeros(3000, int), np.ones(1600, int)])
    assert len(model.lexicon) > 180
    score = model.scorer()
    assert score(["a moron of no known word"])[0] > score(["somebody of no known word"])[0]
    late = "A" * 3 + " "
    assert toxicity.patterns_of("x" * 100_000 + " " + late * 50_000, {"aaa"})[-2] == 1


def test_texts_to_learn_from_are_bounded_and_come_once(spark):
    rows = [(i, f"text {i} " * 50, "a") for i in range(400)] + [(3, "text 3 " * 50, "a")] * 300 + [(None, "no id", "a"), (5, None, "a")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, label int")
    texts, y = labelled.labelled_texts(table(spark, rows), labels, "doc_id", "text", 1000, 10**9)
    assert len(texts) == 401 and sorted(texts) == sorted({t or "" for i, t, _ in rows if i is not None}) and y.sum() == 201
    texts, _ = labelled.labelled_texts(table(spark, rows), labels, "doc_id", "text", 100, 10**9)
    assert 60 <= len(texts) <= 110
    texts, _ = labelled.labelled_texts(table(spark, rows), labels, "doc_id", "text", 1000, 20_000)
    assert 0 < sum(map(len, texts)) <= 20_000
