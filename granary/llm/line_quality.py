"""Quality classifier: a linear-chain conditional random field labels every line, marginals add up to document quality."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .labelled import bounded_sample, fit_logistic, labelled_texts, labels_of, remainder, sigmoid
from .toxicity import one_of_each, score_texts

#: Labelled rows that are learned from at most, their bytes and lines together at most (fewer rows, all whole), rounds of relabelling.
SAMPLE, SAMPLE_BYTES, LINES, ROUNDS = 4_000, 32_000_000, 200_000, 2
#: Lines whose features are held at a time, and lines from which a document's messages are passed by itself.
STRETCH, ALONE = 20_000, 4_096
#: Signs counted one by one.
SIGNS = "!|&$%*#<>{}=\\_@"

#: Classes of bytes: upper case, lower case, digits, white space, other ASCII signs, beyond ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:128] = 4
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3


def repeats(lines: list[str]) -> np.ndarray:
    """Whether each line of a document is equal to an earlier one."""
    seen: set[str] = set()
    out = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        out[i] = line in seen
        seen.add(line)
    return out


def line_features(lines: list[str], repeated: np.ndarray) -> np.ndarray:
    """Own features of lines, each about between 0 and 1."""
    out = np.zeros((len(lines), 16), np.float32)
    raw = [line.encode("utf-8", "replace") for line in lines]
    sizes = np.array([len(r) + 1 for r in raw])
    kinds = _CLASS[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    starts = np.cumsum(sizes) - sizes
    for k in range(6):
        out[:, k] = np.add.reduceat((kinds == k).astype(np.int32), starts) / sizes
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        row = out[i]
        if n:
            different = len(set(words))
            row[6] = 1 - different / n
            row[7] = min(1.0, sum(map(len, words)) / n / 20)
            row[8] = min(1.0, math.log1p(n) / 6)
            row[9], row[10] = min(1.0, line.count("!") / n), min(1.0, line.count("|") / n)
            row[11] = min(1.0, sum(line.count(s) for s in SIGNS[2:]) / (2 * n))
            row[12] = line.rstrip()[-1:] in ".!?…"
            row[13] = line[:1].isupper()
        else:
            row[14] = 1
    out[:, 15] = repeated
    return out


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A line's features beside those of the line before and behind in its document, and whether there is none."""
    ends = np.cumsum(counts)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[ends - counts], last[ends - 1] = True, True
    before, behind = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], behind[last] = 0, 0
    return np.hstack([own, own[:, :12] ** 2, before, behind, first[:, None], last[:, None]])


def whole_texts(texts: list[str], places: list[int], most: int) -> list[int]:
    """Of the places those, in order, whose texts have ``most`` lines together; a text that doesn't fit is left out whole."""
    out, left = [], most
    for i in places:
        n = texts[i].count("\n") + 1
        if n <= left:
            out.append(i)
            left -= n
    return out


def lengths_of(lines: list[str]) -> np.ndarray:
    return np.array([len(x) + 1.0 for x in lines])


def document_features(split: list[list[str]]) -> np.ndarray:
    """Features of all lines of some documents (lists of lines), one document's behind the other's."""
    counts = np.array([len(x) for x in split])
    return with_neighbours(line_features([line for x in split for line in x], np.concatenate([repeats(x) for x in split])), counts)


def in_stretches(lines: list[str], use) -> np.ndarray:
    """use(features) of a document's lines, a stretch at a time; lines at a stretch's ends have their true neighbours."""
    repeated, out = repeats(lines), []
    for a in range(0, len(lines), STRETCH):
        b = min(a + STRETCH, len(lines))
        low, high = max(a - 1, 0), min(b + 1, len(lines))
        features = with_neighbours(line_features(lines[low:high], repeated[low:high]), np.array([high - low]))
        out.append(use(features[a - low : b - low]))
    return np.concatenate(out)


class Chain:
    """A two-state linear-chain CRF (0 bad, 1 good): linear scores of good, and a score for each pair of neighbours.

    Messages are log-odds of good. Documents are given as the scores of all their lines, one document's behind the
    other's, and their numbers of lines.
    """

    def __init__(self, n: int):
        self.weights, self.bias = np.zeros(n), 0.0
        self.pairs = np.zeros((2, 2))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights + self.bias

    def messages(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward messages (with the line's own score) and backward ones (without), all documents side by side."""
        starts = np.cumsum(lengths) - lengths
        forward, backward = scores.astype(float), np.zeros(len(scores))
        for s, n in zip(starts[lengths > ALONE].tolist(), lengths[lengths > ALONE].tolist()):
            forward[s : s + n], backward[s : s + n] = self._alone(scores[s : s + n].tolist())
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] <= ALONE]
        if not len(order):
            return forward, backward
        starts, n = starts[order], lengths[order]
        active = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right")  # documents with a line t
        (a00, a01), (a10, a11) = self.pairs
        for t in range(1, int(n[0])):
            at = starts[: active[t]] + t
            f = forward[at - 1]
            forward[at] += np.logaddexp(a01, f + a11) - np.logaddexp(a00, f + a10)
        for t in range(int(n[0]) - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            b = backward[at + 1] + scores[at + 1]
            backward[at] = np.logaddexp(a10, a11 + b) - np.logaddexp(a00, a01 + b)
        return forward, backward

    def _alone(self, scores: list[float]) -> tuple[list[float], list[float]]:
        """The same for one document, line by line."""
        (a00, a01), (a10, a11) = self.pairs.tolist()

        def add(x: float, y: float) -> float:
            return max(x, y) + math.log1p(math.exp(-abs(x - y)))

        forward, backward = [scores[0]], [0.0]
        for s in scores[1:]:
            f = forward[-1]
            forward.append(s + add(a01, f + a11) - add(a00, f + a10))
        for s in reversed(scores[1:]):
            b = backward[-1] + s
            backward.append(add(a10, a11 + b) - add(a00, a01 + b))
        return forward, backward[::-1]

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(good) of every line."""
        forward, backward = self.messages(scores, lengths)
        return sigmoid(forward + backward)

    def passes(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the expected numbers of neighbouring states."""
        forward, backward = self.messages(scores, lengths)
        inner = np.ones(len(scores), bool)
        inner[np.cumsum(lengths) - 1] = False
        at = np.flatnonzero(inner)
        states = np.arange(2.0)
        joint = forward[at, None, None] * states[:, None] + self.pairs + (scores + backward)[at + 1, None, None] * states
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return sigmoid(forward + backward), (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def fit(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, steps: int = 80, l2: float = 1e-3) -> None:
        """Adam on the log-likelihood of (soft) line labels; the gradient is observed less expected features."""
        n = len(x)
        inner = np.ones(n, bool)
        inner[np.cumsum(lengths) - 1] = False
        here, behind = y[np.flatnonzero(inner)], y[np.flatnonzero(inner) + 1]
        observed = np.stack([1 - here, here]) @ np.stack([1 - behind, behind], axis=1)
        theta = np.r_[self.weights, self.bias, self.pairs.ravel()]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            self.weights, self.bias, self.pairs = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
            p, expected = self.passes(self.scores(x), lengths)
            g = np.r_[(p - y).astype(x.dtype) @ x, (p - y).sum(), (expected - observed).ravel()] / n + l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        self.weights, self.bias, self.pairs = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)


def summary(good: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the document score is made of: the length-weighted share of good lines, and its logit."""
    share = float(good @ lengths / lengths.sum())
    clipped = min(max(share, 1e-4), 1 - 1e-4)
    return np.array([share, np.log(clipped / (1 - clipped)) / 5])


class QualityModel:
    """CRF and document weights learned from whole texts with labels (at most SAMPLE of them, of LINES lines together)."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        places = whole_texts(texts, one_of_each(texts), LINES)
        texts, labels = [texts[i] for i in places], labels[places]
        self.chain, self.document = None, np.zeros(3)
        if not len(texts) or labels.min() == labels.max():
            self.document[-1] = 3.0 if len(texts) and labels.min() == 1 else -3.0 if len(texts) else 0.0
            return
        split = [t.split("\n") for t in texts]
        counts = np.array([len(x) for x in split])
        starts = np.cumsum(counts) - counts
        x = document_features(split)
        self.chain = Chain(x.shape[1])
        # lines of good documents are good; of bad ones all at first, then those that the chain finds bad
        targets = np.repeat(labels.astype(float), counts)
        bad = targets == 0
        for _ in range(ROUNDS):
            self.chain.fit(x, counts, targets)
            found = self.chain.marginals(self.chain.scores(x), counts)
            targets[bad] = found[bad] > 0.8
            for i in np.flatnonzero(labels == 0).tolist():
                targets[starts[i] + int(np.argmin(found[starts[i] : starts[i] + counts[i]]))] = 0
        self.chain.fit(x, counts, targets)
        good = self.chain.marginals(self.chain.scores(x), counts)
        shares = np.array([summary(good[s : s + n], lengths_of(lines)) for s, n, lines in zip(starts, counts, split)])
        self.document = fit_logistic(shares, labels.astype(float), l2=1e-2)

    def line_marginals(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """P(good) and length of each text's lines. The features of STRETCH lines are held at a time, however long a text is."""
        out = []

        def together(batch: list[list[str]]) -> None:
            if batch:
                counts = np.array([len(x) for x in batch])
                good = self.chain.marginals(self.chain.scores(document_features(batch)), counts)
                out.extend(zip(np.split(good, np.cumsum(counts)[:-1]), map(lengths_of, batch)))

        batch, held = [], 0
        for t in texts:
            lines = t.split("\n")
            if held + len(lines) > STRETCH:
                together(batch)
                batch, held = [], 0
            if len(lines) > STRETCH:
                scores = in_stretches(lines, self.chain.scores)
                out.append((self.chain.marginals(scores, np.array([len(lines)])), lengths_of(lines)))
            else:
                batch.append(lines)
                held += len(lines)
        together(batch)
        return out

    def scorer(self):
        def score(texts: list[str]) -> list[float]:
            if self.chain is None or not texts:
                return [float(sigmoid(self.document[-1]))] * len(texts)
            x = np.array([summary(good, n) for good, n in self.line_marginals(texts)])
            return sigmoid(x @ self.document[:-1] + self.document[-1]).tolist()

        return score


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> QualityModel:
    """Learn from rows of ``df`` whose ids are in ``labels`` (id, label: see bounded_sample), SAMPLE rows and SAMPLE_BYTES at most.

    Null texts are empty, null ids match nothing, rows equal in id and text count once, an id with several texts gives
    several rows; whole texts only, of LINES lines together: a sample that would pass the bounds gets fewer rows.
    """
    return QualityModel(*labelled_texts(df, labels, id_col, text, SAMPLE, SAMPLE_BYTES))


def op9_line_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: learned where crc32(doc_id) mod 3 is not 1, scored everywhere; a score of 0.5 or more is predicted 1.

    An empty text is one empty line; equal texts get equal scores; without labels of both kinds every score is a constant.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = bounded_sample(labels_of(spark, sf_dir, "quality"), remainder("doc_id", 3) != 1, SAMPLE)
    scored = score_texts(docs, fit_quality(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
