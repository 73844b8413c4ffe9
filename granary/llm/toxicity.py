"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents
from .labelled import bounded_sample, fit_sparse_logistic, labelled_texts, labels_of, remainder, sigmoid
from .pieces import slices

#: Labelled rows that are learned from at most, and UTF-8 bytes of their texts together at most (fewer rows, all whole).
SAMPLE, SAMPLE_BYTES = 6_000, 64_000_000
#: A term's share of toxic rows: prefixes of these lengths stand for families of words.
PREFIXES = (3, 4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
#: Lexicons that are known without any label (fixed values), a voter each; a word starting with an entry is a hit.
LEXICONS = {
    "mind": "idiot imbecil moron stupid dumb fool dimwit halfwit",
    "worth": "worthless loser pathetic failure nobody useless",
    "filth": "scum trash filth garbage vermin disgusting",
    "ridicule": "clown jerk creep coward liar",
    "german mind": "dummkopf dämlich blödmann schwachkopf vollidiot",
    "german worth": "abschaum versager wertlos ekelhaft drecks",
    "french mind": "imbécile crétin débile abruti",
    "french worth": "ordure minable dégoûtant pourriture",
    "spanish mind": "imbécil estúpid tonto cretino",
    "spanish worth": "basura escoria asqueros patétic",
}
#: Words of politeness: a voter for clean texts.
POLITE = "please thank thanks welcome danke bitte merci gracias".split()


def words_in(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def one_of_each(texts: list[str]) -> list[int]:
    """Places of texts to learn from: of near copies, which share their least hash of three words, mostly one."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        w = t.split()
        key = min((zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))), default=0)
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def terms_of(word: str) -> list[str]:
    """The word itself, and its prefixes (marked by a star) that leave at least one letter."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def mine_lexicon(bags: list[set[str]], targets: np.ndarray, ratio: float = 16) -> list[str]:
    """Terms that mark rows with a high target (0 to 1): ``ratio`` times as frequent there, and beyond chance.

    Beyond chance: a term that is found in n rows has so many of them toxic with a probability (Chernoff's bound for the
    share of toxic rows) below one in the number of terms tried. A longer term is left out where a prefix of it that is
    at least as pure is already in. There is no cap.
    """
    toxic, clean = Counter(), Counter()
    for bag, y in zip(bags, targets.tolist()):
        terms = {t for w in bag for t in terms_of(w)}
        for found, share in ((toxic, y), (clean, 1 - y)):
            if share > 0.01:
                for t in terms:
                    found[t] += share
    n1, n0 = max(1.0, float(targets.sum())), max(1.0, float((1 - targets).sum()))
    base, tried = n1 / (n1 + n0), sum(k >= 2.5 for k in toxic.values())

    def chance(k: float, c: float) -> float:
        share = k / (k + c)
        return -k * np.log(share / base) - (c * np.log((1 - share) / (1 - base)) if c else 0.0)

    ratios = {t: ((k + 0.1) / n1) / ((clean[t] + 0.5) / n0) for t, k in toxic.items() if k >= 2.5}
    purity = {t: clean[t] / toxic[t] for t, r in ratios.items() if r >= ratio and chance(toxic[t], clean[t]) < -np.log(tried)}
    kept = [t for t in purity if not any(purity.get(t[:n] + "*", 2) <= purity[t] for n in PREFIXES if n < len(t.rstrip("*")))]
    return sorted(kept, key=lambda t: (-toxic[t] * np.log(ratios[t]), t))


class Matcher:
    """Counts, for a text, how many of its different words carry each lexicon term."""

    def __init__(self, lexicon: list[str]):
        self.index = {t: i for i, t in enumerate(lexicon)}
        self.known: dict[str, tuple[int, ...]] = {}

    def terms(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = tuple(i for t in terms_of(word) if (i := self.index.get(t)) is not None)
        return found

    def counts(self, bag: set[str]) -> dict[int, int]:
        out: dict[int, int] = {}
        terms = self.terms
        for w in bag:
            for i in terms(w):
                out[i] = out.get(i, 0) + 1
        return out


def patterns_of(text: str, bag: set[str]) -> list[int]:
    """Votes of the rules that need no label: a hit of each of LEXICONS, an insulting address, an exclamation at somebody, shouting, and -1 for politeness."""
    letters = sum(map(len, bag)) or 1
    met = {k for w in bag for k, entries in _ENTRIES.get(w[:3], ()) if w.startswith(entries)}
    hits = [int(k in met) for k in range(len(LEXICONS))]
    shouting = len(re.findall(r"\b[A-Z]{3,}\b", text))
    return [
        *hits,
        int(bool(met) and bool(re.search(r"\b(you|you're|du|tu|vous|tú|eres) (are |bist |es |êtes )?(such )?an? ?\w+", text, re.I))),
        int(bool(re.search(r"\b(you|your)\b[^.\n]{0,40}!", text, re.I))),
        int(shouting * 5 > 0.5 * letters),
        -int(not bag.isdisjoint(POLITE)),
    ]


#: The lexicons' entries by their first three letters.
_ENTRIES = {
    start: [(k, tuple(e for e in v.split() if e[:3] == start)) for k, v in enumerate(LEXICONS.values()) if any(e[:3] == start for e in v.split())]
    for start in {e[:3] for v in LEXICONS.values() for e in v.split()}
}
RULES = len(LEXICONS) + 4


#: Voters that count the different words that carry a mined term: at least so many; EM starts from those with SURE.
COUNTS, SURE = (2, 3, 5, 8), 3


class LabelModel:
    """Generative model of votes (-1, 0, 1), without any label: prior, accuracies and correlations of the voters by EM.

    The hidden class is 0 (clean) or one of some kinds of toxic texts, and P(class) * product over voters of P(vote | vote
    of the voter's parent, class) is the likelihood. Kinds carry the correlations that come from voters speaking about the
    same sort of text (a language, say, in which the others never fire); the parents, a forest of the strongest
    dependences that the class doesn't explain (conditional mutual information beyond chance), carry those of voters that
    repeat each other, which so add little. Tables are shrunk towards the voter's own accuracy, that towards rare votes
    on clean rows. EM starts from kinds of voters that fire together, and from the number of votes.
    """

    SHRINK, ROUNDS, TREES, KINDS, TOGETHER = 8.0, 60, (0, 5, 15), 12, 0.1

    def __init__(self, votes: np.ndarray, sure: np.ndarray):
        """``sure``: rows that are taken as probably toxic at the start; the others are, less so, if some voter fired."""
        level, fired = votes.astype(int) + 1, (votes > 0).astype(float)
        kind = self._kinds(fired)
        self.n_kinds = int(kind.max()) + 1
        per_kind = np.stack([fired[:, kind == c].sum(axis=1) for c in range(self.n_kinds)], axis=1)
        p = np.where(sure, 0.95, np.where(votes.sum(axis=1) > 0, 0.2, 0.01))
        share = (per_kind + 0.05) / (per_kind + 0.05).sum(axis=1, keepdims=True)
        resp = np.hstack([1 - p[:, None], p[:, None] * share])
        self.parents = np.full(votes.shape[1], -1)
        for r in range(self.ROUNDS):
            if r in self.TREES:
                self.parents = self._tree(level, resp, 0.5 if r == 0 else 0.0)
            self._estimate(level, resp)
            new = self._classes(level)
            done = np.abs(new - resp).max() < 1e-6
            resp = new
            if done and r >= self.TREES[-1]:
                break

    def _kinds(self, fired: np.ndarray) -> np.ndarray:
        """A kind for each voter: groups of voters linked by firing together; rare ones share the last kind."""
        k = fired.shape[1]
        counts = fired.sum(axis=0)
        together = fired.T @ fired / np.sqrt(np.outer(counts, counts) + 1e-9)
        linked = (together > self.TOGETHER) & np.outer(counts >= 3, counts >= 3)
        group = np.arange(k)
        for _ in range(k):
            least = np.where(linked, group[None, :], k).min(axis=1)
            least = np.minimum(group, least)
            if (least == group).all():
                break
            group = least
        mass = np.bincount(group, counts, k)
        large = [g for g in np.argsort(-mass, kind="stable") if mass[g] > 0][: self.KINDS - 1]
        names = {g: i for i, g in enumerate(large)}
        return np.array([names.get(g, len(large)) for g in group])

    def _tree(self, level: np.ndarray, resp: np.ndarray, share: float) -> np.ndarray:
        """Parent of each voter (-1: none), by a maximum spanning forest over conditional mutual information.

        It must be more than ``share`` of the entropy of one of the two: before classes are known only repeats are linked.
        """
        n, k = level.shape
        one = (level[:, :, None] == np.arange(3)).reshape(n, 3 * k).astype(float)
        gain, entropy = np.zeros((k, k)), np.zeros(k)
        for weight in resp.T:
            mass = max(weight.sum(), 1e-9)
            joint = (one * weight[:, None]).T @ one / mass
            own = np.diag(joint)
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(joint > 0, joint * np.log(joint / np.outer(own, own)), 0.0)
                entropy -= mass * np.where(own > 0, own * np.log(own), 0.0).reshape(k, 3).sum(axis=1)
            gain += mass * part.reshape(k, 3, k, 3).sum(axis=(1, 3))
        gain[gain < share * np.minimum.outer(entropy, entropy)] = 0
        least = 2 * resp.shape[1] * np.log(max(n, 2))  # a parent's four more numbers for each class must pay for themselves
        parents, best, source = np.full(k, -1), np.full(k, -np.inf), np.full(k, -1)
        left = np.ones(k, bool)
        for _ in range(k):
            j = int(np.argmax(np.where(left, best, -np.inf))) if np.isfinite(best[left]).any() else int(np.argmax(left))
            parents[j] = source[j] if best[j] > least else -1
            left[j] = False
            closer = left & (gain[j] > best)
            best[closer], source[closer] = gain[j][closer], j
        return parents

    def _cells(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, voters and cells (parent's level * 3 + own) of the votes in whose table cell somebody doesn't abstain."""
        cell = np.where(self.parents >= 0, level[:, self.parents], 1) * 3 + level
        rows, voters = np.nonzero(cell != 4)
        return rows, voters, cell[rows, voters]

    def _estimate(self, level: np.ndarray, resp: np.ndarray) -> None:
        (n, k), classes = level.shape, resp.shape[1]
        rows, voters, cell = self._cells(level)
        self.priors = (resp.sum(axis=0) + 1) / (n + classes)
        self.accuracy, self.tables = np.zeros((classes, k, 3)), np.zeros((classes, k, 3, 3))
        for y in range(classes):
            counts = np.bincount(voters * 9 + cell, resp[rows, y], 9 * k).reshape(k, 9)
            counts[:, 4] = resp[:, y].sum() - counts.sum(axis=1)
            counts = counts.reshape(k, 3, 3)
            rare = np.array([0.2, 20.0, 0.2]) if y == 0 else np.array([0.05, 1.0, 0.05])
            own = counts.sum(axis=1) + rare
            self.accuracy[y] = own / own.sum(axis=1, keepdims=True)
            table = counts + self.SHRINK * self.accuracy[y][:, None, :]
            self.tables[y] = table / table.sum(axis=2, keepdims=True)

    def _classes(self, level: np.ndarray) -> np.ndarray:
        rows, voters, cell = self._cells(level)
        odds = np.empty((len(level), len(self.priors)))
        for y in range(len(self.priors)):
            logs = np.log(self.tables[y].reshape(-1, 9))
            odds[:, y] = np.log(self.priors[y]) + logs[:, 4].sum() + np.bincount(rows, (logs - logs[:, 4:5])[voters, cell], len(level))
        odds = np.exp(odds - odds.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each row."""
        return 1 - self._classes(votes.astype(int) + 1)[:, 0]


class ToxicityModel:
    """Voters, label model and classifier learned from texts with labels (at most SAMPLE of them).

    Labels are used once: to mine the lexicons of family voters. The label model sees votes only, the classifier its
    posteriors only; the classifier's terms are mined by the posteriors, so it reaches words that no voter knows.
    """

    def __init__(self, texts: list[str], labels: np.ndarray):
        places = one_of_each(texts)
        texts, labels = [texts[i] for i in places], labels[places]
        bags = [words_in(t) for t in texts]
        self.lexicon: list[str] = []
        self.weights, self.bias, self.posterior = np.zeros(3 + RULES), -2.0, np.zeros(len(texts))
        if not len(texts) or labels.min() == labels.max():
            return
        patterns = [patterns_of(t, b) for t, b in zip(texts, bags)]
        self.voted = mine_lexicon(bags, labels.astype(float))
        votes = self.votes(bags, patterns)
        self.labels = LabelModel(votes, votes[:, RULES + COUNTS.index(SURE)] > 0)
        self.posterior = self.labels.posterior(votes)
        self.lexicon = mine_lexicon(bags, self.posterior)
        matcher = Matcher(self.lexicon)
        x = [self.features(matcher.counts(b), p) for b, p in zip(bags, patterns)]
        rows = np.repeat(np.arange(len(x)), [len(at) for at, _ in x])
        columns, values = np.concatenate([at for at, _ in x]), np.concatenate([v for _, v in x])
        w = fit_sparse_logistic(rows, columns, values, len(self.lexicon) + 3 + RULES, self.posterior, l2=0.3, steps=800)
        self.weights, self.bias = w[:-1], float(w[-1])

    def votes(self, bags: list[set[str]], patterns: list[list[int]]) -> np.ndarray:
        """Rows by voters: the rules, the counts, then a voter for each mined term (1: some word of the text carries it)."""
        matcher, first = Matcher(self.voted), RULES + len(COUNTS)
        out = np.zeros((len(bags), first + len(self.voted)))
        for i, (b, p) in enumerate(zip(bags, patterns)):
            found = [t for t in map(matcher.terms, b) if t]
            out[i, :first] = [*p, *(int(len(found) >= n) for n in COUNTS)]
            out[i, [first + t for terms in found for t in terms]] = 1
        return out

    def features(self, counts: dict[int, int], patterns: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values: each term in the text; whether any is, two are, the logarithm of the words that carry some; the rules' votes."""
        total, n = sum(counts.values()), len(self.lexicon)
        at = np.array([*counts, *range(n, n + 3 + RULES)], int)
        return at, np.array([*[1.0] * len(counts), total > 0, total > 1, np.log1p(total), *patterns], float)

    def scorer(self):
        matcher, weights, bias = Matcher(self.lexicon), self.weights, self.bias

        def score_one(text: str) -> float:
            bag = words_in(text)
            at, values = self.features(matcher.counts(bag), patterns_of(text, bag))
            return float(sigmoid(values @ weights[at] + bias))

        def score(texts: list[str]) -> list[float]:
            return [score_one(t) for t in texts]

        return score


def fit_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learn from rows of ``df`` whose ids are in ``labels`` (id, label: see bounded_sample), SAMPLE rows and SAMPLE_BYTES at most.

    Null texts are empty, null ids match nothing, rows equal in id and text count once, an id with several texts gives
    several rows; whole texts only, however long: a sample that would pass the bounds gets fewer rows.
    """
    return ToxicityModel(*labelled_texts(df, labels, id_col, text, SAMPLE, SAMPLE_BYTES))


def score_texts(df: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the model's score of every row's whole text. A column of that name is replaced, others are carried along.

    Null texts are empty; equal texts get equal scores, whatever their ids (null ones too); each row gets its own; an
    empty table gives an empty one. Very long texts are scored whole, a task holds a slice of texts at a time.
    """
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        score = model.scorer()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(pa.compute.binary_length(column).fill_null(0).to_pylist()):
                part = batch.slice(a, b - a)
                values = score([t or "" for t in column.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: learned where crc32(doc_id) mod 5 is not 0, scored everywhere; a toxic score of 0.5 is predicted 1.

    Equal texts get equal scores; an empty text gets the score of a text without any lexicon word or pattern; without labels of
    both kinds every score is that constant.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = bounded_sample(labels_of(spark, sf_dir, "toxic"), remainder("doc_id", 5) != 0, SAMPLE)
    scored = score_texts(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
