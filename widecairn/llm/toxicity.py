"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees which words a text has and
the probabilities that the chain gave to the categories before.  While fitting, those
earlier probabilities are out-of-fold predictions, so that a later model learns from
probabilities as unsure as those it will meet.  Beginnings of words are features too, which
inflected and compound words share.  No list of words is given: all is learnt from labels.

The label table marks a text as toxic or not.  The first links predict kinds of toxicity,
``KINDS`` clusters of the toxic texts by the words that set these apart (``kinds_of``), and
the last link predicts the mark itself, for which it has the kinds' probabilities.

The fit uses at most ``TRAIN_ROWS`` labelled texts, and of each its ``SAMPLE_WORDS``
distinct words with the smallest hashes at most.  Scores use the whole text: all its
distinct words.  Null and empty texts have no words; their score is the intercepts'.
Without labelled texts every probability is 0.  Each row, repeated or not, has its score;
labels that are null, or of an id that is labelled twice, teach nothing; an empty table
gives no rows; other columns, of any name, are ignored by ``score`` and kept by
``accepted``.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from ._frames import column, field, map_batches, map_rows, text_or_empty
from ._linear import fit_logistic, labelled, sigmoid

#: Kinds of toxicity, the first links; the last predicts the mark.
KINDS = 3
CATEGORIES = (*(f"kind{k + 1}" for k in range(KINDS)), "toxic")
#: Labelled texts for the fit at most, their words at most, texts a word must occur in, words of a model, folds.
TRAIN_ROWS, SAMPLE_WORDS, LEAST_TEXTS, WORDS, FOLDS = 6000, 20_000, 3, 600, 5
#: Standard errors by which a feature's shares must differ to tell kinds apart.
SURE = 4
#: Lengths of beginnings of words, which are features as words are.
BEGINNINGS = (4, 5, 6, 7)
#: Share of real hits among out-of-fold hits from which the threshold is taken.
PRECISION = 0.97

_words = re.compile(r"[^\W\d_]+").findall


def features_of(words: set[str]) -> set[str]:
    """The words and their beginnings."""
    found = {w[:n] for w in words for n in BEGINNINGS if len(w) > n}
    found.update(words)
    return found


def words_in(text: str) -> set[str]:
    return features_of(set(_words(text.lower())))


class Chain:
    def __init__(self, vocabulary: list[str], weights: list[np.ndarray], threshold: float):
        self.vocabulary, self.weights, self.threshold = vocabulary, weights, threshold

    def tables(self) -> tuple[dict[str, int], np.ndarray]:
        n = len(self.vocabulary)
        return {w: i for i, w in enumerate(self.vocabulary)}, np.array([w[:n] for w in self.weights])


class Texts:
    """Features of the sample's texts, made anew at each pass: only the distinct words are held."""

    def __init__(self, words: list[str]):
        self.words = words

    def __len__(self) -> int:
        return len(self.words)

    def __iter__(self):
        return (features_of(set(w.split("\n")) - {""}) for w in self.words)


def select_words(texts: Texts, y: np.ndarray) -> list[str]:
    """The features that differ most between toxic and other texts, by the chi-squared statistic."""
    n, n1 = len(texts), float(y.sum())
    # Counts by hash come first, so that the many features of one or two texts take no memory.
    cells = np.zeros(1 << 21, dtype=np.int32)
    for s in texts:
        cells[np.fromiter((hash(w) & 0x1FFFFF for w in s), dtype=np.int64, count=len(s))] += 1
    often = bytes(np.minimum(cells, LEAST_TEXTS).astype(np.uint8))
    count: dict[str, int] = {}
    for s, t in zip(texts, y):
        one = 1 << 32 if t else 1
        for w in s:
            if often[hash(w) & 0x1FFFFF] == LEAST_TEXTS:
                count[w] = count.get(w, 0) + one
    scored = []
    for w, c in count.items():
        a, b = c & 0xFFFFFFFF, c >> 32
        if a + b >= LEAST_TEXTS:
            d = a + b
            expected = d * n1 / n
            scored.append(((b - expected) ** 2 / max(expected * (1 - n1 / n) * (1 - d / n) + 1e-9, 1e-9), w))
    scored.sort(key=lambda x: (-x[0], x[1]))
    return [w for _, w in scored[:WORDS]]


def kinds_of(x: np.ndarray, toxic: np.ndarray, kinds: int = KINDS, rounds: int = 20) -> np.ndarray:
    """The kind of each toxic text, -1 of all others: clusters by the cosine of the features that toxic texts surely have more often."""
    out = np.full(len(x), -1)
    rows = np.flatnonzero(toxic)
    if not len(rows):
        return out
    share, rest = x[rows].mean(axis=0), x[toxic == 0].mean(axis=0) if (toxic == 0).any() else np.zeros(x.shape[1])
    both = np.clip(x.mean(axis=0), 1e-6, 1 - 1e-6)
    sure = share - rest > SURE * np.sqrt(both * (1 - both) * (1 / len(rows) + 1 / max(1, len(x) - len(rows))))
    y = x[rows][:, sure].astype(np.float64)
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    # Each next centre is the text farthest from those before.
    centres = [y.mean(axis=0)]
    for _ in range(kinds):
        near = np.max([y @ c / max(np.linalg.norm(c), 1e-9) for c in centres], axis=0)
        centres.append(y[int(near.argmin())])
    c = np.array(centres[1:])
    for _ in range(rounds):
        at = (y @ c.T).argmax(axis=1)
        c = np.array([y[at == k].sum(axis=0) if (at == k).any() else c[k] for k in range(kinds)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    out[rows] = (y @ c.T).argmax(axis=1)
    return out


def fit_chain(texts: Texts, toxic: np.ndarray, ids: list[int]) -> Chain:
    if not len(texts):
        return Chain([], [np.array([-1e9]) for _ in CATEGORIES], 0.5)
    vocabulary = select_words(texts, toxic)
    at = {w: i for i, w in enumerate(vocabulary)}
    known, n = set(at), len(vocabulary)
    x = np.zeros((len(texts), n + len(CATEGORIES) - 1), dtype=np.float32)
    for row, s in enumerate(texts):
        x[row, [at[w] for w in known & s]] = 1
    fold = np.array([(int(i) * 0x9E3779B1 & 0xFFFFFFFF) >> 8 for i in ids]) % FOLDS
    kind = kinds_of(x[:, :n], toxic)
    weights, out = [], toxic
    for k, y in enumerate([*((kind == k).astype(np.float64) for k in range(KINDS)), toxic]):
        w, out = fit_link(x[:, : n + k], y, fold)
        weights.append(w)
        if k < KINDS:
            x[:, n + k] = out
    order = np.argsort(-out, kind="stable")
    hits = np.cumsum(toxic[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(hits >= PRECISION)
    threshold = float(np.clip(out[order][good[-1]], 0.2, 0.8)) if len(good) else 0.5
    return Chain(vocabulary, weights, threshold)


def fit_link(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a fit of all rows, and each row's probability by the fit without its fold."""
    w = fit_logistic(x, y, np.hstack([fold[:, None] != np.arange(FOLDS), np.ones((len(y), 1), dtype=bool)]))
    z = np.empty(len(y))
    for f in range(FOLDS):
        z[fold == f] = x[fold == f] @ w[:-1, f] + w[-1, f]
    return w[:, -1], sigmoid(z)


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Chain:
    """Fit on a bounded sample; the tasks send each text's distinct words."""

    def distinct(text: str) -> str:
        words = sorted(set(_words(text.lower())))
        if len(words) > SAMPLE_WORDS:
            words = sorted(sorted(words, key=lambda w: xxhash.xxh3_64_intdigest(w))[:SAMPLE_WORDS])
        return "\n".join(words)

    def run(batches):
        for b in batches:
            yield {"id": b["_id"], "toxic": b["toxic"], "words": [distinct(t) for t in b["_text"]]}

    sample = map_batches(labelled(docs, labels, ["toxic"], most, id_col, text_col), run, "id long, toxic int, words string")
    rows = sorted(sample.collect())
    return fit_chain(Texts([r.words for r in rows]), np.array([float(r.toxic > 0) for r in rows]), [r.id for r in rows])


class Scorer:
    """The chain's probabilities of a text, one for each category."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.at, self.table = chain.tables()
        self.known = set(self.at)

    def __call__(self, text: str) -> np.ndarray:
        # Sorted, so that sums, and scores with them, don't depend on the order of a set.
        found = sorted(self.at[w] for w in self.known.intersection(words_in(text)))
        z = self.table[:, found].sum(axis=1) if found else np.zeros(len(CATEGORIES))
        p, n = np.zeros(len(CATEGORIES)), len(self.at)
        for k, w in enumerate(self.chain.weights):
            p[k] = sigmoid(z[k] + p[:k] @ w[n : n + k] + w[-1]) if w[-1] > -1e8 else 0.0
        return p


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probabilities of each category and the decision for every whole text, one row per row."""
    schema = f"{field(df, id_col)}, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"

    def run(batches):
        own = Scorer(chain)
        for b in batches:
            p = np.array([own(t) for t in b["_text"]])
            yield {id_col: b["_id"], **{f"p_{c}": p[:, k] for k, c in enumerate(CATEGORIES)}, "toxic": p[:, -1] >= chain.threshold}

    return map_batches(df.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), run, schema)


def accepted(df: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the chain doesn't take for toxic."""

    def make():
        own = Scorer(chain)
        return lambda texts: ([not own(t or "")[-1] >= chain.threshold for t in texts], None)

    return map_rows(df, text_col, make)
