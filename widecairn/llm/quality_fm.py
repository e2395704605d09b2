"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).  The pairwise part is
computed in linear time as half of |sum_i v_i x_i|^2 - sum_i |v_i x_i|^2.

Features: distinct lower-cased words hashed into WORD_BINS numbers, each with value
1 / sqrt(number of distinct words); a one for the bin of each structure statistic; and
the same for the length in characters, the row's only metadata here.  Labels, language,
source and id are no features.

The fit uses at most ``TRAIN_ROWS`` labelled texts.  Null text counts as empty; an empty
text has statistics of 0 and is scored by them.  Without labelled texts scores are 0.5.
Each row, repeated or not, has its score, rows with a null id too (never held out); labels
that are null, or of an id that is labelled twice, teach nothing; an empty table gives no
rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import column, field, map_batches, text_or_empty
from ._linear import labelled, sigmoid
from ._words import WordHashes

WORD_BINS, FACTORS, CUTS = 1 << 13, 6, 9
#: Labelled texts for the fit at most, passes over them.
TRAIN_ROWS, EPOCHS = 8000, 6

STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_chars", "line_words", "distinct_words", "distinct_lines", "distinct_pairs",
    "upper", "digit", "mark", "exclamation", "bar", "symbol", "marked_words", "stop", "longest_word", "capitalised",
)

_CLASS = np.zeros((256, 7))
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = (_i < 128 and _c.isupper(), _i < 128 and _c.isdigit(), _i < 128 and not _c.isalnum() and not _c.isspace(), _c == "!", _c == "|", _c in "#$%&*@<>{}[]\\^~=_", _c == ".")


def statistics(text: str, words: list[str]) -> list[float]:
    """Structure of a text; shares are of its bytes, words or lines."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    share = np.bincount(raw, minlength=256) @ _CLASS / max(1, len(raw))
    lines, n = text.split("\n"), max(1, len(words))
    pairs = set(zip(words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), len(text) / n, n / len(lines),
        len(set(words)) / n, len(set(lines)) / len(lines), len(pairs) / max(1, len(words) - 1),
        share[0], share[1], share[2], share[3], share[4], share[5],
        sum([not w[-1].isalnum() for w in words]) / n, share[6], max(map(len, words), default=0), sum([w[0].isupper() for w in words]) / n,
    ]


class Machine:
    """Weights by feature number: words first, then bins of each statistic."""

    def __init__(self, cuts: list[np.ndarray], bias: float, w: np.ndarray, v: np.ndarray):
        self.cuts, self.bias, self.w, self.v = cuts, bias, w, v

    def numbers(self, word_bins: np.ndarray, stats) -> tuple[np.ndarray, np.ndarray]:
        found = [WORD_BINS + j * (CUTS + 1) + int(np.searchsorted(c, stats[j])) for j, c in enumerate(self.cuts)]
        x = np.concatenate([np.full(len(word_bins), 1 / np.sqrt(max(1, len(word_bins)))), np.ones(len(found))])
        return np.concatenate([word_bins, np.array(found, dtype=np.int64)]), x

    def raw(self, i: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        vx = self.v[i] * x[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.w[i] @ x + 0.5 * (total @ total - (vx * vx).sum())), vx, total


def word_bins(words: list[str], cache: WordHashes) -> np.ndarray:
    return np.unique(cache.array([w.lower() for w in words]) % np.uint64(WORD_BINS)).astype(np.int64)


def fit_machine(rows: list[tuple[np.ndarray, list[float], float]], seed: int = 5, epochs: int = EPOCHS, rate: float = 0.05, ridge: float = 2e-5) -> Machine:
    """Adagrad over single rows, in an order drawn anew for each pass."""
    size = WORD_BINS + len(STATISTICS) * (CUTS + 1)
    rng = np.random.default_rng(seed)
    if not rows:
        return Machine([np.zeros(0)] * len(STATISTICS), 0.0, np.zeros(size), np.zeros((size, FACTORS)))
    stats = np.array([r[1] for r in rows])
    cuts = [np.unique(np.quantile(stats[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(stats.shape[1])]
    y = np.array([r[2] for r in rows])
    p = float(np.clip(y.mean(), 0.01, 0.99))
    m = Machine(cuts, float(np.log(p / (1 - p))), np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)))
    found = [m.numbers(r[0], r[1]) for r in rows]
    gw, gv, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x = found[k]
            z, vx, total = m.raw(i, x)
            g = float(sigmoid(z) - y[k])
            dw = g * x + ridge * m.w[i]
            dv = g * (x[:, None] * total - vx * x[:, None]) + ridge * m.v[i]
            gw[i] += dw * dw
            gv[i] += dv * dv
            gb += g * g
            m.w[i] -= rate * dw / np.sqrt(gw[i])
            m.v[i] -= rate * dv / np.sqrt(gv[i])
            m.bias -= rate * g / gb**0.5
    return m


def in_training(doc_id):
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Machine:
    """Fit on a bounded sample of labelled rows; the tasks send features, not texts."""

    def run(batches):
        cache = WordHashes()
        for b in batches:
            words = [t.split() for t in b["_text"]]
            yield {
                "id": b["_id"],
                "quality": b["quality"],
                "bins": [word_bins(w, cache).astype(np.int32).tobytes() for w in words],
                "stats": [[float(x) for x in statistics(t, w)] for t, w in zip(b["_text"], words)],
            }

    sample = map_batches(labelled(docs, labels, ["quality"], most, id_col, text_col, in_training), run, "id long, quality int, bins binary, stats array<double>")
    rows = sorted(sample.collect())
    return fit_machine([(np.frombuffer(r.bins, dtype=np.int32).astype(np.int64), r.stats, float(r.quality > 0)) for r in rows])


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """held_out, score and predicted for every whole text, one row per row; other columns are ignored."""
    schema = f"{field(df, id_col)}, held_out boolean, score double, predicted int"

    def run(batches):
        cache = WordHashes()
        for b in batches:
            out = []
            for text in b["_text"]:
                words = text.split()
                out.append(float(sigmoid(machine.raw(*machine.numbers(word_bins(words, cache), statistics(text, words)))[0])))
            yield {id_col: b["_id"], "held_out": b["_held"], "score": out, "predicted": [int(p >= least) for p in out]}

    held = ~in_training(column(id_col)) & column(id_col).isNotNull()
    return map_batches(df.select(column(id_col).alias("_id"), held.alias("_held"), text_or_empty(text_col).alias("_text")), run, schema)
