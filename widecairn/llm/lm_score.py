"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models of the same form and over one vocabulary are counted from
the whole corpus: a background model from all texts and a target model from the texts
marked as target.  A text's score is the mean, over its tokens, of the target model's
loss less the background model's: low scores are like the target.

Vocabulary: every word (lower-cased, split at white space), however rare, the end of a text,
which is a token too, so that an empty text has one, and an unknown token that has only
its added count.

A token's probability is BIGRAM times the share of its bigram among those of the word
before, and (1 - BIGRAM) times the share of the word among all, with ADDED to its count.
Each text is scored without its own counts in a model that it was counted in.

Counts: words and bigrams are counted exactly, by 64-bit hashes.  Texts are taken in chunks
of about ``CHUNK`` tokens.  A chunk's distinct words and bigrams go, with their counts, to
the parts of the range of hashes; a part adds up the counts of all chunks and answers each
chunk with the sums of what it asked for.  Within a chunk a common bigram is one entry, so
no key is hot.  No task holds more than a chunk (or one text, if that is longer) or a part,
and the driver only totals.

A row is target if its id is marked by any label row; null ids never are.  Repeated rows
count and are scored each, so a text that occurs twice is scored with its other copy's
counts.  Null text counts as empty; an empty table gives no rows; other columns, of any
name, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import column, field, map_batches, stored, text_or_empty
from ._packed import pack, part_bounds, unpack
from ._words import mix64, words_of

CHUNK = 1 << 20
#: Numbers of the unknown token and of text ends in every chunk.
UNKNOWN, END = 0, 1
#: Weight of bigrams in the interpolation, and added count of each word.
BIGRAM, ADDED = 0.6, 0.5
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 200_000

_SINGLE, _FIRST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for t in b["_text"]:
                held.update(words_of(t))
                if len(held) > HELD_WORDS:
                    yield {"word": list(held), "n": list(held.values())}
                    held = Counter()
        yield {"word": list(held), "n": list(held.values())}

    return map_batches(df.select(text_or_empty(text_col).alias("_text")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """The vocabulary in ascending order, read from a distributed count when it is asked for."""

    def __init__(self, df: DataFrame, text_col: str, count: int):
        self.table, self.count = word_counts(df, text_col), count

    def __iter__(self) -> Iterator[str]:
        return (r.word for r in self.table.select("word").orderBy("word").toLocalIterator())

    def __len__(self) -> int:
        return self.count

    def __eq__(self, other) -> bool:
        return list(self) == list(other)

    __hash__ = None


class Numbers(dict):
    """word -> number within a chunk, given on demand."""

    def __init__(self):
        # No word is empty or has a space.
        super().__init__({"": UNKNOWN, " ": END})

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self), dtype=np.uint64, count=len(self))


def _own(x: np.ndarray) -> np.ndarray:
    """How often each value occurs in the array, at its places."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[at]


class Chunk:
    """Texts one after the other, an end before, between and after them, with their distinct words and bigrams."""

    def __init__(self, tokens: bytes, hashes: bytes):
        x, own = unpack(tokens, np.uint32).astype(np.int64), unpack(hashes, np.uint64)
        self.before, self.own, self.words = x[:-1], x[1:], len(own)
        #: The text of each token but the first end.
        self.text = np.cumsum(self.before == END) - 1
        both, self.pair = np.unique(self.before * self.words + self.own, return_inverse=True)
        a, b = np.divmod(both, self.words)
        keys = np.concatenate([mix64(own ^ _SINGLE), mix64(mix64(own[a] ^ _FIRST) * np.uint64(3) + own[b])])
        #: Keys in ascending order; the words' come first before.
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts by key in all texts and in the target texts."""
        y, pairs = target[self.text], len(self.keys) - self.words
        n = np.concatenate([np.bincount(self.own, minlength=self.words), np.bincount(self.pair, minlength=pairs)])
        m = np.concatenate([np.bincount(self.own[y], minlength=self.words), np.bincount(self.pair[y], minlength=pairs)])
        return n[self.order].astype(np.uint32), m[self.order].astype(np.uint32)

    def bounds(self, parts: int) -> list[int]:
        """Where each part's keys begin, and the end."""
        return part_bounds(self.keys, parts)

    def losses(self, sums: list[np.ndarray], target: np.ndarray, total: list[int], size: int) -> np.ndarray:
        """Mean losses in nats by token of the background and target models (rows), without each text's own counts."""
        own_words, own_pairs = _own(self.text * self.words + self.own), _own(self.text * len(self.keys) + self.pair)
        # Contexts are the same tokens as those predicted: the end before a text stands for the end after it.
        own_before = _own(self.text * self.words + self.before)
        starts = np.flatnonzero(self.before == END)
        sizes = np.diff([*starts, len(self.own)])
        out = np.empty((2, len(starts)))
        for m, held in enumerate((np.ones(len(starts), dtype=np.int64), target.astype(np.int64))):
            by_key = np.empty(len(self.keys), dtype=np.int64)
            by_key[self.order] = sums[m].astype(np.int64)
            mine = held[self.text]
            n = by_key[self.before] - mine * own_before
            pair = (by_key[self.words + self.pair] - mine * own_pairs) / np.maximum(n, 1)
            single = (by_key[self.own] - mine * own_words + ADDED) / (total[m] - mine * sizes[self.text] + ADDED * size)
            out[m] = np.add.reduceat(-np.log(BIGRAM * pair + (1 - BIGRAM) * single), starts) / sizes if len(starts) else 0
        return out


def _chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts in chunks: chunk, ids, sizes (tokens of each text), tokens (numbers within the chunk), hashes (of the words by number)."""

    def run(batches):
        first, made = TaskContext.get().partitionId() << 32, 0

        def emit():
            return {"chunk": [first + made], "ids": [ids], "sizes": [sizes], "tokens": [pack(np.concatenate(tokens).astype(np.uint32))], "hashes": [pack(table.hashes())]}

        ids, sizes, tokens, table, held = [], [], [np.array([END])], Numbers(), 0
        for b in batches:
            for i, t in zip(b["_id"], b["_text"]):
                words = words_of(t)
                ids.append(i)
                sizes.append(len(words) + 1)
                tokens.append(np.fromiter(map(table.__getitem__, [*words, " "]), dtype=np.int64, count=len(words) + 1))
                held += len(words) + 1
                if held >= CHUNK:
                    yield emit()
                    made += 1
                    ids, sizes, tokens, table, held = [], [], [np.array([END])], Numbers(), 0
        if ids:
            yield emit()

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), run, f"chunk long, ids array<{kind}>, sizes array<long>, tokens binary, hashes binary")


def _marks(chunks: DataFrame, target: DataFrame) -> DataFrame:
    """Places of the target texts in each chunk that has any, and their tokens."""
    ids = target.select(F.col(target.columns[0]).alias("_id")).where("_id is not null").distinct()
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "sizes")).alias("at", "x")).select("chunk", "at", F.col("x.ids").alias("_id"), F.col("x.sizes").alias("size"))
    # The marks grow with the corpus: they are joined by a shuffle at every size.
    return rows.join(ids.hint("merge"), "_id").groupBy("chunk").agg(F.collect_list("at").alias("marked"), F.sum("size").alias("size"))


def _target(n: int, marked: list | None) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[marked or []] = True
    return out


class Models:
    """The chunks that both models are counted from, the target texts among them, and totals, background first."""

    def __init__(self, texts: DataFrame, chunks: DataFrame, marks: DataFrame, size: int):
        self.texts, self.chunks, self.marks, self.size = texts, chunks, marks, size
        counted = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).head()[0]
        self.total = [counted or 0, marks.agg(F.sum("size")).head()[0] or 0]


def _distinct_words(chunks: DataFrame, parts: int) -> int:
    """Number of distinct words in all chunks, the unknown token and ends among them."""

    def cut(batches):
        for b in batches:
            for raw in b["hashes"]:
                x = np.sort(unpack(raw, np.uint64))
                at = np.searchsorted(x, np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64))
                yield {"part": list(range(parts)), "keys": [pack(np.diff(y, prepend=np.uint64(0))) for y in np.split(x, at)]}

    def count(batches):
        rows = (r for b in batches for r in zip(b["part"], b["keys"]))
        for _, some in groupby(rows, key=lambda r: r[0]):
            yield {"n": [len(np.unique(np.concatenate([np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for _, k in some])))]}

    keys = map_batches(chunks.select("hashes"), cut, "part int, keys binary").repartition(parts, "part").sortWithinPartitions("part")
    return map_batches(keys, count, "n long").agg(F.coalesce(F.sum("n"), F.lit(2))).head()[0]


def fit(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Words, Models]:
    """The vocabulary and both models. ``target``: one column of ids, the target texts."""
    chunks = stored(_chunks(df, id_col, text_col), "chunks")
    size = _distinct_words(chunks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return Words(df, text_col, size - 2), Models(df, chunks, stored(_marks(chunks, target), "marks"), size)


def _dealt(models: Models, parts: int) -> DataFrame:
    """The chunks with their marks; both uses have the same columns, so that Spark shuffles the chunks once."""
    return models.chunks.repartition(parts, "chunk").join(models.marks.select("chunk", "marked").hint("merge"), "chunk", "left")


def _sums(models: Models, parts: int) -> DataFrame:
    """For each chunk and part, the counts in all chunks of the chunk's keys in that part: chunk, part, n, m."""

    def ask(batches):
        for b in batches:
            for chunk, sizes, tokens, hashes, marked in zip(b["chunk"], b["sizes"], b["tokens"], b["hashes"], b["marked"]):
                c = Chunk(tokens, hashes)
                at, (n, m) = c.bounds(parts), c.counts(_target(len(sizes), marked))
                out: dict[str, list] = {k: [] for k in ("chunk", "part", "keys", "n", "m")}
                for k, (i, j) in enumerate(zip(at, at[1:])):
                    if i < j:
                        for name, x in (("chunk", chunk), ("part", k), ("keys", pack(np.diff(c.keys[i:j], prepend=np.uint64(0)))), ("n", pack(n[i:j])), ("m", pack(m[i:j]))):
                            out[name].append(x)
                yield out

    def answer(batches):
        rows = (r for b in batches for r in zip(b["part"], b["chunk"], b["keys"], b["n"], b["m"]))
        for part, some in groupby(rows, key=lambda r: r[0]):
            chunks, keys, n, m = [], [], [], []
            for _, chunk, k, x, y in some:
                chunks.append(chunk)
                keys.append(np.cumsum(unpack(k, np.uint64), dtype=np.uint64))
                n.append(unpack(x, np.uint32))
                m.append(unpack(y, np.uint32))
            ends = np.cumsum([len(k) for k in keys])[:-1]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = [np.split(np.bincount(at, np.concatenate(x)).astype(np.uint64)[at], ends) for x in (n, m)]
            for lo in range(0, len(chunks), 100):
                hi = lo + 100
                yield {"chunk": chunks[lo:hi], "part": [part] * len(chunks[lo:hi]), "n": [pack(x) for x in sums[0][lo:hi]], "m": [pack(x) for x in sums[1][lo:hi]]}

    asked = map_batches(_dealt(models, parts), ask, "chunk long, part int, keys binary, n binary, m binary")
    return map_batches(asked.repartition(parts, "part").sortWithinPartitions("part"), answer, "chunk long, part int, n binary, m binary")


def score(df: DataFrame, target: DataFrame, words: Words, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, loss_background, loss_target and their difference, score, of every whole text that the models were counted from."""
    if not df.sameSemantics(models.texts):
        raise ValueError("score() takes the texts that fit() counted")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, size = models.total, models.size
    schema = f"{field(df, id_col)}, n_tokens long, loss_background double, loss_target double, score double"

    def run(batches):
        for b in batches:
            for ids, sizes, tokens, hashes, marked, sums in zip(*(b[c] for c in ("ids", "sizes", "tokens", "hashes", "marked", "sums"))):
                both = [np.concatenate([unpack(x[c], np.uint64) for x in sums]) for c in "nm"]
                loss = Chunk(tokens, hashes).losses(both, _target(len(ids), marked), total, size)
                for lo in range(0, len(ids), 1000):
                    x, y = loss[:, lo : lo + 1000]
                    yield {id_col: ids[lo : lo + 1000], "n_tokens": sizes[lo : lo + 1000], "loss_background": x, "loss_target": y, "score": y - x}

    sums = _sums(models, parts).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "n", "m"))).alias("sums"))
    # Every chunk has sums; an inner join would put a filter under one of the two shuffles and so make them differ.
    return map_batches(_dealt(models, parts).join(sums.hint("merge"), "chunk", "left"), run, schema)
