"""Document fingerprints: a sketch keeps every shingle hash below a fixed fraction of the range.

Shingles are runs of five words.  Because the threshold is the same for all documents,
sketches merge by union, and both Jaccard similarity and containment can be estimated
between documents of very unequal length.  A kept hash is cut to its 32 leading bits below
the threshold, so a sketch takes about 5.3 / ONE_IN characters for each distinct shingle.
A text whose shingles all lie above the threshold keeps its smallest hash alone (marked
``~``), so that only a text without words has an empty fingerprint; such a one-value
sketch is compared as a MinHash of one.

Null text counts as empty.  The similarity of two empty sketches is 1, that of an empty
sketch and another 0.  Repeated rows each have their fingerprint, equal ones equal ones;
other columns, of any name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import column, field, long_id, map_batches, text_or_empty
from ._words import WordHashes, shingle_set

#: One of this many shingle hashes is kept.
ONE_IN = 8


def _threshold(one_in: int) -> int:
    return ((1 << 64) - 1) // one_in


def _shift(one_in: int) -> np.uint64:
    """Bits of a kept hash that are cut off."""
    return np.uint64(_threshold(one_in).bit_length() - 32)


def sketch(shingles: np.ndarray, one_in: int = ONE_IN) -> np.ndarray:
    """The sorted shingle hashes below 2**64 / one_in, cut to 32 bits; at least the smallest."""
    n = int(np.searchsorted(shingles, np.uint64(_threshold(one_in)), side="right"))
    if n:
        return np.unique(shingles[:n] >> _shift(one_in)) << _shift(one_in)
    return shingles[:1] >> np.uint64(32) << np.uint64(32)


def is_single(s: np.ndarray, one_in: int = ONE_IN) -> bool:
    return len(s) == 1 and int(s[0]) > _threshold(one_in)


def to_string(s: np.ndarray, one_in: int = ONE_IN) -> str:
    single = is_single(s, one_in)
    short = s >> (np.uint64(32) if single else _shift(one_in))
    return "~" * single + base64.b64encode(short.astype(">u4").tobytes()).decode()


def from_string(s: str, one_in: int = ONE_IN) -> np.ndarray:
    short = np.frombuffer(base64.b64decode(s.lstrip("~")), dtype=">u4").astype(np.uint64)
    return short << (np.uint64(32) if s.startswith("~") else _shift(one_in))


def merge(a: np.ndarray, b: np.ndarray, one_in: int = ONE_IN) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return sketch(np.union1d(a, b), one_in)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(a) + len(b) - len(np.union1d(a, b))


def jaccard(a: np.ndarray, b: np.ndarray, one_in: int = ONE_IN) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if is_single(a, one_in) or is_single(b, one_in):
        return float(a[0] == b[0])
    n = _shared(a, b)
    return n / (len(a) + len(b) - n)


def containment(a: np.ndarray, b: np.ndarray, one_in: int = ONE_IN) -> float:
    """Estimated part of a's shingles that b has too."""
    if not len(a) or not len(b):
        return float(not len(a))
    return _shared(a, b) / len(a)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """Id and fingerprint (string) of every whole text, one row per row; other columns are ignored."""
    schema = f"{field(df, id_col)}, fingerprint string"

    def run(batches):
        cache = WordHashes()
        for b in batches:
            yield {id_col: b[id_col], "fingerprint": [to_string(sketch(shingle_set(t, cache), one_in), one_in) for t in b["_text"]]}

    return map_batches(df.select(column(id_col), text_or_empty(text_col).alias("_text")), run, schema)


#: Rows that one task puts in order, about, and ranges at most; beyond that a range holds more rows, which
#: its task sorts on disk and passes through one by one.
ROWS_PER_RANGE, MOST_RANGES = 100_000, 16_384


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at most the key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps, step = [], 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    table = F.lit(np.array(bounds, dtype=np.int64))
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.try_element_at(table, at + s) <= key), at + s).otherwise(at),
    )


def _even(key: Column, parts: int) -> Column:
    """Which of ``parts`` equal ranges of 64-bit numbers the key is in."""
    return F.floor((F.shiftright(key, 32) + F.lit(1 << 31)) * F.lit(parts) / F.lit(1 << 32)).cast("int")


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next text, in one shuffle of the texts.

    The next row is that with the next larger id, among equal ids by the text, after the last
    the first; rows with a null id come first, by a hash of their text.  A single row is its
    own next.  The edited text is the text with its last floor(n/2) code points replaced by
    the first as many of the next text.

    Rows go to ranges that hold about equally many (bounds from a quantile sketch of the id
    column alone; hashes of texts without an id are even by themselves).  The first row's key
    of each range, one number per range, is known beforehand, so that row also goes to the
    range before; each range then needs no other.
    """
    spark = df.sparkSession
    text = text_or_empty(text_col)
    own = long_id(df, id_col)
    key = F.coalesce(own, F.xxhash64(text))
    keys = df.select(own.isNotNull().alias("known"), key.alias("k"))
    counted = keys.agg(F.count("*").alias("n"), F.count_if(~F.col("known")).alias("free")).head()
    rows = counted.n
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))
    parts = max(1, min(parts, rows // 16, MOST_RANGES))
    # Ranges for rows without an id, then those for the others.
    free = -(-parts * counted.free // rows) if counted.free else 0
    named = max(1, parts - free) if counted.free < rows else 0
    found = keys.where("known").agg(F.percentile_approx("k", F.lit([i / named for i in range(1, named)]), F.lit(max(10_000, 20 * named))).alias("q")).head().q if named > 1 else None
    bounds = sorted(set(found or []))
    n = free + len(bounds) + 1
    at = F.col("known").cast("int") * free + F.when(F.col("known"), _range_of(F.col("k"), bounds)).otherwise(_even(F.col("k"), free)) if free else _range_of(F.col("k"), bounds)
    first = {r.b: r.k for r in keys.withColumn("b", at).groupBy("b").agg(F.min("k").alias("k")).collect()}
    order = sorted(first)
    firsts, before = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, b in enumerate(order):
        firsts[b], before[b] = first[b], order[i - 1]
    b = F.col("b")
    here = F.struct(b.cast("int").alias("b"), F.lit(0).alias("ahead"))
    ahead = F.struct(F.element_at(F.lit(before), b + 1).cast("int").alias("b"), F.lit(1).alias("ahead"))
    dealt = (
        df.select(column(id_col).alias("_id"), own.isNotNull().alias("known"), key.alias("k"), text.alias("_text"))
        .withColumn("b", at)
        .withColumn("to", F.when(F.col("k") == F.element_at(F.lit(firsts), b + 1), F.array(here, ahead)).otherwise(F.array(here)))
        .select("_id", "k", "_text", F.explode("to").alias("to"))
        .select("_id", "k", "_text", "to.b", "to.ahead")
        .repartitionById(n, F.col("b"))
        .sortWithinPartitions("b", "ahead", "k", "_text")
    )
    schema = f"{field(df, id_col)}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        cache = WordHashes()
        last = None  # (id, text, sketch) of the row that waits for its next

        def row(own, nxt):
            i, text, s = own
            half = len(text) // 2
            edited = text[: len(text) - half] + nxt[1][:half]
            e = sketch(shingle_set(edited, cache), one_in)
            return i, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_string(s, one_in), to_string(e, one_in), jaccard(s, e, one_in), jaccard(s, nxt[2], one_in)

        for b in batches:
            out = []
            for i, text, ahead in zip(b["_id"], b["_text"], b["ahead"]):
                if ahead and last is None:
                    continue  # a second row with the next range's first id
                own = (i, text, sketch(shingle_set(text, cache), one_in))
                if last is not None:
                    out.append(row(last, own))
                last = None if ahead else own
            cols = list(zip(*out)) or [()] * 7
            yield dict(zip((id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"), map(list, cols)))
        assert last is None, "a range without the row after it"

    return map_batches(dealt.select("_id", "_text", "ahead"), run, schema)
