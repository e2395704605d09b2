"""All pairs of texts whose five-word shingles have a Jaccard similarity of at least 0.8.

1.  Texts with equal shingle sets are copies: one class, represented by its smallest id.
2.  Banded MinHash values of the representatives give buckets.  30 bands of 5 rows miss a
    pair at the threshold with probability (1 - 0.8**5)**30 < 1e-5.  Buckets with the same
    members are one bucket; a pair belongs to the first band in which it meets.
3.  Large buckets are cut into blocks by a hash of the id, and every two blocks meet in a
    task of their own; no pair is written anywhere before it is decided on.
4.  In a task, MinHash values are compared 30 at a time, and a pair is dropped once the
    posterior probability that it reaches the threshold falls below ``TOLERANCE``.
5.  The pairs left are verified exactly on their shingle hashes.  A task hands on, for each
    of its texts, the number of its links and the smallest id it is connected with, so its
    output is as long as its input however many pairs it holds.

A text without words has no links.  Null text counts as empty.  A row with a null id has no
class and no links.  Repeated rows are copies of themselves and count once; texts that
share an id share a class.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import connected_components
from ._frames import Scratch, column, long_id, map_batches, stored, text_or_empty
from ._linkage import linked_sets
from ._words import MinHasher, WordHashes, band_keys, shingle_set

BANDS, ROWS, THRESHOLD, TOLERANCE = 30, 5, 0.8, 1e-6
#: Masks of dropped ids that go to every task; more are joined by a shuffle of the rows.
SENT_MASKS = 1 << 20


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """id, set (hash of the shingle set in two halves; null without words or id), shingles, band keys."""

    def run(batches):
        cache, hasher = WordHashes(), MinHasher(bands * rows)
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("id", "s1", "s2", "n", "keys")}
            for i, text in zip(b["id"], b["_text"]):
                s = shingle_set(text, cache)
                found = len(s) > 0 and i is not None
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                out["id"].append(i)
                out["s1"].append(_signed(h >> 64) if found else None)
                out["s2"].append(_signed(h & ((1 << 64) - 1)) if found else None)
                out["n"].append(len(s))
                out["keys"].append(band_keys(hasher(s), rows)[0] if found else None)
            yield out

    return map_batches(df.select(long_id(df, id_col).alias("id"), text_or_empty(text_col).alias("_text")), run, "id long, s1 long, s2 long, n int, keys array<long>")


def similarity_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row: id, class_id, copy_id, n_copies, n_links.

    copy_id: smallest id with the same shingles; n_copies: ids with them.  n_links: other
    ids whose text reaches the threshold, copies included.  class_id: smallest id that a
    chain of links leads to; a row without links has its own id.
    """
    with Scratch() as scratch:
        marks = scratch.stored(signatures(df, id_col, text_col, bands, rows), "marks")
        ids = marks.where("s1 is not null").select("id", "s1", "s2").distinct()
        sets = ids.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        by_set = marks.where("s1 is not null").groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
        reps = scratch.stored(sets.join(by_set, ["s1", "s2"]), "reps")

        count = bands * rows

        def members_of(wanted):
            texts = df.select(long_id(df, id_col).alias("rep"), text_or_empty(text_col).alias("_text")).join(wanted, "rep").select("rep", "copies", "_text")

            def shingles(batches):
                cache, hasher = WordHashes(), MinHasher(count)
                for b in batches:
                    sets = [shingle_set(t, cache) for t in b["_text"]]
                    signs = [hasher(s) for s in sets]
                    yield {"rep": b["rep"], "copies": b["copies"], "keys": [band_keys(s, rows)[0].tobytes() for s in signs], "signature": [s.tobytes() for s in signs], "shingles": [s.tobytes() for s in sets]}

            return map_batches(texts, shingles, "rep long, copies long, keys binary, signature binary, shingles binary")

        found = linked_sets(reps, members_of, threshold, TOLERANCE, scratch)
        linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
        # Texts that share an id belong together too.
        shared = ids.join(sets, ["s1", "s2"]).groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("lo", "hi")
        roots = connected_components(found.select("rep", "root").unionByName(shared.toDF("rep", "root")), scratch)
        named = sets.join(linked, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        # Written, so that the last join shuffles both sides and a large group of copies can be split.
        named = scratch.stored(named.select("s1", "s2", "rep", "copies", F.coalesce("root", "rep").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked")), "named")
        return stored(
            marks.select("id", "s1", "s2")
            .join(named, ["s1", "s2"], "left")
            .select(
                F.col("id").cast(df.schema[id_col].dataType).alias(id_col),
                F.coalesce("root", "id").alias("class_id"),
                F.coalesce("rep", "id").alias("copy_id"),
                F.coalesce("copies", F.lit(1)).alias("n_copies"),
                (F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
            ),
            "classes",
        )


def without(df: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id isn't in the one column of ``dropped``; whole rows aren't shuffled for up to SENT_MASKS masks of 64 ids."""
    gone = long_id(dropped, id_col).alias("_gone")
    masks = dropped.where(column(id_col).isNotNull()).select(gone)
    masks = masks.groupBy(F.shiftright("_gone", 6).alias("_block")).agg(F.expr("bit_or(shiftleft(1L, CAST(_gone & 63 AS INT)))").alias("_mask"))
    if masks.limit(SENT_MASKS + 1).count() > SENT_MASKS:
        return df.join(dropped.select(column(id_col).alias("_gone")), column(id_col) == F.col("_gone"), "left_anti")
    own = long_id(df, id_col)
    bit = F.expr("shiftright(_mask, CAST(_own & 63 AS INT)) & 1")
    rows = df.select(F.struct(*map(column, df.columns)).alias("_row"), own.alias("_own"))
    rows = rows.join(F.broadcast(masks), F.shiftright("_own", 6) == F.col("_block"), "left")
    return rows.where(F.coalesce(bit, F.lit(0)) == 0).select(*[F.col("_row")[c].alias(c) for c in df.columns])


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is its class's smallest, rows with one id and equal words once; all rows without an id stay."""
    classes = similarity_classes(df.select(column(id_col), column(text_col)), id_col, text_col)
    own = column(id_col)
    kept = without(df, id_col, classes.where(own != F.col("class_id")).select(own))
    again = classes.where(own == F.col("class_id")).groupBy(own.alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    if not again.limit(1).count():
        return kept
    # Few ids have several rows; only these are compared, by their words.
    words = F.md5(F.regexp_replace(F.trim(F.lower(text_or_empty(text_col))), r"\s+", " "))
    several = kept.join(again, column(id_col) == F.col("_again"), "left_semi").select(F.struct(*map(column, df.columns)).alias("_row"), own.alias("_id"), words.alias("_words"))
    first = several.withColumn("_rank", F.row_number().over(Window.partitionBy("_id", "_words").orderBy("_words"))).where("_rank = 1")
    return kept.join(again, column(id_col) == F.col("_again"), "left_anti").unionByName(first.select(*[F.col("_row")[c].alias(c) for c in df.columns]))
