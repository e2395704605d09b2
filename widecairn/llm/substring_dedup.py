"""Substring dedup: paragraphs that recur in other documents, found by MinHash banding.

Paragraphs are of two kinds.

* The lines of a text of at least ``LINE_WORDS`` words.  Equal lines are collapsed; bands of
  MinHash values, tuned for recall (``tune``), bring similar lines together; every pair that
  meets is verified exactly (five-word shingles, Jaccard similarity of at least 0.8), and
  the clusters are the components of the verified pairs.
* Windows, for passages within a longer line or over several short ones.  A text's words are
  marked where the hash of two neighbouring words is the least of ``SPAN`` such hashes in a
  row; a window goes from a mark to the first mark at least ``WINDOW_WORDS`` words on.
  Windows of one key have equal words, so their similarity is 1.  Of a passage of
  4 * SPAN + WINDOW_WORDS - 2 = 50 words at least one window is the same wherever the
  passage stands, if no three of its words in a row are alike.  A run of one word is cut
  into windows of WINDOW_WORDS from its start on.

So whatever is removed is a whole paragraph that another document holds, as a similar line
or as the same run of at least WINDOW_WORDS words; nothing is put together from parts.

The document with a cluster's smallest id keeps its paragraphs, those of all others are
removed.  A cluster within one document removes nothing.  Lines of fewer than
``REMOVED_WORDS`` words are mostly headings and notices: their repeats are reported, and
removed only if asked for.

Null text counts as empty; rows with a null id take no part; an empty table gives no rows.
Rows that share an id are one document, whose rows each lose what their own text repeats;
equal rows lose the same.  Other columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from itertools import groupby
from math import ceil

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._frames import Scratch, column, field, long_id, map_batches, quoted, stored, text_or_empty
from ._linkage import linked_sets
from ._packed import pack, pack_sorted, part_bounds, unpack, unpack_sorted
from ._words import MinHasher, WordHashes, band_keys, mix64, shingle_hashes

THRESHOLD, RECALL, MOST_BANDS = 0.8, 0.999, 8
LINE_WORDS, REMOVED_WORDS = 5, 20
SPAN, WINDOW_WORDS = 8, 20

_MASK = (1 << 64) - 1
#: An odd number and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def tune(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have for this recall with at most ``most`` bands, and the fewest bands then."""
    best = (1, 1)
    for rows in range(1, 9):
        bands = ceil(np.log(1 - recall) / np.log(1 - threshold**rows))
        if bands <= most:
            best = (bands, rows)
    return best


_word = re.compile(r"\S+").finditer


def lines_of(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of each line of at least LINE_WORDS words."""
    out, at = [], 0
    for line in text.split("\n"):
        words = line.lower().split()
        if len(words) >= LINE_WORDS:
            out.append((at, at + len(line), words))
        at += len(line) + 1
    return out


def keys_of(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One signed 64-bit number for each run of words [start, end): equal runs have equal numbers, wherever they stand."""
    if not len(starts):
        return np.empty(0, dtype=np.int64)
    power = np.ones(len(hashes) + 1, dtype=np.uint64)
    power[1:] = np.cumprod(np.full(len(hashes), _BASE, dtype=np.uint64))
    back = np.ones(len(hashes) + 1, dtype=np.uint64)
    back[1:] = np.cumprod(np.full(len(hashes), _INVERSE, dtype=np.uint64))
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix64(hashes) * power[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def marks_of(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the marks in the words of some texts that follow each other; ``doc`` is the text of each word."""
    n = len(hashes) - 1
    if n < SPAN:
        return np.empty(0, dtype=np.int64)
    none = np.uint64(_MASK)
    pair = mix64(hashes[:-1] * np.uint64(3) ^ hashes[1:]) >> np.uint64(1)
    # In a run of one word no place is better than another.
    pair[1:][pair[1:] == pair[:-1]] = none
    rows = np.lib.stride_tricks.sliding_window_view(pair, SPAN)
    at = rows.argmin(axis=1) + np.arange(len(rows))
    inside = doc[: len(rows)] == doc[SPAN : SPAN + len(rows)]
    at = np.unique(at[inside])
    return at[pair[at] != none]


def runs_of(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of pieces of WINDOW_WORDS equal words, from the start of each run of one word on."""
    n = len(hashes)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]))
    pieces = np.diff([*starts, n]) // WINDOW_WORDS
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(starts, pieces) + place * WINDOW_WORDS
    return first, first + WINDOW_WORDS


def windows_of(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each window, and of each piece of a run of one word."""
    marks, runs = marks_of(hashes, doc), runs_of(hashes, doc)
    if not len(marks):
        return runs
    to = np.searchsorted(marks, marks + WINDOW_WORDS)
    first, to = marks[to < len(marks)], to[to < len(marks)]
    end = marks[to]
    # Beyond a run of one word there may be no mark for long: such a window isn't settled by its words alone.
    good = (doc[first] == doc[np.maximum(end - 1, first)]) & (doc[first] == doc[end]) & (end - first < WINDOW_WORDS + SPAN)
    return np.concatenate([first[good], runs[0]]), np.concatenate([end[good], runs[1]])


class Units:
    """Lines of some texts that are long enough, and the windows of the texts, as arrays."""

    def __init__(self, texts: list[str], cache: WordHashes):
        words: list[str] = []
        doc, start, size, count, plain = [], [], [], [], []
        for d, text in enumerate(texts):
            at = 0
            for line in text.split("\n"):
                low = line.lower()
                own = low.split()
                if own:
                    words += own
                    doc.append(d)
                    start.append(at)
                    size.append(len(line))
                    count.append(len(own))
                    plain.append(len(low) == len(line))
                at += len(line) + 1
        line_doc, line_start, line_size, line_count = (np.array(x, dtype=np.int64) for x in (doc, start, size, count))
        hashes = cache.array(words)
        first = np.cumsum(line_count) - line_count
        unit = line_count >= LINE_WORDS
        self.doc, self.start, self.size, self.count = line_doc[unit], line_start[unit], line_size[unit], line_count[unit]
        self.keys = keys_of(hashes, first[unit], first[unit] + self.count)
        self.hashes = hashes[np.repeat(unit, line_count)]
        self.first = np.cumsum(self.count) - self.count
        begin, end = _places(texts, words, line_doc, line_start, line_size, line_count, np.array(plain, dtype=bool))
        word_doc = np.repeat(line_doc, line_count)
        f, e = windows_of(hashes, word_doc)
        self.window_doc, self.window_start = word_doc[f], begin[f]
        self.window_size = end[e - 1] - begin[f]
        self.window_keys = keys_of(hashes, f, e)

    def band_keys(self, hasher: MinHasher, rows: int) -> np.ndarray:
        """Band keys of every line: rows by bands."""
        all_ = shingle_hashes(self.hashes)
        # Shingles that begin in the last four words of a line would go over its end.
        inside = np.ones(len(self.hashes), dtype=bool)
        for back in range(1, 5):
            inside[self.first + self.count - back] = False
        n = self.count - 4
        return band_keys(hasher.segments(all_[inside[: len(all_)]], np.cumsum(n) - n), rows)


def _places(texts: list[str], words: list[str], doc, start, size, count, plain) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in its text."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    if not len(words):
        return length, length
    first = np.cumsum(count) - count
    gone = np.cumsum(length + 1) - (length + 1)
    begin = gone + np.repeat(start - gone[first], count)
    end = begin + length
    # Words of a line with single spaces lie one after the other; elsewhere they are looked up.
    regular = plain & (np.add.reduceat(length, first) + count - 1 == size)
    for k in np.flatnonzero(~regular).tolist():
        a, n = int(first[k]), int(count[k])
        places = [m.span() for m in _word(texts[doc[k]], int(start[k]), int(start[k] + size[k]))]
        if len(places) == n:
            begin[a : a + n], end[a : a + n] = np.array(places).T
        else:  # lower case made or unmade white space: the whole line for each of its words
            begin[a : a + n], end[a : a + n] = start[k], start[k] + size[k]
    return begin, end


#: Words of texts that are looked at together.
WORDS_TOGETHER = 40_000
#: Fewest and most windows of a chunk, about, and windows for each part that it sends keys to.
CHUNK_WINDOWS, MOST_CHUNK_WINDOWS, PER_PART = 100_000, 4_000_000, 32

#: Lines (``keys`` not null), and chunks of windows (``chunk`` not null): the ids and row hashes of some
#: texts, and of their windows the keys, ascending, the text's place among the chunk's, start and size.
UNITS = "id long, row long, key long, start int, size int, words int, keys array<long>, chunk long, ids binary, rows binary, windows binary, texts binary, starts binary, sizes binary"
_LINE, _CHUNK = ("id", "row", "key", "start", "size", "words", "keys"), ("chunk", "ids", "rows", "windows", "texts", "starts", "sizes")


def _units(docs: DataFrame, bands: int, rows: int, parts: int) -> DataFrame:
    most = min(max(CHUNK_WINDOWS, PER_PART * parts), MOST_CHUNK_WINDOWS)

    def run(batches):
        cache, hasher = WordHashes(), MinHasher(bands * rows)
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, ...]] = []  # ids, rows, and the windows' text, start, size, key

        def lines(u, ids, row):
            n = len(u.doc)
            if n:
                own = {"id": ids[u.doc], "row": row[u.doc], "key": u.keys, "start": u.start, "size": u.size, "words": u.count, "keys": list(u.band_keys(hasher, rows))}
                yield {**own, **dict.fromkeys(_CHUNK, [None] * n)}

        def chunk():
            ids, row = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            before = np.cumsum([0, *(len(x[0]) for x in held)])
            text = np.concatenate([x[2] + b for x, b in zip(held, before)])
            start, size = (np.concatenate([x[k] for x in held]) for k in (3, 4))
            key = np.concatenate([x[5] for x in held]).view(np.uint64)
            order = np.lexsort((text, key))
            packed = (first + made, pack(ids), pack(row), pack_sorted(key[order]), *(pack(x[order].astype(np.uint32)) for x in (text, start, size)))
            return {**dict.fromkeys(_LINE, [None]), **{c: [x] for c, x in zip(_CHUNK, packed)}}

        def take(ids, row, texts):
            u = Units(texts, cache)
            ids, row = np.array(ids, dtype=np.int64), np.array(row, dtype=np.int64)
            if len(u.window_doc):
                held.append((ids, row, u.window_doc, u.window_start, u.window_size, u.window_keys))
            yield from lines(u, ids, row)

        for b in batches:
            ids, row, texts, words = [], [], [], 0
            for i, r, t in zip(b["id"], b["row"], b["_text"]):
                ids.append(i)
                row.append(r)
                texts.append(t)
                words += len(t) // 6
                if words >= WORDS_TOGETHER:
                    yield from take(ids, row, texts)
                    ids, row, texts, words = [], [], [], 0
            if ids:
                yield from take(ids, row, texts)
            if sum(len(x[2]) for x in held) >= most:
                yield chunk()
                held, made = [], made + 1
        if held:
            yield chunk()

    return map_batches(docs, run, UNITS)


def _repeated_windows(units: DataFrame, parts: int) -> DataFrame:
    """(id, row, spans) of the rows with windows that a document with a smaller id holds too.

    Each chunk sends its distinct keys, with the smallest and the largest id that it has of
    each, to the parts of the range of keys; a part finds the smallest id of all and answers
    each chunk with the keys that have to go.  A key is one entry of a chunk however often it
    occurs there, so a very common passage weighs no more than others.
    """

    def ask(batches):
        for b in batches:
            for number, ids, windows, texts in zip(b["chunk"], b["ids"], b["windows"], b["texts"]):
                keys, own = unpack_sorted(windows), unpack(ids, np.int64)[unpack(texts, np.uint32)]
                keys, at = np.unique(keys, return_index=True)
                lo, hi = np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)
                ends = part_bounds(keys, parts)
                some = [(k, i, j) for k, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
                yield {
                    "chunk": [number] * len(some),
                    "part": [k for k, _, _ in some],
                    "keys": [pack_sorted(keys[i:j]) for _, i, j in some],
                    "lo": [pack(lo[i:j]) for _, i, j in some],
                    "more": [pack(hi[i:j] - lo[i:j]) for _, i, j in some],
                }

    def answer(batches):
        rows = (r for b in batches for r in zip(b["part"], b["chunk"], b["keys"], b["lo"], b["more"]))
        for _, some in groupby(rows, key=lambda r: r[0]):
            chunks, keys, lo, hi = [], [], [], []
            for _, number, k, x, y in some:
                chunks.append(number)
                keys.append(unpack_sorted(k))
                lo.append(unpack(x, np.int64))
                hi.append(lo[-1] + unpack(y, np.int64))
            all_, at = np.unique(np.concatenate(keys), return_inverse=True)
            least = np.full(len(all_), np.iinfo(np.int64).max)
            np.minimum.at(least, at, np.concatenate(lo))
            ends = np.cumsum([0, *map(len, keys)])
            out: dict[str, list] = {c: [] for c in ("chunk", "keys", "keeper")}
            for n, number in enumerate(chunks):
                keeper = least[at[ends[n] : ends[n + 1]]]
                gone = hi[n] > keeper
                if gone.any():
                    for c, x in (("chunk", number), ("keys", pack(keys[n][gone])), ("keeper", pack(keeper[gone]))):
                        out[c].append(x)
            yield out

    def spans(batches):
        for b in batches:
            for ids, row, windows, texts, starts, sizes, answers in zip(*(b[c] for c in ("ids", "rows", "windows", "texts", "starts", "sizes", "answers"))):
                ids, row, keys = unpack(ids, np.int64), unpack(row, np.int64), unpack_sorted(windows)
                gone = np.concatenate([unpack(a["keys"], np.uint64) for a in answers])
                keeper = np.concatenate([unpack(a["keeper"], np.int64) for a in answers])
                order = np.argsort(gone)
                gone, keeper = gone[order], keeper[order]
                at = np.minimum(np.searchsorted(gone, keys), len(gone) - 1)
                text = unpack(texts, np.uint32)
                mine = np.flatnonzero((gone[at] == keys) & (ids[text] > keeper[at]))
                mine = mine[np.argsort(text[mine], kind="stable")]
                found, first = np.unique(text[mine], return_index=True)
                start, size, keeper = (x.astype(np.int64) for x in (unpack(starts, np.uint32)[mine], unpack(sizes, np.uint32)[mine], keeper[at][mine]))
                own = [[{"start": a, "size": s, "short": False, "keeper": k} for a, s, k in zip(*(x[i:j].tolist() for x in (start, size, keeper)))] for i, j in zip(first, [*first[1:], len(mine)])]
                for i in range(0, len(own), 200):
                    t = found[i : i + 200]
                    yield {"id": ids[t], "row": row[t], "spans": own[i : i + 200]}

    chunks = units.where("chunk is not null").select(*_CHUNK)
    asked = map_batches(chunks.select("chunk", "ids", "windows", "texts"), ask, "chunk long, part int, keys binary, lo binary, more binary")
    found = map_batches(asked.repartition(parts, "part").sortWithinPartitions("part"), answer, "chunk long, keys binary, keeper binary")
    answers = found.groupBy("chunk").agg(F.collect_list(F.struct("keys", "keeper")).alias("answers"))
    return map_batches(chunks.join(answers.hint("merge"), "chunk"), spans, f"id long, row long, spans {SPANS}")


#: Start and size of a span in code points, whether it is a short line, and who keeps it.
SPANS = "array<struct<start: int, size: int, short: boolean, keeper: long>>"


def _clusters(docs: DataFrame, units: DataFrame, bands: int, rows: int, scratch: Scratch) -> DataFrame:
    """(key, keeper) of lines that occur in several documents, alike or nearly: the smallest id of their cluster."""
    lines = units.where("keys is not null").groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first(F.col("words") - 4).alias("n"), F.first("keys").alias("keys"))
    lines = scratch.stored(lines.withColumnRenamed("key", "rep").withColumn("copies", F.lit(1).cast("long")), "lines")

    def members_of(wanted):
        at = wanted.join(lines.select("rep", "lo"), "rep").groupBy("lo").agg(F.collect_list("rep").alias("reps"))
        texts = docs.join(at, F.col("id") == F.col("lo")).select("_text", "reps")

        def run(batches):
            cache, hasher = WordHashes(), MinHasher(bands * rows)
            for b in batches:
                out: dict[str, list] = {c: [] for c in ("rep", "copies", "keys", "signature", "shingles")}
                for text, reps in zip(b["_text"], b["reps"]):
                    left = set(reps)
                    found = [cache.array(words) for _, _, words in lines_of(text)]
                    ends = np.cumsum([len(h) for h in found], dtype=np.int64)
                    keys = keys_of(np.concatenate(found), np.append(0, ends[:-1]), ends).tolist() if found else []
                    for k, h in zip(keys, found):
                        if k in left:
                            left.discard(k)
                            s = np.unique(shingle_hashes(h))
                            sign = hasher(s)
                            out["rep"].append(k)
                            out["copies"].append(1)
                            out["keys"].append(band_keys(sign, rows)[0].tobytes())
                            out["signature"].append(sign.tobytes())
                            out["shingles"].append(s.tobytes())
                yield out

        return map_batches(texts, run, "rep long, copies long, keys binary, signature binary, shingles binary")

    found = linked_sets(lines.select("rep", "copies", "n", "keys"), members_of, THRESHOLD, 1e-9, scratch)
    roots = connected_components(found.select("rep", "root"), scratch)
    own = lines.select("rep", "lo", "hi").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    keepers = own.groupBy("root").agg(F.min("lo").alias("keeper"), F.max("hi").alias("last")).where("keeper < last").drop("last")
    return own.select("rep", "root").join(keepers, "root").select(F.col("rep").alias("key"), "keeper")


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """Disjoint spans (start, end, keepers) that cover the given (start, end, keeper); neighbours a character apart are one."""
    out: list[tuple[int, int, list[int]]] = []
    for a, b, k in sorted(set(spans)):
        if out and a <= out[-1][1] + 1:
            start, end, ks = out[-1]
            out[-1] = (start, max(end, b), ks if k in ks else [*ks, k])
        else:
            out.append((a, b, [k]))
    return out


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(long_id(df, id_col).alias("id"), text_or_empty(text_col).alias("_text")).withColumn("row", F.xxhash64("_text"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_words: int = REMOVED_WORDS, _row: bool = False) -> DataFrame:
    """One row per row: id, n_removed, removed_chars, removed_spans, keeper_ids, n_short, short_spans.

    removed_spans: start:end of each removed span in code points, comma-joined; keeper_ids:
    the documents that keep a copy, ascending; short_spans: repeated lines of fewer than
    ``removed_words`` words, which stay.
    """
    bands, rows = tune()
    with Scratch() as scratch:
        docs = _documents(df, id_col, text_col)
        # One pass over the texts; its result is read for counting and for joining back.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        units = scratch.stored(_units(docs.where("id is not null"), bands, rows, parts), "units")
        clusters = _clusters(docs.where("id is not null"), units, bands, rows, scratch)
        short = F.col("words") < removed_words
        lines = units.where("keys is not null").select("id", "row", "key", "start", "size", short.alias("short")).join(clusters, "key").where("id > keeper").select("id", "row", "start", "size", "short", "keeper")
        windows = _repeated_windows(units, parts)
                # Sets, so that equal rows, however many, have one list of their lines and one of their windows.
        lines = lines.groupBy("id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "size", "short", "keeper"))).alias("spans"))
        spans = lines.unionByName(windows).groupBy("id", "row").agg(F.flatten(F.collect_set("spans")).alias("spans"))

        def run(batches):
            for b in batches:
                out: dict[str, list] = {c: [] for c in ("n", "chars", "spans", "keepers", "n_short", "short")}
                for spans in b["spans"]:
                    found = merged([(s["start"], s["start"] + s["size"], s["keeper"]) for s in spans or [] if not s["short"]])
                    short = merged([(s["start"], s["start"] + s["size"], s["keeper"]) for s in spans or [] if s["short"]])
                    out["n"].append(len(found))
                    out["chars"].append(sum(e - a for a, e, _ in found))
                    out["spans"].append(",".join(f"{a}:{e}" for a, e, _ in found))
                    out["keepers"].append(sorted({k for _, _, ks in found for k in ks}))
                    out["n_short"].append(len(short))
                    out["short"].append(",".join(f"{a}:{e}" for a, e, _ in short))
                yield {id_col: b["_own"], "_row": b["row"], "n_removed": out["n"], "removed_chars": out["chars"], "removed_spans": out["spans"], "keeper_ids": out["keepers"], "n_short": out["n_short"], "short_spans": out["short"]}

        rows_ = df.select(column(id_col).alias("_own"), long_id(df, id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("row")).join(spans, ["id", "row"], "left").select("_own", "row", "spans")
        out = map_batches(rows_, run, f"{field(df, id_col)}, _row long, n_removed long, removed_chars long, removed_spans string, keeper_ids array<long>, n_short long, short_spans string")
        # Written, so that the tables it is made from can go.
        return stored(out if _row else out.drop("_row"), "spans")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_words: int = REMOVED_WORDS) -> DataFrame:
    """The id and the text that is left of every row."""
    found = repeated_spans(df, id_col, text_col, removed_words, _row=True).where("n_removed > 0").select(column(id_col).alias("id"), F.col("_row").alias("row"), "removed_spans").distinct()
    texts = _documents(df, id_col, text_col).withColumn("_id", F.col("id").cast(df.schema[id_col].dataType)).join(found, ["id", "row"], "left")

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b["_text"], b["removed_spans"]):
                kept, at = [], 0
                for s in spans.split(",") if spans else []:
                    a, e = map(int, s.split(":"))
                    kept.append(text[at:a])
                    at = e
                out.append("".join([*kept, text[at:]]))
            yield {id_col: b["_id"], text_col: out}

    return map_batches(texts.select("_id", "_text", "removed_spans"), run, f"{field(df, id_col)}, {quoted(text_col)} string")

