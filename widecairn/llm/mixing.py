"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in a seeded order, form blocks.  With integer weights a_s and their sum
D, block k (from 0) of source s is released at slot floor(k D / a_s) and must be placed
before slot ceil((k + 1) D / a_s), its deadline.  Each slot takes the released block with
the earliest deadline (ties: the source that comes first).  The weights fill every slot
exactly, so all deadlines are met, and after t slots each source that still has blocks has
had t a_s / D of them to within less than one.

The schedule repeats after D slots, where every source is exactly at its share: one period
is computed, in D log(sources) steps, and a block's slot follows from its number by
arithmetic.  The slots of a source whose blocks are used up stay empty: the others go on
side by side at their weights, until all rows are placed.  None is dropped or repeated.

The driver holds one count per source and one period, nothing that grows with the rows;
the period is a table that blocks are joined with.  Rows are numbered within a source
without one task holding the source: they fall into buckets by a hash of the id, as many
as the source needs; buckets are counted, counts are summed along within groups of
buckets, and groups along the source; rows are numbered within their bucket.

A null source is a source of its own.  Ties and repeated rows get numbers in hash order
of the row's id, then in any order; rows with a null id fall into buckets by a hash of
their columns of fixed size.
Texts of any length and other columns only pass.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping
from heapq import heapify, heappop, heappush
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import column

#: Rows of a block, rows of a bucket, about, and buckets of a group.
BLOCK_ROWS, BUCKET_ROWS, GROUP_BUCKETS = 8, 100, 10_000
#: Slots of a period per source if weights are made from counts, and in all at least.
SLOTS_PER_SOURCE, LEAST_SLOTS = 20, 1000
#: Given weights are exact up to this sum, or so many per source if that is more; beyond it they are scaled to it.
EXACT_SLOTS, EXACT_PER_SOURCE = 1 << 20, 64
#: Slots of a period that go to every task; a longer one is joined by a shuffle.
SENT_SLOTS = 1 << 18
#: Sources times partitions up to which the cuts of ``in_order`` go to every task.
SENT_CUTS = 1 << 18


def period(weights: list[int]) -> list[int]:
    """One period: the source of each slot."""
    total = sum(weights)
    waiting = [(0, s, 1) for s, a in enumerate(weights) if a > 0]  # release, source, block
    heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, i = heappop(waiting)
            heappush(ready, (-(-i * total // weights[s]), s, i))
        deadline, s, i = heappop(ready)
        assert t < deadline
        out.append(s)
        heappush(waiting, (i * total // weights[s], s, i + 1))
    return out


def smoothed_weights(counts: Mapping[str | None, int], power: float = 0.5, total: int | None = None) -> dict[str | None, int]:
    """Target weights in proportion to a power of each source's rows, as integers of at least 1."""
    parts = {s: n**power for s, n in counts.items()}
    whole, total = sum(parts.values()), total or max(LEAST_SLOTS, SLOTS_PER_SOURCE * len(counts))
    return {s: max(1, int(total * p / whole + 0.5)) for s, p in parts.items()}


def reduced(weights: list[int]) -> list[int]:
    """The weights by their greatest common divisor, scaled if their sum is beyond EXACT_SLOTS."""
    weights = [a // gcd(*weights) for a in weights]
    total, most = sum(weights), max(EXACT_SLOTS, EXACT_PER_SOURCE * len(weights))
    return weights if total <= most else [max(1, round(a * most / total)) for a in weights]


class Schedule:
    """Sources in their order, rows and weights of each, and one period: all that the driver holds."""

    def __init__(self, tagged: DataFrame, weights: Mapping[str | None, int] | None):
        counts = {(r._s[1:] if r._s else None): r.n for r in tagged.groupBy("_s").agg(F.count("*").alias("n")).collect()}
        self.names = sorted(counts, key=lambda s: (s is not None, s or ""))
        self.rows = [counts[s] for s in self.names]
        given = smoothed_weights(counts) if weights is None else weights
        a = [int(given.get(s, 1)) for s in self.names]
        if min(a, default=1) < 1:
            raise ValueError("weights are positive integers")
        self.weights = reduced(a) if a else a
        self.total = sum(self.weights)
        #: The slots of each source within the period.
        self.slots: list[list[int]] = [[] for _ in self.weights]
        for t, s in enumerate(period(self.weights)):
            self.slots[s].append(t)

    def small(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.total <= SENT_SLOTS else table

    def sources(self, spark: SparkSession) -> DataFrame:
        rows = [("" if s is None else f"={s}", k, -(-n // BUCKET_ROWS), w) for k, (s, n, w) in enumerate(zip(self.names, self.rows, self.weights))]
        return spark.createDataFrame(rows, "_s string, _k int, _buckets long, _w long")

    def cycle(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, i, t) for k, own in enumerate(self.slots) for i, t in enumerate(own)], "_k int, _i long, _t long")

    def before(self, k: int, slot: int, block_rows: int) -> int:
        """Rows of source k in the slots before this one."""
        periods, t = divmod(slot, self.total)
        return min(self.rows[k], block_rows * (periods * self.weights[k] + bisect_left(self.slots[k], t)))

    def even_slots(self, parts: int, block_rows: int) -> list[int]:
        """Slots that cut the rows in about equal parts."""
        n, w = np.array(self.rows, dtype=float), np.array(self.weights, dtype=float)
        ends = -(-n // block_rows) * self.total / w  # until a source is used up, it has the same number of rows in any two periods
        order = np.argsort(ends)
        n, ends = n[order], ends[order]
        rates = n / ends
        had = np.cumsum(n) + ends * (rates.sum() - np.cumsum(rates))
        want = np.arange(1, parts) * (n.sum() / parts)
        return np.interp(want, np.append(0, had), np.append(0, ends)).astype(np.int64).tolist()


def _tagged(df: DataFrame, source_col: str, id_col: str, *more: Column) -> DataFrame:
    """_id, _s (source, marked so that null is a source), _any (what rows without an id are spread by) and more columns."""
    source = F.coalesce(F.concat(F.lit("="), column(source_col).cast("string")), F.lit(""))
    # Numbers, dates and the like, which are read at little cost.
    fixed = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.DatetimeType, T.BooleanType))]
    anything = F.xxhash64(column(source_col), *map(column, fixed))
    return df.select(column(id_col).alias("_id"), source.alias("_s"), F.when(column(id_col).isNull(), anything).alias("_any"), *more)


def _bucketed(tagged: DataFrame, schedule: Schedule, seed: int) -> DataFrame:
    """With the source's number, buckets and weight, the row's hash _h and its bucket _b: rows of a source are in the order of _b, _h."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    spread = F.when(F.col("_id").isNull(), F.col("_any")).otherwise(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long"))
    sources = schedule.sources(tagged.sparkSession)
    return tagged.join(schedule.small(sources), "_s").withColumn("_h", order).withColumn("_b", F.pmod(spread, F.col("_buckets"))).drop("_any")


def _numbered(tagged: DataFrame, tie: str) -> DataFrame:
    """With the row's number _n within its source: by bucket, by group of buckets, and along the groups."""
    sizes = tagged.groupBy("_k", "_b").agg(F.count("*").alias("n")).withColumn("_g", F.expr(f"_b div {GROUP_BUCKETS}"))
    so_far = F.coalesce(F.sum("n").over(Window.partitionBy("_k", "_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("_k", "_g").agg(F.sum("n").alias("n"))
    groups = groups.select("_k", "_g", F.coalesce(F.sum("n").over(Window.partitionBy("_k").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    before = sizes.withColumn("_before", so_far).join(groups, ["_k", "_g"]).select("_k", "_b", (F.col("_before") + F.col("_start")).alias("_before"))
    return tagged.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_h", tie))).join(before, ["_k", "_b"]).withColumn("_n", F.col("_before") + F.col("_n") - 1)


def _placed(numbered: DataFrame, schedule: Schedule, block_rows: int) -> tuple[DataFrame, Column]:
    """With the row's block, and its slot: the block's number within the period from the table, the period's by arithmetic."""
    cycle = schedule.cycle(numbered.sparkSession)
    placed = numbered.withColumn("_block", F.expr(f"_n div {block_rows}")).withColumn("_i", F.expr("_block % _w")).join(schedule.small(cycle), ["_k", "_i"])
    return placed, F.expr(f"_block div _w * {schedule.total}") + F.col("_t")


def mix(df: DataFrame, weights: Mapping[str | None, int] | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, seed: int = 0, keep: bool = True, place_col: str = "_mix") -> DataFrame:
    """The rows with their place in the mixture.

    ``weights`` are positive integers by source; sources without one get 1; None takes
    ``smoothed_weights`` of the counts.  Returns all columns of ``df`` (only id and source
    unless ``keep``) and struct ``place_col`` (block long, within the source, release long,
    deadline long, slot long, position long), in place of a column of that name;
    position = slot * block_rows + place in the block is distinct for every row and has gaps
    where a source's rows are used up.
    """
    passed = [c for c in df.columns if c != place_col] if keep else []
    tagged = _tagged(df, source_col, id_col, *([F.struct(*map(column, passed)).alias("_row")] if keep else []))
    schedule = Schedule(tagged, weights)
    total = schedule.total
    placed, slot = _placed(_numbered(_bucketed(tagged, schedule, seed), "_id"), schedule, block_rows)
    place = F.struct(
        F.col("_block").alias("block"),
        F.expr(f"(_block * {total}) div _w").alias("release"),
        F.expr(f"((_block + 1) * {total} + _w - 1) div _w").alias("deadline"),
        slot.alias("slot"),
        (slot * block_rows + F.col("_n") % block_rows).alias("position"),
    ).alias(place_col)
    columns = [F.col("_row")[c].alias(c) for c in passed] if keep else [F.col("_id").alias(id_col), F.expr("if(_s = '', null, substring(_s, 2))").alias(source_col)]
    return placed.select(*columns, place)


def written_order(mixed: DataFrame, columns: list[str], place_col: str = "_mix") -> DataFrame:
    """The columns in the mixture's order, over partitions by position, ready to be written."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    position = column(place_col)["position"]
    return mixed.repartitionByRange(parts, position).sortWithinPartitions(position).select(*map(column, columns))


def in_order(df: DataFrame, weights: Mapping[str | None, int] | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """The rows in the order of ``mix``, over partitions by position, ready to be written; whole rows are shuffled once.

    Slots cut the positions in partitions, and the schedule tells how many rows of each
    source lie before a cut.  Ids, sources and hashes alone are numbered, to find the row
    that comes first after each cut; with these rows' hashes every row finds its partition
    before it is moved, and its number within the partition gives its place there.  Rows
    that agree in the hash of their id are told apart by where they are read.  Beyond
    ``SENT_CUTS`` sources times partitions the whole rows are numbered.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.monotonically_increasing_id().alias("_tie")
    narrow = _tagged(df, source_col, id_col, tie)
    schedule = Schedule(narrow, weights)
    if schedule.total > SENT_SLOTS or len(schedule.names) * parts > SENT_CUTS:
        place = "_mix" + "_" * max(map(len, df.columns))
        return written_order(mix(df, weights, source_col, id_col, block_rows, seed, place_col=place), df.columns, place)
    if not schedule.names:
        return df

    # Of each source, the number of the first row in each partition that has rows of it.
    slots = schedule.even_slots(parts, block_rows)
    starts = []
    for k, rows in enumerate(schedule.rows):
        starts.append({0: 0} | {schedule.before(k, t, block_rows): p for p, t in enumerate(slots, 1)})
        starts[k].pop(rows, None)
    cuts = [(k, n) for k, own in enumerate(starts) for n in own if n]
    keys = {}
    if cuts:
        numbered = _numbered(_bucketed(narrow, schedule, seed), "_tie")
        first = numbered.join(F.broadcast(spark.createDataFrame(cuts, "_k int, _n long")), ["_k", "_n"])
        keys = {(r._k, r._n): (r._b, r._h, r._tie) for r in first.select("_k", "_n", "_b", "_h", "_tie").collect()}

    # Cells of buckets, so many that few cuts share one: the cuts in each, after the last one before it.
    cells, widths = [], []
    for k, (rows, own) in enumerate(zip(schedule.rows, starts)):
        buckets = -(-rows // BUCKET_ROWS)
        count = min(buckets, 2 * len(own))
        found: list[list[tuple]] = [[] for _ in range(count)]
        last = (-1, "", -1, own[0], 0)
        for n, p in own.items():
            if n:
                b, h, t = keys[k, n]
                found[b * count // buckets].append((b, h, t, p, n))
        for c, inside in enumerate(found):
            cells.append((k, c, [(-1, "", -1, *last[3:]), *inside]))
            last = inside[-1] if inside else last
        widths.append((k, count))
    cells = spark.createDataFrame(cells, "_k int, _cell long, _cuts array<struct<b: long, h: string, t: long, part: int, start: long>>")
    widths = spark.createDataFrame(widths, "_k int, _cells long")

    whole = _bucketed(_tagged(df, source_col, id_col, tie, F.struct(*map(column, df.columns)).alias("_row")), schedule, seed)
    whole = whole.join(F.broadcast(widths), "_k").withColumn("_cell", F.expr("_b * _cells div _buckets")).join(F.broadcast(cells), ["_k", "_cell"])
    whole = whole.withColumn("_at", F.expr("array_max(filter(_cuts, c -> struct(c.b, c.h, c.t) <= struct(_b AS b, _h AS h, _tie AS t)))"))
    moved = whole.select("_row", "_k", "_w", "_b", "_h", "_tie", F.col("_at.part").alias("_part"), F.col("_at.start").alias("_start"))
    # Spark looks for bounds of equal shares in a sample; asked for more than there are numbers, it puts one between any two.
    moved = moved.repartitionByRange(2 * parts, "_part")
    nth = F.row_number().over(Window.partitionBy("_part", "_k").orderBy("_b", "_h", "_tie"))
    placed, slot = _placed(moved.withColumn("_n", F.col("_start") + nth - 1), schedule, block_rows)
    return placed.withColumn("_slot", slot).sortWithinPartitions("_slot", "_n").select(*[F.col("_row")[c].alias(c) for c in df.columns])
