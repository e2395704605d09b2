"""Links between sets that share a band: families, buckets, blocks, pruning, exact counts.

Used by the joins of similar texts and of similar paragraphs.

Many near copies of one text would meet in bucket after bucket and be sent to every block
of each.  So sets in large buckets first get a pivot, the set that shares the most buckets
with others, and are compared with it, each set being sent once.  Those with a similarity
of at least 2 t - 1 to the pivot are its family (t is the threshold); of these, the ones
with at least (1 + t) / 2 are its core.  One minus the similarity is a distance, so any two
of a core are linked: their links are counted and never compared.  The other pairs of a
family are compared once, blocks of the rest with blocks of all, and buckets only compare
sets of different families.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bayes import prune
from ._frames import Scratch, map_batches

STEP = 30
#: Sets and shingles of a block, about, and sets of a bucket beyond which its sets are looked for families.
BLOCK_SETS, BLOCK_SHINGLES, LARGE = 256, 500_000, 64
BUCKET, FAMILY = 0, 1


class Text:
    """A member of a job."""

    __slots__ = ("id", "copies", "block", "family", "keys", "signature", "shingles")

    def __init__(self, id, copies, block, family, keys, signature, shingles):
        self.id, self.copies, self.block, self.family = id, copies, block, family
        self.keys = np.frombuffer(keys, dtype=np.int64)
        self.signature = np.frombuffer(signature, dtype=np.uint32)
        self.shingles = np.frombuffer(shingles, dtype=np.uint64)


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted arrays a[i] and b[j]."""
    total = sum(map(len, a)) + sum(map(len, b))
    if len(i) * (total / (len(a) + len(b))) < 30 * total:
        out = np.empty(len(i), dtype=np.int64)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            s, t = (a[x], b[y]) if len(a[x]) <= len(b[y]) else (b[y], a[x])
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            out[k] = int((t[at] == s).sum())
        return out
    # Many pairs: number the shingles that occur on both sides and multiply a slice of them at a time.
    ua, ub = np.unique(np.concatenate(a)), np.unique(np.concatenate(b))
    common = np.intersect1d(ua, ub, assume_unique=True)
    matrix = np.zeros((len(a), len(b)), dtype=np.float32)
    width = 4096

    def columns(x):
        at = np.searchsorted(common, x)
        at[at == len(common)] = 0
        return at[common[at] == x] if len(common) else at[:0]

    ca, cb = [columns(x) for x in a], [columns(x) for x in b]
    for first in range(0, len(common), width):
        ma, mb = np.zeros((len(a), width), dtype=np.float32), np.zeros((len(b), width), dtype=np.float32)
        for m, cs in ((ma, ca), (mb, cb)):
            for r, c in enumerate(cs):
                lo, hi = np.searchsorted(c, (first, first + width))
                m[r, c[lo:hi] - first] = 1
        matrix += ma @ mb.T
    return matrix[i, j].astype(np.int64)


def decide(kind: int, key: int, first: int, second: int, texts: list[Text], threshold: float, tolerance: float) -> list[tuple[int, int, int, int]]:
    """(id, linked texts, linked rows, smallest id connected with) of each text of two blocks, for the pairs of one bucket or family."""
    left = [t for t in texts if t.block == first]
    right = left if first == second else [t for t in texts if t.block == second]
    if not left or not right:
        return []
    fresh = np.triu(np.ones((len(left), len(right)), dtype=bool), 1) if left is right else np.ones((len(left), len(right)), dtype=bool)
    if kind == BUCKET:
        # Pairs of a family are its own; others belong to the first band in which they meet.
        ka, kb = np.array([t.keys for t in left]), np.array([t.keys for t in right])
        for b in range(int(np.flatnonzero(ka[0] == key)[0])):
            fresh &= ka[:, b, None] != kb[:, b]
        fa, fb = (np.array([[t.family is None, t.family or 0] for t in x]) for x in (left, right))
        fresh &= (fa[:, None, 0] | fb[:, 0] | (fa[:, None, 1] != fb[:, 1])).astype(bool)
    i, j = np.nonzero(fresh)
    sa, sb = np.array([t.signature for t in left]), np.array([t.signature for t in right])
    parts = []
    for at in range(0, len(i), 100_000):
        parts.append(prune(sa, sb, i[at : at + 100_000], j[at : at + 100_000], min(STEP, sa.shape[1]), threshold, tolerance))
    if not parts:
        return []
    i, j = (np.concatenate(x) for x in zip(*parts))
    if not len(i):
        return []
    shared = shared_counts([t.shingles for t in left], [t.shingles for t in right], i, j)
    na, nb = np.array([len(t.shingles) for t in left]), np.array([len(t.shingles) for t in right])
    linked = shared >= threshold * (na[i] + nb[j] - shared) - 1e-9
    ida, idb = np.array([t.id for t in left]), np.array([t.id for t in right])
    linked &= ida[i] != idb[j]
    i, j = i[linked], j[linked]
    if not len(i):
        return []
    ca, cb = np.array([t.copies for t in left]), np.array([t.copies for t in right])
    count: dict[int, list[int]] = {}
    for ids, own, other, weight in ((ida, i, j, cb), (idb, j, i, ca)):
        n, w = np.bincount(own, minlength=len(ids)), np.bincount(own, weight[other], minlength=len(ids))
        for k in np.flatnonzero(n).tolist():
            c = count.setdefault(int(ids[k]), [0, 0])
            c[0] += int(n[k])
            c[1] += int(w[k])
    root = {k: k for k in count}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(ida[i].tolist(), idb[j].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(k, n, w, find(k)) for k, (n, w) in count.items()]


MEMBER = ("rep", "copies", "keys", "signature", "shingles")


def _families(full: DataFrame, members: DataFrame, threshold: float, tasks: int, scratch: Scratch) -> DataFrame | None:
    """(rep, family, core) of the sets that have a family; None if no bucket is large."""
    big = full.where(F.col("m") > LARGE).select("rep", "key", "m")
    if not big.limit(1).count():
        return None
    weight = big.groupBy("rep").agg(F.sum("m").alias("w"))
    pivots = big.join(weight, "rep").groupBy("key").agg(F.max(F.struct("w", (-F.col("rep")).alias("less"))).alias("p"))
    home = scratch.stored(big.join(pivots, "key").groupBy("rep").agg((-F.max("p").getField("less")).alias("family")), "homes")
    # A number that stands for several sets, of texts that share an id, has no family.
    digest = F.xxhash64("shingles")
    several = members.groupBy("rep").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("rep")
    home = home.join(several, "rep", "left_anti").join(several.select(F.col("rep").alias("family")), "family", "left_anti")
    # Each set goes to one of the tasks that its family needs, the pivot to all of them, where it comes first.
    spread = home.groupBy("family").agg(F.count("*").alias("f")).where("f > 1").select("family", F.ceil(F.col("f") / BLOCK_SETS).cast("int").alias("parts"))
    own = home.join(spread, "family").select("rep", "family", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("place"))
    first = spread.select(F.col("family").alias("rep"), "family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"))
    met = own.unionByName(first).join(members.select("rep", "shingles"), "rep").repartition(tasks, "family", "part").sortWithinPartitions("family", "part", "place", "rep")
    least, core = 2 * threshold - 1, (1 + threshold) / 2

    def run(batches: Iterator[dict]):
        at, pivot, last = None, None, None
        for b in batches:
            out: dict[str, list] = {"rep": [], "family": [], "core": []}
            for rep, family, part, place, shingles in zip(*(b[c] for c in ("rep", "family", "part", "place", "shingles"))):
                if not place:
                    if (family, part) != at:
                        at, pivot, last = (family, part), np.frombuffer(shingles, np.uint64), None
                    continue
                if rep == last:
                    continue  # a repeated row
                last, x = rep, np.frombuffer(shingles, np.uint64)
                shared = len(np.intersect1d(x, pivot, assume_unique=True))
                union = len(x) + len(pivot) - shared
                if shared >= least * union:
                    out["rep"].append(rep)
                    out["family"].append(family)
                    out["core"].append(shared >= core * union + 1e-9)
            yield out

    return scratch.stored(map_batches(met, run, "rep long, family long, core boolean"), "families")


def linked_sets(reps: DataFrame, members_of: Callable[[DataFrame], DataFrame], threshold: float, tolerance: float, scratch: Scratch) -> DataFrame:
    """Rows (rep, texts, linked, root): numbers of linked sets and of their copies, and the
    smallest set that it is connected with, of each task that found links of the set.

    ``reps``: rep long, copies long, n int (size), keys array<long> (band keys).
    ``members_of`` gets distinct (rep, copies) and returns rep, copies, keys, signature and
    shingles, the last three as bytes.  A pair belongs to its family or else to the first
    band in which it meets.
    """
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Buckets with at least two members, and of those with equal members one.
    placed = reps.select("rep", "n", F.posexplode("keys").alias("band", "key"))
    h = F.xxhash64("rep")
    buckets = placed.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(h).alias("h1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("h2")).where("m > 1")
    full = scratch.stored(placed.join(buckets, "key").distinct(), "buckets")
    chosen = full.groupBy("h1", "h2", "m").agg(F.min(F.struct("band", "key")).alias("c")).select(F.col("c.key").alias("key"))
    wanted = full.select("rep").distinct().join(reps.select("rep", "copies"), "rep")
    members = scratch.stored(members_of(wanted).select(*MEMBER), "members")
    families = _families(full, members, threshold, tasks, scratch)

    # Rows of jobs: side 0 meets all, side 1 only side 0: a family's core, and a bucket's most common family.
    rows = full.join(chosen, "key", "left_semi").select(F.lit(BUCKET).alias("kind"), "key", "rep", "n")
    linked = None
    if families is None:
        rows = rows.select("*", F.lit(None).cast("long").alias("family"), F.lit(0).alias("side"))
    else:
        rows = rows.join(families.select("rep", "family"), "rep", "left")
        common = rows.where("family is not null").groupBy("key", "family").agg(F.count("*").alias("k")).where("k > 1").groupBy("key").agg(F.max_by("family", F.struct("k", "family")).alias("common"))
        rows = rows.join(common, "key", "left").select("kind", "key", "rep", "n", "family", F.coalesce((F.col("family") == F.col("common")).cast("int"), F.lit(0)).alias("side"))
        sizes = full.select("rep", "n").distinct()
        of_family = families.join(sizes, "rep").select(F.lit(FAMILY).alias("kind"), F.col("family").alias("key"), "rep", "n", "family", F.col("core").cast("int").alias("side"))
        rows = rows.unionByName(of_family)
        cores = families.where("core").join(reps.select("rep", "copies"), "rep").select("rep", "family", "copies")
        whole = cores.groupBy("family").agg(F.count("*").alias("k"), F.sum("copies").alias("all"), F.min("rep").alias("root")).where("k > 1")
        linked = cores.join(whole, "family").select("rep", (F.col("k") - 1).alias("texts"), (F.col("all") - F.col("copies")).alias("linked"), "root")
    rows = scratch.stored(rows, "rows")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_SHINGLES)).cast("int")
    blocks = rows.groupBy("kind", "key", "side").agg(blocks.alias("b"))
    blocks = blocks.groupBy("kind", "key").agg(F.coalesce(F.max(F.when(F.col("side") == 0, F.col("b"))), F.lit(0)).alias("b0"), F.coalesce(F.max(F.when(F.col("side") == 1, F.col("b"))), F.lit(0)).alias("b1")).where("b0 > 0")
    block = F.when(F.col("side") == 0, F.pmod(F.xxhash64("rep", F.lit(2)), F.col("b0"))).otherwise(F.col("b0") + F.pmod(F.xxhash64("rep", F.lit(2)), F.col("b1"))).cast("int")
    jobs = (
        rows.join(blocks, ["kind", "key"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("b0") + F.col("b1") - 1).otherwise(F.col("b0") - 1))))
        .select("kind", "key", "rep", "family", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    )
    met = jobs.join(members, "rep").repartition(tasks, "kind", "key", "first", "second").sortWithinPartitions("kind", "key", "first", "second", "rep")

    def run(batches: Iterator[dict]):
        job, texts = None, []
        for b in batches:
            out = []
            for kind, key, first, second, *rest in zip(*(b[c] for c in ("kind", "key", "first", "second", "rep", "copies", "block", "family", "keys", "signature", "shingles"))):
                if (kind, key, first, second) != job:
                    if job:
                        out += decide(*job, texts, threshold, tolerance)
                    job, texts = (kind, key, first, second), []
                # Of the texts of one id, that which has the bucket's key.
                if (not texts or texts[-1].id != rest[0]) and (key in (t := Text(*rest)).keys or kind == FAMILY):
                    texts.append(t)
            yield _columns(out)
        if job:
            yield _columns(decide(*job, texts, threshold, tolerance))

    found = map_batches(met, run, "rep long, texts long, linked long, root long")
    return scratch.stored(found if linked is None else found.unionByName(linked), "found")


def _columns(rows: list[tuple]) -> dict:
    return {n: [r[k] for r in rows] for k, n in enumerate(("rep", "texts", "linked", "root"))}
