"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards of about ``SHARD`` by a hash.  Equal vectors are one
node of a graph: it holds the smallest k + 1 of their ids, which are all that a query can
return, since ties go to the smaller id and only a query's own id is left out.

A shard's graph is built in one task.  Nodes get levels by their hash and are put in by
groups: each node of a group finds its neighbours by searching the graph of the nodes
before, down the levels from the one entry, and looks at the nodes of its own group that
come before it.  On each of its levels it is linked to at most M (2 M on level 0) of the
nearest found, chosen so that a neighbour is nearer to the node than to any neighbour
chosen before; links are made both ways and pruned by the same rule, but one link to each
node, from a near node with few such links, always stays, so that a search can reach all.
The graph is kept as flat arrays: the vectors, and for each level the nodes on it and a matrix of their
neighbours, padded with -1.

A graph moves once, to the task of its shard; blocks of queries follow it there one after
the other.  Each query walks down the levels greedily and then keeps the ``EF`` nearest on
level 0.  All that are kept are ranked by their exact distance, then id, and the search is
done again with a larger EF while the k-th distance is no less than the farthest kept, so
that ties are settled by id.  Shard results merge by distance, then id.  Distances are
Euclidean, of the original vectors in double precision.

Vectors that are null, all zeros, or hold null or non-finite components take no part, nor
do null ids.  Vectors are only compared with those of equal length.  Rows repeated with
the same id and vector count once; an id with several vectors counts with each.  An empty
table has no shards and no results; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import Scratch, column, long_id, map_batches, stored

SHARD, M, EF_BUILD, EF, QUERY_BLOCK = 4096, 16, 96, 160, 256
#: Nodes that are put in together at most, and nodes that one step of a search opens for each query.
GROUP, OPENED = 256, 4
#: Tasks of one job; beyond it a task takes several shards, one after the other.
MOST_TASKS = 100_000


def usable(col: str):
    v = column(col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def distance(a: list[float], b: list[float]) -> float:
    """Euclidean, summed in the order of the components."""
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return sqrt(total)


def distances(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """``distance`` of q and each row, to the last bit."""
    total = np.zeros(len(vectors))
    for j in range(len(q)):
        d = q[j] - vectors[:, j]
        total += d * d
    return np.sqrt(total)


def diverse(dist: np.ndarray, pair: np.ndarray, most: int) -> list[int]:
    """Of candidates by distance, those nearer to the node than to any already taken; then the nearest of the rest."""
    out, free, taken = [], np.ones(len(dist), dtype=bool), np.zeros(len(dist), dtype=bool)
    while len(out) < most and free.any():
        c = int(free.argmax())
        out.append(c)
        taken[c] = True
        free &= pair[c] >= dist
        free[c] = False
    return out + np.flatnonzero(~taken)[: most - len(out)].tolist()


class Graph:
    """Levels from 0 up: (nodes, neighbours); neighbours[i] are those of nodes[i]."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.place = []
        for nodes, _ in levels:
            p = np.full(len(vectors), -1, dtype=np.int32)
            p[nodes] = np.arange(len(nodes), dtype=np.int32)
            self.place.append(p)

    # -- search of many queries at once ---------------------------------------------------

    def _squares(self, nodes: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of nodes; infinite where a node is -1."""
        d = self.norms[nodes] - 2 * np.einsum("qnd,qd->qn", self.vectors[nodes], q) + own[:, None]
        return np.where(nodes < 0, np.inf, np.maximum(d, 0))

    def _beam(self, level: int, q: np.ndarray, own: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, nodes), nearest first, -1 where fewer than ef are found, from the entries of each query."""
        n, table, place = len(q), self.levels[level][1], self.place[level]
        rows = np.arange(n)[:, None]
        ef = max(ef, entry.shape[1])
        dist, node = np.full((n, ef), np.inf), np.full((n, ef), -1, dtype=np.int64)
        done = np.ones((n, ef), dtype=bool)
        seen = np.zeros((n, len(self.vectors) + 1), dtype=bool)  # the last column stands for -1
        d = self._squares(entry, q, own)
        order = np.argsort(d, axis=1, kind="stable")
        k = entry.shape[1]
        dist[:, :k], node[:, :k] = np.take_along_axis(d, order, 1), np.take_along_axis(entry, order, 1)
        done[:, :k] = node[:, :k] < 0
        seen[rows, entry] = True
        live = np.arange(n)
        while len(live):
            # Open the nearest nodes that aren't yet; queries without any are done.
            wait = np.where(done[live], np.inf, dist[live])
            width = min(OPENED, ef)
            pick = np.argpartition(wait, width - 1, axis=1)[:, :width] if width < ef else np.broadcast_to(np.arange(ef), wait.shape)
            found = np.isfinite(np.take_along_axis(wait, pick, 1))
            live, pick, found = live[found.any(1)], pick[found.any(1)], found[found.any(1)]
            if not len(live):
                break
            at = live[:, None]
            opened = np.where(found, node[at, pick], -1)
            done[at, pick] = True
            js = np.where(opened[:, :, None] < 0, -1, table[place[opened]]).reshape(len(live), -1)
            js = np.where(seen[at, js], -1, js)
            # A node may be the neighbour of several that are opened together: it counts once.
            js.sort(axis=1)
            js[:, 1:][js[:, 1:] == js[:, :-1]] = -1
            keep = (js >= 0).any(0)
            js = js[:, keep]
            if not js.shape[1]:
                continue
            seen[at, js] = True
            seen[:, -1] = False
            d = self._squares(js, q[live], own[live])
            alld, alln = np.concatenate([dist[live], d], 1), np.concatenate([node[live], js], 1)
            allo = np.concatenate([done[live], js < 0], 1)
            order = np.argpartition(alld, ef - 1, axis=1)[:, :ef]
            dist[live], node[live], done[live] = (np.take_along_axis(x, order, 1) for x in (alld, alln, allo))
        order = np.lexsort((node, dist), axis=1)
        return np.take_along_axis(dist, order, 1), np.take_along_axis(node, order, 1)

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """The ef nearest nodes found of each query (a row), -1 where there are fewer."""
        own = np.einsum("ij,ij->i", q, q)
        entry = np.full((len(q), 1), int(self.levels[-1][0][0]), dtype=np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            entry = self._beam(level, q, own, entry, 1)[1][:, :1]
        return self._beam(0, q, own, entry, min(ef, len(self.vectors)))[1]

    # -- construction -----------------------------------------------------------------------

    @classmethod
    def build(cls, vectors: np.ndarray, level_of: np.ndarray, m: int = M, ef: int = EF_BUILD) -> Graph:
        x = np.ascontiguousarray(vectors, dtype=np.float64)
        n, top = len(x), int(level_of.max())
        # The first node is on all levels: it is where every search begins.
        level_of = level_of.copy()
        level_of[0] = top
        spare = 8
        tables, degree, children = [], [], []
        for level in range(top + 1):
            nodes = np.flatnonzero(level_of >= level)
            tables.append((nodes, np.full((len(nodes), (2 * m if level == 0 else m) + spare), -1, dtype=np.int64)))
            degree.append(np.zeros(len(nodes), dtype=np.int64))
            children.append([[] for _ in nodes])
        graph = cls(x, tables)
        squares = lambda i, js: np.maximum(graph.norms[js] + graph.norms[i] - 2 * (x[js] @ x[i]), 0)

        def chosen(i: int, js: np.ndarray, most: int) -> np.ndarray:
            d = squares(i, js)
            order = np.lexsort((js, d))
            js, d = js[order], d[order]
            pair = graph.norms[js][:, None] + graph.norms[js] - 2 * (x[js] @ x[js].T)
            return js[diverse(d, pair, most)]

        def pruned(level: int, p: int, most: int) -> None:
            """Children stay, so that every node can be reached from the first."""
            nodes, table = graph.levels[level]
            own = np.array(children[level][p], dtype=np.int64)
            rest = np.setdiff1d(table[p, : degree[level][p]], own)
            js = np.concatenate([own, chosen(int(nodes[p]), rest, most - len(own))])
            table[p] = -1
            table[p, : len(js)] = js
            degree[level][p] = len(js)

        def parent(level: int, js: np.ndarray) -> int:
            """The first of some nodes that has room for another child, or else a node below the first."""
            place, room = graph.place[level], m if level == 0 else m // 2
            for j in js.tolist():
                if len(children[level][place[j]]) < room:
                    return j
            j = int(js[0])
            while len(children[level][place[j]]) >= room:
                j = children[level][place[j]][-1]
            return j

        done = 1
        while done < n:
            group = np.arange(done, min(n, done + min(done, GROUP)))
            q, own = x[group], graph.norms[group]
            entry = np.zeros((len(group), 1), dtype=np.int64)
            within = np.maximum(own[:, None] + own - 2 * (q @ q.T), 0)
            for level in range(top, -1, -1):
                nodes, table = graph.levels[level]
                place, most = graph.place[level], 2 * m if level == 0 else m
                on = np.flatnonzero(level_of[group] >= level)
                wide = np.zeros(len(group), dtype=bool)
                wide[on] = True
                found = np.full((len(group), ef), -1, dtype=np.int64)
                if (~wide).any():
                    found[~wide, :1] = graph._beam(level, q[~wide], own[~wide], entry[~wide], 1)[1][:, :1]
                if len(on):
                    got = graph._beam(level, q[on], own[on], entry[on], min(ef, done))[1]
                    found[on, : got.shape[1]] = got[:, :ef]
                    back: list[tuple[int, int]] = []
                    for r in on.tolist():
                        js = found[r][found[r] >= 0]
                        peers = on[on < r]
                        if len(peers):
                            near = peers[np.argsort(within[r, peers], kind="stable")[:m]]
                            js = np.concatenate([js, group[near]])
                        links = chosen(int(group[r]), js, m)
                        over = parent(level, js[np.argsort(squares(int(group[r]), js), kind="stable")])
                        if over not in links:
                            links[-1:] = over
                        children[level][place[over]].append(int(group[r]))
                        p = place[group[r]]
                        table[p, : len(links)] = links
                        degree[level][p] = len(links)
                        back += [(j, int(group[r])) for j in links.tolist()]
                    for j, i in back:
                        p = place[j]
                        if i in table[p, : degree[level][p]]:
                            continue
                        if degree[level][p] == table.shape[1]:
                            pruned(level, p, most - 1)
                            if i in table[p, : degree[level][p]]:  # a new child
                                continue
                        table[p, degree[level][p]] = i
                        degree[level][p] += 1
                # Where the search goes on, one level down.
                entry = np.where(found[:, :1] >= 0, found[:, :1], entry)
            done += len(group)
        levels = []
        for level, (nodes, table) in enumerate(graph.levels):
            most = 2 * m if level == 0 else m
            for p in np.flatnonzero(degree[level] > most).tolist():
                pruned(level, p, most)
            levels.append((nodes.astype(np.int32), table[:, :most].astype(np.int32)))
        return cls(x, levels)

    # -- as bytes ---------------------------------------------------------------------

    def parts(self) -> dict:
        return {
            "vectors": self.vectors.astype("<f8").tobytes(),
            "nodes": [n.astype("<i4").tobytes() for n, _ in self.levels],
            "neighbours": [t.astype("<i4").tobytes() for _, t in self.levels],
        }

    @classmethod
    def from_parts(cls, dim: int, vectors: bytes, nodes: list[bytes], neighbours: list[bytes]) -> Graph:
        levels = []
        for n, t in zip(nodes, neighbours):
            a = np.frombuffer(n, dtype="<i4")
            levels.append((a, np.frombuffer(t, dtype="<i4").reshape(len(a), -1)))
        return cls(np.frombuffer(vectors, dtype="<f8").reshape(-1, dim), levels)


def nearest_in(graph: Graph, ids: list[list[int]], queries: list[tuple[int, np.ndarray]], k: int, ef: int) -> list[list[tuple[float, int]]]:
    """(distance, id) of the k nearest found of each query but its own id, by distance, then id."""
    out: list = [None] * len(queries)
    left, n = list(range(len(queries))), len(graph.vectors)
    while left:
        found = graph.search(np.array([queries[r][1] for r in left]), ef)
        again = []
        for r, nodes in zip(left, found):
            own, v = queries[r]
            nodes = nodes[nodes >= 0]
            d = distances(v, graph.vectors[nodes])
            hits = sorted((s, i) for s, node in zip(d.tolist(), nodes.tolist()) for i in ids[node] if i != own)[:k]
            # While the last hit ties with the farthest node found, others as near may lie beyond it.
            if ef < n and len(nodes) >= min(ef, n) and (len(hits) < k or hits[-1][0] >= d.max()):
                again.append(r)
            out[r] = hits
        left, ef = again, 2 * ef
    return out


def distinct_vectors(df: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """Usable vectors, each once, as array<double>, with the smallest k + 1 of its ids."""
    rows = df.select(long_id(df, id_col).alias("id"), column(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    # -0.0 and 0.0 are one value.
    rows = rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    # The first ids of each task's rows are taken before the shuffle, so a very common vector sends few.
    first = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def build_index(df: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """A table, one row per shard: dim, shard, ids array<array<long>>, vectors, nodes, neighbours (flat arrays as bytes)."""
    with Scratch() as scratch:
        rows = scratch.stored(distinct_vectors(df, k, id_col, vector_col).withColumn("dim", F.size("v")), "vectors")
        shards = max(1, -(-rows.count() // shard))
        hashed = rows.withColumn("h", F.xxhash64("v")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
        schema = "dim int, shard int, ids array<array<long>>, vectors binary, nodes array<binary>, neighbours array<binary>"

        def graph_of(dim: int, shard: int, own: list[tuple]) -> dict:
            x = np.array([v for v, _, _ in own], dtype=np.float64)
            h = np.array([h for _, _, h in own], dtype=np.int64).view(np.uint64)
            u = ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
            level = np.minimum((-np.log(u) / np.log(M)).astype(int), 8)
            return {k: [x] for k, x in {"dim": dim, "shard": shard, "ids": [i for _, i, _ in own], **Graph.build(x, level).parts()}.items()}

        def build(batches: Iterator[dict]):
            at, own = None, []
            for b in batches:
                for dim, shard, v, ids, h in zip(b["dim"], b["shard"], b["v"], b["ids"], b["h"]):
                    if (dim, shard) != at:
                        if own:
                            yield graph_of(*at, own)
                        at, own = (dim, shard), []
                    own.append((v, ids, h))
            if own:
                yield graph_of(*at, own)

        # One task for each shard; a shard is bounded, whatever the table holds.
        tasks = min(shards, MOST_TASKS)
        dealt = hashed.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("dim", "shard", "h")
        return stored(map_batches(dealt, build, schema), "hnsw")


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", ef: int = EF, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query row but the query's own id."""
    graph = F.struct("ids", "vectors", "nodes", "neighbours")
    rows = queries.select(long_id(queries, id_col).alias("id"), column(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    rows = rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct().withColumn("dim", F.size("v"))
    blocks = max(1, -(-rows.count() // block))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int") + 1).groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("queries"))
    shards = (index.agg(F.max("shard")).head()[0] or 0) + 1
    # Every block of queries goes to every shard; a graph goes to its shard's task alone, where it comes first.
    graphs = index.select("dim", "shard", F.lit(0).alias("block"), graph.alias("graph"), F.lit(None).cast(blocked.schema["queries"].dataType).alias("queries"))
    asked = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("dim", "shard", "block", F.lit(None).cast(graphs.schema["graph"].dataType).alias("graph"), "queries")
    tasks = min(shards, MOST_TASKS)
    met = graphs.unionByName(asked).repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("dim", "shard", "block")

    def run(batches: Iterator[dict]):
        at, own, ids = None, None, None
        for b in batches:
            for dim, shard, g, qs in zip(b["dim"], b["shard"], b["graph"], b["queries"]):
                if g is not None:
                    at, own, ids = (dim, shard), Graph.from_parts(dim, g["vectors"], g["nodes"], g["neighbours"]), g["ids"]
                elif (dim, shard) == at:  # a shard may hold no vectors of this length
                    found = nearest_in(own, ids, [(q["id"], np.array(q["v"])) for q in qs], k, max(ef, 2 * k))
                    out = [(q["id"], q["v"], i, s) for q, hits in zip(qs, found) for s, i in hits]
                    yield {n: [o[j] for o in out] for j, n in enumerate(("query_id", "v", "vec_id", "score"))}

    found = map_batches(met, run, "query_id long, v array<double>, vec_id long, score double")
    # Queries are told apart by a digest of their vector, which the merge shuffles in its place.
    found = found.select("query_id", F.xxhash64("v").alias("v1"), F.xxhash64(F.lit(1), "v").alias("v2"), "vec_id", "score")
    by = Window.partitionBy("query_id", "v1", "v2").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Neighbours of the rows of a table that ``is_query`` (a column) selects, among all its rows."""
    return search(build_index(df, k, id_col, vector_col), df.where(is_query), k, id_col, vector_col)
