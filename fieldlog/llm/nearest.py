"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, kept as flat arrays.

Rows are dealt to shards, whose size grows with the root of the table's, by a hash of their id, so that a vector which very many rows share is spread over all
shards; within a shard equal vectors are one node with several ids. A shard's graph is one row: ids, vectors, and for each level the
nodes and their neighbours as flat arrays. Queries go to every shard in blocks; each gives its nearest, with distances in double
precision on the original vectors, and the shards' results are merged.

Defined cases: vectors that are null, all zero, or hold a null or a non-finite component take no part, as queries or as candidates. Vectors
of different lengths never meet. A row is no candidate for its own id. Equal distances are ordered by id. Rows that repeat an id
are candidates once each. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows of a shard at least, if the table has as many.
SHARD_ROWS = 4000
BLOCK = 2000
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 14, 48, 100


class Graph:
    """Nodes with neighbours by level. links[level]: (nodes on the level, most neighbours), padded with -1; row[level]: node to row or -1."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 1):
        self.vectors, self.most, self.width = vectors.astype(np.float32), links, width
        n = len(vectors)
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(links)).astype(int), 12)
        top = int(self.level.max())
        self.links = [np.full((n if k == 0 else int((self.level >= k).sum()), 2 * links if k == 0 else links), -1, dtype=np.int32) for k in range(top + 1)]
        self.row = [np.arange(n, dtype=np.int32) if k == 0 else np.where(self.level >= k, np.cumsum(self.level >= k) - 1, -1).astype(np.int32) for k in range(top + 1)]
        self.sizes = [np.zeros(len(x), dtype=np.int32) for x in self.links]
        self.stamp, self.mark = np.zeros(n, dtype=np.int64), 0
        self.start, self.top = 0, int(self.level[0]) if n else 0
        for i in range(1, n):
            self._add(i)

    def near(self, q: np.ndarray, q2: float, nodes: np.ndarray) -> np.ndarray:
        return self.norms[nodes] - 2 * (self.vectors[nodes] @ q) + q2

    def neighbours(self, node: int, level: int) -> np.ndarray:
        r = self.row[level][node]
        return self.links[level][r, : self.sizes[level][r]]

    def search(self, q: np.ndarray, q2: float, start: list[tuple[float, int]], level: int, width: int) -> list[tuple[float, int]]:
        """The nearest found, as (distance squared, node), nearest first."""
        self.mark += 1
        for _, i in start:
            self.stamp[i] = self.mark
        ahead = list(start)
        heapq.heapify(ahead)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while ahead:
            d, i = heapq.heappop(ahead)
            if len(best) >= width and d > -best[0][0]:
                break
            near = self.neighbours(i, level)
            near = near[self.stamp[near] != self.mark]
            if not len(near):
                continue
            self.stamp[near] = self.mark
            ds = self.near(q, q2, near)
            if len(best) >= width:
                ok = ds < -best[0][0]
                near, ds = near[ok], ds[ok]
            for x, j in zip(ds.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-x, j))
                    heapq.heappush(ahead, (x, j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, j))
                    heapq.heappush(ahead, (x, j))
        return sorted((-d, i) for d, i in best)

    def chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: nearer to the node than to any chosen before; filled up with the nearest others."""
        if len(found) <= most:
            return [i for _, i in found]
        nodes = np.array([i for _, i in found])
        v = self.vectors[nodes]
        between = self.norms[nodes][:, None] - 2 * (v @ v.T) + self.norms[nodes][None, :]
        kept: list[int] = []
        for k, (d, _) in enumerate(found):
            if not kept or between[k, kept].min() > d:
                kept.append(k)
                if len(kept) == most:
                    break
        if len(kept) < most:
            taken = set(kept)
            kept += [k for k in range(len(found)) if k not in taken][: most - len(kept)]
        return nodes[kept].tolist()

    def _link(self, i: int, j: int, level: int) -> None:
        r, table, sizes = self.row[level][i], self.links[level], self.sizes[level]
        if sizes[r] < table.shape[1]:
            table[r, sizes[r]] = j
            sizes[r] += 1
            return
        nodes = np.append(table[r], j)
        ds = self.near(self.vectors[i], float(self.norms[i]), nodes)
        kept = self.chosen(sorted(zip(ds.tolist(), nodes.tolist())), table.shape[1])
        table[r, : len(kept)] = kept
        sizes[r] = len(kept)

    def _add(self, i: int) -> None:
        q, q2, level = self.vectors[i], float(self.norms[i]), int(self.level[i])
        at = [(float(self.near(q, q2, np.array([self.start]))[0]), self.start)]
        for k in range(self.top, level, -1):
            at = self.search(q, q2, at, k, 1)
        for k in range(min(level, self.top), -1, -1):
            at = self.search(q, q2, at, k, self.width)
            kept = self.chosen(at, self.most)
            r = self.row[k][i]
            self.links[k][r, : len(kept)] = kept
            self.sizes[k][r] = len(kept)
            for j in kept:
                self._link(j, i, k)
        if level > self.top:
            self.top, self.start = level, i

    def nearest(self, q: np.ndarray, width: int = SEARCH_WIDTH) -> list[int]:
        q = q.astype(np.float32)
        q2 = float(q @ q)
        at = [(float(self.near(q, q2, np.array([self.start]))[0]), self.start)]
        for k in range(self.top, 0, -1):
            at = self.search(q, q2, at, k, 1)
        return [i for _, i in self.search(q, q2, at, 0, width)]

    def flat(self) -> dict:
        """The graph as flat arrays."""
        return {
            "levels": self.level.astype("<i4").tobytes(), "start": self.start, "top": self.top,
            "links": [x.astype("<i4").tobytes() for x in self.links], "sizes": [x.astype("<i4").tobytes() for x in self.sizes],
        }

    @staticmethod
    def from_flat(vectors: np.ndarray, flat: dict) -> Graph:
        g = Graph.__new__(Graph)
        g.vectors = vectors.astype(np.float32)
        g.norms = np.einsum("ij,ij->i", g.vectors, g.vectors)
        g.level = np.frombuffer(flat["levels"], "<i4")
        g.start, g.top = flat["start"], flat["top"]
        g.sizes = [np.frombuffer(x, "<i4") for x in flat["sizes"]]
        g.links = [np.frombuffer(x, "<i4").reshape(len(s), -1) for x, s in zip(flat["links"], g.sizes)]
        g.row = [np.where(g.level >= k, np.cumsum(g.level >= k) - 1, -1) for k in range(len(g.links))]
        g.stamp, g.mark = np.zeros(len(g.level), dtype=np.int64), 0
        return g


#: Partitions in which graphs are built at most; a partition with several shards builds one after the other.
MOST_PARTITIONS = 20_000
INDEX = "dim int, shard int, n long, ids binary, node_of binary, vectors binary, levels binary, start int, top int, links array<binary>, sizes array<binary>"


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def shards_of(n: int, shard_rows: int = SHARD_ROWS) -> int:
    """Shards of n rows. A graph is searched in about the logarithm of its rows, so shards grow with the root of n: n / 100 queries visit n ** 1.5 / 400 graphs, not n * n / 400,000."""
    return -(-n // max(shard_rows, 4 * math.isqrt(n)))


def build(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """From (vec_id, vector, dim): the index, one row a shard."""
    sizes = {r["dim"]: shards_of(r["n"], shard_rows) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("dim")] if sizes else F.lit(1)

    def make(keys, t):
        import pyarrow as pa

        dim, shard = (k.as_py() for k in keys)
        ids = t.column("vec_id").to_numpy()
        vectors = np.array(t.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        nodes, node_of = np.unique(vectors[order], axis=0, return_inverse=True)
        # Graphs grow worse when neighbours come in order: nodes enter in a random one.
        turn = np.random.default_rng(2).permutation(len(nodes))
        back = np.empty_like(turn)
        back[turn] = np.arange(len(turn))
        nodes, node_of = nodes[turn], back[node_of.reshape(-1)]
        flat = Graph(nodes).flat()
        row = {"dim": dim, "shard": shard, "n": len(ids), "ids": ids[order].astype("<i8").tobytes(), "node_of": node_of.astype("<i4").tobytes(), "vectors": nodes.astype("<f8").tobytes(), **flat}
        kinds = {"dim": pa.int32(), "shard": pa.int32(), "n": pa.int64(), "start": pa.int32(), "top": pa.int32(), "links": pa.list_(pa.binary()), "sizes": pa.list_(pa.binary())}
        return pa.table({c: pa.array([x], kinds.get(c, pa.binary())) for c, x in row.items()})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards).cast("int"))
    # A graph takes long for its few bytes, so shards are dealt out by number, not by size: two partitions a shard keep most apart.
    dealt = dealt.repartition(max(1, min(MOST_PARTITIONS, 2 * sum(sizes.values()))), "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInArrow(make, INDEX)


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for queries (query_id, vector, dim), the k nearest found of all shards, nearest first."""

    def look(left, right):
        import pyarrow as pa

        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            x = left.to_pylist()[0]
            ids, node_of = np.frombuffer(x["ids"], "<i8"), np.frombuffer(x["node_of"], "<i4")
            vectors = np.frombuffer(x["vectors"], "<f8").reshape(-1, x["dim"])
            graph = Graph.from_flat(vectors, x)
            by_node = np.argsort(node_of, kind="stable")
            first = np.searchsorted(node_of[by_node], np.arange(len(vectors) + 1))
            for query, v in zip(right.column("query_id").to_pylist(), right.column("vector").to_pylist()):
                q = np.array(v, dtype=np.float64)
                nodes = np.array(graph.nearest(q, max(SEARCH_WIDTH, 2 * k)))
                d = np.sqrt(((vectors[nodes] - q) ** 2).sum(axis=1))
                found = []
                for j in np.argsort(d, kind="stable").tolist():
                    if len(found) >= k and d[j] > found[-1][0]:
                        break
                    # k + 1 ids of a node, smallest first, are enough: one may be the query's own.
                    own = ids[by_node[first[nodes[j]] : first[nodes[j] + 1]][: k + 1]]
                    found.extend((float(d[j]), i) for i in own.tolist() if i != query)
                    found = sorted(found)[:k]
                out.extend((query, i, s) for s, i in found)
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    # A stated query set against all rows, in blocks: each (shard, block) is one bounded task.
    blocks = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    left = index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = queries.join(blocks, "dim").join(shards, "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("blocks", "shards")
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest of each row whose id is divisible by `every`, among all other rows. shard_rows: see `shards_of`."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("vector"))
    index = written(build(rows, shard_rows), "hnsw")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "vector", "dim").dropDuplicates(["query_id"])
    return search(index, queries, k)
