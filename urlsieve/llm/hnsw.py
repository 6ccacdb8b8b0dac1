"""Operator 10: approximate nearest neighbours by one navigable small-world graph per shard.

Equal vectors are one point that knows its smallest ids (one more than asked for, which is
all a result can need). Points are dealt to shards by a hash of their id; a shard has about
``shard_rows`` points at most, at least ``min_shards`` shards keep all tasks busy. Each task
builds the hierarchical graph of one shard, written as one row of flat arrays: ids, vectors,
neighbours of every layer and their counts. Queries travel in packed blocks to every shard;
a task loads the shard's row and then streams the blocks. Results of all shards merge by
``(score, id)``.

Largest inner product becomes nearest neighbour by one more component, sqrt(M^2 - |x|^2) with
M the largest norm, which makes all norms equal and does not change products with queries.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do those
whose length is not the most frequent one (the longer of two). Null ids neither. Of rows with an
id and vector in common one counts; an id with two vectors stands for both. An empty table,
or one without queries, gives an empty result. Ties go to the smaller id. Vectors may be of any
length as long as those of a shard fit into a task. Only id and vector are read, so that other columns can't clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.store import staged, table

INDEX = "shard int, kind int, block int, n int, dim int, entry int, ids binary, vectors binary, layers array<binary>"
BLOCK = 256


class Graph:
    """Layers of fixed-width neighbour arrays over the points of one shard."""

    def __init__(self, points: np.ndarray, width: int, layers: list[np.ndarray], entry: int):
        self.points, self.width, self.layers, self.entry = points, width, layers, entry
        self.seen = np.zeros(len(points), np.int64)
        self.turn = 0

    def near(self, query: np.ndarray, start: list[tuple[float, int]], layer: int, size: int) -> list[tuple[float, int]]:
        """The ``size`` most similar points found from ``start``, best first."""
        self.turn += 1
        seen, turn, points, links = self.seen, self.turn, self.points, self.layers[layer]
        open_ = [(-s, p) for s, p in start]
        best = list(start)
        heapq.heapify(open_)
        heapq.heapify(best)
        seen[[p for _, p in start]] = turn
        while open_:
            s, p = heapq.heappop(open_)
            if len(best) >= size and -s < best[0][0]:
                break
            around = links[p]
            around = around[around >= 0]
            around = around[seen[around] != turn]
            if not len(around):
                continue
            seen[around] = turn
            sims = points[around] @ query
            if len(best) >= size:
                good = sims > best[0][0]
                around, sims = around[good], sims[good]
            for sim, q in zip(sims.tolist(), around.tolist(), strict=True):
                if len(best) < size:
                    heapq.heappush(best, (sim, q))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, q))
                else:
                    continue
                heapq.heappush(open_, (-sim, q))
        return sorted(best, reverse=True)

    def descend(self, query: np.ndarray, to: int) -> list[tuple[float, int]]:
        """A close point on layer ``to`` by greedy steps from the top."""
        at = [(float(self.points[self.entry] @ query), self.entry)]
        for layer in range(len(self.layers) - 1, to, -1):
            at = self.near(query, at, layer, 1)
        return at

    def search(self, query: np.ndarray, size: int) -> np.ndarray:
        return np.array([p for _, p in self.near(query, self.descend(query, 0), 0, size)], np.int64)


def spread(points: np.ndarray, sims: np.ndarray, many: int) -> list[int]:
    """Up to ``many`` of the points (by falling similarity), those first that lie in new directions."""
    if len(points) <= many:
        return list(range(len(points)))
    between = points @ points.T
    kept: list[int] = []
    closest = np.full(len(points), -np.inf)
    for i in range(len(points)):
        if sims[i] > closest[i]:
            kept.append(i)
            if len(kept) == many:
                return kept
            np.maximum(closest, between[i], out=closest)
    left = [i for i in range(len(points)) if i not in set(kept)]
    return kept + left[: many - len(kept)]


def build(points: np.ndarray, width: int, breadth: int, seed: int) -> Graph:
    """Insert the points one after the other; ``width`` links, twice as many on the lowest layer."""
    n = len(points)
    height = np.floor(-np.log(np.random.default_rng([seed, n]).random(n)) / np.log(width)).astype(int)
    top = int(height.max())
    layers = [np.full((n, width * (1 if level else 2)), -1, np.int32) for level in range(top + 1)]
    graph = Graph(points, width, layers[: height[0] + 1], 0)
    degree = [np.zeros(n, np.int32) for _ in layers]
    for p in range(1, n):
        query = points[p]
        at = graph.descend(query, min(int(height[p]), len(graph.layers) - 1))
        for level in range(min(int(height[p]), len(graph.layers) - 1), -1, -1):
            at = graph.near(query, at, level, breadth)
            found = np.array([q for _, q in at], np.int64)
            sims = np.array([s for s, _ in at])
            links, room = layers[level], layers[level].shape[1]
            own = found[spread(points[found], sims, width)]
            links[p, : len(own)] = own
            degree[level][p] = len(own)
            for q in own.tolist():
                d = degree[level][q]
                if d < room:
                    links[q, d] = p
                    degree[level][q] = d + 1
                    continue
                those = np.append(links[q], p)
                sims_q = points[those] @ points[q]
                order = np.argsort(-sims_q, kind="stable")
                those = those[order]
                kept = those[spread(points[those], sims_q[order], room)]
                links[q, : len(kept)] = kept
                links[q, len(kept) :] = -1
                degree[level][q] = len(kept)
        if height[p] + 1 > len(graph.layers):
            graph.layers = layers[: height[p] + 1]
            graph.entry = p
    return graph


def points_of(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """``(uid, embedding, ids)``: distinct usable vectors with their ``k + 1`` smallest ids."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0) & ~bad)
    usual = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    rows = rows.filter(F.size("embedding") == (usual.dim if usual else 0))
    # -0.0 and 0.0 are one value; the rank limit applies before the shuffle, so copies of one vector fold
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= k + 1)
    return first.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("uid"), "embedding", "ids")


def build_index(points: DataFrame, shards: int, norm: float, width: int, breadth: int) -> DataFrame:
    """One row per shard: its graph as flat arrays."""

    def run(source):
        held: dict[str, list] = {"uid": [], "vector": []}
        now = None

        def done():
            ids = np.concatenate(held["uid"])
            original = np.concatenate(held["vector"])
            rest = np.sqrt(np.maximum(norm**2 - (original**2).sum(axis=1), 0))
            graph = build(np.column_stack([original, rest]).astype(np.float32), width, breadth, int(now))
            return pa.RecordBatch.from_pylist([{
                "shard": now, "kind": 0, "block": 0, "n": len(ids), "dim": original.shape[1], "entry": graph.entry,
                "ids": ids.tobytes(), "vectors": original.tobytes(), "layers": [x.tobytes() for x in graph.layers],
            }], INDEX_SCHEMA)

        for batch in source:
            if not batch.num_rows:
                continue
            shards_ = batch.column("shard").to_numpy(zero_copy_only=False)
            ids = batch.column("uid").to_numpy(zero_copy_only=False)
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            cuts = [0, *(np.flatnonzero(np.diff(shards_)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if now is not None and shards_[a] != now:
                    yield done()
                    held = {"uid": [], "vector": []}
                now = int(shards_[a])
                held["uid"].append(ids[a:b])
                held["vector"].append(flat[a:b])
        if now is not None:
            yield done()

    dealt = points.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), "uid", "embedding")
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "uid").mapInArrow(run, INDEX)


INDEX_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("entry", pa.int32()),
    ("ids", pa.binary()), ("vectors", pa.binary()), ("layers", pa.list_(pa.binary())),
])


def pack(queries: DataFrame) -> DataFrame:
    """Query rows ``(query_id, embedding)`` in blocks, as rows of the index table's shape."""

    def run(source):
        for batch in source:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids = part.column("query_id").to_numpy(zero_copy_only=False)
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pylist([{
                    "shard": 0, "kind": 1, "block": int(ids[0] % (1 << 31)), "n": len(ids), "dim": len(flat) // len(ids), "entry": 0,
                    "ids": ids.tobytes(), "vectors": flat.tobytes(), "layers": [],
                }], INDEX_SCHEMA)

    return queries.select("query_id", "embedding").mapInArrow(run, INDEX)


def search_index(index: DataFrame, queries: DataFrame, shards: int, norm: float, k: int, width: int, breadth: int) -> DataFrame:
    """``(query_id, uid, score)``: the ``k + 1`` best points of every shard for each query."""
    everywhere = pack(queries).drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = index.unionByName(everywhere.select(*index.columns))
    sorted_ = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "block")

    def run(source):
        graph = ids = original = now = None
        for batch in source:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])
                if row["kind"] == 0:
                    ids, original, now = np.frombuffer(row["ids"], np.int64), vectors, row["shard"]
                    rest = np.sqrt(np.maximum(norm**2 - (original**2).sum(axis=1), 0))
                    layers = [np.frombuffer(x, np.int32).reshape(row["n"], -1) for x in row["layers"]]
                    graph = Graph(np.column_stack([original, rest]).astype(np.float32), width, layers, row["entry"])
                    continue
                if now != row["shard"]:
                    continue  # no point has been dealt to this shard
                out_q, out_p, out_s = [], [], []
                for q, vector in zip(np.frombuffer(row["ids"], np.int64).tolist(), vectors, strict=True):
                    found = graph.search(np.append(vector, 0).astype(np.float32), max(breadth, k + 1))
                    score = (original[found] * vector).sum(axis=1)
                    best = np.lexsort((ids[found], -score))[: k + 1]
                    out_q.append(np.full(len(best), q))
                    out_p.append(ids[found[best]])
                    out_s.append(score[best])
                yield table(["query_id", "uid", "score"], [pa.array(np.concatenate(x)) for x in (out_q, out_p, out_s)])

    return sorted_.mapInArrow(run, "query_id long, uid long, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, every: int = 20, k: int = 20, shard_rows: int = 1 << 16, min_shards: int = 8,
    width: int = 16, build_breadth: int = 96, search_breadth: int = 160, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each query.

    Queries are the rows of ``vectors`` whose id is divisible by ``every`` and, with
    ``queries``, belongs to that table's ids as well; a row is no candidate for itself.
    """
    points = staged(points_of(vectors, k, id_col, vector_col), "hnsw-points")
    size, norm = points.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not size:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = float(np.sqrt(norm))
    shards = max(min_shards, -(-size // shard_rows))
    index = staged(build_index(points, shards, norm, width, build_breadth), "hnsw-index")
    asked = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    asked = asked.filter(F.col("query_id") % every == 0)
    if queries is not None:
        asked = asked.join(queries.select(F.col(id_col).cast("long").alias("query_id")).distinct(), "query_id")
    asked = asked.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).distinct()
    # only vectors that take part: those that are points themselves
    asked = asked.join(points.select("embedding"), "embedding", "left_semi")
    found = staged(search_index(index, asked, shards, norm, k, width, search_breadth), "hnsw-found")
    # an id with several vectors, or none, is one query: its best scores count
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), "uid")
    best = found.withColumn("nth", F.row_number().over(whole)).filter(F.col("nth") <= k + 1)
    named = best.join(points.select("uid", "ids"), "uid").select("query_id", "score", F.explode("ids").alias("vec_id"))
    named = named.filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
