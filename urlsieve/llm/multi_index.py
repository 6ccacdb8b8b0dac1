"""Operator 12: hard negatives found with an inverted multi-index.

Vectors become integers, ``floor(scale * x)``. Two codebooks, one for either half of the
components, are fitted on at most ``sample`` rows; *every* row is indexed. Rows are dealt to
shards by a hash, and a shard's index is one row of flat arrays: its vectors sorted by cell
(code of the first half, code of the second) and, for each code, the largest distance of a
row from it. An anchor's half-scores with the codes, raised by these radii, bound what a cell
can hold. A heap walks the cells by falling sum of the two bounds; it stops when no cell left
can reach the last result kept. So results are exact; the index only saves work.

The first search finds an anchor's positives, its best rows of the same label. The second
finds, for each positive, the best rows of other labels whose score lies in a window below the
positive's score; a cell that lies wholly above all windows is stepped over.

Rows with a null id or label, a null vector, or a null or non-finite component take no part.
Shorter vectors count as filled up with zeros. Of rows with id, label and vector in common
one counts; an id with several vectors or labels is several rows, each an anchor of its own.
Ties go to the smaller id, then to a hash of the row. Scores are exact integers; beyond the
limits of a long they count as that limit. Vectors have no bound on their length but
that a shard's (``shard_rows`` of them) fit into a task. An empty table, or one without
anchors, positives or negatives, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.store import staged, table

ROW = "shard int, kind int, block int, n int, ids binary, labels binary, tags binary, vectors binary, codes binary, windows binary"
ROW_SCHEMA = pa.schema(
    [(c, pa.int32()) for c in ("shard", "kind", "block", "n")] + [(c, pa.binary()) for c in ("ids", "labels", "tags", "vectors", "codes", "windows")]
)
BLOCK = 256
READ = 512
LONG = 2**63 - 1


def codebook(x: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres of the rows: the farthest-point start, then k-means rounds."""
    at = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    far = ((x - x[at[0]]) ** 2).sum(axis=1)
    while len(at) < min(codes, len(x)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
    centres = x[at].astype(float)
    for _ in range(rounds):
        own = closest(x, centres)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


class Shard:
    """The rows of one shard by cell, and bounds on the scores a cell can hold."""

    def __init__(self, ids, labels, tags, vectors, codes, centres: tuple[np.ndarray, np.ndarray], exact: bool):
        self.ids, self.labels, self.tags, self.exact = ids, labels, tags, exact
        self.vectors = vectors.astype(object) if exact else vectors
        self.centres = centres
        half = centres[0].shape[1]
        self.used, self.own, self.radii = [], [], []
        for part, code, middle in ((vectors[:, :half], codes[:, 0], centres[0]), (vectors[:, half:], codes[:, 1], centres[1])):
            used, own = np.unique(code, return_inverse=True)
            away = np.sqrt(((part - middle[code]) ** 2).sum(axis=1))
            radii = np.zeros(len(used))
            np.maximum.at(radii, own, away)
            self.used.append(used)
            self.own.append(own)
            self.radii.append(radii)
        cell = self.own[0] * len(self.used[1]) + self.own[1]
        # rows come sorted by code pair, which is the order of the cells
        self.starts = np.searchsorted(cell, np.arange(len(self.used[0]) * len(self.used[1]) + 1))
        self.half = half

    def bounds(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Upper and lower bounds of either half's scores, by used code."""
        out = []
        for part, centres, used, radii in zip((anchor[: self.half], anchor[self.half :]), self.centres, self.used, self.radii, strict=True):
            middle = centres[used] @ part
            reach = np.sqrt((part**2).sum()) * radii
            slack = 1e-9 * (np.abs(middle) + reach) + 0.25  # scores are whole numbers, rounding is far below
            out.append((middle + reach + slack, middle - reach - slack))
        return out

    def visit(self, anchor: np.ndarray, least, above=np.inf):
        """Yield ``(rows, scores)`` of cells by falling bound, while it is not below ``least()``."""
        (up1, low1), (up2, low2) = self.bounds(anchor.astype(float))
        order1, order2 = np.argsort(-up1, kind="stable"), np.argsort(-up2, kind="stable")
        u1, u2, wide = up1[order1].tolist(), up2[order2].tolist(), len(order2)
        heap = [(-(u1[0] + u2[0]), 0, 0)]
        taken = np.full(len(order1) + 1, 0)  # how many cells of a row are behind us
        query = anchor.astype(object) if self.exact else anchor
        spans, held = [], 0
        while heap:
            bound, i, j = heapq.heappop(heap)
            if max(-bound, -LONG - 1) < least():
                break
            taken[i] = j + 1
            a, b = int(order1[i]), int(order2[j])
            # the next cell to the right, and the one below, each once both their neighbours are done
            if j + 1 < wide and (i == 0 or taken[i - 1] > j + 1):
                heapq.heappush(heap, (-(u1[i] + u2[j + 1]), i, j + 1))
            if i + 1 < len(u1) and taken[i + 1] == j:
                heapq.heappush(heap, (-(u1[i + 1] + u2[j]), i + 1, j))
            start, end = self.starts[a * wide + b], self.starts[a * wide + b + 1]
            if start == end or low1[a] + low2[b] > above:
                continue
            spans.append((start, end))
            held += end - start
            if held >= READ:
                yield self.read(spans, query)
                spans, held = [], 0
        if spans:
            yield self.read(spans, query)

    def read(self, spans, query) -> tuple[np.ndarray, np.ndarray]:
        rows = np.concatenate([np.arange(a, b) for a, b in spans])
        scores = self.vectors[rows] @ query
        if self.exact:
            return rows, np.array([max(-LONG - 1, min(LONG, s)) for s in scores], object)
        return rows, np.rint(scores).astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, many: int) -> np.ndarray:
        """Places of the ``many`` first of some rows: larger score, smaller id, smaller tag."""
        return np.array(sorted(range(len(rows)), key=lambda p: (-scores[p], self.ids[rows[p]], self.tags[rows[p]]))[:many], np.int64)

    def keep(self, held, rows, scores, many: int):
        """``held`` and new rows, cut to the first ``many``; scores below the last one held are left out early."""
        if len(held[0]) == many:
            fit = scores >= held[1][-1]
            rows, scores = rows[fit], scores[fit]
        if not len(rows):
            return held
        if len(rows) > 4 * many and not self.exact:
            fit = scores >= np.partition(scores, len(scores) - many)[len(scores) - many]
            rows, scores = rows[fit], scores[fit]
        if len(rows) > 64 * many and not self.exact:  # one score over and over: the smallest ids are all that can count
            first = np.lexsort((self.tags[rows], self.ids[rows], -scores))[:many]
            rows, scores = rows[first], scores[first]
        rows, scores = np.concatenate([held[0], rows]), np.concatenate([held[1], scores])
        first = self.best(rows, scores, many)
        return rows[first], scores[first]

    def nothing(self):
        return np.empty(0, np.int64), np.empty(0, object if self.exact else np.int64)

    def positives(self, label: int, tag: int, vec_id: int, anchor: np.ndarray, many: int):
        """The first ``many`` other rows of the label in this shard."""
        held = self.nothing()
        for rows, scores in self.visit(anchor, lambda: held[1][-1] if len(held[0]) == many else -np.inf):
            own = (self.labels[rows] == label) & ((self.tags[rows] != tag) | (self.ids[rows] != vec_id))
            held = self.keep(held, rows[own], scores[own], many)
        return held

    def negatives(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], many: int):
        """For each window ``(least, most)`` on 100 x score, its first ``many`` rows of other labels."""
        held = [self.nothing() for _ in windows]

        def least():
            return min(
                (h[1][-1] if len(h[0]) == many else low / 100 for h, (low, high) in zip(held, windows, strict=True) if low <= high),
                default=np.inf,
            )

        for rows, scores in self.visit(anchor, least, max(high for _, high in windows) / 100 + 1):
            other = self.labels[rows] != label
            rows, scores = rows[other], scores[other]
            for w, (low, high) in enumerate(windows):
                inside = (100 * scores >= low) & (100 * scores <= high)
                held[w] = self.keep(held[w], rows[inside.astype(bool)], scores[inside.astype(bool)], many)
        return held


def usable(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, x, tag)``: distinct rows that take part, with whole-number components."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x")
    )
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("long"))).distinct()
    return rows.withColumn("tag", F.xxhash64("vec_id", "label", "x"))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column as a matrix, filled up with zeros."""
    flat, sizes = _numbers(column.flatten()), _numbers(pc.list_value_length(column))
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def build_index(points: DataFrame, shards: int, dim: int, centres: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per shard: its rows sorted by cell, as flat arrays."""
    half = centres[0].shape[1]

    def run(source):
        held = [b for b in source if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        shard = _numbers(rows["shard"].combine_chunks())
        ids, labels, tags = (_numbers(rows[c].combine_chunks()) for c in ("vec_id", "label", "tag"))
        x = np.concatenate([_padded(b.column("x"), dim) for b in held])
        codes = np.column_stack([closest(x[:, :half].astype(float), centres[0]), closest(x[:, half:].astype(float), centres[1])]).astype(np.int32)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            own = own[np.lexsort((tags[own], ids[own], codes[own, 1], codes[own, 0]))]
            yield pa.RecordBatch.from_pylist([{
                "shard": int(s), "kind": 0, "block": 0, "n": len(own), "ids": ids[own].tobytes(), "labels": labels[own].tobytes(),
                "tags": tags[own].tobytes(), "vectors": x[own].tobytes(), "codes": codes[own].tobytes(), "windows": b"",
            }], ROW_SCHEMA)

    dealt = points.withColumn("shard", F.pmod(F.col("tag"), F.lit(shards)).cast("int"))
    return dealt.repartitionById(shards, F.col("shard")).mapInArrow(run, ROW)


def pack(anchors: DataFrame, dim: int) -> DataFrame:
    """Anchors ``(vec_id, label, tag, x, scores)`` in blocks, as rows of the index table's shape."""

    def run(source):
        for batch in source:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids, labels, tags = (_numbers(part.column(c)) for c in ("vec_id", "label", "tag"))
                scores = part.column("scores").to_pylist()
                wide = max((len(s) for s in scores), default=0)
                known = np.array([[len(s), *s, *[0] * (wide - len(s))] for s in scores], np.int64)
                yield pa.RecordBatch.from_pylist([{
                    "shard": 0, "kind": 1, "block": int(tags[0] % (1 << 31)), "n": len(ids), "ids": ids.tobytes(), "labels": labels.tobytes(),
                    "tags": tags.tobytes(), "vectors": _padded(part.column("x"), dim).tobytes(), "codes": b"", "windows": known.tobytes(),
                }], ROW_SCHEMA)

    return anchors.select("vec_id", "label", "tag", "x", "scores").mapInArrow(run, ROW)


FOUND = "anchor_id long, anchor_tag long, nth int, vec_id long, tag long, score long"


def search(index: DataFrame, anchors: DataFrame, shards: int, dim: int, centres, exact: bool, many: int, window: tuple[int, int] | None = None) -> DataFrame:
    """Every shard's first ``many`` rows for each anchor; with ``window`` for each of its ``scores``.

    ``window`` holds the least and the most percent of a positive's score.
    """
    everywhere = pack(anchors, dim).drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = index.unionByName(everywhere.select(*index.columns))

    def run(source):
        shard = now = None
        for batch in source:
            for row in batch.to_pylist():
                n = row["n"]
                ids, labels, tags = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "tags"))
                x = np.frombuffer(row["vectors"], np.int64).reshape(n, dim)
                x = x if exact else x.astype(float)
                if row["kind"] == 0:
                    codes = np.frombuffer(row["codes"], np.int32).reshape(n, 2)
                    shard, now = Shard(ids, labels, tags, x, codes, centres, exact), row["shard"]
                    continue
                if now != row["shard"]:
                    continue  # no row has been dealt to this shard
                out = []
                known = np.frombuffer(row["windows"], np.int64).reshape(n, -1)
                for q in range(n):
                    if window is None:
                        found = [shard.positives(labels[q], tags[q], ids[q], x[q], many)]
                    else:
                        scores = known[q, 1 : 1 + known[q, 0]].tolist()
                        spans = [(window[0] * s, window[1] * s) for s in scores]
                        if not any(low <= high for low, high in spans):
                            continue
                        found = shard.negatives(labels[q], x[q], spans, many)
                    for nth, (rows, scores) in enumerate(found):
                        out += [(ids[q], tags[q], nth, shard.ids[r], shard.tags[r], int(s)) for r, s in zip(rows, scores, strict=True)]
                if out:
                    yield table(["anchor_id", "anchor_tag", "nth", "vec_id", "tag", "score"], [pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))])

    return both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "block").mapInArrow(run, FOUND)


def first(found: DataFrame, many: int, *per: str) -> DataFrame:
    """The first ``many`` of all shards together, ranked from 1."""
    order = Window.partitionBy(*per).orderBy(F.desc("score"), "vec_id", "tag")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= many)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    codes: int = 64, sample: int = 16_384, shard_rows: int = 1 << 16, min_shards: int = 6,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``. A negative's score lies between
    ``low`` and ``high`` percent of its positive's. ``codes`` is the most codes of a half.
    """
    spark = vectors.sparkSession
    points = staged(usable(vectors, scale, id_col, vector_col, label_col), "hard-points")
    size, dim, most = points.agg(F.count("*"), F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double")))))).first()
    if not size or not dim:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    exact = dim * most * most >= 2**53
    shards = max(min_shards, -(-size // shard_rows))
    picked = points.select("x").orderBy(F.xxhash64("tag"), "tag").limit(sample).toArrow()
    x = np.concatenate([_padded(c, dim) for c in picked["x"].chunks]).astype(float)
    half = (dim + 1) // 2
    # a cell holds some sixteen rows of a shard on average
    codes = int(min(codes, max(2, (size / shards / 16) ** 0.5)))
    centres = (codebook(x[:, :half], codes), codebook(x[:, half:], codes))
    index = staged(build_index(points, shards, dim, centres), "hard-index")
    anchors = points.filter(F.col("vec_id") % every == 0).withColumn("scores", F.array().cast("array<long>"))
    near = search(index, anchors, shards, dim, centres, exact, positives).drop("nth")
    near = staged(first(near, positives, "anchor_id", "anchor_tag"), "hard-positives")
    ranked = near.groupBy("anchor_id", "anchor_tag").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    asked = anchors.drop("scores").join(
        ranked.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_tag").alias("tag"), F.col("p.score").alias("scores")), ["vec_id", "tag"]
    )
    far = search(index, asked, shards, dim, centres, exact, negatives, (low, high))
    far = first(far, negatives, "anchor_id", "anchor_tag", "nth")
    named = near.select("anchor_id", "anchor_tag", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["anchor_id", "anchor_tag", "nth"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


#: the same by comparing every anchor with every row
ORACLE = """
WITH rows_of AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * v::DOUBLE) for v in embedding] AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
    FROM rows_of a, rows_of b WHERE a.vec_id % 100 = 0 AND a.vec_id != b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER best)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10"""
