import math

import numpy as np
import pytest

from urlsieve.llm import hnsw
from urlsieve.llm.queries import op10_hnsw


def test_recall_and_scores_of_the_query(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in rows}
    got: dict[int, list] = {}
    for r in op10_hnsw(spark, small_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in x if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        exact = sorted(((-float(x[q] @ x[i]), i) for i in x if i != q))[:20]
        assert [f[0] for f in sorted(found)] == list(range(1, len(exact) + 1))
        assert all(abs(s - x[q] @ x[i]) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in sorted(found)] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i in exact} & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_over_several_shards(spark, scaled):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    if scaled:
        x *= rng.uniform(0.2, 3, (3000, 1))  # inner products, not angles
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = hnsw.nearest(rows, every=50, k=10, shard_rows=700, min_shards=3).collect()
    best = {q: set(np.argsort(-np.where(np.arange(3000) == q, -np.inf, x @ x[q]))[:10].tolist()) for q in range(0, 3000, 50)}
    assert sum(r.vec_id in best[r.query_id] for r in got) >= 0.9 * 10 * len(best)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [math.nan, 1.0]),
        (6, [math.inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, -0.0]), (9, [-1.0, 0.0]),
        (40, [0.0, 0.0]), (60, None),
    ] + [(100 + i, [0.25, -0.25]) for i in range(0, 600, 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    got: dict[int, list] = {}
    for r in hnsw.nearest(df, k=20, min_shards=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    copies = [100 + i for i in range(0, 600, 3)]
    asked = {0, 20, *(i for i in copies if i % 20 == 0)}
    assert set(got) == asked
    first = sorted(got[0])
    assert first[:2] == [(1, 20, 1.0), (2, 1, 0.5)] and [f[1] for f in first[2:]] == copies[:18]
    some = min(i for i in copies if i % 20 == 0)
    assert sorted(got[some])[0][1:] == (0, 0.25) and sorted(got[some])[1][1:] == (20, 0.25)
    assert [f[1] for f in sorted(got[some])[2:]] == [i for i in copies if i != some][:18]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.nearest(empty).collect() == []
    alone = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert hnsw.nearest(alone).collect() == []
    assert hnsw.nearest(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")).collect() == []
