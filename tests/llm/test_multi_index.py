import math

import numpy as np
import pytest

from check import compare, connect
from urlsieve.llm import multi_index as M
from urlsieve.llm.queries import ORACLES, op12_multi_index


def brute(rows, every=100, positives=5, negatives=10):
    """``rows`` (id, label, whole-number components), all distinct, with Python's integers."""
    wide = max((len(r[2]) for r in rows), default=0)
    rows = [(i, l, [*x, *[0] * (wide - len(x))]) for i, l, x in rows]
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, la, xa in (r for r in rows if r[0] % every == 0):
        scored = sorted((-held(sum(p * q for p, q in zip(xa, x, strict=True))), i, l == la) for i, l, x in rows if (i, l, x) != (a, la, xa))
        for minus, i, _ in [s for s in scored if s[2]][:positives]:
            inside = [(n, s) for s, n, same in scored if not same and 30 * -minus <= 100 * -s <= 90 * -minus][:negatives]
            out += [(a, i, rank, n, -minus, -s) for rank, (n, s) in enumerate(inside, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def whole(x):
    return [math.floor(256 * v) for v in x]


def test_query_matches_sql(spark, small_dir):
    got = op12_multi_index(spark, small_dir).toPandas()
    assert compare(got, connect(small_dir).execute(ORACLES["op12_multi_index"]).df()).startswith("ok")


@pytest.mark.parametrize("codes, shard_rows", [(64, 300), (3, 1 << 16)])
def test_same_as_brute_force(spark, codes, shard_rows):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 10))
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(scale=0.4, size=(1500, 10))).round(2)
    rows = [(int(i), int(i % 4), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = found(M.hard_negatives(df, codes=codes, shard_rows=shard_rows, min_shards=2))
    assert got == brute([(i, l, whole(v)) for i, l, v in rows])


def test_odd_rows(spark):
    same = [0.5, 0.25]
    rows = [
        (0, 1, same), (0, 1, same), (1, 1, None), (2, None, same), (None, 1, same), (3, 1, [math.nan, 1.0]), (4, 2, [math.inf, 0.0]), (5, 2, [None, 1.0]),
        (6, 2, []), (7, 2, [0.25]), (8, 2, [0.3, 0.1, 9.0]), (9, 1, [0.0, 0.0]), (100, 1, [-0.5, -0.25]), (200, 1, same), (200, 2, same), (200, 2, [0.1, 0.0]),
        (300, 3, [0.0, 0.0]), (12, 1, [0.5, 0.25, 0.0]),
    ] + [(1000 + i, i % 2 + 1, [0.3, 0.2]) for i in range(7, 400, 3)]  # one vector over and over
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, rank string, shard int")
    kept, seen = [], set()
    for i, l, x in rows:
        if i is None or l is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if (i, l, tuple(x)) not in seen:
            seen.add((i, l, tuple(x)))
            kept.append((i, l, whole(x)))
    wide = max(len(r[2]) for r in kept)
    padded = [(i, l, [*x, *[0] * (wide - len(x))]) for i, l, x in kept]
    assert len({(i, l, tuple(x)) for i, l, x in padded}) == len(padded)
    got = M.hard_negatives(df, min_shards=3)
    # several anchors of one id: compare as a multiset
    assert found(got) == brute(kept)


@pytest.mark.parametrize("big", [2.0**21, 2.0**40])
def test_scores_beyond_doubles_and_longs(spark, big):
    rows = [(0, 0, [big, 1.0]), (1, 0, [big, 3.0]), (2, 0, [big, 2.0]), (100, 1, [-big, 0.0])] + [(10 + i, 1, [big * 0.5, float(i % 3)]) for i in range(9)]
    got = found(M.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), min_shards=2))
    assert got == brute([(i, l, whole(v)) for i, l, v in rows])


def test_cells_are_visited_by_falling_bound_and_once():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (800, 6)).astype(float)
    centres = (M.codebook(x[:, :3], 6), M.codebook(x[:, 3:], 5))
    codes = np.column_stack([M.closest(x[:, :3], centres[0]), M.closest(x[:, 3:], centres[1])])
    order = np.lexsort((codes[:, 1], codes[:, 0]))
    shard = M.Shard(np.arange(800), np.zeros(800, int), np.arange(800), x[order], codes[order], centres, False)
    anchor = rng.integers(-200, 200, 6).astype(float)
    (up1, _), (up2, _) = shard.bounds(anchor)
    seen = np.concatenate([rows for rows, _ in shard.visit(anchor, lambda: -np.inf)])
    assert sorted(seen.tolist()) == list(range(800))
    bound = up1[shard.own[0]] + up2[shard.own[1]]
    assert (np.diff(bound[seen]) <= 1e-9).all() and (shard.vectors @ anchor <= bound).all()


def test_empty_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert M.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    for rows in ([(100, 1, [1.0])], [(1, 1, [1.0]), (2, 2, [1.0])], [(100, 1, []), (200, 1, [])], [(100, 1, [1.0]), (1, 1, [1.0])]):
        assert M.hard_negatives(spark.createDataFrame(rows, schema)).collect() == []
