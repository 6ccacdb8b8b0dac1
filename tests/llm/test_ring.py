import zlib
from collections import defaultdict

import pytest

from urlsieve.llm import ring
from urlsieve.llm.queries import op6_ring


def check(got, rows, shards=16):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}
    return {s: sum(r.size for r in own) for s, own in by.items()}


def test_query(spark, sample, small_dir):
    got = op6_ring(spark, small_dir).collect()
    loads = check(got, sample)
    largest = max(len((t or "").encode()) + 1 for _, t in sample)
    assert max(loads.values()) <= sum(loads.values()) / 16 * 1.0005 + largest + 1


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    check(ring.shard_documents(odd_docs).collect(), [(i, t) for i, t, _, _ in odd_rows])
    assert ring.shard_documents(no_docs).collect() == []


def test_hot_text_is_dealt_and_small_groups_stay_whole(spark):
    rows = [(i, "hot text") for i in range(3000)] + [(10_000 + i, f"text number {i // 2} of the rest") for i in range(6000)]
    got = ring.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), slack=0.01).collect()
    loads = check(got, rows)
    mean = sum(loads.values()) / 16
    assert max(loads.values()) <= 1.01 * mean + 1 and min(loads.values()) > 0.8 * mean
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32].add(r.shard)
    assert sum(len(p) > 1 for p in places.values()) <= 15  # of 3,001: those at a full shard's border


def test_many_empty_texts_are_dealt_though_they_have_few_bytes(spark, monkeypatch):
    rows = [(i, None if i % 2 else "") for i in range(2000)] + [(10_000 + i, f"{i} " + "x" * 5000) for i in range(4000)]
    most, plain = [], ring.assign_units

    def assign(units, *how):
        most.append(units.selectExpr("max(n)").first()[0])
        return plain(units, *how)

    monkeypatch.setattr(ring, "assign_units", assign)
    check(ring.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert most[0] <= 20  # of 2,000 rows with the same text


@pytest.mark.parametrize("same", [1, None])
def test_equal_rows_and_null_ids_are_dealt(spark, same):
    rows = [(same, "the same text")] * 3000 + [(10_000 + i, f"{i % 90:2d} of the rest") for i in range(3000)]
    loads = check(ring.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    mean = sum(loads.values()) / 16
    assert len(loads) == 16 and 0.9 * mean < min(loads.values()) and max(loads.values()) < 1.1 * mean


def test_few_keys_move_with_one_more_shard(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    a, b = ({r.doc_id: r.home_shard for r in ring.shard_documents(rows, shards=n).collect()} for n in (8, 9))
    moved = [i for i in a if a[i] != b[i]]
    assert 0 < len(moved) < 0.25 * len(a)


@pytest.mark.parametrize("shards", [1, 5])
def test_routes_meet_every_shard_once(spark, shards):
    rows = ring.ring(spark, shards, 16).collect()
    assert sorted(r.cell for r in rows) == list(range(ring.CELLS))
    assert all(sorted(r.route) == list(range(shards)) for r in rows)


def test_no_python_in_the_plan(spark, small_dir):
    plan = op6_ring(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
