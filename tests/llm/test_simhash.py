from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from urlsieve.llm import simhash
from urlsieve.llm.components import components
from urlsieve.llm.queries import op3_simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = (text or "").translate(LOWER).encode().split()
    return [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])


def plain(text):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def expected(rows):
    fps = [plain(t) for _, t in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    of = roots(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[of[k]] = min(least.get(of[k], i), i)
    return sorted(((i, f"{fps[k]:016x}", least.get(of[k])) for k, (i, _) in enumerate(rows)), key=str)


def test_query_against_all_pairs(spark, sample, small_dir):
    got = sorted((tuple(r) for r in op3_simhash(spark, small_dir).collect()), key=str)
    assert got == expected(sample)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = sorted((tuple(r) for r in simhash.simhash_components(odd_docs).collect()), key=str)
    assert got == expected([(i, t) for i, t, _, _ in odd_rows])
    assert simhash.simhash_components(no_docs).collect() == []


@settings(deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_close_fingerprints_share_a_key(fp, flips):
    other = fp
    for bit in flips:
        other ^= 1 << bit
    a, b = simhash.ring_keys(np.array([fp, other], np.uint64))
    assert (a == b).any()


@pytest.mark.parametrize("n", [2, 16, 17, 300])
def test_links_of_a_run_connect_what_all_pairs_connect(n):
    rng = np.random.default_rng(n)
    fps = np.uint64(rng.integers(0, 2**63)) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 24, (3, n)).astype(np.uint64))
    ids = np.arange(n)
    a, b = simhash.run_links(np.zeros(n, np.int64), ids, fps, 3)
    pairs = [(x, y) for x, y in combinations(range(n), 2) if int(fps[x] ^ fps[y]).bit_count() <= 3]
    assert roots(range(n), zip(a.tolist(), b.tolist(), strict=True)) == roots(range(n), pairs)


def test_a_key_of_several_blocks_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 8)
    rng = np.random.default_rng(5)
    fps = sorted({int(x) for x in rng.integers(0, 2**12, 60)})
    keyed = spark.createDataFrame([(1, k, f) for k, f in enumerate(fps)], "key long, leader long, fp long")
    got = [(r.a, r.b) for r in simhash.linked(keyed, 2).collect()]
    pairs = [(x, y) for x, y in combinations(range(len(fps)), 2) if (fps[x] ^ fps[y]).bit_count() <= 2]
    assert roots(range(len(fps)), got) == roots(range(len(fps)), pairs)


def test_keys_are_never_broadcast(spark, tmp_path):
    # a file of few bytes has 24 keys a row, which Spark does not see
    spark.range(100).selectExpr("id AS leader", "id * 7919 AS fp").write.parquet(f"{tmp_path}/leaders")
    links = simhash.linked(simhash.with_ring_keys(spark.read.parquet(f"{tmp_path}/leaders")), 3)
    plan = links._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links[:-1] for x in p}
    assert got == roots(nodes, links[:-1])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_groups_against_all_pairs(spark, sample, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r.id: r.first_id for r in simhash.near_groups(docs).collect()}
    sets = {i: set(shingles(t, 5)) for i, t in sample}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == roots(sorted(sets), links)


def test_a_large_group_of_different_near_copies_is_one(spark):
    rng = np.random.default_rng(1)
    base = [f"word{k}" for k in rng.integers(0, 10**6, 204)]
    rows = [(0, " ".join(base))]
    for k in range(1, 101):  # four words apart from the base, eight from each other
        own = base.copy()
        for place in rng.choice(np.arange(5, 199, 6), 4, replace=False):
            own[place] = f"own{k}at{place}"
        rows.append((k, " ".join(own)))
    sets = {i: set(shingles(t, 5)) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert len(set(want.values())) == 1 and len(links) < 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.id: r.first_id for r in simhash.near_groups(docs).collect()} == want


def test_similar_sets_meet_whatever_their_fingerprints_say(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):  # one line more, ten times over; the few new shingles keep the sets similar
        words = [f"word{x}" for x in rng.integers(0, 10**6, 104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[:14] * 10))]
    for k in range(100, 300):  # 8 words against 9: 4 shingles of 5
        words = [f"word{x}" for x in rng.integers(0, 10**6, 9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1]))]
    sets = {i: set(shingles(t, 5)) for i, t in rows}
    assert all(len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, 80, 2))
    got = {r.id: r.first_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


@settings(deadline=None)
@given(st.integers(1, 2000), st.integers(0, 2**32))
def test_bin_counts_differ_no_more_than_the_sets(n, seed):
    rng = np.random.default_rng(seed)
    known = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    other = np.unique(np.concatenate([known[rng.random(len(known)) < 0.9], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
    left, right = (np.frombuffer(simhash.bin_counts(x), np.uint8).astype(int) for x in (known, other))
    assert np.abs(left - right).sum() <= len(np.setxor1d(known, other))


def test_one_document_of_a_group_stays(spark, odd_docs, no_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and simhash.keep_first(no_docs).collect() == []
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    ids = [i for i, _ in rows]
    assert 1 in ids and 3 not in ids and 4 not in ids  # the copy, the repeated row and the near copy
    assert sorted(i for i in ids if i in (5, 6, 7)) == [5]  # texts without words are one
    assert ids.count(12) == 2 and len(rows) == 11


def test_of_equal_id_and_text_the_first_by_the_other_columns_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "z", "b"), (1, text, "a", None), (1, text, "a", "c"), (2, text, "a", "a")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, note string").repartition(3)
        assert [(r.doc_id, r.lang, r.note) for r in simhash.keep_first(docs).collect()] == [(1, "a", None)]
