from collections import Counter, defaultdict

import numpy as np
import pytest

from urlsieve.llm import mixing
from urlsieve.llm.queries import op9_mixing


def size(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def test_targets():
    got = mixing.targets({"a": 100, "b": 100, "c": 10, "d": 0}, 1.5, 2)
    assert sum(got.values()) == pytest.approx(315) and got["c"] == 20 and got["d"] == 0 and got["a"] == 200
    assert mixing.targets({}, 1.5, 2) == {} and mixing.targets({"a": 0}, 1.5, 2) == {"a": 0.0}


def test_query(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    got = op9_mixing(spark, small_dir).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d.doc_id, size(d.text)) for d in docs)
    of = {d.doc_id: d.source for d in docs}
    total, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        total[of[r.doc_id]] += r.size
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(total.values()))
    for s in total:
        assert abs(taken[s] - target[s]) <= 2 * 128
    again = op9_mixing(spark, small_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = mixing.taken_words(odd_docs, block=16).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _, _ in odd_rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.taken_words(no_docs).collect() == []
    assert [r.taken for r in mixing.taken_words(odd_docs.filter("doc_id = 5")).collect()] == [0]


def test_documents_of_the_mix_hold_what_was_taken(spark, odd_docs, odd_rows):
    words = defaultdict(int)
    for r in mixing.taken_words(odd_docs, block=16).collect():
        words[r.doc_id] += r.taken
    mixed = mixing.mixed_documents(odd_docs, block=16)
    assert mixed.columns == odd_docs.columns
    texts = defaultdict(list)
    for r in mixed.collect():
        texts[r.doc_id].append(r.text)
    assert {i: sum(map(size, t)) for i, t in texts.items()} == {i: n for i, n in words.items() if n}
    known = defaultdict(set)
    for i, t, _, _ in odd_rows:
        known[i] |= set((t or "").split())
    assert all(set(t.split()) <= known[i] for i, ts in texts.items() for t in ts)
    assert mixing.mixed_documents(odd_docs.limit(0)).collect() == []


def test_rows_that_differ_in_another_column_keep_it(spark):
    rows = [(1, "a b c d e f g h", "en", "s", "first"), (1, "a b c d e f g h", "de", "s", "second"), (1, "a b c d e f g h", None, "s", ""), (1, "a b c d e f g h", "", "s", None)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, note string")
    # five rows of 8 words, each wholly drawn at least once
    got = Counter((r.lang, r.note) for r in mixing.mixed_documents(docs, block=8, share=2.0).collect())
    assert got == {("en", "first"): 4, ("de", "second"): 2, (None, ""): 2, ("", None): 2}


def test_a_long_text_is_mixed_whole(spark):
    docs = spark.createDataFrame([(1, "word " * 600_000, "s"), (2, "few words", "s")], "doc_id long, text string, source string")
    assert sum(size(r.text) for r in mixing.mixed_documents(docs, share=1.0, passes=1).collect()) == 600_002


def test_slots_are_exact_and_distinct_in_a_pass(spark):
    plan = mixing.Plan({"0a": 10_000, "0b": 3_000, "1": 64}, 1.5, 2, 10)
    rows = mixing.slots(spark, plan, 5, per_shard=97).collect()
    assert Counter(r.skey for r in rows) == dict(zip(plan.names, plan.slots.tolist(), strict=True))
    assert max(Counter((r.skey, r.block, r["pass"]) for r in rows).values()) == 1
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and max(r.slot for r in rows) < 97


def test_blocks_of_documents_are_never_broadcast(spark, tmp_path):
    # a document may have any number of blocks, which Spark does not see
    placed = spark.range(100).selectExpr("id AS doc_id", "id AS t", "id AS r", "'0s' AS skey", "1000L AS size", "1000 * id AS offset")
    drawn = spark.range(100).selectExpr("'0s' AS skey", "id AS block", "0 AS pass")
    for name, df in (("placed", placed), ("drawn", drawn)):
        df.write.parquet(f"{tmp_path}/{name}")
    found = mixing.pieces(*(spark.read.parquet(f"{tmp_path}/{n}") for n in ("placed", "drawn")), 16)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.count() == 101  # every block once, the one that two documents share twice
