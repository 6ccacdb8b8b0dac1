import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from urlsieve.llm import toxicity
from urlsieve.llm.queries import op4_toxicity


def best_by_definition(scores):
    """Maximal scoring segments by recursion: the best segment, then both sides of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] + 1e-9):
                best = (a, b, total)
    if best is None:
        return []
    a, b, total = best
    right = [(x + b + 1, y + b + 1, v) for x, y, v in best_by_definition(scores[b + 1 :])]
    return best_by_definition(scores[:a]) + [(a, b, total)] + right


@given(st.lists(st.one_of(st.none(), st.integers(1, 9)), max_size=14), st.sampled_from([0.7, 2.3]))
def test_scan_finds_all_maximal_segments(gains, cost):
    scores = [-cost if g is None else g * 1.0137 for g in gains]
    places = [k for k, g in enumerate(gains) if g is not None]
    got = toxicity.maximal_segments(places, [scores[k] for k in places], cost)
    want = best_by_definition(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([v for *_, v in got], [v for *_, v in want])


def labelled(spark, n=240):
    bad = ["vile", "scum", "rotten"]
    words = [f"w{k}" for k in range(60)]
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        text = rng.choice(words, 40).tolist()
        toxic = i % 4 == 0
        if toxic:
            for place in rng.choice(40, 3, replace=False):
                text[place] = str(rng.choice(bad))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_rows_are_judged_well(spark):
    docs, labels, truth = labelled(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 30 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    for r in got:
        words = r.text.split()
        assert all({"vile", "scum", "rotten"} & set(words[p.first : p.last + 1]) for p in r.passages)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels, _ = labelled(spark, 120)
    from pyspark.sql import functions as F

    from urlsieve.llm.store import fold_of

    turned = labels.withColumn("toxic", F.when(fold_of("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, turned))
    assert a.curve == b.curve and a.units.tolist() == b.units.tolist()


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels, _ = labelled(spark, 120)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd_docs, model, names=("s", "p", "q")).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.s <= 1 and r.p == 0 for r in got)
    assert toxicity.score(no_docs, model, names=("s", "p", "q")).collect() == []
    empty = labels.limit(0)
    for nothing in (toxicity.fit(docs, empty), toxicity.fit(no_docs, labels), toxicity.fit(docs, labels.filter("toxic = 0"))):
        assert {(r.score, r.predicted) for r in toxicity.score(docs, nothing).collect()} == {(0.0, 0)}
    odd = labels.union(spark.createDataFrame([(None, 1), (5, None), (7, 3), (9999, 1)], labels.schema))
    assert toxicity.fit(docs, odd).curve == model.curve


def test_query_has_every_document(spark, sample, small_dir):
    got = op4_toxicity(spark, small_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in sample)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
