import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import rowwise
from urlsieve.operators import vectorize as V

TEXTS = [
    "example.com/login", "a", "ab cd", "", "  x\t\tyz  ", "aaaa.aaaa", "Éa b", "example.com/login?x=1",
    "\U0001f600\U0001f600.io", "hot.example.com", "b",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def test_grams(docs):
    for r in V.with_term_counts(docs, "t").collect():
        got = [(t.gram, t.tf) for t in r.terms]
        assert len(got) == len(dict(got))
        assert Counter(dict(got)) == rowwise.char_grams(TEXTS[r.i]), TEXTS[r.i]


def brute(k):
    counts = [rowwise.char_grams(t) for t in TEXTS]
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    # Spark and UTF-8 order agree on code points.
    top = sorted(total, key=lambda g: (-total[g], g.encode()))[:k]
    vocab = {g: i for i, g in enumerate(sorted(top, key=str.encode))}
    idf = {g: math.log((1 + len(TEXTS)) / (1 + df[g])) + 1 for g in vocab}
    rows = []
    for c in counts:
        w = {vocab[g]: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in vocab}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows.append({i: x / norm for i, x in w.items()})
    return vocab, rows


@pytest.mark.parametrize("k", [5, 40, 10_000])
def test_tfidf(spark, docs, k):
    vocab, want = brute(k)
    table = V.vocabulary(docs, "t", k)
    assert {r.gram: r.idx for r in table.collect()} == vocab
    rows = V.weighted_terms(docs, "i", "t", table, k)
    vectors = rows.withColumn("v", V.sparse_vector(F.col("indices"), F.col("values"), len(vocab))).collect()
    assert len(vectors) == len(TEXTS)
    for r in vectors:
        assert r.indices == sorted(want[r.i])
        assert dict(zip(r.indices, r["values"])) == pytest.approx(want[r.i])
        assert list(r.v.indices) == r.indices and list(r.v.values) == r["values"] and r.v.size == len(vocab)


def test_weights_use_one_shuffle(docs, spark):
    vocab = spark.createDataFrame(
        [(r.gram, r.idx, r.idf) for r in V.vocabulary(docs, "t", 50).collect()], "gram string, idx int, idf double"
    )
    plan = V.weighted_terms(docs, "i", "t", vocab, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_equal_keys_are_one_row(spark):
    df = spark.createDataFrame([("abc", 1), ("abc", 1), ("xyz", 2)], "url string, n int")
    vocab = V.vocabulary(df.select("url").distinct(), "url", 50)
    got = V.weighted_terms(df, "url", "url", vocab, 50, ("n",)).collect()
    assert sorted((r.url, r.n) for r in got) == [("abc", 1), ("xyz", 2)]
    for r in got:
        assert len(set(r.indices)) == len(r.indices) and sum(x * x for x in r["values"]) == pytest.approx(1)


def test_vectors_use_one_hash_exchange(spark):
    from urlsieve.operators import models as M

    df = spark.createDataFrame([(f"a{i}.com/x", float(i % 2), "train") for i in range(20)], "url string, label double, split string")
    vec = M.fit_vectorizer(df.select("url"), M.ModelConfig(vocabulary_size=30))
    plan = M.vectorize(df, vec)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    stats = V.fit_scaler(df, ["a", "b"])
    assert stats == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    assert [tuple(r) for r in V.scale(df, stats).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
