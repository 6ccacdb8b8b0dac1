import hashlib
import math

import pytest
from pyspark.sql import functions as F

from urlsieve.operators import sampling, split


def digest(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"u{i}.com", int(i % 3 == 0), f"g{i % 97 if i % 3 else 0}") for i in range(3000)]
    return rows, spark.createDataFrame(rows, "url string, label int, group string")


@pytest.mark.parametrize("n", [0, 1, 100, 1234, 2999, 3000, 9999])
def test_stratified_sample_is_exact(table, n):
    rows, df = table
    got = {r.url for r in sampling.stratified_sample(df, n).collect()}
    want = set()
    for label in (0, 1):
        urls = sorted((u for u, y, _ in rows if y == label), key=lambda u: digest(42, u))
        k = len(urls) if n >= len(rows) else round(n / len(rows) * len(urls))
        want |= set(urls[:k])
    assert got == want


def test_exact_split_counts_and_disjoint(table):
    rows, df = table
    out = split.group_split_exact(df)
    by = {}
    for r in out.select("group", "split").distinct().collect():
        assert r.group not in by
        by[r.group] = r.split
    n = len(by)
    n_test = math.ceil(0.15 * n)
    n_val = math.ceil(0.15 / 0.85 * (n - n_test))
    order = sorted(by, key=lambda g: digest(42, g))
    assert [by[g] for g in order] == ["test"] * n_test + ["val"] * n_val + ["train"] * (n - n_test - n_val)
    assert out.count() == len(rows)


def test_bucket_split(table):
    _, df = table
    got = {(r.group, r.split) for r in split.group_split(df).select("group", "split").distinct().collect()}
    for g, s in got:
        b = int(digest(42, g)[:8], 16) % 100
        assert s == ("test" if b < 15 else "val" if b < 30 else "train")


def test_augment_only_new_and_train(spark):
    rows = [
        ("a.com", 1, "a.com", "train"), ("a.com/x", 0, "a.com", "train"), ("b.com/x", 0, "b.com", "train"),
        ("c.com/x", 0, "c.com", "test"), ("d.com/x", 1, "d.com", "train"),
    ]
    df = spark.createDataFrame(rows, "url string, label int, group string, split string")
    out = split.augment_bare_domains(df, 1.0)
    new = {(r.url, r.label, r.split) for r in out.collect()} - {(u, y, s) for u, y, _, s in rows}
    assert new == {("b.com", 0, "train")}
    assert split.augment_bare_domains(df, 0.0).count() == 5
    assert split.split_leakage(out).first().overlap == 0
    leaky = out.withColumn("group", F.lit("same"))
    assert split.split_leakage(leaky).first().overlap == 1


def test_keep_first_folds_hot_key(spark):
    rows = [("hot", i, f"r{i}") for i in range(500)] + [("cold", 7, "c")]
    df = spark.createDataFrame(rows, "url string, priority int, note string")
    got = {r.url: r.note for r in sampling.keep_first(df, "url", "priority").collect()}
    assert got == {"hot": "r0", "cold": "c"}


def test_seeded_order_is_a_shuffle(table):
    rows, df = table
    got = [r.url for r in sampling.seeded_order(df).collect()]
    assert got == sorted((r[0] for r in rows), key=lambda u: digest(42, u))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_numbered_order_is_the_order(spark, table, parts):
    rows, df = table
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.url: r.position for r in sampling.numbered_order(df).collect()}
        some = {r.url for r in sampling.first_of_order(df, 17).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted((u for u, _, _ in rows), key=lambda u: digest(42, u))
    assert got == {u: i for i, u in enumerate(want)}
    assert some == set(want[:17])


def test_numbered_order_of_nothing(table):
    assert sampling.numbered_order(table[1].limit(0)).collect() == []
