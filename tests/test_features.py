import random
import re

import pytest
from pyspark.sql import functions as F

from tests import rowwise
from tests.test_urls import ODD, frame, fuzz
from urlsieve.constants import BRANDS, COMMON_TLDS, FEATURE_NAMES, KEYWORDS, SMOKE_URLS, TLD_RISK
from urlsieve.functions.brands import brand_dim, brand_exact, brand_match, near_brands
from urlsieve.functions.features import extract_features

EDGE = [
    "", "paypa1-secure.tk", "zoo.com", "com.com", "gggooogle.icu", "xn--80ak6aa92e.com", "snapple.com",
    "google.com", "my.app", "web.dev", "paypal.google.com", "http://a.b/" + "x" * 5000, "é²٣Ⅷ.com/ÀÉ",
    "a-b_c.d@e?f=g&h%i+j!k~l$m#n;o:p", "id-verify.login.verify.verification.bank", "x.y\nz",
]


@pytest.fixture(scope="module")
def rows(spark, page_urls):
    urls = EDGE + ODD + [u for u, _ in SMOKE_URLS] + page_urls + fuzz(1500, "goleapyt.-/1Aé=?&%0")
    urls = [u for u in urls if "[" not in u]
    return urls, extract_features(frame(spark, urls)).collect()


def test_matches_rowwise(rows):
    urls, got = rows
    for r in got:
        want, meta = rowwise.features(urls[r.i])
        mine = {n: r[n] for n in FEATURE_NAMES}
        close = {n: v for n, v in mine.items() if abs(v - want[n]) > 1.01e-4}
        assert not close, (urls[r.i], close, {n: want[n] for n in close})
        assert r.meta.asDict() == meta, urls[r.i]


def test_counts(spark):
    assert (len(FEATURE_NAMES), len(BRANDS), len(KEYWORDS), len(TLD_RISK)) == (30, 39, 30, 21)
    assert len(SMOKE_URLS) == 34 and sum(y for _, y in SMOKE_URLS) == 15


def test_known_values(spark):
    df = extract_features(frame(spark, ["", "google.com", "zoo.com", "com.com"])).orderBy("i").collect()
    empty, google, zoo, com = df
    assert (empty.shannon_entropy, empty.consecutive_char_repeat_count, empty.char_trigram_diversity) == (0, 1, 1)
    assert (google.min_brand_levenshtein_distance, google.is_authentic_brand_domain) == (0, 1)
    assert (zoo.min_brand_levenshtein_distance, zoo.meta.target_brand) == (1, "zoom")
    assert (com.min_brand_levenshtein_distance, com.meta.target_brand) == (10, "None")


def test_empty_input_keeps_schema(spark):
    df = extract_features(frame(spark, ["x"]).filter("i > 5"))
    assert df.columns == ["i", "url", *FEATURE_NAMES, "meta"] and df.count() == 0


def test_narrow_plan_without_python(spark, sf):
    df = extract_features(spark.read.parquet(f"{sf}/pages.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_brand_operators(spark):
    df = spark.createDataFrame(
        [("a", "paypal.google.com"), ("b", "paypa1.com"), ("c", "x.org")], "url string, host string"
    )
    got = {r.url: (r.dist, r.brand) for r in brand_match(df, "host").collect()}
    assert got == {"a": (0, "paypal"), "b": (1, "paypal"), "c": (10, "None")}
    exact = brand_exact(df, "url", "host", brand_dim(spark)).collect()
    assert {(r.url, r.brand) for r in exact} == {("a", "paypal"), ("a", "google")}


def test_own_brands(spark):
    df = frame(spark, ["x"]).withColumn("host", F.lit("acma1-shop.com"))
    got = brand_match(df, "host", brands=["acme", "shop"]).first()
    assert (got.dist, got.brand) == (0, "shop")


@pytest.mark.parametrize("most", [1, 2])
def test_near_brands_by_shared_deletions(spark, most):
    rng = random.Random(most)
    names = ["".join(rng.choices("abcde", k=rng.randint(3, 8))) for _ in range(300)] + BRANDS + ["ééé", "日本語語"]
    brands = list(enumerate(dict.fromkeys(names)))
    hosts = ["", "ab.com", "com.net", "paypa1-secure.tk", "gogle.icu", "日本語.jp", "éé1ee.com"]
    hosts += [".".join("".join(rng.choices("abcdef", k=rng.randint(2, 9))) for _ in range(2)) for _ in range(250)]
    words = lambda h: [t for t in re.split(r"[-._0-9]+", h) if len(t) >= 3 and t not in COMMON_TLDS]
    want = {}
    for i, h in enumerate(hosts):
        near = [(rowwise.edit(t, b), k, b) for t in words(h) for k, b in brands]
        if near and min(near)[0] <= most:
            want[i] = min(near)
    df = spark.createDataFrame(list(enumerate(hosts)), "i int, host string")
    table = spark.createDataFrame(brands, "idx int, brand string")
    got = near_brands(df, "i", "host", table, most)
    assert {r.i: (r.dist, r.idx, r.brand) for r in got.collect()} == want
    assert near_brands(df, "i", "host", table.limit(0)).collect() == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "paypal" not in plan and "Cartesian" not in plan


def test_near_brands_of_a_large_table(spark):
    names = spark.range(50_000).selectExpr("cast(id AS int) AS idx", "concat('name', lpad(cast(conv(id, 10, 26) AS string), 4, 'z'), 'x') AS brand")
    hosts = spark.createDataFrame([(1, "nam-name.org"), (2, "namezz1ax.com")], "i int, host string")
    assert near_brands(hosts, "i", "host", names).filter("dist > 2").collect() == []
