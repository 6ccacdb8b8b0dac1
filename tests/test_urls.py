import random

import pytest
from pyspark.sql import functions as F

from tests import rowwise
from urlsieve.constants import SMOKE_URLS
from urlsieve.functions.labels import label_a, label_b, label_c
from urlsieve.functions.urls import (
    normalize_url, registered_domain, url_parts, with_group, with_normalized,
)

KNOWN = [
    ("https://WWW.Example.com/Login/", "example.com/login", "example.com"),
    ("example.com", "example.com", "example.com"),
    ("http://user@host.a.co.uk:8080/x", "user@host.a.co.uk:8080/x", "a.co.uk"),
    ("https://bbc.co.uk", "bbc.co.uk", "bbc.co.uk"),
    ("http://192.168.1.1/a", "192.168.1.1/a", "192.168.1.1"),
    ("https://", "https://", "https"),
    ("?guid=a b", "?guid=a b", ""),
    ("http://http://x.com", "http://x.com", "x.com"),
    ("www2.shop.example.org///", "shop.example.org", "example.org"),
]
ODD = [
    "", "///", "www.", "http://www.", "https://www./", "www./x", "a..b..c.com", ".x.com.", "x..", "..",
    "HTTP://WWW.A.COM", "ftp://www3.a.net//", "  x.com ", "www٣.example.com/É",
    "http://[2001:db8::1]:80/p;q?a#b", "http://[::1", "http://a]b/c", "http://x[1]/y", "http://[1.2.3.4]/",
    "http://[v1.fe]/x", "http://u@[::1]/x", "a@b@c.d.co.uk/@", "1.2.3.4:80", "256.1.1.1.com", "01.02.03.004",
    "http://a.com/p;x=1?q#f", "http://a.com/p;x/y;z;w", "x?y/z", "x#y?z", "h\tt\nt/p", "http://exa mple.com/ x",
    "http://／a.com/x", "http://a℀b.com/x", "\U0001f600.com/\U0001f600\U0001f600", "//a.com/x", "a:b:c/d",
]


def fuzz(n: int, alphabet: str, seed: int = 5) -> list[str]:
    rnd = random.Random(seed)
    heads = ["", "http://", "https://", "www.", "https://www1.", "ftp://"]
    return [
        rnd.choice(heads) + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25)))
        for _ in range(n)
    ]


def frame(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")


@pytest.fixture(scope="module")
def sample(page_urls):
    return (
        [k[0] for k in KNOWN] + ODD + [u for u, _ in SMOKE_URLS] + page_urls
        + fuzz(1500, "ab.:/?#@;w1- ") + fuzz(500, "aé.É/²٣ß- ")
    )


def test_known_rows(spark):
    df = frame(spark, [k[0] for k in KNOWN])
    norm = df.select("i", normalize_url("url").alias("url"))
    rows = norm.select("i", "url", registered_domain("url").alias("g")).orderBy("i").collect()
    assert [(r.url, r.g) for r in rows] == [k[1:] for k in KNOWN]


def test_normalize_and_group_match_rowwise(spark, sample):
    df = with_group(with_normalized(frame(spark, sample), "url", "n"), "n", "g")
    plain = df.withColumns({"n2": normalize_url("url"), "g2": registered_domain("n")})
    for r in plain.collect():
        n = rowwise.normalize(sample[r.i])
        assert (r.n, r.g) == (n, rowwise.domain(n)), sample[r.i]
        assert (r.n2, r.g2) == (r.n, r.g)


def test_parts_match_rowwise(spark, sample):
    rows = url_parts(frame(spark, sample)).select("i", "_host", "_path", "_query").collect()
    for r in rows:
        assert (r._host, r._path, r._query) == rowwise.parts(sample[r.i]), repr(sample[r.i])


def test_bracketed_hosts_match_rowwise(spark):
    urls = fuzz(3000, "[]:1af/@v.%", 9)
    urls = [u for u in urls if "%" not in u.partition("]")[0] or "[" not in u]
    rows = url_parts(frame(spark, urls)).select("i", "_host", "_path", "_query").collect()
    wrong = [urls[r.i] for r in rows if (r._host, r._path, r._query) != rowwise.parts(urls[r.i])]
    assert not wrong


def test_labels(spark):
    cells = ["benign", " Benign ", "GOOD", "good", "0", "1", "0.9", "-0.5", "1.0", "x", "0d", "1e-3", "inf", "NaN", ""]
    rows = frame(spark, cells).select(
        "i", label_a("url").alias("a"), label_b("url").alias("b"), label_c("url").alias("c")
    ).orderBy("i").collect()
    assert [r.a for r in rows][:4] == [0, 0, 1, 1]
    assert [r.b for r in rows][:4] == [1, 1, 0, 0]
    assert [r.c for r in rows][4:] == [1, 0, 1, 1, 0, 0, 0, 1, 0, 0, 0]


def test_normalized_variants_agree(spark, page_urls):
    df = frame(spark, page_urls).withColumn("bare", F.regexp_replace("url", "^https?://", ""))
    assert df.filter(normalize_url("url") != normalize_url("bare")).isEmpty()


def test_disguised_delimiters_are_all_there():
    import sys
    import unicodedata

    from urlsieve.functions.urls import _DISGUISED_DELIMITERS

    want = {
        chr(c) for c in range(128, sys.maxunicode + 1)
        if unicodedata.decomposition(chr(c)) and set("/?#@:") & set(unicodedata.normalize("NFKC", chr(c)))
    }
    assert set(_DISGUISED_DELIMITERS) == want
