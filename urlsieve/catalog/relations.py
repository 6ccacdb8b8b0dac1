"""Input relations that Spark derives from the given tables, over all of their rows.

Three corpora that disagree: A holds every page url twice (as found and as http), B
every page url without scheme, query and fragment and a site per page, C bare hosts, some full urls and
every link of every page. ``urls`` holds every page in nine shapes, and the links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.constants import BRANDS, TLD_RISK
from urlsieve.functions.basic import md5_bucket
from urlsieve.functions.labels import label_a, label_b, label_c
from urlsieve.functions.urls import with_group, with_normalized
from urlsieve.operators.consolidate import consolidate, corpus_votes, master, merge_votes, normalized_rows
from urlsieve.session import materialize
from urlsieve.sources.corpora import apply_label

SPAM = "cheap-pills|casino-win|free-bets|adult-x|spam-farm"
SPAM_B = "casino-win|spam-farm"
SOURCES = ["corpus_a", "corpus_b", "corpus_c"]
HOST = r"^https?://([^/?#]*)"
EDGE_ROWS = [
    ("abc", "benign"),
    ("https://", "benign"),
    ("?guid=a b", "phishing"),
    (None, "benign"),
    ("x.example.com/z", None),
]


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def bare_host(url: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(url, HOST, 1), r"^www\.", "")


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url, page_url) of every link of every page, on the page's host."""
    found = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return pages(spark, sf).select("page_id", F.col("url").alias("page_url"), found.alias("href")).select(
        "page_id", F.concat(F.lit("https://"), F.regexp_extract("page_url", HOST, 1), "href").alias("url"),
        "page_url",
    )


def corpus_a(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf).select("page_id", "url")
    kind = F.when(F.col("url").rlike(SPAM), F.when(F.col("page_id") % 2 == 0, "phishing").otherwise("malware"))
    found = p.select("url", kind.otherwise(" Benign").alias("type"))
    plain = p.select(F.replace("url", F.lit("https://"), F.lit("http://")).alias("url"), F.lit("benign").alias("type"))
    edge = spark.createDataFrame(EDGE_ROWS, "url string, type string")
    return found.unionByName(plain).unionByName(edge)


def corpus_b(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf).select("page_id", "url")
    url = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    bad = (F.col("page_id") % 7 == 0) | F.col("url").rlike(SPAM_B)
    found = p.select(url.alias("URL"), F.when(bad, "bad").otherwise("good").alias("Label"))
    # the pages lie on a few sites; splits by site need many
    site = F.concat(F.lit("s"), F.col("page_id"), F.lit(".net/"), F.col("page_id") % 3)
    return found.unionByName(p.select(site.alias("URL"), F.when(F.col("page_id") % 7 == 0, "bad").otherwise("good").alias("Label")))


def corpus_c(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf).select("page_id", "url")
    at_home = F.concat(F.lit("https://www."), bare_host("url"))
    url = F.when(F.col("page_id") % 10 == 0, F.col("url")).otherwise(at_home)
    mark = F.when(F.col("page_id") % 26 == 0, "x").when(F.col("page_id") % 5 == 0, "0").otherwise("1")
    linked = links(spark, sf).select(
        F.col("url").alias("URL"), F.when(F.col("page_url").rlike(SPAM), "0").otherwise("1.0").alias("label")
    )
    return p.select(url.alias("URL"), mark.alias("label")).unionByName(linked)


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(url, label, source) of the three corpora, urls as they were found."""
    parts = [
        apply_label(corpus(spark, sf).toDF("url", "label"), name, fn)
        for name, corpus, fn in zip(
            SOURCES, (corpus_a, corpus_b, corpus_c), (label_a, label_b, label_c), strict=True
        )
    ]
    return reduce(DataFrame.unionByName, parts)


def votes(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_votes(normalized_rows(raw_rows(spark, sf)), SOURCES)


def merged_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The merged urls with the votes of every corpus, written once: corpora and master both follow from it."""
    return materialize(merge_votes(votes(spark, sf), SOURCES, "phishing", keep_votes=True), "merged")


def merged(spark: SparkSession, sf: str, **policies) -> DataFrame:
    return consolidate(raw_rows(spark, sf), SOURCES, **policies)


def master_table(spark: SparkSession, sf: str) -> DataFrame:
    return master(merged(spark, sf))


def url_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, variant, url): every page url as found, eight derived shapes and the links."""
    p = pages(spark, sf).select("page_id", "url")
    pid = F.col("page_id")
    rest = F.regexp_replace("url", "^https?://", "")
    host = F.regexp_extract("url", HOST, 1)
    brand = F.get(F.array(*[F.lit(b) for b in BRANDS]), (pid % len(BRANDS)).cast("int"))
    tld = F.get(F.array(*[F.lit(t) for t in TLD_RISK]), (pid % len(TLD_RISK)).cast("int"))
    typo = F.replace(F.replace(brand, F.lit("l"), F.lit("1")), F.lit("oo"), F.lit("ooo"))
    s, num = F.lit, pid.cast("string")
    shapes = [
        F.col("url"),
        F.concat(s("http://"), brand, s("."), rest),
        F.concat(
            s("https://www."), typo, s("-secure."), tld, s("/Login;v=1/verify;p="), num, s("?u="), host
        ),
        F.concat(s("http://user:pw@10."), (pid % 256).cast("string"), s(".0.1:8080/"), rest),
        F.upper("url"),
        F.concat(s("https://"), brand, s(".com/"), num),
        F.concat(s("http://[2001:db8::"), (pid % 9999).cast("string"), s("]:443/x?a=1")),
        F.concat(s("  "), F.col("url"), s(" ")),
        F.concat(s("HTTP-like[zz"), num, s("]/x?a=1")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("variant"), x.alias("url")) for i, x in enumerate(shapes)])
    made = p.select("page_id", F.inline(rows))
    linked = links(spark, sf).select("page_id", F.lit(len(shapes)).alias("variant"), "url")
    return made.unionByName(linked)


def documents_for_text(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct normalised urls of pages and links."""
    found = pages(spark, sf).select("url").unionByName(links(spark, sf).select("url"))
    return with_normalized(found).select("url").distinct()


def labelled_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url, label, group): one row per page, urls normalised."""
    p = pages(spark, sf).select("page_id", "url", F.col("url").rlike(SPAM).cast("int").alias("label"))
    return with_group(with_normalized(p))


EXPERTS = ["nlp", "nn", "tree", "hyb"]


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, y, p_nlp, p_nn, p_tree, p_hyb) made from the labels table."""
    t = spark.read.parquet(f"{sf}/labels.parquet")
    cols = [
        ((md5_bucket(e, F.col("doc_id"), 600) + 400 * F.col("toxic")) / F.lit(1000.0)).alias(f"p_{e}")
        for e in EXPERTS
    ]
    return t.select("doc_id", F.col("toxic").alias("y"), *cols)
