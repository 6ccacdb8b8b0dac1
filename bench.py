"""Time the headline queries; prints one JSON line.

``build_master_csv`` and ``features_1m`` repeat the page urls to the row counts of the
published builds (three CSV corpora of 1.4 million raw rows; 1 million urls), so that
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.catalog import all_queries
from urlsieve.functions.features import extract_features
from urlsieve.functions.labels import label_a, label_b, label_c
from urlsieve.plans.build_master import build_master
from urlsieve.session import local_session, scratch_path
from urlsieve.sources.corpora import SourceSpec

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "master_table", "manifest_totals", "surface_audit", "policy_domains_only", "extract_features",
    "master_features", "brand_match", "counterfactual_scheme", "group_split", "stratified_sample",
    "ngram_vocab_topk", "tfidf_weights", "eval_table", "best_threshold", "roc_auc",
]


def run(query: Callable[[], DataFrame]) -> float:
    """Seconds of the call and of its result: a query may work before it returns."""
    started = time.time()
    query().write.format("noop").mode("overwrite").save()
    return time.time() - started


def repeated(spark: SparkSession, low: int, high: int) -> DataFrame:
    """Every page url once per number, as a url of its own."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url")
    numbered = pages.select("page_id", "url", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("k"))
    return numbered.withColumn("url", F.concat(F.col("url"), F.lit("/"), F.col("k")))


def write_corpora(spark: SparkSession, times: int) -> list[SourceSpec]:
    """Three overlapping CSV corpora that disagree on a seventh of what they share."""
    root = scratch_path(spark, "bench")
    odd = F.col("page_id") % 7 == 0
    a = repeated(spark, 0, times).select("url", F.when(odd, "phishing").otherwise("benign").alias("type"))
    b = repeated(spark, times // 4, times + times // 16).select(
        F.regexp_replace("url", "^https?://", "").alias("URL"),
        F.when(F.col("page_id") % 5 == 0, "bad").otherwise("good").alias("Label"),
    )
    c = repeated(spark, 0, max(1, times // 3)).select(
        F.concat(F.lit("https://www.s"), F.col("k"), F.lit("-"), F.col("page_id"), F.lit(".com")).alias("URL"),
        F.when(odd, "0").otherwise("1").alias("label"),
    )
    specs = []
    for name, df, fn in (("corpus_a", a, label_a), ("corpus_b", b, label_b), ("corpus_c", c, label_c)):
        path = f"{root}/{name}.csv"
        df.repartition(8).write.option("header", True).option("escape", '"').csv(path)
        specs.append(SourceSpec(name, (path,), *df.columns, fn))
    return specs


def main() -> None:
    spark = local_session("bench", CPUS, int(CPUS) if CPUS.isdigit() else 8)
    queries = all_queries()
    seconds: dict[str, float] = {}
    run(lambda: queries["normalize_url"](spark, SF_DIR))
    for name in HEADLINE:
        seconds[name] = round(min(run(lambda n=name: queries[n](spark, SF_DIR)) for _ in range(2)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    n_pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    times = max(1, 650_000 // n_pages)
    specs = write_corpora(spark, times)
    builds = [
        build_master(spark, specs, scratch_path(spark, "bench-out"), policy_source="corpus_c")
        for _ in range(2)
    ]
    manifest = min(builds, key=lambda m: m["build_seconds"])
    seconds["build_master_csv"] = manifest["build_seconds"]
    urls = repeated(spark, 0, max(1, 1_000_000 // n_pages)).select("url").repartition(int(CPUS) * 4)
    seconds["features_1m"] = round(min(run(lambda: extract_features(urls, meta=None)) for _ in range(2)), 3)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "build_master_urls": manifest["totals"]["unique_urls"],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
