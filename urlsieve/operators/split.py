"""Domain-disjoint splits and the bare-domain augmentation of the train side."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.constants import BARE_DOMAIN_FRACTION
from urlsieve.functions.basic import md5_bucket
from urlsieve.functions.urls import has_path
from urlsieve.operators.sampling import kth_hashes, row_hash
from urlsieve.session import materialize


def group_split(df: DataFrame, group: str = "group", test: int = 15, val: int = 15, seed=42) -> DataFrame:
    """Add ``split`` by a hash bucket of the group, in percent of groups.

    Row-local: a site that owns a third of the rows costs nothing extra.
    """
    bucket = md5_bucket(seed, F.col(group))
    split = F.when(bucket < test, "test").when(bucket < test + val, "val").otherwise("train")
    return df.withColumn("split", split)


def group_split_exact(
    df: DataFrame, group: str = "group", test: float = 0.15, val: float = 0.15, seed=42
) -> DataFrame:
    """As :func:`group_split` with exact group counts.

    ceil(test * groups) groups go to test, then ceil(val / (1 - test) * rest) to val.
    The hashes of the distinct groups are written once; only two cuts reach the driver.
    """
    hashed = row_hash(seed, group)
    groups = materialize(df.select(group).distinct().select(hashed.alias("_h")), "groups")
    n = groups.count()
    n_test = math.ceil(test * n)
    n_val = math.ceil(val / (1 - test) * (n - n_test))
    cut_test, cut_val = kth_hashes(groups, [n_test, min(n, n_test + n_val)])
    split = F.lit("train")
    if cut_val is not None:
        split = F.when(hashed <= cut_val, "val").otherwise(split)
    if cut_test is not None:
        split = F.when(hashed <= cut_test, "test").otherwise(split)
    return df.withColumn("split", split)


def augment_bare_domains(
    df: DataFrame, fraction: float = BARE_DOMAIN_FRACTION, seed=7
) -> DataFrame:
    """Add domains of benign train rows as benign train rows, unless already present.

    df has (url, label, group, split). Only urls without a path can equal a domain, so
    nothing else enters the anti-join, and both of its sides are unique.
    """
    train = F.col("split") == "train"
    hosts = (
        df.filter(train & (F.col("label") == 0))
        .select("group")
        .distinct()
        .filter(md5_bucket(seed, F.col("group")) < int(round(fraction * 100)))
    )
    known = df.filter(train & ~has_path("url")).select("url")
    new = (
        hosts.withColumn("url", F.col("group"))
        .join(known, "url", "left_anti")
        .select("url", F.lit(0).cast("tinyint").alias("label"), "group", F.lit("train").alias("split"))
    )
    return df.select("url", F.col("label").cast("tinyint").alias("label"), "group", "split").unionByName(new)


def split_leakage(df: DataFrame, left: str = "train", right: str = "test") -> DataFrame:
    """Groups present in both splits; has to be 0.

    One aggregation of two flags per group instead of a join of two distinct sets.
    """
    flags = df.groupBy("group").agg(
        F.bool_or(F.col("split") == left).alias("_l"),
        F.bool_or(F.col("split") == right).alias("_r"),
    )
    return flags.agg(F.count_if(F.col("_l") & F.col("_r")).alias("overlap"))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
