"""Audits for formatting shortcuts that would leak the label.

Every audit is one aggregation with fixed-width buffers, so a corpus or class that
holds most of the rows is folded on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.constants import FEATURE_NAMES
from urlsieve.functions.basic import round4, safe_ratio
from urlsieve.functions.features import extract_features
from urlsieve.functions.urls import has_path, has_scheme
from urlsieve.operators.consolidate import vote_column


def surface_audit(df: DataFrame, by: str | None = None, class_counts: bool = False) -> DataFrame:
    """How well "malicious iff the url has a path" predicts the label.

    Rates without rows are null. 0.5 accuracy means the shape carries no signal.
    """
    path, bad = has_path("url"), F.col("label") == 1

    def share(cond: Column, given: Column | None = None) -> Column:
        value = cond.cast("double")
        return F.bround(F.avg(value if given is None else F.when(given, value)), 6)

    extra = []
    if class_counts:
        extra = [F.count_if(~bad).alias("benign"), F.count_if(bad).alias("phishing")]
    return df.groupBy(*([by] if by else [])).agg(
        *extra,
        F.count(F.lit(1)).alias("n_rows"),
        share(path).alias("pct_with_path"),
        share(path, ~bad).alias("pct_with_path_benign"),
        share(path, bad).alias("pct_with_path_phishing"),
        share(bad, path).alias("p_phishing_given_path"),
        share(bad, ~path).alias("p_phishing_given_bare"),
        share(path == bad).alias("path_rule_accuracy"),
    )


def scheme_audit(df: DataFrame) -> DataFrame:
    """Share of raw urls with a scheme, per source and class."""
    return df.groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n"),
        round4(F.avg(has_scheme("url").cast("double"))).alias("has_scheme"),
    )


def bare_domain_audit(df: DataFrame) -> DataFrame:
    """Per class: rows without a path, and the median url length.

    The median comes from a histogram of lengths, which stays small on any volume.
    """
    lengths = df.groupBy("label", F.length("url").alias("len")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~has_path("url")).alias("bare")
    )
    return lengths.groupBy("label").agg(
        F.sum("n").alias("n"),
        F.sum("bare").alias("n_bare"),
        F.bround(F.sum("bare") / F.sum("n"), 6).alias("bare_share"),
        F.percentile("len", F.lit(0.5), F.col("n")).alias("median_length"),
    )


def rule_audit(df: DataFrame, rule: Column, by: str | None = None) -> DataFrame:
    """Accuracy, false positive and false negative rate of a boolean rule."""
    bad = F.col("label") == 1
    counts = df.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(rule == bad).alias("_right"),
        F.count_if(rule & ~bad).alias("_fp"),
        F.count_if(~rule & bad).alias("_fn"),
        F.count_if(bad).alias("_pos"),
    )
    c = F.col
    return counts.select(
        *([by] if by else []),
        "n",
        round4(safe_ratio(c("_right"), c("n"))).alias("accuracy"),
        round4(safe_ratio(c("_fp"), c("n") - c("_pos"))).alias("fpr"),
        round4(safe_ratio(c("_fn"), c("_pos"))).alias("fnr"),
    )


def path_or_not_https(url: Column) -> Column:
    """The published shortcut rule, on a raw url."""
    rest = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.\-]*+://", "")
    path = F.contains(F.rtrim(rest, F.lit("/")), F.lit("/"))
    return path | ~F.startswith(F.lower(url), F.lit("https://"))


def disagreement(votes: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Per pair of corpora that share urls: their number and the disagreements in both
    directions.

    The votes of one url sit in one row, so no self-join is needed: one global
    aggregation holds a few counters per pair.
    """
    pairs = list(combinations(sources, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ya, yb = F.col(vote_column(a)), F.col(vote_column(b))
        aggs += [
            F.count_if(ya.isNotNull() & yb.isNotNull()).alias(f"_s{i}"),
            F.count_if((ya == 1) & (yb == 0)).alias(f"_a{i}"),
            F.count_if((ya == 0) & (yb == 1)).alias(f"_b{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("source_a"),
                F.lit(b).alias("source_b"),
                F.col(f"_s{i}").alias("shared"),
                F.col(f"_a{i}").alias("only_a_malicious"),
                F.col(f"_b{i}").alias("only_b_malicious"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    out = votes.agg(*aggs).select(F.inline(rows)).filter("shared > 0")
    both = F.col("only_a_malicious") + F.col("only_b_malicious")
    return out.withColumn("disagreement", round4(safe_ratio(both, F.col("shared"))))


def counterfactual_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Per feature: mean on the url as it is, on ``https://`` + url, and the share of
    urls on which the two differ.

    Both variants come from one row and the report from one aggregation.
    """
    as_is = extract_features(df.select(F.col(url).alias("url")), meta=None)
    base = as_is.select("url", F.struct(*FEATURE_NAMES).alias("_x"))
    with_scheme = base.withColumn("url", F.concat(F.lit("https://"), F.col("url")))
    both = extract_features(with_scheme, meta=None)
    aggs = []
    for name in FEATURE_NAMES:
        x, y = F.col(f"_x.{name}"), F.col(name)
        aggs.append(
            F.struct(
                F.lit(name).alias("feature"),
                round4(F.avg(x)).alias("mean_bare"),
                round4(F.avg(y)).alias("mean_https"),
                round4(F.avg((x != y).cast("double"))).alias("share_changed"),
            ).alias(f"_{name}")
        )
    wide = both.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.col(f"_{n}") for n in FEATURE_NAMES])))
