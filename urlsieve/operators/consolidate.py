"""Merge disagreeing corpora into one labelled row per url.

The first aggregation keeps one vote counter per corpus and url, so a single shuffle
on ``url`` does both the de-duplication inside a corpus and the merge across corpora.
Its buffers are fixed-width numbers: a url that fills a third of the input is folded
into one row per map task before anything is sent.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.functions.basic import strip_ws
from urlsieve.functions.urls import site_host, with_group, with_normalized

CORPUS_POLICIES = ("include", "exclude", "domains-only")
CONFLICT_POLICIES = ("phishing", "benign", "drop")
MIN_LENGTH = 4


def normalized_rows(df: DataFrame) -> DataFrame:
    """Drop missing cells and short urls, then normalise."""
    df = df.dropna(subset=["url", "label"])
    return with_normalized(df.filter(F.length(strip_ws(F.col("url"))) >= MIN_LENGTH))


def clean_urls(df: DataFrame) -> DataFrame:
    """:func:`normalized_rows` without the urls that normalising made short."""
    return normalized_rows(df).filter(F.length("url") >= MIN_LENGTH)


def _per_url(value: Column, count: Column) -> Column:
    """``value`` tied to a count (never negative) of the aggregation by url.

    A filter on the url alone would be copied below the aggregation, where it
    normalises every raw row once more. Tied to the count it runs once per url.
    """
    return value + F.least(count, F.lit(0))


def vote_column(source: str) -> str:
    return f"y_{source}"


def _plus(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def corpus_votes(
    df: DataFrame, sources: Sequence[str], min_length: int = MIN_LENGTH
) -> DataFrame:
    """(url, label, source) rows -> one row per url with a nullable label per source.

    Inside a source the majority wins and a tie is malicious. Short urls are left out
    here, after they were folded.
    """
    aggs = []
    for i, source in enumerate(sources):
        hit = F.col("source") == source
        aggs.append(F.count_if(hit).alias(f"_n{i}"))
        aggs.append(F.count_if(hit & (F.col("label") == 1)).alias(f"_p{i}"))
    votes = df.groupBy("url").agg(*aggs)
    total = _plus([F.col(f"_n{i}") for i in range(len(sources))])
    if min_length:
        votes = votes.filter(_per_url(F.length("url"), total) >= min_length)
    labels = [
        F.when(F.col(f"_n{i}") > 0, (F.col(f"_p{i}") * 2 >= F.col(f"_n{i}")).cast("tinyint")).alias(
            vote_column(source)
        )
        for i, source in enumerate(sources)
    ]
    return votes.select("url", *labels)


def per_source_rows(votes: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Votes back to (source, url, label): the tables unique within each source."""
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("source"), F.col("url"), F.col(vote_column(s)).alias("label"))
            for s in sources
        ]
    )
    return votes.select(F.inline(rows)).filter(F.col("label").isNotNull())


def apply_corpus_policy(
    votes: DataFrame, sources: Sequence[str], source: str, policy: str
) -> DataFrame:
    """Reshape one corpus whose two classes differ in surface form.

    ``exclude`` drops its benign votes, ``domains-only`` reduces its malicious urls to
    their registered domain and de-duplicates that corpus again; a domain may be short.
    """
    if policy not in CORPUS_POLICIES:
        raise ValueError(f"unknown corpus policy: {policy}")
    if policy == "include" or source not in sources:
        return votes
    vote = vote_column(source)
    if policy == "exclude":
        kept = votes.withColumn(vote, F.when(F.col(vote) == 1, F.col(vote)))
        return kept.filter(F.coalesce(*[F.col(vote_column(s)) for s in sources]).isNotNull())
    rows = with_group(per_source_rows(votes, sources), "url", "_domain")
    moved = (F.col("source") == source) & (F.col("label") == 1)
    rows = rows.withColumn("url", F.when(moved, F.col("_domain")).otherwise(F.col("url")))
    return corpus_votes(rows.drop("_domain"), sources, min_length=0)


def merge_votes(
    votes: DataFrame, sources: Sequence[str], conflict_policy: str = "phishing",
    keep_votes: bool = False,
) -> DataFrame:
    """One vote per corpus -> label, provenance and group of every url.

    Adds ``n_sources``, ``contested``, ``kept`` (false where the policy ``drop``
    removes a contested url) and ``has_host``, so that the counts taken before and
    after the drops come from the same rows. Integer arithmetic throughout: no mean is
    rounded. Filter on ``has_host`` and not on ``group``: the optimiser copies a
    filter's expression towards the scan, and the host is far cheaper than the group.
    """
    if conflict_policy not in CONFLICT_POLICIES:
        raise ValueError(f"unknown conflict policy: {conflict_policy}")
    present = [F.col(vote_column(s)).isNotNull().cast("int") for s in sources]
    positive = [F.coalesce(F.col(vote_column(s)).cast("int"), F.lit(0)) for s in sources]
    names = [F.when(F.col(vote_column(s)).isNotNull(), F.lit(s)) for s in sorted(sources)]
    own = [vote_column(s) for s in sources] if keep_votes else []
    df = votes.select(
        "url",
        *own,
        _plus(present).alias("n_sources"),
        _plus(positive).alias("_pos"),
        F.concat_ws("+", *names).alias("source_dataset"),
    )
    n, pos = F.col("n_sources"), F.col("_pos")
    tie_up = pos * 2 > n if conflict_policy == "benign" else pos * 2 >= n
    df = df.withColumns(
        {"label": tie_up.cast("tinyint"), "contested": (pos > 0) & (pos < n)}
    )
    kept = ~F.col("contested") if conflict_policy == "drop" else F.lit(True)
    host = _per_url(F.length(site_host("url")), n) > 0
    df = with_group(df.withColumns({"kept": kept, "has_host": host}))
    return df.select(
        "url", "label", "group", "source_dataset", "n_sources", "contested", "kept", "has_host", *own
    )


def drop_no_host(df: DataFrame) -> DataFrame:
    """Urls without a host have no split key."""
    return df.filter("has_host" if "has_host" in df.columns else F.length("group") > 0)


def master(merged: DataFrame) -> DataFrame:
    """The final table: url, label, group, source_dataset."""
    return drop_no_host(merged.filter("kept")).select(
        "url", "label", "group", "source_dataset"
    )


def consolidate(
    df: DataFrame,
    sources: Sequence[str],
    conflict_policy: str = "phishing",
    corpus_policy: str = "include",
    policy_source: str | None = None,
) -> DataFrame:
    """Raw (url, label, source) rows -> merged rows, see :func:`merge_votes`."""
    votes = corpus_votes(normalized_rows(df), sources)
    if policy_source is not None:
        votes = apply_corpus_policy(votes, sources, policy_source, corpus_policy)
    return merge_votes(votes, sources, conflict_policy)


def harmonize_rows(df: DataFrame) -> DataFrame:
    """The other consensus rule: every raw row has one vote, whatever its corpus."""
    votes = (
        normalized_rows(df)
        .groupBy("url")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("label") == 1).alias("_p"))
        .filter(_per_url(F.length("url"), F.col("_n")) >= MIN_LENGTH)
    )
    label = (F.col("_p") * 2 >= F.col("_n")).cast("tinyint")
    return with_group(votes.select("url", label.alias("label")))


def totals(merged: DataFrame) -> DataFrame:
    """One row of totals; duplicates and conflicts count before anything is dropped."""
    final = F.col("kept") & F.col("has_host")
    rows = merged.agg(
        F.count_if(final).alias("unique_urls"),
        F.count_if(final & (F.col("label") == 0)).alias("benign"),
        F.count_if(final & (F.col("label") == 1)).alias("phishing"),
        F.countDistinct(F.when(final, F.col("group"))).alias("unique_registered_domains"),
        F.count_if(F.col("n_sources") > 1).alias("cross_corpus_duplicates"),
        F.count_if("contested").alias("label_conflicts"),
        F.count_if(F.col("kept") & ~F.col("has_host")).alias("rows_dropped_no_host"),
    )
    urls = F.greatest(F.col("unique_urls"), F.lit(1))
    domains = F.greatest(F.col("unique_registered_domains"), F.lit(1))
    return rows.withColumns(
        {
            "benign_pct": F.bround(F.col("benign") / urls, 4),
            "phishing_pct": F.bround(F.col("phishing") / urls, 4),
            "urls_per_domain": F.bround(F.col("unique_urls") / domains, 3),
        }
    )


def source_dataset_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"))


def per_source_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("unique_urls"),
        F.count_if(F.col("label") == 0).alias("benign"),
        F.count_if(F.col("label") == 1).alias("phishing"),
    )
