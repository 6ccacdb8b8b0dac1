"""Queries of the feature job. Unless named otherwise they read ``urls``: every page in
eight shapes plus every link."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve.catalog import relations as R
from urlsieve.catalog import sql as S
from urlsieve.constants import BRANDS, FEATURE_NAMES, SMOKE_URLS
from urlsieve.functions.brands import brand_dim, brand_exact, brand_match, near_brands
from urlsieve.functions.features import extract_features
from urlsieve.functions.urls import normalize_url, url_parts
from urlsieve.operators.audit import counterfactual_features
from urlsieve.operators.sampling import numbered_order
from urlsieve.operators.vectorize import fit_scaler, scale
from urlsieve.plans.train import smoke_relation
from urlsieve.session import scratch_path
from urlsieve.streaming.features import featurise, stream_features, url_stream

GROUPS = {
    "feat_lengths": ["url_length", "hostname_length", "path_length", "query_length"],
    "feat_structure": ["subdomain_count", "path_depth"],
    "feat_chars": [
        "digit_count", "digit_ratio", "uppercase_count", "uppercase_ratio", "special_char_count",
        "dot_count", "hyphen_count", "slash_count", "at_count", "question_count", "equal_count",
    ],
    "feat_entropy": ["shannon_entropy"],
    "feat_host": ["vowel_consonant_ratio", "is_ip_address", "is_punycode"],
    "feat_keywords": ["suspicious_keyword_count"],
    "feat_tld_risk": ["tld_risk_score"],
    "feat_brand_distance": ["min_brand_levenshtein_distance", "is_homoglyph_brand"],
    "feat_brand_spoof": ["has_brand_in_subdomain_or_path", "is_authentic_brand_domain"],
    "feat_runs": ["consecutive_char_repeat_count"],
    "feat_words": ["avg_word_length"],
    "feat_trigrams": ["char_trigram_diversity"],
}
KEYS = ["page_id", "variant", "url"]
META = ["target_brand", "is_homoglyph", "is_authentic_brand", "root_domain"]


def feature_group(names):
    def query(spark, sf):
        return extract_features(R.url_shapes(spark, sf), meta=None).select(*KEYS, *names)

    return query


def all_features(spark, sf):
    df = extract_features(R.url_shapes(spark, sf))
    return df.select(*KEYS, *FEATURE_NAMES, *[F.col(f"meta.{m}").alias(m) for m in META])


def url_metadata(spark, sf):
    df = extract_features(R.url_shapes(spark, sf))
    return df.select(*KEYS, *[F.col(f"meta.{m}").alias(m) for m in META])


def url_parts_query(spark, sf):
    return url_parts(R.url_shapes(spark, sf)).select(
        *KEYS, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_query").alias("query")
    )


def hosts(spark, sf):
    return url_parts(R.url_shapes(spark, sf)).select("url", F.col("_host").alias("host"))


def brand_match_query(spark, sf):
    return brand_match(hosts(spark, sf).distinct(), "host").select("url", "host", "dist", "brand")


def brand_table(spark, sf):
    """The listed brands and, behind them, the first label of every page host and of its look-alikes."""
    label = F.split_part("host", F.lit("."), F.lit(1))
    names = hosts(spark, sf).select(label.alias("brand")).filter(F.length("brand") >= 5).distinct()
    own = names.filter(~F.col("brand").isin(BRANDS))
    numbered = numbered_order(own, "brand", "brand", "idx").select((F.col("idx") + 1000).cast("int").alias("idx"), "brand")
    return brand_dim(spark).unionByName(numbered)


def near_brands_query(spark, sf):
    """Look-alikes of a brand table that grows with the tables, by shared deletions."""
    rows = hosts(spark, sf).distinct()
    return near_brands(rows, "url", "host", brand_table(spark, sf))


def brand_exact_query(spark, sf):
    found = brand_exact(hosts(spark, sf), "url", "host", brand_dim(spark))
    return found.groupBy("brand", "idx").agg(F.count(F.lit(1)).alias("n"))


def master_features(spark, sf):
    """Consolidation and features in one plan: the training job's tabular input."""
    return extract_features(R.master_table(spark, sf).select("url", "label", "group"), meta=None)


def page_features(spark, sf):
    df = R.labelled_pages(spark, sf)
    return extract_features(df, meta=None).select("page_id", "label", *FEATURE_NAMES)


def standard_scale(spark, sf):
    df = page_features(spark, sf)
    scaled = scale(df, fit_scaler(df))
    return scaled.select("page_id", *[F.bround(F.col(n), 6).alias(n) for n in FEATURE_NAMES])


def smoke_urls_features(spark, sf):
    """The hand-labelled urls on the scale of all page urls of the tables."""
    stats = fit_scaler(page_features(spark, sf))
    smoke = extract_features(smoke_relation(spark).select("url", "label"), meta=None)
    return scale(smoke, stats).select("url", "label", *[F.bround(F.col(n), 6).alias(n) for n in FEATURE_NAMES])


def counterfactual_scheme(spark, sf):
    df = R.pages(spark, sf).select(F.regexp_replace("url", "^https?://", "").alias("url"))
    return counterfactual_features(df)


def counterfactual_normalized(spark, sf):
    """After normalising, a scheme changes nothing: every share has to be 0."""
    df = R.pages(spark, sf).select(F.regexp_replace("url", "^https?://", "").alias("bare"))
    both = df.select(
        normalize_url("bare").alias("a"), normalize_url(F.concat(F.lit("https://"), F.col("bare"))).alias("b")
    )
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def stream_query(spark, sf):
    """Every page through the stream; the result is what the sink holds."""
    schema = R.pages(spark, sf).schema
    stream = url_stream(spark, sf, schema, "pages.parquet").select("page_id", "url")
    root = scratch_path(spark, "stream")
    stream_features(stream, f"{root}/sink", f"{root}/checkpoint").awaitTermination()
    expected = featurise(R.pages(spark, sf).select("page_id", "url")).schema
    out = spark.read.schema(expected).parquet(f"{root}/sink")
    return out.select("page_id", "raw_url", "url", "group", *FEATURE_NAMES, "meta.target_brand")


QUERIES = {
    "url_parts": url_parts_query,
    **{name: feature_group(cols) for name, cols in GROUPS.items()},
    "url_metadata": url_metadata,
    "extract_features": all_features,
    "master_features": master_features,
    "brand_exact": brand_exact_query,
    "brand_match": brand_match_query,
    "near_brands": near_brands_query,
    "standard_scale": standard_scale,
    "smoke_urls_features": smoke_urls_features,
    "counterfactual_scheme": counterfactual_scheme,
    "counterfactual_normalized": counterfactual_normalized,
    "stream_features": stream_query,
}

_URLS = f"{S.URL_SHAPES},\n{S.features('urls')}"
_KEYS = "urls.page_id::BIGINT AS page_id, urls.variant::INT AS variant, urls.url AS url"
_META = (
    "target_brand, is_homoglyph_brand = 1 AS is_homoglyph, "
    "is_authentic_brand_domain = 1 AS is_authentic_brand, root_domain"
)


def _shapes(columns: str) -> str:
    return f"WITH {_URLS}\nSELECT {_KEYS}, {columns} FROM urls JOIN ft ON urls.url = ft.url"


_PAGES = f"""pg AS (SELECT page_id, {S.norm('url')} AS url, url AS raw_url,
  CASE WHEN regexp_matches(url, '{R.SPAM}') THEN 1 ELSE 0 END AS label FROM pages)"""
_PAGE_FT = f"{_PAGES},\n{S.features('pg')}"


def _scaled(prefix: str) -> str:
    return ", ".join(
        f"round_even(({prefix}{n} - m_{n}) / CASE WHEN s_{n} = 0 THEN 1 ELSE s_{n} END, 6)::DOUBLE AS {n}"
        for n in FEATURE_NAMES
    )


_STATS = "st AS (SELECT " + ", ".join(
    f"avg({n}::DOUBLE) AS m_{n}, stddev_pop({n}::DOUBLE) AS s_{n}" for n in FEATURE_NAMES
) + " FROM {source})"

_SMOKE_ROWS = ", ".join(f"('{u}', {y})" for u, y in SMOKE_URLS)
_BOTH = f"""{_PAGES},
sm AS (SELECT {S.norm('u')} AS url, y AS label FROM (VALUES {_SMOKE_ROWS}) v(u, y)),
allu AS (SELECT url FROM pg UNION ALL SELECT url FROM sm),
{S.features('allu')}"""

_CF = f"""cf AS (SELECT regexp_replace(url, '^https?://', '') AS bare FROM pages),
allu AS (SELECT bare AS url FROM cf UNION ALL SELECT 'https://' || bare FROM cf),
{S.features('allu')},
pr AS (SELECT {', '.join(f'a.{n}::DOUBLE AS a_{n}, b.{n}::DOUBLE AS b_{n}' for n in FEATURE_NAMES)}
  FROM cf JOIN ft a ON a.url = bare JOIN ft b ON b.url = 'https://' || bare)"""

ORACLES = {
    "url_parts": f"WITH {S.URL_SHAPES},\n{S.parts('urls')}\nSELECT {_KEYS}, host, path, query "
    "FROM urls JOIN pt ON urls.url = pt.url",
    **{name: _shapes(S.doubles(cols)) for name, cols in GROUPS.items()},
    "url_metadata": _shapes(_META),
    "extract_features": _shapes(f"{S.doubles()}, {_META}"),
    "master_features": f"WITH {S.master()},\n{S.features('master')}\n"
    f'SELECT master.url AS url, label::TINYINT AS label, "group", {S.doubles()} '
    "FROM master JOIN ft ON master.url = ft.url",
    "brand_exact": f"WITH {_URLS}\nSELECT t AS brand, brands.idx::INT AS idx, count(*) AS n FROM urls JOIN "
    "(SELECT DISTINCT url, t FROM tok) k ON k.url = urls.url JOIN brands ON brands.brand = t GROUP BY 1, 2",
    "brand_match": f"WITH {_URLS}\nSELECT url, host, coalesce(d, 10)::INT AS dist, target_brand AS brand FROM ft",
    "near_brands": f"""WITH {_URLS},
own AS (SELECT DISTINCT split_part(host, '.', 1) AS brand FROM pt WHERE length(split_part(host, '.', 1)) >= 5),
dim AS (SELECT idx, brand FROM brands UNION ALL
  SELECT 1000 + row_number() OVER (ORDER BY {S.digest('brand', 'brand')}, brand) - 1, brand FROM own WHERE brand NOT IN (SELECT brand FROM brands)),
near AS (SELECT url, levenshtein(t, dim.brand) AS dist, dim.brand AS brand, dim.idx AS idx FROM tok JOIN dim ON levenshtein(t, dim.brand) <= 2)
SELECT url, dist::INT AS dist, brand, idx::INT AS idx FROM near QUALIFY row_number() OVER (PARTITION BY url ORDER BY dist, idx) = 1""",
    "standard_scale": f"WITH {_PAGE_FT},\nj AS (SELECT page_id, ft.* FROM pg JOIN ft ON pg.url = ft.url),\n"
    f"{_STATS.format(source='j')}\nSELECT page_id, {_scaled('j.')} FROM j, st",
    "smoke_urls_features": f"WITH {_BOTH},\nj AS (SELECT ft.* FROM pg JOIN ft ON pg.url = ft.url),\n"
    f"{_STATS.format(source='j')}\nSELECT sm.url AS url, label::INT AS label, {_scaled('ft.')} "
    "FROM sm JOIN ft ON sm.url = ft.url, st",
    "counterfactual_scheme": f"WITH {_CF}\n"
    + "\nUNION ALL ".join(
        f"SELECT '{n}' AS feature, round_even(avg(a_{n}), 4) AS mean_bare, round_even(avg(b_{n}), 4) AS mean_https, "
        f"round_even(avg(CASE WHEN a_{n} <> b_{n} THEN 1 ELSE 0 END), 4) AS share_changed FROM pr"
        for n in FEATURE_NAMES
    ),
    "counterfactual_normalized": "SELECT count(*) AS n, count(*) FILTER "
    f"({S.norm('bare')} <> {S.norm(chr(39) + 'https://' + chr(39) + ' || bare')}) AS changed "
    "FROM (SELECT regexp_replace(url, '^https?://', '') AS bare FROM pages)",
    "stream_features": f"WITH {_PAGE_FT},\n{S.with_domain('dom', 'pg')}\n"
    f'SELECT page_id, raw_url, dom.url AS url, "group", {S.doubles()}, target_brand '
    "FROM dom JOIN ft ON dom.url = ft.url",
}
