"""Queries of the consolidation job, its audits, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve.catalog import relations as R
from urlsieve.catalog import sql as S
from urlsieve.functions.basic import strip_ws
from urlsieve.functions.labels import label_a, label_b, label_c
from urlsieve.functions.urls import with_group, with_normalized
from urlsieve.operators import audit, consolidate as con, sampling, split
from urlsieve.plans.build_master import build_manifest
from urlsieve.session import materialize, scratch_path
from urlsieve.sources.corpora import SourceSpec, read_corpora
from urlsieve.sources.master import read_master, write_master

MASTER = "SELECT url, label::TINYINT AS label, \"group\", source_dataset FROM master"


def scan_csv_corpus(spark, sf):
    """Write the corpora as CSV, each in its dialect, and read them back through their specs."""
    root = scratch_path(spark, "corpora")
    for name, corpus in (("a", R.corpus_a), ("b", R.corpus_b)):
        corpus(spark, sf).write.option("header", True).option("escape", '"').csv(f"{root}/{name}.csv")
    # the third has a byte order mark, further columns and the flipped label
    third = R.corpus_c(spark, sf).select(F.lit("f").alias("\ufeffFILENAME"), "URL", F.lit(9).alias("junk"), "label")
    third.write.option("header", True).option("escape", '"').csv(f"{root}/c.csv")
    specs = [
        SourceSpec("corpus_c", (f"{root}/c.csv",), "URL", "label", label_c),
        SourceSpec("corpus_a", (f"{root}/missing.csv", f"{root}/a.csv"), "url", "type", label_a),
        SourceSpec("corpus_b", (f"{root}/b.csv",), "other", "names", label_b),
        SourceSpec("absent", (f"{root}/absent.csv",), "url", "label", label_c),
    ]
    return read_corpora(spark, specs)[0]


def sink_roundtrip(spark, sf):
    root = scratch_path(spark, "master")
    write_master(R.master_table(spark, sf), {}, root)
    parquet = spark.read.parquet(f"{root}/master.parquet")
    text = spark.read.option("header", True).option("escape", '"').csv(f"{root}/master.csv")
    both = parquet.withColumn("format", F.lit("parquet")).unionByName(
        text.withColumn("format", F.lit("csv")).withColumn("label", F.col("label").cast("tinyint"))
    )
    return both


def scan_master(spark, sf):
    root = scratch_path(spark, "master")
    write_master(R.master_table(spark, sf), {"url_normalization": None}, root, ("parquet",))
    return read_master(spark, root)


def label_maps(corpus, fn):
    def query(spark, sf):
        df = corpus(spark, sf)
        name = df.columns[1]
        return df.dropna(subset=[name]).groupBy(F.col(name).alias("raw"), fn(F.col(name)).alias("label")).agg(
            F.count(F.lit(1)).alias("n")
        )

    return query


def length_filter(spark, sf):
    raw = R.raw_rows(spark, sf)
    long = F.length(strip_ws(F.col("raw"))) > 3
    counted = with_normalized(raw.withColumnRenamed("url", "raw"), "raw", "url")
    return counted.groupBy("source").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(long).alias("long_rows"),
        F.count_if(long & (F.length("url") > 3)).alias("clean_rows"),
    )


def normalize_url(spark, sf):
    return with_normalized(R.raw_rows(spark, sf).select(F.col("url").alias("raw")), "raw", "url")


def registered_domain(spark, sf):
    return with_group(con.clean_urls(R.raw_rows(spark, sf)).select("url"))


def policy(name, **kw):
    def query(spark, sf):
        return con.master(R.merged(spark, sf, **kw))

    query.__name__ = name
    return query


def harmonize_raw(spark, sf):
    raw = R.raw_rows(spark, sf)
    return con.harmonize_rows(raw.filter(F.col("source") != "corpus_c"))


def surface_audit(spark, sf):
    merged = R.merged_votes(spark, sf)
    per_source = audit.surface_audit(con.per_source_rows(merged, R.SOURCES), "source")
    whole = audit.surface_audit(con.master(merged)).withColumn("source", F.lit("master"))
    return per_source.unionByName(whole)


def rule_audit(spark, sf):
    rows = R.raw_rows(spark, sf)
    return audit.rule_audit(rows, audit.path_or_not_https(F.col("url")), "source")


SPLIT_SQL = f"""CASE WHEN {S.bucket('42', '"group"')} < 15 THEN 'test'
  WHEN {S.bucket('42', '"group"')} < 30 THEN 'val' ELSE 'train' END"""


SPLIT = S.master() + f""",
spl AS (SELECT url, label, "group", {SPLIT_SQL} AS split FROM master)"""


def group_split(spark, sf):
    return split.group_split(R.master_table(spark, sf)).select("url", "label", "group", "split")


def group_split_exact(spark, sf):
    return split.group_split_exact(R.master_table(spark, sf)).select("url", "group", "split")


def augmented(spark, sf):
    """The augmentation reads the split three times: from one written copy."""
    return split.augment_bare_domains(materialize(group_split(spark, sf), "split"))


def bare_domain_augment(spark, sf):
    return augmented(spark, sf)


def split_leakage(spark, sf):
    return split.split_leakage(augmented(spark, sf))


def manifest_rows(spark, sf):
    """Every number of the manifest: totals, corpora, provenance and the shape audit."""
    merged = R.merged_votes(spark, sf)
    manifest = build_manifest(merged, con.master(merged), R.SOURCES, "phishing", "include")
    rows = [("totals", "", k, v) for k, v in manifest["totals"].items()]
    for name, own in manifest["per_source"].items():
        rows += [("per_source", name, k, v) for k, v in (own | own["surface_form"]).items() if k not in ("surface_form", "n_rows")]
    rows += [("source_dataset", name, "n", n) for name, n in manifest["source_dataset_counts"].items()]
    rows += [("surface_form", "master", k, v) for k, v in manifest["surface_form_audit"]["master"].items()]
    numbers = [(s, n, k, float(v)) for s, n, k, v in rows if isinstance(v, (int, float))]
    return spark.createDataFrame(numbers, "section string, name string, metric string, value double")


def numbered_order(spark, sf):
    return sampling.numbered_order(R.master_table(spark, sf).select("url", "label"))


def keep_first(spark, sf):
    rows = R.raw_rows(spark, sf).select(
        "url", "source", F.concat_ws("|", "source", F.lpad(F.col("label").cast("string"), 2, "0")).alias("priority")
    )
    return sampling.keep_first(con.clean_urls(rows.withColumn("label", F.lit(0))).drop("label"), "url", "priority")


def seeded_order(spark, sf):
    ordered = sampling.seeded_order(R.master_table(spark, sf).select("url"))
    return ordered.withColumn("h", sampling.row_hash(42, "url"))


QUERIES = {
    "master_table": R.master_table,
    "scan_csv_corpus": scan_csv_corpus,
    "scan_master": scan_master,
    "sink_roundtrip": sink_roundtrip,
    "label_map_a": label_maps(R.corpus_a, label_a),
    "label_map_b": label_maps(R.corpus_b, label_b),
    "label_map_c": label_maps(R.corpus_c, label_c),
    "length_filter": length_filter,
    "normalize_url": normalize_url,
    "registered_domain": registered_domain,
    "within_source_dedup": lambda s, sf: con.per_source_rows(R.votes(s, sf), R.SOURCES),
    "cross_source_consensus": lambda s, sf: R.merged(s, sf).select(
        "url", "label", "n_sources", "contested", "source_dataset"
    ),
    "conflict_phishing": policy("conflict_phishing", conflict_policy="phishing"),
    "conflict_benign": policy("conflict_benign", conflict_policy="benign"),
    "conflict_drop": policy("conflict_drop", conflict_policy="drop"),
    "policy_exclude": policy("policy_exclude", corpus_policy="exclude", policy_source="corpus_c"),
    "policy_domains_only": policy("policy_domains_only", corpus_policy="domains-only", policy_source="corpus_c"),
    "drop_no_host": lambda s, sf: con.drop_no_host(R.merged(s, sf)).agg(F.count(F.lit(1)).alias("kept_rows")),
    "source_dataset_counts": lambda s, sf: con.source_dataset_counts(R.master_table(s, sf)),
    "per_source_totals": lambda s, sf: con.per_source_totals(con.per_source_rows(R.votes(s, sf), R.SOURCES)),
    "manifest_totals": lambda s, sf: con.totals(R.merged(s, sf)),
    "harmonize_raw": harmonize_raw,
    "surface_audit": surface_audit,
    "scheme_audit": lambda s, sf: audit.scheme_audit(R.raw_rows(s, sf)),
    "bare_domain_audit": lambda s, sf: audit.bare_domain_audit(R.master_table(s, sf)),
    "rule_audit": rule_audit,
    "corpus_disagreement": lambda s, sf: audit.disagreement(R.votes(s, sf), R.SOURCES),
    "group_split": group_split,
    "group_split_exact": group_split_exact,
    "split_counts": lambda s, sf: split.split_counts(group_split(s, sf)),
    "bare_domain_augment": bare_domain_augment,
    "split_leakage": split_leakage,
    "stratified_sample": lambda s, sf: sampling.stratified_sample(R.master_table(s, sf), 100),
    "keep_first": keep_first,
    "seeded_order": seeded_order,
    "numbered_order": numbered_order,
    "manifest_rows": manifest_rows,
}


def _label_sql(corpus: str, column: str, expr: str) -> str:
    return f"""WITH {S.CORPORA} SELECT {column} AS raw, ({expr})::TINYINT AS label, count(*) AS n
FROM {corpus} WHERE {column} IS NOT NULL GROUP BY 1, 2"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_EXCLUDED = f"""{S.SOURCE_ROWS},
pol AS (SELECT * FROM src WHERE source <> 'corpus_c' OR label = 1)"""
_DOMAINS = f"""{S.SOURCE_ROWS},
{S.with_domain('keyed', 'src')},
pol AS (SELECT source, url, label FROM src WHERE source <> 'corpus_c'
  UNION ALL SELECT 'corpus_c', u, CASE WHEN avg(label) >= 0.5 THEN 1 ELSE 0 END
  FROM (SELECT CASE WHEN label = 1 THEN "group" ELSE url END AS u, label FROM keyed WHERE source = 'corpus_c')
  GROUP BY u)"""

_RULE = """(contains(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.\\-]*://', ''), '/+$', ''), '/')
  OR NOT starts_with(lower(url), 'https://'))"""

ORACLES = {
    "master_table": _with(S.master(), MASTER),
    "scan_csv_corpus": _with(
        S.CORPORA, "SELECT url, label::TINYINT AS label, source FROM raw"
    ),
    "scan_master": _with(S.master(), 'SELECT url, label::INT AS label, "group" FROM master'),
    "sink_roundtrip": _with(
        S.master(),
        "SELECT url, label::TINYINT AS label, \"group\", source_dataset, format FROM master, "
        "(VALUES ('parquet'), ('csv')) f(format)",
    ),
    "label_map_a": _label_sql(
        "corpus_a", "type", "CASE WHEN lower(trim(type)) = 'benign' THEN 0 ELSE 1 END"
    ),
    "label_map_b": _label_sql("corpus_b", "label", "CASE WHEN lower(trim(label)) = 'good' THEN 0 ELSE 1 END"),
    "label_map_c": _label_sql(
        "corpus_c", "label", "CASE WHEN trunc(coalesce(try_cast(label AS DOUBLE), 1)) = 0 THEN 1 ELSE 0 END"
    ),
    "length_filter": _with(
        S.CLEAN,
        f"""SELECT * FROM (SELECT source, count(*) AS raw_rows,
  count(*) FILTER (length({S.strip('url')}) > 3) AS long_rows FROM raw GROUP BY source)
JOIN (SELECT source, count(*) AS clean_rows FROM clean GROUP BY source) USING (source)""",
    ),
    "normalize_url": _with(S.CORPORA, f"SELECT url AS raw, {S.norm('url')} AS url FROM raw"),
    "registered_domain": _with(
        f"{S.CLEAN}, {S.with_domain('dom', 'clean')}", 'SELECT url, "group" FROM dom'
    ),
    "within_source_dedup": _with(S.SOURCE_ROWS, "SELECT source, url, label::TINYINT AS label FROM src"),
    "cross_source_consensus": _with(
        f"{S.SOURCE_ROWS}, {S.merged()}",
        "SELECT url, label::TINYINT AS label, n_sources::INT AS n_sources, contested, source_dataset FROM merged",
    ),
    "conflict_phishing": _with(S.master(policy="phishing"), MASTER),
    "conflict_benign": _with(S.master(policy="benign"), MASTER),
    "conflict_drop": _with(S.master(policy="drop"), MASTER),
    "policy_exclude": _with(S.master(_EXCLUDED, "pol"), MASTER),
    "policy_domains_only": _with(S.master(_DOMAINS, "pol"), MASTER),
    "drop_no_host": _with(S.master(), "SELECT count(*) AS kept_rows FROM merged WHERE \"group\" <> ''"),
    "source_dataset_counts": _with(S.master(), "SELECT source_dataset, count(*) AS n FROM master GROUP BY 1"),
    "per_source_totals": _with(
        S.SOURCE_ROWS,
        """SELECT source, count(*) AS unique_urls, count(*) FILTER (label = 0) AS benign,
  count(*) FILTER (label = 1) AS phishing FROM src GROUP BY source""",
    ),
    "manifest_totals": _with(
        S.master(),
        """SELECT unique_urls, benign, phishing, unique_registered_domains, cross_corpus_duplicates, label_conflicts,
  rows_dropped_no_host, round_even(benign * 1.0::DOUBLE / unique_urls, 4) AS benign_pct,
  round_even(phishing * 1.0::DOUBLE / unique_urls, 4) AS phishing_pct,
  round_even(unique_urls * 1.0::DOUBLE / unique_registered_domains, 3) AS urls_per_domain FROM
(SELECT count(*) AS unique_urls, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS phishing,
  count(DISTINCT "group") AS unique_registered_domains FROM master),
(SELECT count(*) FILTER (n_sources > 1) AS cross_corpus_duplicates, count(*) FILTER (contested) AS label_conflicts,
  count(*) FILTER (kept AND "group" = '') AS rows_dropped_no_host FROM merged)""",
    ),
    "harmonize_raw": _with(
        f"""{S.CLEAN},
har AS (SELECT url, CASE WHEN avg(label) >= 0.5 THEN 1 ELSE 0 END AS label FROM clean
  WHERE source <> 'corpus_c' GROUP BY url),
{S.with_domain('dom', 'har')}""",
        'SELECT url, label::TINYINT AS label, "group" FROM dom',
    ),
    "surface_audit": _with(
        S.master(),
        f"""SELECT source, {S.SURFACE} FROM src GROUP BY source
UNION ALL SELECT 'master', {S.SURFACE} FROM master""",
    ),
    "scheme_audit": _with(
        S.CORPORA,
        f"""SELECT source, label::TINYINT AS label, count(*) AS n,
  round_even(avg(CASE WHEN regexp_matches(lower({S.strip('url')}), '^https?://') THEN 1 ELSE 0 END), 4) AS has_scheme
FROM raw GROUP BY 1, 2""",
    ),
    "bare_domain_audit": _with(
        S.master(),
        """SELECT label::TINYINT AS label, count(*) AS n, count(*) FILTER (NOT contains(url, '/')) AS n_bare,
  round_even(count(*) FILTER (NOT contains(url, '/')) * 1.0::DOUBLE / count(*), 6) AS bare_share,
  quantile_cont(length(url), 0.5)::DOUBLE AS median_length FROM master GROUP BY 1""",
    ),
    "rule_audit": _with(
        S.CORPORA,
        f"""SELECT source, count(*) AS n,
  round_even(avg(CASE WHEN {_RULE} = (label = 1) THEN 1 ELSE 0 END), 4) AS accuracy,
  coalesce(round_even(avg(CAST({_RULE} AS INT)) FILTER (label = 0), 4), 0) AS fpr,
  coalesce(round_even(avg(CAST(NOT {_RULE} AS INT)) FILTER (label = 1), 4), 0) AS fnr FROM raw GROUP BY source""",
    ),
    "corpus_disagreement": _with(
        S.SOURCE_ROWS,
        """SELECT source_a, source_b, shared, only_a_malicious, only_b_malicious, CASE WHEN shared = 0 THEN 0
  ELSE round_even((only_a_malicious + only_b_malicious) * 1.0::DOUBLE / shared, 4) END AS disagreement FROM
(SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared,
  count(*) FILTER (a.label > b.label) AS only_a_malicious, count(*) FILTER (a.label < b.label) AS only_b_malicious
  FROM src a JOIN src b ON a.url = b.url AND a.source < b.source GROUP BY 1, 2)""",
    ),
    "group_split": _with(SPLIT, 'SELECT url, label::TINYINT AS label, "group", split FROM spl'),
    "group_split_exact": _with(
        S.master()
        + f""",
gs AS (SELECT "group", row_number() OVER (ORDER BY {S.digest('42', '"group"')}) AS r, count(*) OVER () AS g
  FROM (SELECT DISTINCT "group" FROM master)),
cut AS (SELECT "group", r, ceil(0.15::DOUBLE * g) AS t,
  ceil((0.15::DOUBLE / (1 - 0.15::DOUBLE)) * (g - ceil(0.15::DOUBLE * g))) AS v FROM gs)""",
        """SELECT url, "group", CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split
FROM master JOIN cut USING ("group")""",
    ),
    "split_counts": _with(SPLIT, "SELECT split, label::TINYINT AS label, count(*) AS n FROM spl GROUP BY 1, 2"),
    "bare_domain_augment": _with(
        SPLIT,
        f"""SELECT url, label::TINYINT AS label, "group", split FROM spl
UNION ALL SELECT g, 0::TINYINT, g, 'train' FROM
  (SELECT DISTINCT "group" AS g FROM spl WHERE split = 'train' AND label = 0 AND {S.bucket('7', '"group"')} < 50)
WHERE g NOT IN (SELECT url FROM spl WHERE split = 'train')""",
    ),
    "split_leakage": _with(
        SPLIT
        + f""",
aug AS (SELECT "group", split FROM spl
  UNION ALL SELECT g, 'train' FROM
  (SELECT DISTINCT "group" AS g FROM spl WHERE split = 'train' AND label = 0 AND {S.bucket('7', '"group"')} < 50)
  WHERE g NOT IN (SELECT url FROM spl WHERE split = 'train'))""",
        """SELECT count(*) AS overlap FROM
  (SELECT "group" FROM aug WHERE split = 'train' INTERSECT SELECT "group" FROM aug WHERE split = 'test')""",
    ),
    "stratified_sample": _with(
        S.master()
        + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {S.digest('42', 'url')}) AS r,
  count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM master)""",
        MASTER.replace("FROM master", "FROM rk")
        + " WHERE total <= 100 OR r <= round_even(100.0::DOUBLE / total * n, 0)",
    ),
    "keep_first": _with(
        S.CLEAN,
        """SELECT url, min(source) AS source, min(source || '|' || lpad(label::VARCHAR, 2, '0')) AS priority
FROM clean GROUP BY url""",
    ),
    "seeded_order": _with(S.master(), f"SELECT url, {S.digest('42', 'url')} AS h FROM master"),
    "numbered_order": _with(
        S.master(),
        f"SELECT url, label::TINYINT AS label, row_number() OVER (ORDER BY {S.digest('42', 'url')}, url) - 1 AS position FROM master",
    ),
    "manifest_rows": _with(
        S.master()
        + f""",
tot AS (SELECT unique_urls, benign, phishing, unique_registered_domains, cross_corpus_duplicates, label_conflicts,
  rows_dropped_no_host, round_even(benign * 1.0::DOUBLE / unique_urls, 4) AS benign_pct,
  round_even(phishing * 1.0::DOUBLE / unique_urls, 4) AS phishing_pct,
  round_even(unique_urls * 1.0::DOUBLE / unique_registered_domains, 3) AS urls_per_domain FROM
(SELECT count(*) AS unique_urls, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS phishing,
  count(DISTINCT "group") AS unique_registered_domains FROM master),
(SELECT count(*) FILTER (n_sources > 1) AS cross_corpus_duplicates, count(*) FILTER (contested) AS label_conflicts,
  count(*) FILTER (kept AND "group" = '') AS rows_dropped_no_host FROM merged)),
per AS (SELECT source, count(*) AS unique_urls, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS phishing,
  {S.SURFACE} FROM src GROUP BY source),
whole AS (SELECT {S.SURFACE} FROM master)""",
        """SELECT 'totals' AS section, '' AS name, metric, value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM tot) ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL SELECT 'per_source', source, metric, value
FROM (UNPIVOT (SELECT source, COLUMNS(* EXCLUDE (source, n_rows))::DOUBLE FROM per) ON COLUMNS(* EXCLUDE (source)) INTO NAME metric VALUE value)
UNION ALL SELECT 'source_dataset', source_dataset, 'n', count(*)::DOUBLE FROM master GROUP BY source_dataset
UNION ALL SELECT 'surface_form', 'master', metric, value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM whole) ON COLUMNS(*) INTO NAME metric VALUE value)""",
    ),
}
