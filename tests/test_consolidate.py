import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests import rowwise
from urlsieve.operators import audit
from urlsieve.operators import consolidate as con
from urlsieve.sources.corpora import apply_label
from urlsieve.functions.labels import label_a, label_b, label_c

SOURCES = ["b", "a", "c"]


def make_rows(n=400, seed=3):
    rnd = random.Random(seed)
    hosts = ["x.com", "www.y.co.uk", "z.net", "hot.example.org", "a.b"]
    rows = []
    for _ in range(n):
        url = rnd.choice(["", "http://", "HTTPS://"]) + rnd.choice(hosts) + rnd.choice(["", "/", "/p", "/q?x=1", "/P"])
        rows.append((url, rnd.randint(0, 1), rnd.choice(SOURCES)))
    rows += [("http://hot.example.org/p", 1, "a")] * (n // 2)
    rows += [("abc", 0, "a"), ("?guid=1", 1, "c"), (None, 1, "a"), ("x.com", None, "b"), ("http://a/", 0, "a")]
    return rows


def brute(rows, conflict="phishing", policy="include", policy_source="c"):
    cells = defaultdict(list)
    for url, label, source in rows:
        if url is None or label is None or len(url.strip()) <= 3:
            continue
        n = rowwise.normalize(url)
        if len(n) > 3:
            cells[source, n].append(label)
    votes = {k: int(sum(v) * 2 >= len(v)) for k, v in cells.items()}
    if policy == "exclude":
        votes = {k: v for k, v in votes.items() if k[0] != policy_source or v == 1}
    if policy == "domains-only":
        moved = defaultdict(list)
        for (s, u), v in votes.items():
            moved[s, rowwise.domain(u) if s == policy_source and v else u].append(v)
        votes = {k: int(sum(v) * 2 >= len(v)) for k, v in moved.items()}
    by_url = defaultdict(dict)
    for (s, u), v in votes.items():
        by_url[u][s] = v
    out, stats = {}, {"dup": 0, "conflict": 0, "no_host": 0}
    for u, v in by_url.items():
        mean = sum(v.values()) / len(v)
        stats["dup"] += len(v) > 1
        stats["conflict"] += 0 < mean < 1
        if conflict == "drop" and 0 < mean < 1:
            continue
        label = int(mean > 0.5) if conflict == "benign" else int(mean >= 0.5)
        if not rowwise.domain(u):
            stats["no_host"] += 1
            continue
        out[u] = (label, rowwise.domain(u), "+".join(sorted(v)))
    return out, stats


@pytest.mark.parametrize("conflict", con.CONFLICT_POLICIES)
@pytest.mark.parametrize("policy", con.CORPUS_POLICIES)
def test_against_brute_force(spark, conflict, policy):
    rows = make_rows()
    df = spark.createDataFrame(rows, "url string, label int, source string")
    merged = con.consolidate(df, SOURCES, conflict, policy, "c")
    got = {r.url: (r.label, r.group, r.source_dataset) for r in con.master(merged).collect()}
    want, stats = brute(rows, conflict, policy)
    assert got == want
    t = con.totals(merged).first()
    assert (t.unique_urls, t.cross_corpus_duplicates, t.label_conflicts, t.rows_dropped_no_host) == (
        len(want), stats["dup"], stats["conflict"], stats["no_host"]
    )
    assert t.benign + t.phishing == t.unique_urls
    counts = con.source_dataset_counts(con.master(merged)).agg(F.sum("n")).first()[0]
    assert counts == t.unique_urls


def test_unknown_policies(spark):
    df = spark.createDataFrame([("x.com", 1, "a")], "url string, label int, source string")
    with pytest.raises(ValueError):
        con.consolidate(df, SOURCES, "maybe")
    with pytest.raises(ValueError):
        con.consolidate(df, SOURCES, "drop", "maybe", "c")


def test_one_shuffle_for_both_dedups(spark):
    df = spark.createDataFrame(make_rows(20), "url string, label int, source string")
    plan = con.master(con.consolidate(df, SOURCES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan


def test_two_consensus_rules_differ(spark):
    rows = [("x.com/a", 1, "a"), ("x.com/a", 1, "a"), ("x.com/a", 1, "a"), ("x.com/a", 0, "b"), ("x.com/a", 0, "c")]
    df = spark.createDataFrame(rows, "url string, label int, source string")
    assert con.master(con.consolidate(df, SOURCES)).first().label == 0
    assert con.harmonize_rows(df).first().label == 1


# The stand-in corpora and the measured counts of the fixture notes.
STANDIN_A = """
select url, case when rlike(url,'cheap-pills|casino-win|free-bets|adult-x|spam-farm')
  then case when page_id%2=0 then 'phishing' else 'malware' end else ' Benign' end as type from pages
union all select replace(url,'https://','http://'),'benign' from pages where page_id%11=0
union all select * from (values ('abc','benign'),('https://','benign'),('?guid=a b','phishing'),
  (NULL,'benign'),('x.example.com/z',NULL)) v(url,type)"""
STANDIN_B = """
select regexp_replace(url,'^https?://','') as URL,
  case when page_id%7=0 or rlike(url,'casino-win|spam-farm') then 'bad' else 'good' end as Label
from pages where page_id%3<>0"""
STANDIN_C = """
select case when page_id%10=0 then url
    else 'https://www.' || regexp_extract(url,'^https?://(?:www[.])?([^/?#]*)',1) end as URL,
  case when page_id%26=0 then 'x' when page_id%5=0 then '0' else '1' end as label
from pages where page_id%2=0"""
MEASURED = {
    "sf0.001": {1: (17, 0, 2), 3: (30, 6, 6), 4: (17, 0, 0), 5: (2, 1, 1), 7: (3, 3, 0)},
    "sf0.01": {1: (77, 0, 5), 3: (150, 27, 32), 4: (50, 0, 0), 5: (9, 8, 8), 7: (16, 14, 3)},
}


@pytest.mark.parametrize("scale", list(MEASURED))
def test_fixture_counts(spark, scale):
    spark.read.parquet(f"/root/testdata/{scale}/pages.parquet").createOrReplaceTempView("pages")
    parts = [
        apply_label(spark.sql(sql).toDF("url", "label"), name, fn)
        for sql, name, fn in ((STANDIN_A, "a", label_a), (STANDIN_B, "b", label_b), (STANDIN_C, "c", label_c))
    ]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    bits = {"a": 1, "b": 2, "c": 4}
    merged = con.consolidate(df, ["a", "b", "c"])
    counts = defaultdict(lambda: [0, 0, 0])
    for r in merged.collect():
        cell = counts[sum(bits[s] for s in r.source_dataset.split("+"))]
        cell[0] += 1
        cell[1] += r.contested
        cell[2] += r.label
    assert {k: tuple(v) for k, v in counts.items()} == MEASURED[scale]


def test_surface_audit_nulls(spark):
    df = spark.createDataFrame([("x.com", 0), ("y.com", 0)], "url string, label int")
    r = audit.surface_audit(df).first()
    assert (r.n_rows, r.pct_with_path, r.pct_with_path_phishing, r.p_phishing_given_path) == (2, 0.0, None, None)
    assert r.path_rule_accuracy == 1.0
    empty = audit.surface_audit(df.filter("label = 7")).first()
    assert empty.n_rows == 0 and empty.path_rule_accuracy is None
