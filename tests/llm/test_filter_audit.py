import re
from collections import Counter
from itertools import permutations

import pytest

from check import compare, connect
from urlsieve.llm.filter_audit import LETTERS, METRICS, filter_interactions, mask_cells, walk
from urlsieve.llm.queries import ORACLES, op13_filter_audit


def brute(rows, labels):
    """``rows`` (doc_id, text, lang) and ``labels`` (doc_id, quality, toxic) by the definition, order after order."""
    texts = [(i, t or "", l or "") for i, t, l in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    docs = []
    for i, t, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        docs.append((part, i, {c for c, f in zip(LETTERS, fails, strict=True) if f}))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = Counter()
        for order in map("".join, permutations(LETTERS)):
            left = [d for d in docs if d[0] == part]
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[2]]
                failing = sum(c in d[2] for d in docs if d[0] == part)
                left = [d for d in left if c not in d[2]]
                shapley[c] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), failing - len(gone), sum(d[2] == {c} for d in docs if d[0] == part),
                    sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone),
                )
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row, shapley[order[step - 1]])
    return out


def test_query_matches_sql(spark, small_dir):
    got = op13_filter_audit(spark, small_dir).toPandas()
    assert compare(got, connect(small_dir).execute(ORACLES["op13_filter_audit"]).df()).startswith("ok")


def test_odd_rows(spark, odd_docs, odd_rows):
    many = " ".join(f"word{i}" for i in range(150))
    more = [(20, many, "en"), (21, many, None), (None, many, "en"), (22, many + " #", "en"), (19, "LOUD " * 120, ""), (23, many * 20_000, "en")]
    docs = odd_docs.select("doc_id", "text", "lang", "part", "kept").union(spark.createDataFrame([(*m, "x", "y") for m in more], "doc_id long, text string, lang string, part string, kept string"))
    labels = [(20, 1, 0), (21, 1, 1), (21, 0, None), (None, 1, 1), (3, None, 1), (999, 1, 1), (12, 1, 0), (22, 0, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [(r[0], r[1], r[2]) for r in odd_rows] + more
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*METRICS, "shapley")) for r in filter_interactions(docs, table).collect()}
    assert got == brute(rows, labels)


def test_a_third_of_all_rows_are_one_text(spark):
    rows = [(i, "same " * 120, "en") for i in range(300)] + [(i, f"text {i}", "de") for i in range(300, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    cells = {r["part"]: sorted((c["mask"], c["n"], c["good"], c["toxic"]) for c in r["cells"]) for r in mask_cells(docs, spark.createDataFrame([(0, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")).collect()}
    assert cells == {"en": [(2, 1, 1, 0), (18, 299, 1, 1)], "de": [(1, 600, 0, 0)]}


def test_walk_has_every_prefix_once(spark):
    cells = spark.createDataFrame([("en", [(3, 4, 1, 0), (0, 2, 0, 0)])], "part string, cells array<struct<mask int, n long, good long, toxic long>>")
    rows = walk(cells).collect()
    assert len(rows) == len({r["prefix"] for r in rows}) == 326
    assert all(r["applied"] == sum(1 << LETTERS.index(c) for c in r["prefix"]) and r["step"] == len(r["prefix"]) for r in rows)


@pytest.mark.parametrize("labelled", [False, True])
def test_empty_tables(spark, no_docs, odd_docs, labelled):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    if labelled:
        assert filter_interactions(no_docs, spark.createDataFrame([(1, 1, 1)], labels.schema)).collect() == []
    else:
        assert {r["good_lost"] for r in filter_interactions(odd_docs, labels).collect()} == {0}
