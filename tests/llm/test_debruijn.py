import hashlib

import numpy as np
import pytest

from urlsieve.llm import debruijn
from urlsieve.llm.queries import op7_debruijn


def removed(rows, k=20):
    """By definition: (id, words, removed, kept words); equal rows are one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for row in order:
        w = (row[1] or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            run = tuple(w[s : s + k])
            if run in seen:
                gone[s : s + k] = [True] * k
            else:
                seen.add(run)
        out[row] = (row[0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return sorted((out[r] for r in rows), key=str)


def test_query_against_definition(spark, sample, small_dir):
    got = sorted((tuple(r) for r in op7_debruijn(spark, small_dir).collect()), key=str)
    assert got == sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in removed(sample)), key=str)


@pytest.mark.parametrize("k", [20, 9])
def test_odd_rows(spark, odd_docs, odd_rows, no_docs, k):
    rows = [(i, t) for i, t, _, _ in odd_rows]
    got = debruijn.drop_repeats(odd_docs, k, carry=("lang", "t", "base")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == removed(rows, k)
    assert sorted(str(r.lang) for r in got) == sorted(str(x[2]) for x in odd_rows)
    assert debruijn.drop_repeats(no_docs, k).collect() == []


def test_texts_without_repeats_stay_as_they_are(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, "  a\tb \n" + " ".join(words)), (2, "x  y\nz " + "\n".join(words[:40]) + " end"), (3, None)]
    got = {r.doc_id: r.text for r in debruijn.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), output="text").collect()}
    assert got == {1: rows[0][1], 2: "x  y\nz end", 3: None}


def test_paths_compact_a_passage(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"{' '.join(f'd{i}x{j}' for j in range(30))} {passage} tail{i}") for i in range(5)]
    paths, _ = debruijn.repeated_paths(spark.createDataFrame(rows, "doc_id long, text string"))
    got = paths.collect()
    assert len(got) == 5 and {(r.edges, r.copies, r.start) for r in got} == {(51, 5, 30)}
    assert sum(r.is_source for r in got) == 1 and len({r.source for r in got}) == 1


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 5, 13):
        assert debruijn.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    plans = []

    def staged(df, name, keep=debruijn.staged):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(debruijn, "staged", staged)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"{' '.join(f'd{i}x{j}' for j in range(30))} {passage} tail{i}") for i in range(5)]
    out = debruijn.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    # one sum for each partition is all that may be
    assert len(joins) >= 9 and all("SortMergeJoin" in line or "__part" in line for line in joins)
