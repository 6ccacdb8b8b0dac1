import random

import numpy as np
import pytest

from urlsieve.operators import evaluate as ev


def brute_metrics(ys, ps, t):
    tp = sum(p >= t and y for y, p in zip(ys, ps))
    fp = sum(p >= t and not y for y, p in zip(ys, ps))
    fn, tn = sum(ys) - tp, len(ys) - sum(ys) - fp

    def div(a, b):
        return round(a / b, 4) if b else 0.0

    pairs = [(a > b) + 0.5 * (a == b) for a, y in zip(ps, ys) if y for b, z in zip(ps, ys) if not z]
    return {
        "threshold": round(float(t), 4), "accuracy": div(tp + tn, len(ys)), "precision": div(tp, tp + fp),
        "recall_tpr": div(tp, tp + fn), "f1_score": div(2 * tp, 2 * tp + fp + fn), "fpr": div(fp, fp + tn),
        "tp": tp, "fp": fp, "tn": tn, "fn": fn, "roc_auc": div(sum(pairs), len(pairs)),
    }


def brute_tune(ys, ps, ceiling=0.015):
    """The best F1 of the cuts within the ceiling, the first of equals; 0.5 where none has any."""
    every = [brute_metrics(ys, ps, cut) for cut in ev.THRESHOLDS]
    allowed = [(-m["f1_score"], place) for place, m in enumerate(every) if m["fpr"] <= ceiling and m["f1_score"]]
    if not allowed:
        return 0.5, brute_metrics(ys, ps, 0.5)
    place = min(allowed)[1]
    return round(ev.THRESHOLDS[place], 2), every[place]


CASES = {
    "spread": lambda r: (r.random() < 0.4, r.random()),
    "ties": lambda r: (r.random() < 0.4, r.choice([0.1, 0.3, 0.31, 0.5, 0.79, 0.9])),
    "one class": lambda r: (False, r.random()),
    "hopeless": lambda r: (True, 0.1) if r.random() < 0.5 else (False, 0.95),
    "crowded": lambda r: (lambda y: (y, (1 - 1e-9 * r.random()) if y else 1 - 2e-9 * r.random()))(r.random() < 0.5),
    "good": lambda r: (lambda y: (y, 0.4 * r.random() + 0.5 * y))(r.random() < 0.3),
}


def table(spark, name, n=400):
    rnd = random.Random(name)
    rows = [(int(y), float(p)) for y, p in (CASES[name](rnd) for _ in range(n))]
    return [y for y, _ in rows], [p for _, p in rows], spark.createDataFrame(rows, "y int, p double")


@pytest.mark.parametrize("name", list(CASES))
def test_evaluate(spark, name):
    ys, ps, df = table(spark, name)
    want = brute_metrics(ys, ps, 0.5)
    assert ev.evaluate(df, "y", "p").first().asDict() == pytest.approx(want, abs=1.01e-4)


@pytest.mark.parametrize("name", list(CASES))
def test_tune(spark, name):
    ys, ps, df = table(spark, name)
    t, m = brute_tune(ys, ps)
    got = ev.tune_threshold(df, "y", "p").first().asDict()
    assert got.pop("threshold") == t
    assert got == pytest.approx({k: m[k] for k in got}, abs=1.01e-4)


@pytest.mark.parametrize("bins", [2, 7, 64])
def test_auc_does_not_depend_on_bins(spark, bins):
    ys, ps, df = table(spark, "ties")
    assert ev.roc_auc(df, "y", "p", bins=bins).first().roc_auc == pytest.approx(
        brute_metrics(ys, ps, 0.5)["roc_auc"], abs=1.01e-4
    )


def test_auc_survives_one_hot_score(spark):
    rows = [(i % 2, 0.5) for i in range(3000)] + [(1, 0.9), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos = neg = 1501
    area = (1500 * (1 + 1500 / 2) + neg) / (pos * neg)
    assert ev.roc_auc(df, "y", "p").first().roc_auc == round(area, 4)


def test_count_at_most(spark):
    from pyspark.sql import functions as F

    bounds = [0.1, 0.2, 0.2, 0.5, 0.9]
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.2, 0.3, 0.9, 1.0)], "p double")
    col = ev.count_at_most(F.array(*[F.lit(b) for b in bounds]), 5, F.col("p"))
    assert [r.n for r in df.select(col.alias("n")).collect()] == [0, 1, 3, 3, 5, 5]


def test_grid_is_the_published_one():
    assert len(ev.THRESHOLDS) == 50 and ev.THRESHOLDS == list(np.arange(0.30, 0.80, 0.01))


def test_an_evaluation_scans_the_scores_once(spark):
    rows = [(i % 2, (i * 37 % 100) / 100, i) for i in range(200)]
    df = spark.createDataFrame(rows, "y int, a double, n int").selectExpr("y", "a", "1 - a AS b")
    counts = ev.score_counts(ev.long_scores(df, "y", {"one": "a", "two": "b"}), "y", "p", by="model")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan ExistingRDD") == 1
    table = ev.eval_table(df, "y", {"one": ("a", 0.5), "two": ("b", 0.3)})
    plan = table._jdf.queryExecution().executedPlan().toString()
    # both parts read the written counts, none the rows
    assert "ExistingRDD" not in plan and plan.count("FileScan parquet") == 3
    got = {r.model: r.asDict() for r in table.collect()}
    for model, column, cut in (("one", 1, 0.5), ("two", None, 0.3)):
        want = brute_metrics([r[0] for r in rows], [r[1] if column else 1 - r[1] for r in rows], cut)
        assert {k: got[model][k] for k in want} == pytest.approx(want, abs=1e-4)
