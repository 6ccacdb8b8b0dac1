import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from urlsieve.operators import epochs as E
from urlsieve.operators.vectorize import sparse_vector

SCHEMA = "label double, key long, indices array<int>, values array<double>"


def rows_of(seed, n, size=40, noise=0.5):
    """Sparse unit rows whose label hangs on hidden weights."""
    rng = random.Random(seed)
    hidden = [random.Random(1).gauss(0, 2) for _ in range(1)] and [random.Random(c).gauss(0, 2) for c in range(size)]
    rows = []
    for i in range(n):
        at = sorted(rng.sample(range(size), 8))
        x = [rng.random() + 0.1 for _ in at]
        norm = math.sqrt(sum(v * v for v in x))
        z = sum(hidden[c] * v / norm for c, v in zip(at, x, strict=True)) + rng.gauss(0, noise)
        rows.append((float(z > 0), i * 31 + seed, at, [v / norm for v in x]))
    return rows


def log_loss(label, p):
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return float(-np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)))


def scores(df, model):
    got = df.select("label", model.probability(F.col("indices"), F.col("values")).alias("p")).toPandas()
    return got["label"].to_numpy(), got["p"].to_numpy()


@pytest.mark.parametrize("block_rows", [10_000, 400])
def test_linear_comes_near_the_least_loss(spark, block_rows):
    df = spark.createDataFrame(rows_of(3, 1600), SCHEMA).repartition(3)
    model = E.fit_linear(df, 40, E.LinearConfig(l2=1e-4, epochs=30, block_rows=block_rows))
    vectors = df.select("label", sparse_vector(F.col("indices"), F.col("values"), 40).alias("features"))
    exact = LogisticRegression(regParam=1e-4, maxIter=200, tol=1e-9, standardization=False).fit(vectors)
    weights, intercept = exact.coefficients.toArray(), exact.intercept
    arrays = df.select("label", "indices", "values").toPandas()
    z = np.array([weights[i] @ v for i, v in zip(arrays["indices"], arrays["values"], strict=True)]) + intercept
    least = log_loss(arrays["label"].to_numpy(), 1 / (1 + np.exp(-z)))
    assert log_loss(*scores(df, model)) <= least + 0.03


def test_one_task_is_plain_descent(spark):
    """With one block an epoch is the plain loop over rows."""
    rows = rows_of(5, 90)
    cfg = E.LinearConfig(l2=1e-3, epochs=2, block_rows=1000)
    model = E.fit_linear(spark.createDataFrame(rows, SCHEMA), 40, cfg)
    rows.sort(key=lambda r: r[1])
    w, b, t = np.zeros(40), 0.0, 0
    typical = (1 / cfg.l2**0.5) ** 0.5
    t0 = 1 / (typical * cfg.l2)
    seed = int(sum(r[0] for r in rows)) * 1_000_003 + len(rows)
    for epoch in range(2):
        for i in np.random.default_rng([cfg.seed, epoch, seed]).permutation(len(rows)):
            y, _, at, x = rows[i]
            z = sum(w[c] * v for c, v in zip(at, x, strict=True)) + b
            rate = 1 / (cfg.l2 * (t0 + t))
            t += 1
            w *= 1 - rate * cfg.l2
            d = 1 / (1 + math.exp(-z)) - y
            for c, v in zip(at, x, strict=True):
                w[c] -= rate * d * v
            b -= rate * d
    assert model.weights == pytest.approx(w, abs=1e-9) and model.intercept == pytest.approx(b, abs=1e-9)
    assert len(model.losses) == 2 and model.losses[1] < model.losses[0]


def test_linear_stops_when_nothing_is_gained(spark):
    df = spark.createDataFrame(rows_of(6, 60), SCHEMA)
    assert len(E.fit_linear(df, 40, E.LinearConfig(epochs=30, tolerance=10.0, patience=3)).losses) == 4


def test_gradient_is_that_of_the_loss():
    cfg = E.NetworkConfig(hidden=6, drop=0.0)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float)
    net = E.Network(4, cfg)
    flat = net.flat.copy()
    flat += rng.normal(scale=0.1, size=len(flat)) * (flat != 0)

    def loss(values):
        own = E.Network(4, cfg, values.copy())
        z = own.forward(x, np.random.default_rng(0), [])
        return float((np.logaddexp(0, z) - y * z).mean())

    grad, _ = E.Network(4, cfg, flat.copy()).gradient(x, y, np.random.default_rng(0))
    names = np.concatenate([np.full(int(np.prod(s)), i) for i, (_, s) in enumerate(net.shapes)])
    for i, (name, _) in enumerate(net.shapes):
        if name.endswith((".mean", ".var")):
            assert not grad[names == i].any()
            continue
        for k in rng.choice(np.flatnonzero(names == i), 3):
            step = np.zeros(len(flat))
            step[k] = 1e-5
            assert grad[k] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("block_rows", [10_000, 500])
def test_network_keeps_the_best_epoch(spark, block_rows):
    df = spark.createDataFrame(rows_of(8, 1500, 20, 0.2), SCHEMA)
    val = spark.createDataFrame(rows_of(9, 400, 20, 0.2), SCHEMA).cache()
    cfg = E.NetworkConfig(hidden=32, epochs=6, batch=64, rate=3e-3, block_rows=block_rows)
    model = E.fit_network(df, 20, cfg, val)
    aucs = [auc for _, auc in model.epochs]
    assert len(aucs) == 6 and max(aucs) > 0.85
    y, p = scores(val, model)
    pairs = (p[y == 1][:, None] > p[y == 0][None, :]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :]).mean()
    assert round(pairs, 3) == pytest.approx(max(aucs), abs=1e-3)
    again = E.fit_network(df.repartition(4), 20, cfg, val)
    assert again.flat.tolist() == pytest.approx(model.flat.tolist(), abs=1e-9)


def test_network_without_validation_and_odd_tables(spark):
    df = spark.createDataFrame(rows_of(2, 50, 20), SCHEMA)
    cfg = E.NetworkConfig(hidden=8, epochs=2)
    model = E.fit_network(df, 20, cfg, df.filter("label = 1"))
    assert [auc for _, auc in model.epochs] == [0.0, 0.0]
    empty = spark.createDataFrame([], SCHEMA)
    assert E.fit_linear(empty, 3).weights.tolist() == [0.0] * 3
    assert len(E.fit_network(empty, 3, cfg).epochs) == 2
