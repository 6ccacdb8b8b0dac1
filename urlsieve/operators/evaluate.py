"""Exact evaluation of scores: confusion metrics, ROC-AUC, thresholds, blends."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.constants import (
    BLEND_CHAMPION, BLEND_SERVING, DEFAULT_THRESHOLD, MAX_FPR,
)
from urlsieve.functions.basic import as_col, round4, safe_ratio
from urlsieve.session import materialize

# The published grid: 50 floats from 0.30 in steps of 0.01.
THRESHOLDS = [float(t) for t in np.arange(0.30, 0.80, 0.01)]
AUC_BINS = 1024

METRICS = [
    "threshold", "accuracy", "precision", "recall_tpr", "f1_score", "fpr",
    "tp", "fp", "tn", "fn",
]


def predict(p: Column | str, threshold) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (as_col(p) >= t).cast("int")


def verdict(p: Column | str, y: Column | str, threshold) -> Column:
    right = predict(p, threshold) == as_col(y)
    return F.when(right, "ok").otherwise("MISS")


def blend(df: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    terms = [F.lit(w) * F.col(name) for name, w in weights.items()]
    return df.withColumn(out, reduce(lambda a, b: a + b, terms))


def with_blends(df: DataFrame) -> DataFrame:
    """Add the three-expert and the two-expert serving score."""
    return blend(blend(df, BLEND_CHAMPION, "p_moe"), BLEND_SERVING, "p_serving")


def metric_columns(df: DataFrame) -> DataFrame:
    """tp, fp, tn, fn, threshold -> rounded metrics; empty denominators give 0."""
    tp, fp, tn, fn = (F.col(n).cast("double") for n in ("tp", "fp", "tn", "fn"))
    return df.withColumns(
        {
            "threshold": round4(F.col("threshold")),
            "accuracy": round4(safe_ratio(tp + tn, tp + fp + tn + fn)),
            "precision": round4(safe_ratio(tp, tp + fp)),
            "recall_tpr": round4(safe_ratio(tp, tp + fn)),
            "f1_score": round4(safe_ratio(2 * tp, 2 * tp + fp + fn)),
            "fpr": round4(safe_ratio(fp, fp + tn)),
        }
    )


def score_counts(df: DataFrame, y: str, p: str, threshold=DEFAULT_THRESHOLD, by: str | None = None) -> DataFrame:
    """``(_g, _p, _pos, _neg, _cut)``: rows folded to the distinct scores of each group.

    Everything that is asked of scores follows from these counts. They add up, so tables of
    them can be merged; copies of a score fold on the map side. ``threshold`` is a number or a
    column that is constant within a group.
    """
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    group = F.col(by) if by else F.lit(0)
    return df.groupBy(group.alias("_g"), F.col(p).cast("double").alias("_p")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"), F.max(cut).alias("_cut")
    )


def counted_confusion(counts: DataFrame) -> DataFrame:
    """``(_g, METRICS)`` of ``score_counts`` at the cut of each group."""

    def total(name: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(name)).otherwise(F.lit(0)))

    hit = F.col("_p") >= F.col("_cut")
    cells = counts.groupBy("_g").agg(
        F.max("_cut").alias("threshold"),
        total("_pos", hit).alias("tp"),
        total("_neg", hit).alias("fp"),
        total("_neg", ~hit).alias("tn"),
        total("_pos", ~hit).alias("fn"),
    )
    return metric_columns(cells).select("_g", *METRICS)


def confusion(df: DataFrame, y: str, p: str, threshold=DEFAULT_THRESHOLD, by: str | None = None) -> DataFrame:
    """One row of METRICS per group."""
    found = counted_confusion(score_counts(df, y, p, threshold, by))
    return found.withColumnRenamed("_g", by) if by else found.drop("_g")


def count_at_most(bounds: Column, size: int, value: Column) -> Column:
    """How many entries of a sorted array are <= value, by binary search."""
    steps = [1 << b for b in reversed(range(size.bit_length()))]

    def probe(found: Column, step: Column) -> Column:
        fits = F.get(bounds, found + step - 1) <= value
        return F.when(fits, found + step).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), probe)


def counted_area(counts: DataFrame, bins: int = AUC_BINS) -> DataFrame:
    """``(_g, roc_auc)`` of ``score_counts``: exact, tie-aware; 0.0 when a class is missing.

    Approximate quantiles cut the distinct scores into bins of
    even size; a bin ranks its own scores and a running sum over at most ``bins`` rows
    adds what lies below it. Any cut gives the exact area, so the quantiles only
    balance the work.
    """
    marks = [i / bins for i in range(1, bins)]
    bounds = counts.groupBy("_g").agg(F.percentile_approx("_p", marks, 10 * bins).alias("_b"))
    binned = counts.join(F.broadcast(bounds), "_g").withColumn(
        "_bin", count_at_most(F.col("_b"), bins - 1, F.col("_p"))
    )
    below = F.sum("_neg").over(
        Window.partitionBy("_g", "_bin").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    )
    beaten = F.coalesce(below, F.lit(0)) + F.col("_neg") / 2
    cells = (
        binned.select("_g", "_bin", "_pos", "_neg", (F.col("_pos") * beaten).alias("_u"))
        .groupBy("_g", "_bin")
        .agg(F.sum("_u").alias("_u"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    )
    lower = F.sum("_neg").over(
        Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    )
    area = cells.withColumn("_low", F.coalesce(lower, F.lit(0)).cast("double")).groupBy("_g").agg(
        F.sum(F.col("_u") + F.col("_pos") * F.col("_low")).alias("_u"),
        (F.sum("_pos").cast("double") * F.sum("_neg").cast("double")).alias("_pairs"),
    )
    return area.select("_g", round4(safe_ratio(F.col("_u"), F.col("_pairs"))).alias("roc_auc"))


def roc_auc(df: DataFrame, y: str, p: str, by: str | None = None, bins: int = AUC_BINS) -> DataFrame:
    """Exact, tie-aware area under the ROC curve per group."""
    found = counted_area(score_counts(df, y, p, by=by), bins)
    return found.withColumnRenamed("_g", by) if by else found.drop("_g")


def evaluate(df: DataFrame, y: str, p: str, threshold=DEFAULT_THRESHOLD, by: str | None = None) -> DataFrame:
    """Confusion metrics and ROC-AUC per group, both from one written table of counts."""
    counts = materialize(score_counts(df, y, p, threshold, by), "score-counts")
    found = counted_confusion(counts).join(counted_area(counts), "_g")
    return found.withColumnRenamed("_g", by) if by else found.drop("_g")


def threshold_sweep(df: DataFrame, y: str, p: str, by: str | None = None, grid: list[float] | None = None) -> DataFrame:
    """Metrics at every threshold of a sorted grid, from one pass over the scores.

    A row only counts how many thresholds it passes; the sweep works on that
    histogram, whose size is the grid's.
    """
    grid = grid or THRESHOLDS
    keys = [by] if by else []
    passed = count_at_most(F.array(*[F.lit(t) for t in grid]), len(grid), F.col(p))
    histogram = (
        df.select(*keys, passed.alias("_k"), F.col(y).alias("_y"))
        .groupBy(*keys, "_k")
        .agg(F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") == 0).alias("_neg"))
    )
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    cells = histogram.select("*", F.inline(steps))
    hit = F.col("_k") > F.col("step")

    def total(name: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(name)).otherwise(F.lit(0)))

    counts = cells.groupBy(*keys, "step", "threshold").agg(
        total("_pos", hit).alias("tp"),
        total("_neg", hit).alias("fp"),
        total("_neg", ~hit).alias("tn"),
        total("_pos", ~hit).alias("fn"),
    )
    return metric_columns(counts).select(*keys, "step", *METRICS)


def tune_threshold(df: DataFrame, y: str, p: str, max_fpr: float = MAX_FPR, by: str | None = None) -> DataFrame:
    """The lowest threshold of highest F1 under the false positive ceiling, rounded to
    2 decimals; 0.50 where none qualifies. Compares the rounded metrics."""
    grid = sorted([*THRESHOLDS, DEFAULT_THRESHOLD])
    default = grid.index(DEFAULT_THRESHOLD)
    sweep = threshold_sweep(df, y, p, by, grid)
    keys = [by] if by else []
    on_grid = F.col("step") != default
    fits = on_grid & (F.col("fpr") <= max_fpr) & (F.col("f1_score") > 0)
    row = F.struct(*METRICS)
    best = sweep.groupBy(*keys).agg(
        F.max_by(row, F.when(fits, F.struct("f1_score", -F.col("step")))).alias("_best"),
        F.max_by(row, F.when(~on_grid, F.lit(1))).alias("_default"),
    )
    picked = best.select(*keys, F.coalesce("_best", "_default").alias("_m"))
    names = [n for n in METRICS if n != "threshold"]
    return picked.select(
        *keys,
        F.bround(F.col("_m.threshold"), 2).alias("threshold"),
        *[F.col(f"_m.{n}").alias(n) for n in names],
    )


def mean_score_by_class(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("label")).agg(round4(F.avg(p)).alias("mean_p"))


def long_scores(df: DataFrame, y: str, models: dict[str, str]) -> DataFrame:
    """One row per input row and model: (model, y, p)."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in models.items()])
    return df.select(F.col(y).alias("y"), F.inline(rows))


def eval_table(df: DataFrame, y: str, models: dict[str, tuple[str, float]]) -> DataFrame:
    """Metrics per model; ``models`` maps a name to (score column, threshold)."""
    scores = long_scores(df, y, {m: c for m, (c, _) in models.items()})
    cut = reduce(
        lambda acc, m: acc.when(F.col("model") == m, F.lit(float(models[m][1]))), models, F
    )
    return evaluate(scores.withColumn("_cut", cut), "y", "p", F.col("_cut"), "model")


def metrics_long(table: DataFrame) -> DataFrame:
    """(model, metric, percent) rows of the three charted metrics."""
    names = ["accuracy", "f1_score", "roc_auc"]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), F.bround(F.col(n) * 100, 2).alias("percent"))
            for n in names
        ]
    )
    return table.select("model", F.inline(rows))
