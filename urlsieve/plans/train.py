"""Job: master table -> split, models, thresholds, evaluation and reports."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.constants import (
    BARE_DOMAIN_FRACTION, BLEND_CHAMPION, BLEND_SERVING, DEFAULT_THRESHOLD, FEATURE_NAMES,
    NORMALIZATION_VERSION, SMOKE_URLS,
)
from urlsieve.functions.urls import normalize_url
from urlsieve.operators.consolidate import harmonize_rows
from urlsieve.operators.evaluate import (
    eval_table, evaluate, mean_score_by_class, metrics_long, tune_threshold, verdict,
)
from urlsieve.operators.models import (
    ModelConfig, Models, fit_models, importances, save_models, score, score_vectors,
)
from urlsieve.operators.sampling import stratified_sample
from urlsieve.operators.split import (
    augment_bare_domains, group_split, group_split_exact, split_counts, split_leakage,
)
from urlsieve.session import materialize
from urlsieve.sources.corpora import SourceSpec, path_exists, read_corpora
from urlsieve.sources.master import MANIFEST, read_master, write_json

MODEL_SCORES = {
    "nlp": "p_nlp", "nn": "p_nn", "tree": "p_tree", "hybrid": "p_hyb",
    "champion": "p_moe", "serving": "p_serving",
}


def prepare_splits(df: DataFrame, exact: bool = True, fraction: float = BARE_DOMAIN_FRACTION) -> DataFrame:
    """Domain-disjoint split and the augmentation of its train side."""
    split = group_split_exact(df) if exact else group_split(df)
    return augment_bare_domains(split, fraction) if fraction > 0 else split


def smoke_relation(spark: SparkSession) -> DataFrame:
    """The hand-labelled urls: raw ``shown``, normalised ``url`` and ``label``."""
    rows = spark.createDataFrame(SMOKE_URLS, "shown string, label int")
    return rows.withColumn("url", normalize_url("shown"))


def smoke_scores(spark: SparkSession, models: Models) -> DataFrame:
    return score(smoke_relation(spark), models)


def smoke_verdicts(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        F.col("shown").alias("url"),
        F.when(F.col("label") == 1, "MAL").otherwise("BEN").alias("truth"),
        F.round("p_serving", 3).alias("p"),
        verdict("p_serving", "label", threshold).alias("verdict"),
    )


def training_rows(spark: SparkSession, master: str | None, specs: Sequence[SourceSpec] = ()) -> DataFrame:
    """url, label, group of the written master, or of the raw corpora where there is none."""
    if master and path_exists(spark, f"{master}/{MANIFEST}"):
        return read_master(spark, master)
    return harmonize_rows(read_corpora(spark, specs)[0])


def _records(df: DataFrame, key: str) -> dict:
    """A report table of a few rows as a dict."""
    return {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}


def train(
    spark: SparkSession, master: DataFrame, out: str, cfg: ModelConfig | None = None,
    max_samples: int = 0,
) -> dict:
    """Run the whole training job and write models and reports below ``out``."""
    cfg = cfg or ModelConfig()
    started = time.time()
    if max_samples:
        master = stratified_sample(master, max_samples)
    data = materialize(prepare_splits(master), "splits")
    leaked = split_leakage(data).first()["overlap"]
    if leaked:
        raise ValueError(f"{leaked} domains lie in both train and test")
    models, vectors = fit_models(data, cfg)
    scored = materialize(score_vectors(vectors, models), "scores")
    val = scored.filter(F.col("split") == "val")
    test = scored.filter(F.col("split") == "test")
    tuned = {
        name: tune_threshold(val, "label", MODEL_SCORES[name]).first()["threshold"]
        for name in ("champion", "serving")
    }
    cuts = {n: (c, tuned.get(n, DEFAULT_THRESHOLD)) for n, c in MODEL_SCORES.items()}
    validation = materialize(eval_table(val, "label", cuts), "validation")
    table = materialize(eval_table(test, "label", cuts), "evaluation")
    smoke = materialize(smoke_scores(spark, models), "smoke")
    smoke_metrics = evaluate(smoke, "label", "p_serving", tuned["serving"]).first().asDict()
    weights = importances(spark, models.tree)
    now = time.strftime("%Y-%m-%d %H:%M:%S")
    report = {
        "updated_at": now,
        "validation": _records(validation, "model"),
        "test_set_size": test.count(),
        "split_strategy": "registered domain, no host shared across splits",
        "url_normalization": NORMALIZATION_VERSION,
        "optimal_threshold": tuned["champion"],
        "serving_threshold": tuned["serving"],
        "models": _records(table, "model"),
        "percent": [r.asDict() for r in metrics_long(table).collect()],
        "out_of_corpus_smoke": smoke_metrics,
        "smoke_mean_p": {
            str(r["label"]): r["mean_p"]
            for r in mean_score_by_class(smoke, "label", "p_serving").collect()
        },
        "feature_importances": {r["feature"]: r["importance"] for r in weights.collect()},
        "split_counts": [r.asDict() for r in split_counts(data).collect()],
    }
    save_models(models, f"{out}/models", cfg)
    write_json(spark, report, f"{out}/test_evaluation_report")
    write_json(
        spark,
        {
            "optimal_threshold": tuned["champion"], "weights": BLEND_CHAMPION,
            "serving_threshold": tuned["serving"], "serving_weights": BLEND_SERVING,
            "url_normalization": NORMALIZATION_VERSION,
        },
        f"{out}/threshold_config",
    )
    write_json(
        spark,
        {
            "created_at": now,
            "artifacts": [f"models/{n}" for n in ("nlp", "nn", "tree", "hyb", "vocabulary", "scaler", "config")]
            + ["test_evaluation_report", "threshold_config", "evaluation_metrics", "smoke_verdicts"],
            "url_normalization": NORMALIZATION_VERSION,
            "split_strategy": "group-by-registered-domain",
            "bare_domain_augment_fraction": BARE_DOMAIN_FRACTION,
            "feature_names": FEATURE_NAMES,
            "n_features_tabular": len(FEATURE_NAMES),
            "n_features_tfidf": models.vec.size,
            "n_features_hybrid": models.vec.size + len(FEATURE_NAMES),
            "train_seconds": round(time.time() - started, 2),
        },
        f"{out}/run_manifest",
    )
    smoke_verdicts(smoke, tuned["serving"]).write.mode("overwrite").parquet(f"{out}/smoke_verdicts")
    write_json(
        spark,
        {k: report[k] for k in ("updated_at", "models", "validation", "out_of_corpus_smoke", "feature_importances")},
        f"{out}/evaluation_metrics",
    )
    return report
