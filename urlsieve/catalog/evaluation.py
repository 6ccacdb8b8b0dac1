"""Queries of the evaluation operators over scores made from the labels table."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve.catalog import relations as R
from urlsieve.catalog import sql as S
from urlsieve.constants import MAX_FPR
from urlsieve.operators import evaluate as ev
from urlsieve.plans.train import MODEL_SCORES

# Name -> (score column, threshold): four experts at 0.50, both blends at given cuts.
CUTS = {m: (c, {"champion": 0.53, "serving": 0.55}.get(m, 0.50)) for m, c in MODEL_SCORES.items()}


def blended(spark, sf):
    return ev.with_blends(R.scores(spark, sf))


def long(spark, sf):
    return ev.long_scores(blended(spark, sf), "y", MODEL_SCORES)


def eval_table(spark, sf):
    return ev.eval_table(blended(spark, sf), "y", CUTS)


def score_verdicts(spark, sf):
    df = blended(spark, sf)
    return df.select(
        "doc_id", ev.predict("p_serving", 0.55).alias("predicted"),
        F.when(F.col("y") == 1, "MAL").otherwise("BEN").alias("truth"),
        ev.verdict("p_serving", "y", 0.55).alias("verdict"),
    )


def blend_scores(spark, sf):
    df = blended(spark, sf)
    return df.select("doc_id", "y", F.bround("p_moe", 8).alias("p_moe"), F.bround("p_serving", 8).alias("p_serving"))


def mean_p_by_class(spark, sf):
    return ev.mean_score_by_class(blended(spark, sf), "y", "p_serving")


QUERIES = {
    "blend_scores": blend_scores,
    "score_verdicts": score_verdicts,
    "eval_metrics": lambda s, sf: ev.confusion(long(s, sf), "y", "p", 0.5, "model"),
    "roc_auc": lambda s, sf: ev.roc_auc(long(s, sf), "y", "p", "model"),
    "eval_table": eval_table,
    "metric_long": lambda s, sf: ev.metrics_long(eval_table(s, sf)),
    "mean_p_by_class": mean_p_by_class,
    "threshold_sweep": lambda s, sf: ev.threshold_sweep(long(s, sf), "y", "p", "model"),
    "best_threshold": lambda s, sf: ev.tune_threshold(long(s, sf), "y", "p", MAX_FPR, "model"),
}

_CUT = "CASE model " + " ".join(f"WHEN '{m}' THEN {t}" for m, (_, t) in CUTS.items()) + " END::DOUBLE"
_EVAL = f"""{S.LONG_SCORES},
{S.AUC},
cnt AS ({S.counts('lng', _CUT, 'model')}),
met AS (SELECT model, {S.METRIC_SELECT} FROM cnt),
evt AS (SELECT met.*, roc_auc FROM met JOIN auc USING (model))"""
_SWEEP = f"""{S.LONG_SCORES},
{S.GRID},
g2 AS (SELECT * FROM grid UNION ALL SELECT -1, 0.5::DOUBLE),
cells AS (SELECT model, step, t, y, p FROM lng, g2),
cnt AS ({S.counts('cells', 't', 'model, step')}),
met AS (SELECT model, step, {S.METRIC_SELECT} FROM cnt)"""
_NAMES = 'accuracy, "precision", recall_tpr, f1_score, fpr, tp, fp, tn, fn'

ORACLES = {
    "blend_scores": f"WITH {S.SCORES}\nSELECT doc_id, y, round_even(p_moe, 8) AS p_moe, "
    "round_even(p_serving, 8) AS p_serving FROM blended",
    "score_verdicts": f"WITH {S.SCORES}\nSELECT doc_id, CAST(p_serving >= 0.55::DOUBLE AS INT) AS predicted, "
    "CASE WHEN y = 1 THEN 'MAL' ELSE 'BEN' END AS truth, "
    "CASE WHEN (p_serving >= 0.55::DOUBLE) = (y = 1) THEN 'ok' ELSE 'MISS' END AS verdict FROM blended",
    "eval_metrics": f"WITH {S.LONG_SCORES},\ncnt AS ({S.counts('lng', '0.5::DOUBLE', 'model')})\n"
    f"SELECT model, {S.METRIC_SELECT} FROM cnt",
    "roc_auc": f"WITH {S.LONG_SCORES},\n{S.AUC}\nSELECT model, roc_auc FROM auc",
    "eval_table": f"WITH {_EVAL}\nSELECT * FROM evt",
    "metric_long": f"WITH {_EVAL}\n"
    + "\nUNION ALL ".join(
        f"SELECT model, '{m}' AS metric, round_even({m} * 100, 2) AS percent FROM evt"
        for m in ("accuracy", "f1_score", "roc_auc")
    ),
    "mean_p_by_class": f"WITH {S.SCORES}\nSELECT y AS label, round_even(avg(p_serving), 4) AS mean_p "
    "FROM blended GROUP BY y",
    "threshold_sweep": f"WITH {_SWEEP}\nSELECT * FROM met WHERE step >= 0",
    "best_threshold": f"""WITH {_SWEEP},
ok AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1_score DESC, step) AS r FROM met
  WHERE step >= 0 AND fpr <= {MAX_FPR} AND f1_score > 0),
pick AS (SELECT * EXCLUDE (r) FROM ok WHERE r = 1
  UNION ALL SELECT * FROM met WHERE step = -1 AND model NOT IN (SELECT model FROM ok))
SELECT model, round_even(threshold, 2) AS threshold, {_NAMES} FROM pick""",
}
