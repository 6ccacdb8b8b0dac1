"""The four classifiers over the tabular and n-gram features, and their scores.

All take sparse rows, an array of column numbers and one of values: the n-grams alone, the thirty
features alone, or both side by side. Scores stay keyed by url: nothing relies on the position of a row.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.constants import FEATURE_NAMES
from urlsieve.functions.features import extract_features
from urlsieve.operators.boosting import BoostConfig, Boosted, fit_boosted
from urlsieve.operators.epochs import Fitted, Linear, LinearConfig, NetworkConfig, fit_linear, fit_network
from urlsieve.operators.evaluate import with_blends
from urlsieve.operators.vectorize import VOCABULARY_SIZE, fit_scaler, scale, vocabulary, weighted_terms
from urlsieve.session import materialize, reachable
from urlsieve.sources.master import read_json, write_json


@dataclass(frozen=True)
class ModelConfig:
    """Training parameters; the defaults are the published settings."""

    vocabulary_size: int = VOCABULARY_SIZE
    linear_l2: float = 1e-5
    linear_epochs: int = 30
    linear_tolerance: float = 1e-4
    nn_hidden: int = 256
    nn_epochs: int = 12
    nn_batch: int = 1024
    nn_rate: float = 1e-3
    tree_rounds: int = 450
    tree_rate: float = 0.05
    tree_bins: int = 255
    hybrid_rounds: int = 350
    hybrid_rate: float = 0.08
    hybrid_bins: int = 63
    leaves: int = 63
    leaf_rows: int = 20
    row_share: float = 0.85
    tree_columns: float = 0.85
    hybrid_columns: float = 0.80
    seed: int = 42

    def linear(self) -> LinearConfig:
        return LinearConfig(self.linear_l2, self.linear_epochs, self.linear_tolerance, seed=self.seed)

    def network(self) -> NetworkConfig:
        return NetworkConfig(self.nn_hidden, self.nn_epochs, self.nn_batch, self.nn_rate, seed=self.seed)

    def trees(self) -> BoostConfig:
        return BoostConfig(self.tree_rounds, self.tree_rate, self.leaves, self.tree_bins, self.row_share, self.tree_columns, self.leaf_rows, seed=self.seed)

    def hybrid_trees(self) -> BoostConfig:
        return BoostConfig(self.hybrid_rounds, self.hybrid_rate, self.leaves, self.hybrid_bins, self.row_share, self.hybrid_columns, self.leaf_rows, seed=self.seed)


@dataclass
class Vectorizer:
    """What is learnt from the train rows before any classifier: terms and scales."""

    vocab: DataFrame
    size: int
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)


def fit_vectorizer(train: DataFrame, cfg: ModelConfig) -> Vectorizer:
    """Vocabulary, idf and scaler from the train rows only."""
    vocab = materialize(vocabulary(train, "url", cfg.vocabulary_size), "vocabulary")
    stats = fit_scaler(extract_features(train.select("url"), meta=None))
    return Vectorizer(vocab, vocab.count(), stats)


def vectorize(df: DataFrame, vec: Vectorizer) -> DataFrame:
    """Add ``indices`` and ``values`` of the n-grams, and ``tab``, the 30 scaled features.

    ``url`` is the key; rows of one url fold to one. Its other columns are carried through
    the regrouping of the n-grams, and the features depend on the url alone, so one hash
    exchange is all.
    """
    rest = tuple(c for c in df.columns if c != "url")
    return with_tab(weighted_terms(df, "url", "url", vec.vocab, vec.size, rest), vec.stats)


def with_tab(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Add ``tab``, the 30 scaled features; what follows may ask a model in Python for its score."""
    reachable(df.sparkSession)
    scaled = scale(extract_features(df, meta=None), stats)
    return scaled.select(*df.columns, F.array(*[F.col(n).cast("double") for n in FEATURE_NAMES]).alias("tab"))


def tabular_table(df: DataFrame) -> DataFrame:
    """(url, label, split, tab) of the models that need no n-grams, scaled by the train rows."""
    stats = fit_scaler(extract_features(df.filter(F.col("split") == "train").select("url"), meta=None))
    return materialize(with_tab(df.withColumn("label", F.col("label").cast("double")), stats), "tabular")


def text_row(size: int = 0) -> tuple[Column, Column]:
    """The n-grams of a row, as column numbers and values."""
    return F.col("indices"), F.col("values")


def tab_row(size: int = 0) -> tuple[Column, Column]:
    """The thirty features of a row."""
    return F.expr(f"sequence(0, {len(FEATURE_NAMES) - 1})"), F.col("tab")


def hybrid_row(size: int) -> tuple[Column, Column]:
    """The n-grams of a vocabulary of ``size``, and the thirty features behind them."""
    last = size + len(FEATURE_NAMES) - 1
    return F.expr(f"concat(indices, sequence({size}, {last}))"), F.concat("values", "tab")


def training_rows(table: DataFrame, split: str, row: tuple[Column, Column]) -> DataFrame:
    """``(label, key, indices, values)`` of a split."""
    indices, values = row
    chosen = table.filter(F.col("split") == split)
    return chosen.select("label", F.xxhash64("url").alias("key"), indices.alias("indices"), values.alias("values"))


def fit_text(table: DataFrame, size: int, cfg: ModelConfig) -> Linear:
    return fit_linear(training_rows(table, "train", text_row()), size, cfg.linear())


def fit_neural(table: DataFrame, cfg: ModelConfig) -> Fitted:
    """The state of best validation AUC of all epochs."""
    val = training_rows(table, "val", tab_row())
    return fit_network(training_rows(table, "train", tab_row()), len(FEATURE_NAMES), cfg.network(), val)


def fit_tabular(table: DataFrame, cfg: ModelConfig) -> Boosted:
    return fit_boosted(training_rows(table, "train", tab_row()), len(FEATURE_NAMES), cfg.trees())


def fit_hybrid(table: DataFrame, size: int, cfg: ModelConfig) -> Boosted:
    return fit_boosted(training_rows(table, "train", hybrid_row(size)), size + len(FEATURE_NAMES), cfg.hybrid_trees())


@dataclass
class Models:
    """Everything needed to score a url."""

    vec: Vectorizer
    nlp: Linear
    nn: Fitted
    tree: Boosted
    hyb: Boosted

    def experts(self) -> dict[str, Column]:
        """Probability of the malicious class by each expert, over the columns of ``vectorize``."""
        return {
            "p_nlp": self.nlp.probability(*text_row()),
            "p_nn": self.nn.probability(*tab_row()),
            "p_tree": self.tree.probability(*tab_row()),
            "p_hyb": self.hyb.probability(*hybrid_row(self.vec.size)),
        }


def training_table(df: DataFrame, vec: Vectorizer) -> DataFrame:
    """The vectors of (url, label, split), written once: the fits read it many times."""
    return materialize(vectorize(df.withColumn("label", F.col("label").cast("double")), vec), "vectors")


def fit_models(df: DataFrame, cfg: ModelConfig) -> tuple[Models, DataFrame]:
    """df(url, label, split) -> fitted models and the vectors they were fitted on."""
    vec = fit_vectorizer(df.filter(F.col("split") == "train").select("url"), cfg)
    table = training_table(df.select("url", "label", "split"), vec)
    models = Models(
        vec, fit_text(table, vec.size, cfg), fit_neural(table, cfg), fit_tabular(table, cfg), fit_hybrid(table, vec.size, cfg)
    )
    return models, table


def score_vectors(table: DataFrame, models: Models) -> DataFrame:
    """Add the four expert scores and the two blends; drops the vectors."""
    return with_blends(table.withColumns(models.experts()).drop("tab", "indices", "values"))


def score(df: DataFrame, models: Models) -> DataFrame:
    """Batch scoring of a relation with a unique ``url``."""
    return score_vectors(vectorize(df, models.vec), models)


def scheme_effect(df: DataFrame, label: str, models: Models, p: str = "p_serving") -> DataFrame:
    """``(variant, label, n, mean_p)``: mean score of the urls as they are and behind ``https://``.

    The scheme says nothing of a site, so a gap between the two is what a model has learnt
    from the form of its corpora.
    """
    both = df.select(
        F.col(label), F.explode(F.array(
            F.struct(F.lit("bare").alias("variant"), F.col("url")),
            F.struct(F.lit("https").alias("variant"), F.concat(F.lit("https://"), F.col("url")).alias("url")),
        )).alias("_v"),
    ).select(label, "_v.variant", "_v.url")
    return score(both, models).groupBy("variant", label).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"))


def importances(spark: SparkSession, model: Boosted, kind: str = "split") -> DataFrame:
    """Share of each feature in the number of splits, or with ``gain`` in their gain: percent, 2 decimals."""
    values = model.importance(kind)
    total = float(values.sum()) or 1.0
    rows = [(n, round(float(v) / total * 100, 2)) for n, v in zip(FEATURE_NAMES, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


def save_models(models: Models, path: str, cfg: ModelConfig) -> None:
    """Tables and reports below ``path``: any reader of Parquet and JSON can take the models apart."""
    spark = models.vec.vocab.sparkSession
    models.vec.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    write_json(spark, {"size": models.vec.size, "stats": models.vec.stats}, f"{path}/scaler")
    write_json(spark, json.loads(json.dumps(asdict(cfg))), f"{path}/config")
    save_linear(spark, models.nlp, f"{path}/nlp")
    save_network(spark, models.nn, f"{path}/nn")
    save_trees(spark, models.tree, f"{path}/tree")
    save_trees(spark, models.hyb, f"{path}/hyb")


def save_linear(spark: SparkSession, model: Linear, path: str) -> None:
    rows = [(i, float(w)) for i, w in enumerate(model.weights)]
    spark.createDataFrame(rows, "idx int, weight double").write.mode("overwrite").parquet(f"{path}/weights")
    write_json(spark, {"intercept": model.intercept, "losses": model.losses}, f"{path}/rest")


def read_linear(spark: SparkSession, path: str) -> Linear:
    rest = read_json(spark, f"{path}/rest")
    weights = [r.weight for r in spark.read.parquet(f"{path}/weights").orderBy("idx").collect()]
    return Linear(np.array(weights, float), rest["intercept"], rest["losses"])


def save_network(spark: SparkSession, model: Fitted, path: str) -> None:
    spark.createDataFrame([(model.flat.tolist(),)], "parameters array<double>").write.mode("overwrite").parquet(f"{path}/parameters")
    write_json(spark, {"size": model.size, "config": asdict(model.cfg), "epochs": [list(e) for e in model.epochs]}, f"{path}/rest")


def read_network(spark: SparkSession, path: str) -> Fitted:
    rest = read_json(spark, f"{path}/rest")
    flat = np.array(spark.read.parquet(f"{path}/parameters").first()["parameters"])
    return Fitted(rest["size"], NetworkConfig(**rest["config"]), flat, [tuple(e) for e in rest["epochs"]])


def save_trees(spark: SparkSession, model: Boosted, path: str) -> None:
    model.ledger(spark).write.mode("overwrite").parquet(f"{path}/nodes")
    write_json(spark, {"base": model.base, "columns": model.columns}, f"{path}/rest")


def read_trees(spark: SparkSession, path: str) -> Boosted:
    rest = read_json(spark, f"{path}/rest")
    return Boosted.read(spark.read.parquet(f"{path}/nodes"), rest["base"], rest["columns"])


def load_models(spark: SparkSession, path: str) -> Models:
    saved = read_json(spark, f"{path}/scaler")
    stats = {n: (m, d) for n, (m, d) in saved["stats"].items()}
    vec = Vectorizer(spark.read.parquet(f"{path}/vocabulary"), saved["size"], stats)
    return Models(
        vec, read_linear(spark, f"{path}/nlp"), read_network(spark, f"{path}/nn"), read_trees(spark, f"{path}/tree"), read_trees(spark, f"{path}/hyb")
    )
