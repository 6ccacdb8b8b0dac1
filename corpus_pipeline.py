"""A training corpus from ``documents``: five stages, each by one of the operators in ``urlsieve.llm``.

Every stage takes all rows that its predecessor kept and is written before the next one
reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.debruijn import drop_repeats
from urlsieve.llm.mixing import mixed_documents
from urlsieve.llm.piece_bpe import encode_pieces
from urlsieve.llm.simhash import keep_first, simhash_groups
from urlsieve.llm.store import reachable, staged
from urlsieve.llm.toxicity import fit, score


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it is now, columns in their order."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model of the labelled texts does not call toxic, unchanged."""
    reachable(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = score(docs, model, names=("__score", "__predicted", "__passages"))
    return judged.filter("__predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of fingerprints linked at 3 or fewer bits, as in operator 3, unchanged."""
    reachable(spark)
    return keep_first(docs, groups=simhash_groups)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row; words in runs of twenty that stand earlier in the corpus are cut from its text."""
    reachable(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return counted(drop_repeats(docs, carry=others, output="text"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and pass of the mix, its text cut to the blocks that were drawn."""
    reachable(spark)
    return counted(mixed_documents(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of every row."""
    reachable(spark)
    encoded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: fitted models, text fingerprints and a byte-pair vocabulary are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
