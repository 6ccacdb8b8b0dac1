"""The numbered queries, each a thin digest of its operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm import brown, filter_audit, multi_index
from urlsieve.llm.bitplanes import document_digests, write_planes
from urlsieve.llm.debruijn import drop_repeats
from urlsieve.llm.hnsw import nearest
from urlsieve.llm.mixing import taken_words
from urlsieve.llm.outliers import STATS, judge
from urlsieve.llm.piece_bpe import encode_pieces
from urlsieve.llm.randomness import BASE, count_of, find_secrets, joined
from urlsieve.llm.ring import shard_documents
from urlsieve.llm.simhash import simhash_components
from urlsieve.llm.store import fold_of, reachable, scratch
from urlsieve.llm.toxicity import fit, score


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold_of("doc_id", 5) == 1
    scored = brown.train_and_score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


def op2_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "bitplanes")
    write_planes(documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"))
    return document_digests(spark, out)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = fold_of("doc_id", 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op5_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop(*STATS)


def op6_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op7_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir), output="digest")


def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(documents(spark, sf_dir))


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count_of(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.hard_negatives(vectors.withColumn("label", moved))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_brown": op1_brown,
    "op2_bitplanes": op2_bitplanes,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_mcd": op5_mcd,
    "op6_ring": op6_ring,
    "op7_debruijn": op7_debruijn,
    "op8_piece_bpe": op8_piece_bpe,
    "op9_mixing": op9_mixing,
    "op10_hnsw": op10_hnsw,
    "op11_randomness": op11_randomness,
    "op12_multi_index": op12_multi_index,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op12_multi_index": multi_index.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
