"""Queries of the n-gram operators over all distinct page and link urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve.catalog import relations as R
from urlsieve.catalog import sql as S
from urlsieve.operators.vectorize import VOCABULARY_SIZE, term_rows, tfidf_weights, vocabulary, weighted_terms
from urlsieve.session import materialize

TOP = VOCABULARY_SIZE


def char_ngrams(spark, sf):
    return term_rows(R.documents_for_text(spark, sf), "url", "url")


def ngram_vocab_topk(spark, sf):
    vocab = vocabulary(R.documents_for_text(spark, sf), "url", TOP)
    return vocab.select("gram", "idx", "cf", "df", F.bround("idf", 8).alias("idf"))


def tfidf(spark, sf):
    docs = R.documents_for_text(spark, sf)
    vocab = materialize(vocabulary(docs, "url", TOP), "vocabulary")
    weights = tfidf_weights(weighted_terms(docs, "url", "url", vocab, TOP), "url", vocab)
    return weights.withColumn("weight", F.bround("weight", 6))


QUERIES = {"char_ngrams": char_ngrams, "ngram_vocab_topk": ngram_vocab_topk, "tfidf_weights": tfidf}

_VOCAB = f"""{S.TEXT_DOCS},
top AS (SELECT gram, sum(tf)::BIGINT AS cf, count(*) AS df FROM tf GROUP BY gram ORDER BY cf DESC, gram LIMIT {TOP}),
vocab AS (SELECT gram, (row_number() OVER (ORDER BY gram) - 1)::INT AS idx, cf, df,
  ln((1 + (SELECT count(*) FROM docs)) * 1.0::DOUBLE / (1 + df)) + 1 AS idf FROM top)"""

ORACLES = {
    "char_ngrams": f"WITH {S.TEXT_DOCS}\nSELECT url, gram, tf::INT AS tf FROM tf",
    "ngram_vocab_topk": f"WITH {_VOCAB}\nSELECT gram, idx, cf, df, round_even(idf, 8) AS idf FROM vocab",
    "tfidf_weights": f"""WITH {_VOCAB},
w AS (SELECT url, gram, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (gram))
SELECT url, gram, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY url)), 6) AS weight FROM w""",
}
