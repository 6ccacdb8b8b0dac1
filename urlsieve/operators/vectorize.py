"""Character n-gram TF-IDF and the scaled tabular block.

Term counts are made inside a row, so the only data that grows with urls x grams is
folded by gram on the map side (fit) or stays in its partition (transform).
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlsieve.constants import FEATURE_NAMES
from urlsieve.functions.basic import CHAR_START, as_col

GRAM_SIZES = (3, 4, 5)
VOCABULARY_SIZE = 20_000
MAX_TERMS = 1_000_000

# The same white space as WHITESPACE, as a character class.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def char_ngrams(text: Column | str, sizes: tuple[int, ...] = GRAM_SIZES) -> Column:
    """All n-grams inside words, each word padded with one blank on either side.

    Words are set two blanks apart; a look-ahead then yields every overlapping gram
    that does not reach across such a gap.
    """
    words = F.btrim(F.regexp_replace(F.lower(as_col(text)), _BLANK, "  "), F.lit(" "))
    padded = F.when(F.length(words) > 0, F.concat(F.lit(" "), words, F.lit(" "))).otherwise("")

    def grams(n: int) -> Column:
        pattern = rf"(?s)(?=((?!  ){CHAR_START}{'(?!  ).' * (n - 2)}.))"
        return F.regexp_extract_all(padded, F.lit(pattern), F.lit(1))

    return F.concat(*[grams(n) for n in sizes])


def with_term_counts(df: DataFrame, text: str, out: str = "terms") -> DataFrame:
    """Add array<struct<gram, tf>>: run lengths of the sorted grams."""
    df = df.withColumn("_grams", F.sort_array(char_ngrams(text)))
    n = F.size("_grams")
    starts = F.filter(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (F.get("_grams", i) != F.get("_grams", i - 1)),
    )
    df = df.withColumn("_starts", starts)
    counts = F.transform(
        "_starts",
        lambda at, j: F.struct(
            F.get("_grams", at).alias("gram"),
            (F.coalesce(F.get("_starts", j + 1), n) - at).alias("tf"),
        ),
    )
    return df.withColumn(out, counts).drop("_grams", "_starts")


def term_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, gram, tf) rows.

    The outer form of ``inline`` on purpose: for the inner one the optimiser infers a
    filter on the array and copies the whole expression chain into it.
    """
    columns = list(dict.fromkeys([*keys, text]))
    counted = with_term_counts(df.select(*columns), text)
    return counted.select(*keys, F.inline_outer("terms")).filter(F.col("gram").isNotNull())


def vocabulary(df: DataFrame, text: str = "url", k: int = VOCABULARY_SIZE) -> DataFrame:
    """(gram, idx, cf, df, idf) of the k most frequent grams of the corpus.

    Ties go to the smaller gram; ``idx`` follows gram order; idf = ln((1+N)/(1+df))+1.
    """
    top = (
        term_rows(df, text)
        .groupBy("gram")
        .agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
        .orderBy(F.desc("cf"), "gram")
        .limit(k)
    )
    docs = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.ln((1 + docs) / (1 + F.col("df"))) + 1
    # At most k rows are left, so one task may number them.
    order = F.row_number().over(Window.orderBy("gram")) - 1
    return top.select("gram", order.alias("idx"), "cf", "df", idf.alias("idf"))


def weighted_terms(
    df: DataFrame, key: str, text: str, vocab: DataFrame, k: int = VOCABULARY_SIZE, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per key: sorted ``indices`` and L2-normalised ``values``.

    Weight (1 + ln tf) * idf. Rows are hashed by key *before* they are exploded, rows of
    one key fold to one there, and a broadcast join keeps that partitioning, so regrouping
    needs no second shuffle. The vocabulary has k rows of at most 40 bytes (a gram has up to
    five characters) and k is at most MAX_TERMS. A key without known grams keeps its row.
    ``carry`` columns follow the key.
    """
    if k > MAX_TERMS:
        raise ValueError(f"a vocabulary of {k} grams is too large to broadcast")
    # A given number of partitions: left to itself the engine would merge them by the
    # bytes of the unexploded rows.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(key, F.col(text).alias("_text"), *carry).repartition(parts, key).dropDuplicates([key])
    counted = with_term_counts(texts, "_text")
    terms = counted.select(key, *carry, F.posexplode_outer("terms").alias("_pos", "_term"))
    side = vocab.select("gram", "idx", "idf")
    joined = terms.withColumn("gram", F.col("_term.gram")).join(F.broadcast(side), "gram", "left")
    weight = (1 + F.ln(F.col("_term.tf"))) * F.col("idf")
    known = F.when(F.col("idx").isNotNull(), F.struct("idx", weight.alias("w")))
    # The norm is aggregated here and not folded from the array afterwards: as a
    # projection it would be copied into the division and folded once per element.
    grouped = (
        joined.filter(F.col("idx").isNotNull() | (F.coalesce("_pos", F.lit(0)) == 0))
        .groupBy(key)
        .agg(
            F.sort_array(F.collect_list(known)).alias("_t"),
            F.sum(F.when(F.col("idx").isNotNull(), weight * weight)).alias("_sq"),
            *[F.first(c).alias(c) for c in carry],
        )
    )
    return grouped.select(
        key,
        *carry,
        F.col("_t.idx").alias("indices"),
        F.transform("_t.w", lambda w: w / F.sqrt("_sq")).alias("values"),
    )


def tfidf_weights(weighted: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """The weights as (key, gram, weight) rows."""
    rows = weighted.select(key, F.inline_outer(F.arrays_zip("indices", "values")))
    return rows.toDF(key, "idx", "weight").join(F.broadcast(vocab.select("idx", "gram")), "idx").select(key, "gram", "weight")


def sparse_vector(indices: Column, values: Column, size: int) -> Column:
    """Arrays -> ML sparse vector without leaving the JVM.

    There is no SQL function for sparse vectors; the JSON reader builds one from the
    vector's own four fields.
    """
    schema = T.StructType([T.StructField("v", VectorUDT())])
    fields = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        indices.alias("indices"),
        values.alias("values"),
    )
    return F.from_json(F.to_json(F.struct(fields.alias("v"))), schema)["v"]


def fit_scaler(df: DataFrame, columns: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column: one aggregation, one row back."""
    columns = columns or FEATURE_NAMES
    row = df.agg(
        *[F.avg(n).alias(f"m_{n}") for n in columns],
        *[F.stddev_pop(n).alias(f"s_{n}") for n in columns],
    ).first()
    return {n: (row[f"m_{n}"] or 0.0, row[f"s_{n}"] or 1.0) for n in columns}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardise in place; a constant column keeps scale 1."""
    return df.withColumns(
        {n: (F.col(n) - F.lit(mean)) / F.lit(dev) for n, (mean, dev) in stats.items()}
    )
