"""Brand look-alike matching as a row-local expression over the brand list.

The brand list is a Python sequence, so its size is bounded by the caller's code.
Keeping it as an array literal avoids the two shuffles (tokens out, matches back)
of a token join, and with them the skew of tokens that a third of all urls share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.constants import BRANDS, COMMON_TLDS

LENGTH_BAND = 2
NO_CANDIDATE = 10
BROADCAST_ROWS = 100_000
CANDIDATES = "array<struct<idx:int,brand:string>>"


def host_tokens(host: Column) -> Column:
    """Host words of three letters or more, common TLD labels left out."""
    return F.filter(
        F.split(host, r"[-._0-9]+"),
        lambda t: (F.length(t) >= 3) & ~t.isin(COMMON_TLDS),
    )


def _candidates_by_length(brands: Sequence[str]) -> tuple[Column, int]:
    """Brands within the length band, indexed by token length, as one literal.

    Given as SQL text: hundreds of small column objects take seconds to build.
    """
    top = max(len(b) for b in brands) + LENGTH_BAND + 1
    rows = []
    for n in range(top + 1):
        near = [
            f"named_struct('idx', {i}, 'brand', {_quoted(b)})"
            for i, b in enumerate(brands)
            if n >= 3 and abs(len(b) - n) <= LENGTH_BAND
        ]
        rows.append(f"array({', '.join(near)})" if near else f"cast(array() as {CANDIDATES})")
    return F.expr(f"array({', '.join(rows)})"), top


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def best_brand_code(tokens: Column, brands: Sequence[str] = BRANDS) -> Column:
    """distance * len(brands) + brand index of the nearest brand, null without one.

    One integer orders by distance first and by list position second, which is
    cheaper to minimise than a struct.
    """
    table, top = _candidates_by_length(brands)
    base = F.lit(len(brands))

    def nearest(token: Column) -> Column:
        near = F.get(table, F.least(F.length(token), F.lit(top)))
        return F.array_min(
            F.transform(near, lambda b: F.levenshtein(token, b["brand"]) * base + b["idx"])
        )

    return F.array_min(F.transform(tokens, nearest))


def code_distance(code: Column, brands: Sequence[str] = BRANDS) -> Column:
    return F.floor(code / F.lit(len(brands))).cast("int")


def code_brand(code: Column, brands: Sequence[str] = BRANDS) -> Column:
    names = F.expr(f"array({', '.join(_quoted(b) for b in brands)})")
    return F.get(names, (code % F.lit(len(brands))).cast("int"))


def brand_match(
    df: DataFrame, host: str, dist: str = "dist", brand: str = "brand",
    brands: Sequence[str] = BRANDS,
) -> DataFrame:
    """Add the smallest edit distance between host words and brands (10 without a
    candidate) and the brand, or ``None`` beyond distance 2."""
    df = df.withColumn("_code", best_brand_code(host_tokens(F.col(host)), brands))
    d = code_distance(F.col("_code"), brands)
    return df.withColumns(
        {
            dist: F.coalesce(d, F.lit(NO_CANDIDATE)),
            brand: F.when(d <= 2, code_brand(F.col("_code"), brands)).otherwise("None"),
        }
    ).drop("_code")


def deletions(word: Column, most: int = LENGTH_BAND) -> Column:
    """A word and all it becomes when up to ``most`` letters are left out, each once."""
    kept = F.array(word)
    for _ in range(most):
        shorter = F.flatten(F.transform(kept, lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
            lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
        )))
        kept = F.array_distinct(F.concat(kept, shorter))
    return kept


def near_brands(df: DataFrame, key: str, host: str, brands: DataFrame, most: int = LENGTH_BAND) -> DataFrame:
    """``(key, dist, brand, idx)``: the nearest brand of each row whose host has a word within ``most`` edits of one.

    For a brand table ``(idx, brand)`` of any size. Two words within ``most`` edits of each other
    share a word that either becomes by leaving out up to ``most`` letters; so both sides
    list those and meet by equality, and only pairs that share one are measured. Words are
    compared once however many hosts hold them, and joined back by the word. The smaller
    ``idx`` wins ties. Rows without such a word are left out.
    """
    held = df.select(key, F.explode(F.array_distinct(host_tokens(F.col(host)))).alias("_word"))
    # a longer word is further from every brand
    longest = (brands.agg(F.max(F.length("brand"))).first()[0] or 0) + most
    held = held.filter(F.length("_word") <= longest)
    words = held.select("_word").distinct()
    left = words.select("_word", F.explode(deletions(F.col("_word"), most)).alias("_part"))
    right = brands.select("idx", "brand", F.explode(deletions(F.col("brand"), most)).alias("_part"))
    pairs = left.join(right, "_part").select("_word", "idx", "brand").distinct()
    far = F.levenshtein("_word", "brand")
    best = pairs.withColumn("dist", far).filter(F.col("dist") <= most).groupBy("_word").agg(F.min(F.struct("dist", "idx", "brand")).alias("_best"))
    found = held.join(best, "_word").groupBy(key).agg(F.min("_best").alias("_best"))
    return found.select(key, "_best.dist", "_best.brand", "_best.idx")


def brand_exact(df: DataFrame, key: str, host: str, brands: DataFrame) -> DataFrame:
    """Rows (key, brand) whose host holds the brand as a word: a broadcast equi-join.

    ``brands(idx, brand)`` must be a dimension of a few thousand rows at most; its
    size is checked before it is broadcast and a larger one is joined by shuffle.
    """
    size = brands.limit(BROADCAST_ROWS + 1).count()
    side = F.broadcast(brands) if size <= BROADCAST_ROWS else brands
    words = df.select(key, F.explode(F.array_distinct(host_tokens(F.col(host)))).alias("brand"))
    return words.join(side, "brand").select(key, "brand", "idx")


def brand_dim(spark: SparkSession, brands: Sequence[str] = BRANDS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(brands)), "idx int, brand string")
