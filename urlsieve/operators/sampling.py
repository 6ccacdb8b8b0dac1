"""Exact, repeatable samples and orders by hash.

Order by md5 of a unique key is a random order any engine can repeat. The k-th
smallest hash is found from a histogram of hash prefixes, so neither a stratum nor the
whole table is ever sorted in one task; the sample is then a plain filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.session import materialize

PREFIX_DIGITS = 4


def row_hash(seed, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)))


def prefix_histogram(df: DataFrame, strata: list[str]) -> DataFrame:
    """Rows per stratum and hash prefix: at most 65,536 rows per stratum."""
    prefix = F.substring("_h", 1, PREFIX_DIGITS).alias("_prefix")
    return df.groupBy(*strata, prefix).agg(F.count(F.lit(1)).alias("_n"))


def hash_cutoffs(df: DataFrame, histogram: DataFrame, quotas: DataFrame, strata: list[str]) -> DataFrame:
    """(strata, _cut): the ``_k``-th smallest hash of each stratum.

    ``quotas(strata, _k)`` has a few rows per stratum, each of which gets its cut. Only
    the rows that share the prefix in which the k-th one falls are ranked, about 1 in
    65,536 of a stratum.
    """
    running = Window.partitionBy(*strata).orderBy("_prefix")
    cell = (
        histogram.withColumn("_cum", F.sum("_n").over(running))
        .join(quotas, strata)
        .filter((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_n") < F.col("_k")))
        .select(*strata, "_k", "_prefix", (F.col("_k") - F.col("_cum") + F.col("_n")).alias("_need"))
    )
    ranked = Window.partitionBy(*strata, "_k", "_prefix").orderBy("_h")
    return (
        df.select(*strata, "_h", F.substring("_h", 1, PREFIX_DIGITS).alias("_prefix"))
        .join(cell, [*strata, "_prefix"])
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") == F.col("_need"))
        .select(*strata, "_k", F.col("_h").alias("_cut"))
    )


def stratified_sample(df: DataFrame, n: int, label: str = "label", key: str = "url", seed=42) -> DataFrame:
    """round(n / rows * rows of the label) rows per label; everything if n covers it.

    ``key`` must be unique, as ``url`` is in the master table; ``label`` has a handful
    of values, which bounds the broadcast tables.
    """
    # the keyed hashes are written once: counted, ranked and joined back from the copy
    hashed = materialize(df.withColumn("_h", row_hash(seed, key)), "sample")
    histogram = prefix_histogram(hashed, [label])
    sizes = histogram.groupBy(label).agg(F.sum("_n").alias("_rows"))
    total = F.sum("_rows").over(Window.partitionBy())
    quota = F.bround(F.lit(float(n)) / total * F.col("_rows"), 0).cast("bigint")
    quotas = sizes.select(label, F.when(total <= n, F.col("_rows")).otherwise(quota).alias("_k"))
    cuts = hash_cutoffs(hashed, histogram, quotas, [label])
    return (
        hashed.join(cuts, label)
        .filter(F.col("_h") <= F.col("_cut"))
        .select(*df.columns)
    )


def kth_hashes(hashes: DataFrame, ks: list[int]) -> list[str | None]:
    """The k-th smallest of the distinct hashes ``_h`` for every k, in one job (None for k = 0)."""
    hashed = hashes.select(F.lit(0).alias("_all"), "_h")
    wanted = F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))])).alias("_k")
    quotas = hashes.sparkSession.range(1).select(F.lit(0).alias("_all"), wanted).filter("_k > 0")
    cuts = hash_cutoffs(hashed, prefix_histogram(hashed, ["_all"]), quotas, ["_all"])
    found = {r["_k"]: r["_cut"] for r in cuts.collect()}
    return [found.get(k) for k in ks]


def seeded_order(df: DataFrame, key: str = "url", seed=42) -> DataFrame:
    """A repeatable shuffle, as a range-partitioned sort for ordered exports."""
    return df.withColumn("_h", row_hash(seed, key)).orderBy("_h", key).drop("_h")


def numbered_order(df: DataFrame, key: str = "url", seed=42, out: str = "position") -> DataFrame:
    """The same order with the number of every row in it, from 0.

    Range partitions are written with a number of their own for each row; one count per
    partition then says where it begins. No task sees more than its partition.
    """
    ranged = df.withColumn("_h", row_hash(seed, key)).repartitionByRange("_h", key).sortWithinPartitions("_h", key)
    # the high bits are the partition, the low 33 bits the place in it
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).cast("int")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of the write
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, (F.col("_start") + place).alias(out))


def first_of_order(df: DataFrame, n: int, key: str = "url", seed=42) -> DataFrame:
    """``n`` rows in random order as a cut of it; all if there are no more."""
    return numbered_order(df, key, seed, "_position").filter(F.col("_position") < n).drop("_position")


def keep_first(df: DataFrame, key: str, priority: str) -> DataFrame:
    """One row per key, the one of lowest priority.

    An aggregation and not a window: copies of a hot key fold on the map side.
    """
    rest = [n for n in df.columns if n != key]
    first = F.min_by(F.struct(*rest), F.col(priority)).alias("_row")
    return df.groupBy(key).agg(first).select(key, *[F.col(f"_row.{n}") for n in rest])
