"""Operator 13: how five quality filters interact, by a recursive walk over their orders.

Every document gets a mask of the filters it fails. Documents of a part with the same mask
behave alike under every order, so the whole table folds to at most 32 cells a part, each with
its documents, good ones and toxic ones. A recursive query extends prefixes of an order by
every letter not yet used, joins the cells of the part and carries the bits applied so far;
each level emits the metrics of the step it adds. The 120 orders then look their prefixes up.

A row fails ``E`` if an equal text stands under a smaller id. No join goes by text: of all
ids of a text's digest (SHA-256) only the smallest is kept, and rows find it by digest *and* id.
Rows fold by id before they meet the labels, so neither copies nor a frequent id gather.

A null text is empty, a null language is the empty string. A null id is never larger than
another one, so its row cannot fail ``E``, has no label and counts like any other. Repeated
rows count each; equal ids with equal texts are no copies of each other. An id with several
labels is good, or toxic, if one of them says so. Texts of any length are judged whole. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlsieve.llm.store import staged

LETTERS = "ABCDE"
LIMIT = "spark.sql.cteRecursionRowLimit"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


@contextmanager
def recursion_unlimited(spark: SparkSession):
    """The recursion here ends by itself; its rows are 326 a part."""
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(LIMIT, before)


def text_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails A, B, C and D; ``words`` is the array of its words."""
    n_words = F.size(words)
    return [
        n_words < 100,
        100 * F.size(F.array_distinct(words)) < 80 * n_words,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def judged(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, digest, mask)`` of every row, its bits A to D."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    mask = F.lit(0)
    for i, fails in enumerate(text_failures(F.col("text"), F.col("words"))):
        mask = mask + F.when(fails, F.lit(1 << i)).otherwise(0)
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, cells array<struct<mask, n, good, toxic>>)``: the table folded by failures."""
    rows = staged(judged(docs), "filter-masks")
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    found = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marked = found.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.when(F.col("first") | F.col("doc_id").isNull(), 0).otherwise(1 << LETTERS.index("E"))
    folded = marked.select("doc_id", "part", (F.col("mask") + copy).alias("mask"), "n")
    folded = folded.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))]
    )
    flag = {c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))) for c in ("good", "toxic")}
    cells = folded.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *[f.alias(c) for c, f in flag.items()])
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _total(condition: str, field: str = "n") -> str:
    """SQL: the sum of ``field`` over the part's cells that fulfil a condition on ``x.mask``."""
    return f"aggregate(filter(c.cells, x -> {condition}), 0L, (total, x) -> total + x.{field})"


def walk(cells: DataFrame) -> DataFrame:
    """``(part, prefix, step, applied, metrics)``: a row for each prefix of an order, the empty one included.

    The last letter of ``prefix`` is the step's filter; ``applied`` has the bits of all of them.
    """
    bit = "shiftleft(1, i)"
    gone = f"(x.mask & w.applied) = 0 AND (x.mask & {bit}) != 0"
    step = {
        "kept": _total(f"(x.mask & (w.applied | {bit})) = 0"),
        "removed": _total(gone),
        "redundant": _total(f"(x.mask & w.applied) != 0 AND (x.mask & {bit}) != 0"),
        "unique_fails": _total(f"x.mask = {bit}"),
        "good_lost": _total(gone, "good"),
        "toxic_lost": _total(gone, "toxic"),
    }
    query = f"""
        WITH RECURSIVE walk(part, prefix, step, applied, {", ".join(step)}) AS (
            SELECT part, CAST('' AS STRING), 0, 0, {", ".join(["0L"] * len(step))} FROM {{cells}}
            UNION ALL
            SELECT w.part, concat(w.prefix, substr('{LETTERS}', i + 1, 1)), w.step + 1, w.applied | {bit}, {", ".join(step.values())}
            FROM walk w JOIN {{cells}} c ON c.part = w.part
            LATERAL VIEW explode(filter(sequence(0, {len(LETTERS) - 1}), j -> (w.applied & shiftleft(1, j)) = 0)) unused AS i
        )
        SELECT * FROM walk"""
    return cells.sparkSession.sql(query, cells=cells)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, metrics, shapley)`` of every order and step, zeros included."""
    spark = docs.sparkSession
    cells = staged(mask_cells(docs, labels), "filter-cells")
    with recursion_unlimited(spark):
        steps = staged(walk(cells), "filter-walk")
    orders = steps.filter(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    orders = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    orders = orders.withColumn("prefix", F.expr("left(filter_order, step)"))
    every = orders.join(steps.drop("step", "applied"), ["part", "prefix"])
    own = Window.partitionBy("part", F.expr("right(prefix, 1)"))
    return every.select("part", "filter_order", "step", *METRICS, F.sum("removed").over(own).alias("shapley"))


#: the same by plain SQL: masks by a window, orders by a recursive query without the fold
ORACLE = r"""
WITH RECURSIVE known AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS body FROM documents
), parts_of AS (
    SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS first_id FROM texts
), masked AS (
    SELECT p.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN p.doc_id > first_id THEN 16 ELSE 0 END AS mask
    FROM parts_of p LEFT JOIN known k ON k.doc_id = p.doc_id
), walk(filter_order, used) AS (
    SELECT '', 0
    UNION ALL
    SELECT filter_order || substr('ABCDE', i + 1, 1), used | (1 << i) FROM walk, range(5) r(i) WHERE used & (1 << i) = 0
), steps AS (
    SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
        list_sum([0] || [1 << (ascii(substr(filter_order, s, 1)) - 65) for s in range(1, step)])::INT AS before
    FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM walk WHERE length(filter_order) = 5)
), cells AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY ALL
), found AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before != 0 AND mask & bit != 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM found"""
