import pytest
from pyspark.sql import types as T

#: besides the columns of documents, names that the operators use for columns of their own
EXTRA = ["id", "t", "base", "score", "shard", "size", "words", "part", "unit", "key", "kept", "predicted", "cell", "vec", "rank"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
    + [T.StructField(n, T.StringType()) for n in EXTRA]
)


def prose(seed: int, n: int) -> str:
    """n words that depend on the seed alone."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("".join("abcdefghij"[(x >> (8 * i)) % 10] for i in range(3 + (x >> 60) % 4)))
    return " ".join(out)


PASSAGE = prose(99, 40)
ROWS = [
    (1, prose(1, 60) + " " + PASSAGE, "en", "a"),
    (2, prose(2, 50) + "\n" + PASSAGE + " " + prose(3, 30), "en", "a"),
    (3, prose(1, 60) + " " + PASSAGE, "en", "b"),  # an exact copy
    (3, prose(1, 60) + " " + PASSAGE, "en", "b"),  # a repeated row
    (4, prose(1, 59) + " other " + PASSAGE, "en", None),  # a near copy
    (5, None, "en", "a"),
    (6, "", None, "a"),
    (7, " \n\t ", "fr", "c"),
    (8, "one", "fr", "c"),
    (None, prose(5, 30), None, None),
    (None, None, None, None),
    (9, "naïve 日本語   Ünï ▁x <|endoftext|> <s>  a\tb\r\n" + prose(6, 25), "de", "c"),
    (10, prose(7, 3000) + " " + PASSAGE, "de", "c"),  # long
    (11, "x" * 5000, "de", "c"),  # one very long word
    (12, "same " * 60, "de", "b"),  # the same word over and over
    (12, prose(8, 20), "de", "b"),  # another text under the same id
    (-3, prose(9, 45), "es", ""),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ROWS


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty, short and long texts, ties, repeated rows, clashing column names."""
    rows = [(i, t, l, s, None if t is None else len(t)) + (None,) * len(EXTRA) for i, t, l, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table, as Python rows."""
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
