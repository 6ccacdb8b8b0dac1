"""Labelled CSV corpora -> one (url, label, source) relation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.constants import CSV_NULLS
from urlsieve.functions.labels import label_a, label_b, label_c


# Whole fields, quoted or not, then a quote that no other one on the line closes.
OPEN_QUOTE = r'^\x{FEFF}?((\"([^\"]|\"\")*\"|[^\",][^,]*)?,)*\"([^\"]|\"\")*$'


@dataclass(frozen=True)
class SourceSpec:
    """Where a corpus lies and how its label reads.

    ``paths`` are tried in order. ``multi_line=None`` looks at the file: only one with
    quoted line breaks is read unsplit.
    """

    name: str
    paths: tuple[str, ...]
    url_col: str
    label_col: str
    label_fn: Callable[[Column], Column]
    encoding: str = "UTF-8"
    multi_line: bool | None = None


def public_corpora(root: str) -> list[SourceSpec]:
    """The three public corpora the label maps were made for, below one folder."""
    third = "PhiUSIIL_Phishing_URL_Dataset.csv"
    return [
        SourceSpec("malicious_phish", (f"{root}/malicious_phish.csv",), "url", "type", label_a),
        SourceSpec("phishing_site_urls", (f"{root}/phishing_site_urls.csv",), "URL", "Label", label_b),
        SourceSpec("phiusiil", (f"{root}/test_model/{third}", f"{root}/{third}"), "URL", "label", label_c),
    ]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def has_quoted_line_breaks(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """True when some line ends inside a quoted field.

    Without such a line no record spans two lines, and the file can be read in splits. A
    quote inside an unquoted field ties nothing together. Only the first such line is
    looked for.
    """
    lines = spark.read.option("encoding", encoding).text(path)
    return not lines.filter(F.col("value").rlike(OPEN_QUOTE)).isEmpty()


def read_corpus(spark: SparkSession, spec: SourceSpec) -> DataFrame | None:
    """(url, label, source) with the raw url; None when no path exists.

    Falls back to the first two columns when the named ones are missing. Cells that
    the usual loader reads as missing become null.
    """
    path = next((p for p in spec.paths if path_exists(spark, p)), None)
    if path is None:
        return None
    unsplit = spec.multi_line
    if unsplit is None:
        unsplit = has_quoted_line_breaks(spark, path, spec.encoding)
    table = (
        spark.read.option("header", True)
        .option("encoding", spec.encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", unsplit)
        .csv(path)
    )
    names = table.columns
    at = [names.index(n) for n in (spec.url_col, spec.label_col) if n in names]
    if len(at) < 2:
        at = [0, 1]
    cells = table.toDF(*[f"c{i}" for i in range(len(names))]).select(
        *[_present(F.col(f"c{i}")).alias(n) for i, n in zip(at, ("url", "label"), strict=True)]
    )
    return apply_label(cells, spec.name, spec.label_fn)


def _present(cell: Column) -> Column:
    return F.when(~cell.isin(CSV_NULLS), cell)


def apply_label(cells: DataFrame, name: str, label_fn: Callable[[Column], Column]) -> DataFrame:
    """Raw (url, label) cells -> (url, label, source) without missing cells."""
    return cells.dropna(subset=["url", "label"]).select(
        "url", label_fn(F.col("label")).alias("label"), F.lit(name).alias("source")
    )


def read_corpora(spark: SparkSession, specs: Sequence[SourceSpec]) -> tuple[DataFrame, list[str]]:
    """Union of the corpora that exist, and their names; fails when none does."""
    found = [(s.name, read_corpus(spark, s)) for s in specs]
    present = [(n, d) for n, d in found if d is not None]
    if not present:
        raise FileNotFoundError("none of: " + ", ".join(p for s in specs for p in s.paths))
    return reduce(DataFrame.unionByName, [d for _, d in present]), [n for n, _ in present]
