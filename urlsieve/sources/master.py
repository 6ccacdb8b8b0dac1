"""The master table on disk: Parquet, CSV and its manifest."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.constants import NORMALIZATION_VERSION
from urlsieve.sources.corpora import path_exists

PARQUET, CSV, MANIFEST = "master.parquet", "master.csv", "manifest.json"


def path_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder, by the file system it lies in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small report as one JSON text file, through Spark's file system."""
    text = json.dumps(value, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0]["value"])


def write_table(df: DataFrame, root: str, formats: tuple[str, ...] = ("parquet", "csv")) -> None:
    """Parquet (snappy) and CSV copies; the CSV is written from the Parquet copy."""
    spark = df.sparkSession
    if "parquet" in formats:
        df.write.mode("overwrite").option("compression", "snappy").parquet(f"{root}/{PARQUET}")
        df = spark.read.parquet(f"{root}/{PARQUET}")
    if "csv" in formats:
        writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
        writer.csv(f"{root}/{CSV}")


def write_master(df: DataFrame, manifest: dict, root: str, formats=("parquet", "csv")) -> None:
    write_table(df, root, formats)
    write_json(df.sparkSession, manifest, f"{root}/{MANIFEST}")


def read_master(
    spark: SparkSession, root: str, expect_version: str = NORMALIZATION_VERSION
) -> DataFrame:
    """url, label, group of a written master; Parquet is preferred to CSV.

    Warns when the manifest names another normalisation than ours.
    """
    if path_exists(spark, f"{root}/{PARQUET}"):
        table = spark.read.parquet(f"{root}/{PARQUET}")
    else:
        # a url may hold a line break, so records cannot be told from lines
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        table = reader.csv(f"{root}/{CSV}")
    check_version(spark, root, expect_version)
    return table.select("url", F.col("label").cast("int").alias("label"), "group").dropna()


def check_version(spark: SparkSession, root: str, expect_version: str) -> dict:
    """What the manifest says of the build; {} without one."""
    if not path_exists(spark, f"{root}/{MANIFEST}"):
        return {}
    manifest = read_json(spark, f"{root}/{MANIFEST}")
    built = manifest.get("url_normalization")
    if built and built != expect_version:
        warnings.warn(
            f"master was normalised with {built}, expected {expect_version}: rebuild it",
            stacklevel=2,
        )
    return {
        "url_normalization": built,
        "conflict_policy": manifest.get("conflict_policy"),
        "label_conflicts": manifest.get("totals", {}).get("label_conflicts"),
        "path_rule_accuracy": manifest.get("surface_form_audit", {})
        .get("master", {})
        .get("path_rule_accuracy"),
    }
