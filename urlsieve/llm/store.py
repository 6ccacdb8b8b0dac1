"""Written intermediate tables and small helpers that several operators share."""

from __future__ import annotations

import ctypes
import os
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlsieve.session import materialize, scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run inside drop their shuffle files as soon as they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back; the shuffles behind it are freed.

    The copy survives lost executors and cuts the lineage.
    """
    with shuffles_removed(df.sparkSession):
        return materialize(df, name)


def drop_staged(*tables: DataFrame) -> None:
    """Remove the files behind ``staged`` tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def positioned(df: DataFrame, order: list[str], size: str, out: str) -> DataFrame:
    """``df`` with the sum of ``size`` (long) over all rows before each one in ``order``, as ``out``.

    Range partitions keep running sums; one sum per partition joins them. ``df`` is read
    twice, so let it be a written table.
    """

    def run(source):
        part, total = TaskContext.get().partitionId(), 0
        for batch in source:
            sizes = batch.column(size).to_numpy(zero_copy_only=False)
            before = np.cumsum(sizes) - sizes + total
            total += int(sizes.sum())
            yield table([*batch.schema.names, "__at", "__part"], [*batch.columns, pa.array(before, pa.int64()), pa.array([part] * len(sizes), pa.int32())])

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = staged(ranged.mapInArrow(run, f"{schema}, __at long, __part int"), "positioned")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("__part").agg(F.sum(size).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return rows.join(bases, "__part").withColumn(out, F.col("__at") + F.col("__base")).drop("__at", "__base", "__part")


def tidy(run):
    """A partition function that gives its free memory back when it ends: a worker that waits should hold little."""

    @wraps(run)
    def tidied(source):
        try:
            yield from run(source)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, env.get("PYTHONPATH", "")) if p)


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def parts(source, column: str, limit: int = 2 << 20):
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in source:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def table(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)
