"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
#: Lets Spark delete the shuffle files of a query as it ends: what it wrote is read back instead.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of this application if it runs in one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        if key not in _own_dir:
            _own_dir[key] = tempfile.mkdtemp(prefix="wanderlake-")
        base = _own_dir[key]
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/wanderlake-{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go as each of them ends."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back, so that lost executors repeat nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_released(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def stage_bucketed(df: DataFrame, label: str, column: str, buckets: int, *parts: str) -> DataFrame:
    """Like ``stage``, kept in buckets of ``column`` (and folders of ``parts``): joins and groups by it don't shuffle these rows."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = f"wanderlake_{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column)
    with shuffles_released(spark):
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    out = spark.table(name)
    out._staged_at, out._staged_as = path, name
    return out


def stage_parts(df: DataFrame, label: str, column: str) -> DataFrame:
    """Like ``stage``, in a folder for each value of ``column``, so that a read for one value opens that folder alone."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_released(spark):
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for df in staged:
        spark = df.sparkSession
        if name := getattr(df, "_staged_as", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _file(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def file_there(spark: SparkSession, path: str) -> bool:
    """Whether a file is there."""
    system, found = _file(spark, path)
    return system.exists(found)


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, replaced if it is there."""
    system, found = _file(spark, path)
    out = system.create(found, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_note(spark: SparkSession, path: str) -> str:
    """What ``write_note`` wrote."""
    system, found = _file(spark, path)
    source = system.open(found)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def ordered_index(df: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """A dense 0-based number of each row in the given order, without one task for all rows.

    Rows are range-sorted and written with their partition and place; the count per partition, one
    row each, gives where every partition starts.
    """
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = stage(placed, "ordered")
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def _successions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's value and the next row's in this partition; the last row's next is not there yet."""
    part, held, at = TaskContext.get().partitionId(), None, 0
    names = ["_part", "_at", "_end", "value", "next"]
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0) if held is None else pa.concat_arrays([held, batch.column(0)])
        n = len(values) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(np.zeros(n, bool)), values[:n], values[1:]], names=names)
        held, at = values[n:], at + n
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at]), pa.array([True]), held, pa.nulls(1, pa.int64())], names=names)


def successions(df: DataFrame, order: str, value: str) -> DataFrame:
    """edge_idx, src, dst: each row's ``value`` (a long) and that of the row next in order; the last row has none and is left out.

    Rows are range-sorted once and neither numbered apart nor joined with each other: what lies over the end of a partition is one row
    a partition, and goes through the driver with the counts.
    """
    spark = df.sparkSession
    placed = df.select(order, value).orderBy(order).select(value).mapInArrow(_successions, "_part int, _at long, _end boolean, value long, next long")
    placed = stage(placed, "successions")
    ends = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min(F.expr("if(_at = 0, value, null)")).alias("first")).collect()  # one row a partition
    rows, total, ends = [], 0, sorted(ends)
    for k, (part, n, _) in enumerate(ends):
        rows.append((part, total, k + 1 < len(ends), ends[k + 1]["first"] if k + 1 < len(ends) else None))
        total += n
    offsets = spark.createDataFrame(rows, "_part int, _start long, _more boolean, _first long")
    found = placed.join(F.broadcast(offsets), "_part").filter("not _end or _more")
    return found.select((F.col("_start") + F.col("_at")).alias("edge_idx"), F.col("value").alias("src"), F.when(F.col("_end"), F.col("_first")).otherwise(F.col("next")).alias("dst"))


def running_total(df: DataFrame, index: str, value: str, name: str, chunk: int = 1 << 20) -> DataFrame:
    """The sum of ``value`` over all rows of smaller ``index``: within chunks by window, over chunks by their totals."""
    from pyspark.sql import Window

    parts = df.withColumn("_chunk", F.floor(F.col(index) / F.lit(chunk)))
    inner = F.sum(value).over(Window.partitionBy("_chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_inner", F.coalesce(inner, F.lit(0)))
    totals = parts.groupBy("_chunk").agg(F.sum(value).alias("_sum"))
    # One row per chunk of a million: the only rows that meet in one task.
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(before.select("_chunk", "_before"), "_chunk").withColumn(name, F.col("_before") + F.col("_inner")).drop("_chunk", "_inner", "_before")
