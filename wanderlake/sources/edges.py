"""Readers and writers of edge lists: ``edge_idx, src, dst`` with names in 0..4294967295."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage
from .adjacency import read_adjacency_text  # noqa: F401
from .binary import read_binary_edges  # noqa: F401
from .names import checked

def add_edge_index(lines: DataFrame) -> DataFrame:
    """Numbers rows of a file scan in file order, then place in the file; needs ``_file``, ``_start`` (of the split).

    Splits are contiguous in a task, so a row's place is its task number less that of the split's
    first row; one row per split is collected.
    """
    placed = stage(lines.withColumn("_at", F.monotonically_increasing_id()), "lines")
    splits = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n")).collect()
    rows, total = [], 0
    for r in sorted(splits, key=lambda r: (r["_file"], r["_start"])):
        rows.append((r["_file"], r["_start"], r["_first"], total))
        total += r["n"]
    offsets = lines.sparkSession.createDataFrame(rows, "_file string, _start long, _first long, _base long")
    out = placed.join(F.broadcast(offsets), ["_file", "_start"])
    return out.withColumn("edge_idx", F.col("_base") + F.col("_at") - F.col("_first")).drop("_file", "_start", "_first", "_base", "_at")


def read_text_edges(spark: SparkSession, path: str | list[str], malformed: str = "error") -> DataFrame:
    """Lines ``src dst ...``; lines that begin with ``#`` and blank lines are left out, further columns too.

    ``malformed``: ``error`` or ``drop``. (A malformed line never repeats the edge before it.)
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    lines = lines.filter(~F.col("value").startswith("#") & (F.btrim("value", F.lit(" \t\r")) != ""))
    # Numbered with the malformed lines out, so that the order has no gaps.
    found = r"^\s*(\d{1,10})\s+(\d{1,10})(?:\s.*)?$"
    lines = lines.withColumn("_ok", F.col("value").rlike(found))
    if malformed == "drop":
        lines = lines.filter("_ok")
    elif malformed != "error":
        raise ValueError("malformed: error or drop")
    value = F.when(F.col("_ok"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed edge: "), F.col("value"))).cast("string"))
    src, dst = (checked(F.regexp_extract(value, found, i).cast("long")) for i in (1, 2))
    return add_edge_index(lines.select(src.alias("src"), dst.alias("dst"), "_file", "_start")).select("edge_idx", "src", "dst")


def write_text_edges(edges: DataFrame, path: str, header: str | None = None) -> None:
    """``src dst`` lines in order of edge_idx over the part files; ``header`` goes to a comment file before them."""
    lines = edges.orderBy("edge_idx").select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    lines.write.text(path)
    if header is not None:
        note = "\n".join(x if x.startswith("#") else f"# {x}" for x in header.split("\n"))
        edges.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("append").text(path)


def write_binary_edges(edges: DataFrame, path: str, edges_per_file: int = 1_000_000) -> None:
    """Packed little-endian unsigned 32-bit pairs in order of edge_idx over the part files, of about ``edges_per_file`` each (8 MB).

    A task holds a few copies of its part, which is why parts are small: a larger table has more of them, not larger ones.

    The bytes go through Spark's text writer, so any file system Spark knows will do; each part
    ends in one line feed, a part of a record that readers of the format leave out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1).astype("<u4").tobytes() for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

    parts = max(1, -(-edges.count() // edges_per_file))
    packed = edges.repartitionByRange(parts, "edge_idx").sortWithinPartitions("edge_idx").select("src", "dst").mapInArrow(run, "content binary")
    packed.select(F.col("content").cast("string").alias("value")).write.text(path)


def write_info(path: str, vertices: int, edges: int, spark: SparkSession) -> None:
    """The sidecar of a graph file: ``<path>.info.txt`` with its counts."""
    spark.createDataFrame([(f"vertex_num {vertices}",), (f"edge_num {edges}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.info.txt")


def read_info(spark: SparkSession, path: str) -> dict[str, int]:
    """The counts in the sidecar of a graph file."""
    return {k: int(v) for k, v in (r["value"].split() for r in spark.read.text(f"{path}.info.txt").collect())}
