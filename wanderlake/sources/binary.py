"""Packed pairs read by ranges of whole records, so a file of any size is read by many tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "edge_idx long, src long, dst long"
RECORD = 8
#: Records of a range (128 MB) and of a batch.
RANGE, BATCH = 16 << 20, 1 << 20
#: Stores that a task opens by itself, and what they are called there; files in others are read by Spark, each whole.
STORES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs"}


def pairs(raw: bytes | pa.Buffer, first: int) -> pa.RecordBatch:
    """A batch of edges out of packed pairs; edges are numbered from ``first`` on, and a trailing part of a record is left out."""
    found = np.frombuffer(raw, "<u4", len(raw) // RECORD * 2).astype(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)) + first), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["edge_idx", "src", "dst"])


class _Range(InputPartition):
    def __init__(self, uri: str, first: int, records: int, base: int):
        self.uri, self.first, self.records, self.base = uri, first, records, base


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.size = json.loads(options["files"]), int(options["records"])

    def partitions(self) -> list[InputPartition]:
        return [_Range(uri, at, min(self.size, n - at), base) for uri, n, base in self.files for at in range(0, n, self.size)] or [_Range("", 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not partition.records:
            return
        store, path = fs.FileSystem.from_uri(partition.uri)
        with store.open_input_file(path) as source:
            for at in range(partition.first, partition.first + partition.records, BATCH):
                n = min(BATCH, partition.first + partition.records - at)
                yield pairs(source.read_at(n * RECORD, at * RECORD), partition.base + at)


class PackedPairs(DataSource):
    """``files``: JSON of (URI, records, number of the first edge); ``records`` of a range."""

    @classmethod
    def name(cls) -> str:
        return "wanderlake_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def _whole(files: DataFrame, base: dict[str, int]) -> DataFrame:
    """Files read whole by Spark, for stores that only it opens: up to 2 GB each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                for at in range(0, len(raw) // RECORD, BATCH):
                    yield pairs(raw[at * RECORD : (at + BATCH) * RECORD], base[name] + at)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_binary_edges(spark: SparkSession, path: str | list[str], records: int = RANGE) -> DataFrame:
    """Pairs of little-endian unsigned 32-bit numbers, numbered in order of files and places; a trailing part of a record is left out.

    Tasks read ranges of ``records`` pairs, of local and shared folders and object stores; in stores that only Spark opens a file is
    a task, and at most 2 GB.
    """
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    sizes = sorted((r["path"], r["length"] // RECORD) for r in files.select("path", "length").collect())  # one row a file
    found, base, total = [], {}, 0
    for name, n in sizes:
        scheme, _, rest = name.partition(":")
        found.append((f"{STORES.get(scheme)}://{rest.lstrip('/') if scheme != 'file' else '/' + rest.lstrip('/')}", n, total))
        base[name] = total
        total += n
    if any(name.partition(":")[0] not in STORES for name, _ in sizes):
        return _whole(files, base)
    spark.dataSource.register(PackedPairs)
    return spark.read.format("wanderlake_pairs").option("files", json.dumps(found)).option("records", records).load()
