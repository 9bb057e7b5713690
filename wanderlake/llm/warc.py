"""Operator 2, WARC archives and the merge of their capture index.

``write_archives`` writes a record per page with Spark's own writer: a payload that an equal one with
a larger key supersedes is a revisit of that response. ``read_captures`` reads the archives back by
their content lengths and leaves locally sorted runs of captures; ``merge_runs`` merges the runs of
each range of (URL key, time, key) through a loser tree, so that all ranges in turn are the
globally ordered capture history.

Defined results: a null payload is empty; a null URL is the empty string; a null key is written as
``none`` and read back as null; of repeated rows with one key and payload, all with the largest key are
responses; an empty table writes no record and reads back none; further columns are ignored. One
record is one row, however long; archives end after ``records_per_file`` records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, salted_lookup, stage

_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:wanderlake:record:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: hexadecimal digits regrouped five bits at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, at + 1, n), 16, 32), n * 4 // 5, "0") for at, n in ((0, 15), (15, 15), (30, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """The sort-friendly form: host labels from the top down, then the path and query."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*([^#]*)", 1), r"^$", "/")
    return F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.|:(80|443)$", ""), r"\.")), ","), F.lit(")"), rest)


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None, least_bytes: int = 0, records_per_file: int = 2000, small: int = 50_000) -> str:
    """Writes the pages as gzipped WARC files; returns their folder. ``captured``: capture time of a row."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
        F.coalesce(captured if captured is not None else F.current_timestamp(), F.timestamp_seconds(F.lit(0))).alias("captured"),
    )
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= least_bytes
    groups = rows.filter(large).groupBy("digest").agg(F.max("key").alias("newest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "newest")
    groups = stage(groups, "copies")
    if groups.count() <= small:
        rows = rows.join(F.broadcast(groups), "digest", "left")
    else:
        rows = salted_lookup(rows, groups, "digest", F.col("key"))
    again = large & F.col("newest").isNotNull() & F.coalesce(F.col("key") != F.col("newest"), F.lit(True))
    rows = rows.withColumn("again", again)

    def urn(c: Column) -> Column:
        return F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(_END + _END))
    block = F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("key"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp("captured", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("again"), F.concat(F.lit(f"WARC-Profile: {_PROFILE}{_END}WARC-Refers-To: "), urn(F.col("newest")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    path = new_path(spark, "warc")
    record = F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END), block)
    rows.select(record.alias("value")).write.option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def records(packed: bytes, piece: int = 1 << 20) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of a gzipped WARC file, members in turn.

    Unpacked piece by piece: no more than the record at hand and a piece are held.
    """
    raw, at, base, view = bytearray(), 0, 0, memoryview(packed)
    member, place = zlib.decompressobj(31), 0

    def more() -> bool:
        nonlocal member, place
        while place < len(view) or member.unconsumed_tail:
            feed = member.unconsumed_tail or view[place : place + piece]
            if not member.unconsumed_tail:
                place += len(feed)
            out = member.decompress(feed, piece)
            if member.eof:
                place -= len(member.unused_data)
                member = zlib.decompressobj(31)
            if out:
                raw.extend(out)
                return True
        return False

    while True:
        while (head := raw.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        lines = raw[at:head].decode().split(_END)
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        first = head + 4
        past = first + int(fields["Content-Length"])
        while len(raw) < past and more():
            pass
        yield base + at, fields, bytes(raw[first:past])
        at = past + 4
        if at > piece:
            while len(raw) < at and more():
                pass
            del raw[:at]
            base, at = base + at, 0


_CAPTURE = T.StructType(
    [
        T.StructField("url_key", T.StringType()),
        T.StructField("captured", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("archive", T.StringType()),
        T.StructField("record_offset", T.LongType()),
    ]
)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives: what its headers and its payload say.

    A response's length and digest come from the payload itself; a revisit's from its headers.
    """
    schema = T.StructType([f for f in _CAPTURE if f.name != "url_key"])

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if f.dataType == T.LongType() else pa.string()) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, fields, block in records(packed.as_buffer()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    own = lambda s: None if s == "none" else s
                    row = [fields["WARC-Date"], own(fields["WARC-Record-ID"][1:-1].removeprefix(_ID)), fields["WARC-Target-URI"], fields["WARC-Type"]]
                    if fields["WARC-Type"] == "revisit":
                        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length"))
                        row += [fields["WARC-Payload-Digest"].removeprefix("sha1:"), size, own(fields["WARC-Refers-To"][1:-1].removeprefix(_ID))]
                    else:
                        row += [base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), None]
                    rows.append([*row, name, at])
                    if len(rows) == 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    found = files.select("path", "content").mapInArrow(run, schema)
    return found.withColumn("url_key", url_key(F.col("url"))).select(*_CAPTURE.names)


def sorted_runs(captures: DataFrame) -> DataFrame:
    """The captures with the number of their run, each task's rows one run in order, written as they are."""
    out = captures.withColumn("run", F.spark_partition_id()).sortWithinPartitions("url_key", "captured", "key")
    return stage(out, "runs")


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers, so each step replays one path only."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i)

    def _next(self, i: int) -> tuple:
        head = next(self.runs[i], None)
        return (1,) if head is None else (0, head, i)

    def _replay(self, i: int) -> None:
        at = (i + self.k) // 2
        while at:
            other = self.tree[at]
            if other < 0:
                self.tree[at] = i
                return
            if self.heads[other] < self.heads[i]:
                self.tree[at], i = i, other
            at //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.k and len(self.heads[self.tree[0]]) > 1:
            i = self.tree[0]
            yield self.heads[i][1]
            self.heads[i] = self._next(i)
            self._replay(i)


def merge_runs(runs: DataFrame, range_rows: int = 200_000) -> DataFrame:
    """The captures in global order: by ``range``, then ``position`` in it.

    Ranges are cut by (URL key, time, key), so a URL with very many captures falls into several. In
    a range each run's rows come as pieces in order; pieces are found by where the order falls, and
    a loser tree merges them.
    """
    parts = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(parts, "url_key", "captured", "key")
    schema = T.StructType([*_CAPTURE.fields, T.StructField("position", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        # A null key sorts first, as Spark sorts it.
        keys = list(zip(*[[(x is not None, x or "") for x in table.column(c).to_pylist()] for c in ("url_key", "captured", "key")], strict=True))
        pieces: list[list[int]] = []
        last: dict[int, list[int]] = {}
        for i, r in enumerate(table.column("run").to_pylist()):
            piece = last.get(r)
            if piece is None or keys[i] < keys[piece[-1]]:
                piece = last[r] = []
                pieces.append(piece)
            piece.append(i)
        order = [i for _, i in LoserTree([((keys[i], i) for i in piece) for piece in pieces])]
        out = table.select(_CAPTURE.names).take(pa.array(order, pa.int64())).append_column("position", pa.array(np.arange(len(order))))
        yield from out.combine_chunks().to_batches()

    return dealt.mapInArrow(run, schema).withColumn("range", F.spark_partition_id())


def op2_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the merged capture index.

    Pages have no capture time; their number stands for it, in seconds.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = write_archives(pages, captured=F.timestamp_seconds(F.col("page_id")))
    history = merge_runs(sorted_runs(read_captures(spark, path)))
    return history.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url_key", "captured")


QUERIES = {"op2_warc_merge": op2_warc_merge}
ORACLES: dict[str, str] = {}
