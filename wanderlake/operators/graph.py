"""Graphs as DataFrames: arcs, dictionary, degree order, adjacency.

``edges``: edge_idx, src, dst. Duplicates stay and weigh; an undirected edge gives both arcs, a self-loop
two arcs of one vertex. Vertex names are longs; internal numbers never leave the operators that define them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from ..plans.staging import ordered_index, running_total, stage


def expand_arcs(edges: DataFrame, directed: bool = False) -> DataFrame:
    """edge_idx, side, src, dst: one arc per edge, or both directions of each, in one pass."""
    if directed:
        return edges.select("edge_idx", F.lit(0).alias("side"), "src", "dst")
    both = F.array(F.struct(F.lit(0).alias("side"), "src", "dst"), F.struct(F.lit(1).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select("edge_idx", F.explode(both).alias("a")).select("edge_idx", "a.side", "a.src", "a.dst")


def weighted_arcs(arcs: DataFrame) -> DataFrame:
    """src, dst, weight: duplicate arcs merged to their number."""
    return arcs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def degrees(arcs: DataFrame) -> DataFrame:
    """src, degree: arcs that leave each vertex that has any."""
    return arcs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def dictionary(edges: DataFrame) -> DataFrame:
    """name, raw_id: dense numbers in order of first appearance, source before destination."""
    seen = F.array(F.struct(F.col("src").alias("name"), (F.col("edge_idx") * 2).alias("at")), F.struct(F.col("dst").alias("name"), (F.col("edge_idx") * 2 + 1).alias("at")))
    first = edges.select(F.explode(seen).alias("x")).groupBy("x.name").agg(F.min("x.at").alias("at"))
    return ordered_index(first, F.col("at"), name="raw_id").select("name", "raw_id")


def degree_rank(vertices: DataFrame) -> DataFrame:
    """name, raw_id, degree, vid: numbers by falling degree, of equal degrees the larger raw_id first."""
    return ordered_index(vertices, F.desc("degree"), F.desc("raw_id"), name="vid").select("name", "raw_id", "degree", "vid")


def degree_offsets(ranked: DataFrame) -> DataFrame:
    """vid, degree, offset: the sum of degrees before each vertex."""
    return running_total(ranked.select("vid", "degree"), "vid", "degree", "offset")


def relabel(edges: DataFrame, numbers: DataFrame, number: str = "raw_id") -> DataFrame:
    """Edges with names replaced by numbers, by two joins in which a hub's edges stay spread."""
    a = numbers.select(F.col("name").alias("src"), F.col(number).alias("_s"))
    b = numbers.select(F.col("name").alias("dst"), F.col(number).alias("_d"))
    found = spread_join(spread_join(edges.select("edge_idx", "src", "dst"), a, ["src"]), b, ["dst"])
    return found.select("edge_idx", F.col("_s").alias("src"), F.col("_d").alias("dst"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted arcs with their place since their source began in this partition."""
    part, open_, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        src = batch.column(0).to_numpy()
        if not len(src):
            continue
        row = np.arange(len(src))
        first = np.concatenate([[src[0] != open_], src[1:] != src[:-1]])
        k = row - np.maximum.accumulate(np.where(first, row, 0))
        k[np.maximum.accumulate(first) == 0] += count
        open_, count = src[-1], int(k[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), part, np.int32)), batch.column(0), pa.array(k), batch.column(1)], names=["part", "src", "k", "dst"])


def slots(arcs: DataFrame) -> DataFrame:
    """src, k, dst: the adjacency lists as rows, k numbering each vertex's arcs by (dst, edge_idx, side).

    Rows, not arrays: a hub of any degree is many rows, and a walker reaches its next vertex by (src, k). Arcs are range-sorted
    and numbered in their partition; a source that goes on from one partition to the next is carried over by one row
    a partition, so a hub's arcs lie, and are numbered, in many tasks.
    """
    placed = arcs.select("src", "dst", "edge_idx", "side").orderBy("src", "dst", "edge_idx", "side").mapInArrow(_places, "part int, src long, k long, dst long")
    placed = stage(placed, "slots")
    ends = placed.groupBy("part").agg(F.min("src").alias("first"), F.max(F.struct("src", "k")).alias("last")).collect()  # one row a partition
    carried, open_, count = [], None, 0
    for part, first, (last, k) in sorted(ends):
        before = count if first == open_ else 0
        if before:
            carried.append((part, first, before))
        open_, count = last, k + 1 + (before if first == last else 0)
    if not carried:
        return placed.select("src", "k", "dst")
    found = placed.join(F.broadcast(placed.sparkSession.createDataFrame(carried, "part int, src long, _before long")), ["part", "src"], "left")
    return found.select("src", (F.col("k") + F.coalesce("_before", F.lit(0))).alias("k"), "dst")


def adjacency(arcs: DataFrame) -> DataFrame:
    """src, degree, nbrs (sorted): lists as arrays, for graphs whose largest list fits a row."""
    return arcs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sort_array(F.collect_list("dst")).alias("nbrs"))


def has_neighbor(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """pairs (src, dst) with has_neighbor: whether that arc exists; exact, directed."""
    known = arcs.select("src", "dst").distinct().withColumn("_hit", F.lit(True))
    return spread_join(pairs, known, ["src", "dst"], "left").withColumn("has_neighbor", F.col("_hit").isNotNull()).drop("_hit")


def edge_multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """src, dst, surplus: where the number of equal edges differs; a's less b's."""
    both = a.select("src", "dst", F.lit(1).alias("_n")).unionByName(b.select("src", "dst", F.lit(-1).alias("_n")))
    return both.groupBy("src", "dst").agg(F.sum("_n").alias("surplus")).filter("surplus != 0")


def csr_bytes(vertices: int, arcs: int, copies: int = 1) -> int:
    """Bytes of the packed adjacency: 12 per vertex and copy, 4 per arc."""
    return 12 * vertices * copies + 4 * arcs


class Graph:
    """A graph over an edge table, with its tables made when first used.

    ``on_sink``: what a walk does at a vertex without arcs, ``error`` or ``stop``.
    """

    def __init__(self, edges: DataFrame, directed: bool = False, on_sink: str = "error"):
        if on_sink not in ("error", "stop"):
            raise ValueError("on_sink: error or stop")
        self.edges, self.directed, self.on_sink = edges, directed, on_sink

    @classmethod
    def load(cls, spark, path: str, kind: str = "text", directed: bool = False, on_sink: str = "error") -> Graph:
        """A graph from files: ``text``, ``binary`` or ``adjacency``."""
        from .. import sources

        read = {"text": sources.read_text_edges, "binary": sources.read_binary_edges, "adjacency": sources.read_adjacency_text}[kind]
        return cls(stage(read(spark, path), "edges"), directed, on_sink)

    @cached_property
    def arcs(self) -> DataFrame:
        return expand_arcs(self.edges, self.directed)

    @cached_property
    def names(self) -> DataFrame:
        """name of every vertex."""
        return self.edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()

    @cached_property
    def vertices(self) -> DataFrame:
        """name, raw_id, degree, vid."""
        found = dictionary(self.edges).join(degrees(self.arcs).withColumnRenamed("src", "name"), "name", "left")
        return degree_rank(found.select("name", "raw_id", F.coalesce("degree", F.lit(0)).alias("degree")))

    @cached_property
    def starts(self) -> DataFrame:
        """start (0.. in order of name), name, degree: where walkers begin."""
        named = self.names.join(degrees(self.arcs).withColumnRenamed("src", "name"), "name", "left").select("name", F.coalesce("degree", F.lit(0)).alias("degree"))
        return stage(ordered_index(named, F.col("name"), name="start"), "starts")

    @cached_property
    def numbered(self) -> DataFrame:
        """start, name: as in ``starts``, without degrees."""
        return stage(ordered_index(self.names, F.col("name"), name="start"), "numbered")

    @cached_property
    def ends(self) -> DataFrame:
        """name, degree of every vertex."""
        return self.starts.select("name", "degree")

    @cached_property
    def slots(self) -> DataFrame:
        """src, k, dst."""
        return stage(slots(self.arcs), "slots")

    @cached_property
    def steps(self) -> DataFrame:
        """src, k, dst, dst_degree, kept hash-partitioned by (src, k).

        A slot also tells the degree of where it leads, so a step is one join.
        """
        out = spread_join(self.slots, self.ends.select(F.col("name").alias("dst"), F.col("degree").alias("dst_degree")), ["dst"])
        parts = int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return stage(out.select("src", "k", "dst", "dst_degree"), "steps").repartition(parts, "src", "k").persist()

    @cached_property
    def weights(self) -> DataFrame:
        """src, dst, weight, first: distinct arcs with their number and the first of their slots, which follow one another."""
        return stage(self.slots.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.min("k").alias("first")), "weights")

    @cached_property
    def pairs(self) -> DataFrame:
        """src, dst of the distinct arcs."""
        return self.weights.select("src", "dst")

    @cached_property
    def arc_count(self) -> int:
        """Arcs."""
        return self.edges.count() * (1 if self.directed else 2)

    @cached_property
    def counts(self) -> tuple[int, int]:
        """Vertices and arcs."""
        return self.names.count(), self.arc_count


class Reached(Graph):
    """The lists of a few vertices ``at`` (vertex) of a graph: what a step from there needs to know, found by one pass over the edges.

    Slots have the numbers that they have in the whole graph. Where they lead to is not looked at, so they don't tell its degree.
    """

    def __init__(self, graph: Graph, at: DataFrame):
        super().__init__(graph.edges, graph.directed, graph.on_sink)
        self._all, self._at = graph.arcs, at

    @cached_property
    def arcs(self) -> DataFrame:
        return stage(self._all.join(F.broadcast(self._at.select(F.col("vertex").alias("src"))), "src", "left_semi").select("edge_idx", "side", "src", "dst"), "reached")

    @cached_property
    def steps(self) -> DataFrame:
        """src, k, dst, dst_degree (null)."""
        return self.slots.withColumn("dst_degree", F.lit(None).cast("long"))

    @cached_property
    def degrees(self) -> DataFrame:
        """src, degree of those that have arcs."""
        return degrees(self.slots)
