"""Walks by lookup in packed lists: for graphs of any size, with nothing broadcast.

A vertex's slots lie in arrays of ``LIST`` of them, dealt over the cluster's tasks by (vertex, list, copy), once a job. A step deals the
walkers by the same key, so each task holds the lists its walkers stand on in a hash table of vertices, not arcs, and a
walker's next vertex is an array lookup: nothing is sorted, and what is shuffled is walkers. Many steps make one job.

A hub's walkers spread over its lists. Where many arcs lead to a vertex that few leave, its lists are few, so they are there in
several copies, of which a walker takes one by its number. Draws are those of the joins and the kernel, so are the walks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw_text
from ..plans.joins import spread_join
from ..plans.staging import stage
from .graph import Graph
from .walks import start_walkers

#: Slots of a list.
LIST = 512


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed_ends(graph: Graph) -> DataFrame:
    """name, degree, copies of every vertex: its lists times its copies are about its share of all arcs times the tasks, or one."""
    incoming = graph.slots.groupBy("dst").agg(F.count(F.lit(1)).alias("_in"))
    arcs = max(graph.slots.count(), 1)
    share = F.coalesce("_in", F.lit(0)) * F.lit(_tasks(graph.edges.sparkSession)) / F.lit(arcs)
    lists = F.greatest(F.ceil(F.col("degree") / F.lit(LIST)), F.lit(1))
    ends = graph.starts.join(incoming.withColumnRenamed("dst", "name"), "name", "left")
    return stage(ends.select("start", "name", "degree", (1 + F.floor(share / lists)).cast("int").alias("copies")), "packed_ends")


def packed_lists(graph: Graph, ends: DataFrame) -> DataFrame:
    """src, list, copy, to, degrees, copies: a list's destinations in order of their slots, and what a walker must know there."""
    there = ends.select(F.col("name").alias("dst"), "degree", "copies")
    rows = spread_join(graph.slots, there, ["dst"])
    # At most LIST rows a group.
    rows = rows.groupBy("src", F.shiftright("k", LIST.bit_length() - 1).alias("list")).agg(F.array_sort(F.collect_list(F.struct("k", "dst", "degree", "copies"))).alias("_s"))
    rows = rows.select("src", "list", F.col("_s.dst").alias("to"), F.col("_s.degree").alias("degrees"), F.col("_s.copies").alias("copies"))
    rows = rows.join(ends.select(F.col("name").alias("src"), F.col("copies").alias("_c")), "src").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return stage(rows.select("src", "list", "copy", "to", "degrees", "copies"), "packed")


@contextmanager
def fixed_plan(spark: SparkSession) -> Iterator[None]:
    """Plans inside are not changed as they run: keys are known to be spread, and planning each of many short steps anew takes longer than they do."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class PackedGraph:
    """A graph's packed lists, made once for any number of walks; each job deals them out once, however many steps it makes."""

    def __init__(self, graph: Graph):
        self.graph, self.spark = graph, graph.edges.sparkSession
        self.ends = packed_ends(graph)
        self.lists = packed_lists(graph, self.ends).repartition(_tasks(self.spark), "src", "list", "copy")

    def _step(self, inner: str, seed: int) -> str:
        """A step as SQL: draws a slot, looks it up; a walker at a sink fails or stays, under a key of its own.

        All steps have the same columns and no number of their own, so that Spark compiles their code once.
        """
        drawn = f"{draw_text(seed, 'walker_id', '(step + 1L)')} % degree"
        if self.graph.on_sink == "error":
            k, at = f"if(degree > 0, {drawn}, cast(raise_error(concat('walker at a vertex without arcs: ', vertex)) as bigint))", "vertex"
        else:
            k, at = f"if(degree > 0, {drawn}, 0L)", "if(degree > 0, vertex, -1 - walker_id)"
        i = f"int(k & {LIST - 1})"
        return f"""SELECT /*+ SHUFFLE_HASH(p) */ walker_id, step, p.to[{i}] AS vertex, coalesce(p.degrees[{i}], 0L) AS degree, coalesce(p.copies[{i}], 1) AS copies,
                if(p.src is null, path, array_append(path, p.to[{i}])) AS path
            FROM (SELECT walker_id, step + 1L AS step, copies, path, {at} AS at, {k} AS k FROM (SELECT walker_id, step, vertex, degree, copies, path FROM ({inner}))) h
            LEFT JOIN {{lists}} p ON p.src = h.at AND p.list = shiftright(h.k, {LIST.bit_length() - 1}) AND p.copy = int(h.walker_id % h.copies)"""

    def walks(self, walkers: int, length: int, seed: int = 1, first: int = 0, every: int = 8) -> DataFrame:
        """walker_id (from ``first`` on), step, vertex: uniform walks, written every ``every`` steps."""
        if length < 1:
            raise ValueError("length counts vertices: at least 1")
        here = start_walkers(self.graph, walkers, seed, first, self.ends).select("walker_id", F.lit(0).cast("long").alias("step"), "vertex", "degree", "copies")
        here = stage(here, "walkers")
        parts = [here.select("walker_id", F.lit(0).alias("step"), "vertex")]
        for low in range(1, length, every):
            text = "SELECT *, cast(array() as array<bigint>) AS path FROM {here}"
            for _ in range(low, min(low + every, length)):
                text = self._step(text, seed)
            with fixed_plan(self.spark):
                here = stage(self.spark.sql(text, here=here, lists=self.lists), "walkers")
            parts.append(here.select("walker_id", F.posexplode("path").alias("_i", "vertex")).select("walker_id", (F.col("_i") + low).alias("step"), "vertex"))
            here = here.drop("path")
        return reduce(DataFrame.unionByName, parts)


def packed_graph(graph: Graph) -> PackedGraph:
    """The graph's packed lists, made when first asked for."""
    if "_packed" not in graph.__dict__:
        graph.__dict__["_packed"] = PackedGraph(graph)
    return graph.__dict__["_packed"]


def packed_walks(graph: Graph, walkers: int, length: int, seed: int = 1, first: int = 0) -> DataFrame:
    """walker_id, step, vertex: uniform walks by the graph's packed lists."""
    return packed_graph(graph).walks(walkers, length, seed, first)
