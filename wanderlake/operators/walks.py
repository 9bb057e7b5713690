"""Random walks by iterative joins: first order (uniform), and second order with return p and in-out q.

Draws depend on seed, walker and step alone, so partitioning, retries and strategy don't change a walk. A
step joins walkers to slots on (vertex, slot number): keys are spread even where many walkers stand on
one hub, and a hub's list is many rows. Slots stay hash-partitioned by that key, so that only walkers
are shuffled; every ``every`` steps what was walked is written and the plan starts anew.

Few walkers on a large graph touch little of it: then a step takes the lists of the vertices they stand on out of the edges, numbers
the slots of those alone, and joins as above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, draw_unit
from ..plans.staging import discard, stage
from .graph import Graph, Reached, weighted_arcs
from .triangles import acceptance, drawn_slots, second_order_law  # noqa: F401

#: Walkers that are few, and arcs of a graph that is large for them.
FEW, MANY = 10_000, 2_000_000
_PATH = "array<struct<step:int,vertex:bigint>>"


def start_walkers(graph: Graph, walkers: int, seed: int, first: int = 0, starts: DataFrame | None = None) -> DataFrame:
    """walker_id (from ``first`` on), vertex, degree (and what else ``starts`` has): uniform over all vertices, with replacement."""
    if walkers < 0:
        raise ValueError("walkers: at least 0")
    spark: SparkSession = graph.edges.sparkSession
    starts = graph.starts if starts is None else starts
    n = starts.count()
    if walkers and not n:
        raise ValueError("walkers on a graph without vertices")
    drawn = spark.range(first, first + walkers).select(F.col("id").alias("walker_id"))
    drawn = drawn.withColumn("start", draw(seed, F.col("walker_id"), 0) % F.lit(max(n, 1)))
    return drawn.join(starts, "start").drop("start").withColumnRenamed("name", "vertex")


def are_few(graph: Graph, walkers: int) -> bool:
    """Whether walkers are so few for a graph that only the lists they come to are looked at."""
    return walkers <= FEW and graph.arc_count >= MANY


def _slot_number(graph: Graph, drawn: Column) -> Column:
    """The slot a walker takes; at a sink an error, or a number no slot has (its own, so that such rows stay spread)."""
    if graph.on_sink == "error":
        fail = F.raise_error(F.concat(F.lit("walker at a vertex without arcs: "), F.col("vertex").cast("string")))
        return F.when(F.col("degree") > 0, drawn).otherwise(fail.cast("long"))
    return F.when(F.col("degree") > 0, drawn).otherwise(-1 - F.col("walker_id"))


def _moved(found: DataFrame) -> DataFrame:
    """Walkers after a step: where ``next`` is null the walker has ended and stays."""
    went = F.col("next").isNotNull()
    path = F.when(went, F.concat("path", F.array(F.struct((F.col("step") + 1).cast("int").alias("step"), F.col("next").alias("vertex"))).cast(_PATH))).otherwise(F.col("path"))
    return found.select(
        "walker_id",
        (F.col("step") + 1).alias("step"),
        F.when(went, F.col("vertex")).otherwise(F.col("prev")).alias("prev"),
        F.when(went, F.col("degree")).otherwise(F.col("prev_degree")).alias("prev_degree"),
        F.coalesce("next", "vertex").alias("vertex"),
        F.when(went, F.col("next_degree")).otherwise(F.lit(0)).alias("degree"),
        path.alias("path"),
    )


def step_uniform(here: DataFrame, graph: Graph, seed: int) -> DataFrame:
    """Moves walkers (walker_id, step, prev, prev_degree, vertex, degree, path) along a uniformly drawn arc.

    ``step`` counts the steps made; as a column and not a number of the plan, it lets all steps run the same compiled code.
    """
    here = here.withColumn("k", _slot_number(graph, draw(seed, F.col("walker_id"), F.col("step") + 1) % F.col("degree")))
    arcs = graph.steps.select(F.col("src").alias("vertex"), "k", F.col("dst").alias("next"), F.col("dst_degree").alias("next_degree"))
    return _moved(here.join(arcs, ["vertex", "k"], "left"))


def step_second_order(here: DataFrame, graph: Graph, seed: int, p: float, q: float, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Moves walkers by the law ``weight * (1/p to prev, 1 to neighbours of prev, 1/q else)``; also gives the staged table to discard afterwards.

    ``rounds`` rounds of rejection: a drawn arc is accepted or not from the draw alone where that
    decides, else by whether prev has an arc to it. Walkers that no round moves draw from all their
    arcs by weight, of which only those back and to common neighbours are looked at. As rounds are independent, the law is exact.
    """
    back, out = 1.0 / p, 1.0 / q
    upper = max(1.0, back, out)
    step = F.col("step") + 1
    arcs = graph.steps.select(F.col("src").alias("vertex"), "k", F.col("dst").alias("cand"), F.col("dst_degree").alias("cand_degree"))
    known = graph.pairs.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.lit(True).alias("_arc"))
    none = F.lit(None).cast("long")
    now = here.withColumn("next", none).withColumn("next_degree", none)
    own = -1 - F.col("walker_id")
    for r in range(rounds):
        open_ = F.col("next").isNull() & (F.col("degree") > 0)
        now = now.withColumn("k", F.when(open_, draw(seed, F.col("walker_id"), step, 2 * r) % F.col("degree")).otherwise(own))
        now = now.join(arcs, ["vertex", "k"], "left").withColumn("u", draw_unit(seed, F.col("walker_id"), step, 2 * r + 1) * upper)
        easy = F.when(F.col("prev").isNull(), F.lit(True)).when(F.col("cand") == F.col("prev"), F.col("u") < back).when(F.col("u") < min(1.0, out), F.lit(True)).when(F.col("u") >= max(1.0, out), F.lit(False))
        now = now.withColumn("ok", F.when(F.col("cand").isNotNull(), easy))
        ask = F.col("cand").isNotNull() & F.col("ok").isNull()
        now = now.withColumn("_from", F.when(ask, F.col("prev")).otherwise(own)).withColumn("_to", F.when(ask, F.col("cand")).otherwise(own))
        now = now.join(known, ["_from", "_to"], "left")
        ok = F.when(ask, F.col("u") < F.when(F.col("_arc"), 1.0).otherwise(out)).otherwise(F.coalesce("ok", F.lit(False)))
        now = now.withColumn("ok", ok).withColumn("next", F.when(F.col("ok"), F.col("cand")).otherwise(F.col("next"))).withColumn("next_degree", F.when(F.col("ok"), F.col("cand_degree")).otherwise(F.col("next_degree")))
        now = now.drop("k", "cand", "cand_degree", "u", "ok", "_from", "_to", "_arc")
    now = stage(now, "proposed")
    left = now.filter("next is null and degree > 0").select("walker_id", "step", "prev", "prev_degree", "vertex", "degree")
    if left.isEmpty():
        return _moved(now), now
    late = drawn_slots(left.withColumn("u", draw_unit(seed, F.col("walker_id"), step, 2 * rounds)), graph.weights, p, q)
    late = late.join(arcs, ["vertex", "k"]).select("walker_id", F.col("cand").alias("_late"), F.col("cand_degree").alias("_late_degree"))
    late = now.join(late, "walker_id", "left")
    late = late.withColumn("next", F.coalesce("next", "_late")).withColumn("next_degree", F.coalesce("next_degree", "_late_degree"))
    return _moved(late), now


def _walk(graph: Graph, walkers: int, length: int, seed: int, every: int, move: Callable[[DataFrame, Graph, int], tuple[DataFrame, DataFrame | None]], walker: int = 0) -> DataFrame:
    """walker_id, step, vertex. Within a round the path rides along; between rounds only the position does."""
    if length < 1:
        raise ValueError("length counts vertices: at least 1")
    none = F.lit(None).cast("long")
    few = are_few(graph, walkers)
    # Degrees of few walkers' vertices are counted as they come to them.
    starts = graph.numbered.withColumn("degree", F.lit(0).cast("long")) if few else None
    here = stage(start_walkers(graph, walkers, seed, walker, starts).select("walker_id", F.lit(0).cast("long").alias("step"), none.alias("prev"), none.alias("prev_degree"), "vertex", "degree"), "walkers")
    parts = [here.select("walker_id", F.lit(0).alias("step"), "vertex")]
    if few:
        return reduce(DataFrame.unionByName, [*parts, *_few_steps(graph, here, length, move)])
    for first in range(1, length, every):
        here, used = here.withColumn("path", F.array().cast(_PATH)), []
        for step in range(first, min(first + every, length)):
            here, left = move(here, graph, step)
            used += [left] if left is not None else []
        here = stage(here, "walkers")
        discard(*used)
        parts.append(here.select("walker_id", F.explode("path").alias("p")).select("walker_id", "p.step", "p.vertex"))
        here = here.drop("path")
    return reduce(DataFrame.unionByName, parts)


def _few_steps(graph: Graph, here: DataFrame, length: int, move: Callable[[DataFrame, Graph, int], tuple[DataFrame, DataFrame | None]]) -> Iterator[DataFrame]:
    """walker_id, step, vertex of each step of few walkers: a pass over the edges finds the lists of where they are and come from."""
    for step in range(1, length):
        near = Reached(graph, here.select(F.explode(F.array("prev", "vertex")).alias("vertex")).filter("vertex is not null").distinct())
        found = here.drop("degree").join(near.degrees.withColumnRenamed("src", "vertex"), "vertex", "left")
        found = found.withColumns({"degree": F.coalesce("degree", F.lit(0)), "path": F.array().cast(_PATH)})
        moved, left = move(found, near, step)
        here = stage(moved, "walkers")
        discard(near.arcs, near.slots, *([] if left is None else [left]))
        yield here.select("walker_id", F.explode("path").alias("p")).select("walker_id", "p.step", "p.vertex")
        here = here.drop("path")


def deepwalk(graph: Graph, walkers: int, length: int, seed: int = 1, every: int = 8, first: int = 0) -> DataFrame:
    """walker_id (from ``first`` on), step, vertex: uniform walks of ``length`` vertices (fewer where one stops at a sink)."""
    return _walk(graph, walkers, length, seed, every, lambda here, at, step: (step_uniform(here, at, seed), None), first)


def node2vec(graph: Graph, walkers: int, length: int, p: float, q: float, seed: int = 1, rounds: int = 3, every: int = 4, first: int = 0) -> DataFrame:
    """walker_id (from ``first`` on), step, vertex: second-order walks; the first step is uniform."""
    if not (p > 0 and q > 0):
        raise ValueError("p and q: above 0")

    def move(here: DataFrame, at: Graph, step: int) -> tuple[DataFrame, DataFrame | None]:
        return (step_uniform(here, at, seed), None) if step == 1 else step_second_order(here, at, seed, p, q, rounds)

    return _walk(graph, walkers, length, seed, every, move, first)


def paths(walks: DataFrame) -> DataFrame:
    """walker_id, path: a row per walker."""
    steps = F.array_sort(F.collect_list(F.struct("step", "vertex")))
    return walks.groupBy("walker_id").agg(F.transform(steps, lambda s: s["vertex"]).alias("path"))


def first_order_law(arcs: DataFrame) -> DataFrame:
    """src, dst, prob: duplicates weigh."""
    total = Window.partitionBy("src")
    return weighted_arcs(arcs).select("src", "dst", (F.col("weight") / F.sum("weight").over(total)).alias("prob"))
