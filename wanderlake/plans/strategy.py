"""Which way to walk, and walks in batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validate
from ..operators.graph import Graph
from ..operators.kernel import LIMIT, fits, kernel_walks
from ..operators.packed import packed_graph, packed_walks
from ..operators.triangles import second_order_law
from ..operators.walks import are_few, deepwalk, node2vec, paths
from .layout import epoch_plan
from .staging import discard, file_there, new_path, read_note, stage, stage_bucketed, write_note

STRATEGIES = ("auto", "kernel", "packed", "join")


class WalkEngine:
    """Walks over a graph, in one of three ways that give the same rows.

    ``kernel``: the packed adjacency, if within ``limit`` bytes, is broadcast; ``packed``: lists are dealt out and walkers go to them
    (uniform walks); ``join``: slots are rows. ``auto``: the kernel where it fits, else packed lists for uniform walks, and
    joins for second-order ones and for few walkers.
    """

    def __init__(self, graph: Graph, strategy: str = "auto", limit: int = LIMIT, seed: int = 1):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy: {', '.join(STRATEGIES)}")
        self.graph, self.strategy, self.limit, self.seed = graph, strategy, limit, seed

    def _walkers(self, walkers: int | None, epochs: int | None) -> int:
        if (walkers is None) == (epochs is None):
            raise ValueError("give walkers or epochs, not both")
        return walkers if walkers is not None else epochs * self.graph.counts[0]

    @property
    def uses_kernel(self) -> bool:
        """Whether walks go by kernel."""
        return self.strategy == "kernel" or self.strategy == "auto" and fits(self.graph, self.limit)

    def prepare(self, second_order: bool = False) -> None:
        """Makes what walks need of the graph, so that a walk's time is that of walking."""
        if self.uses_kernel:
            self.graph.counts  # noqa: B018  packed with the walk itself
        elif second_order or self.strategy == "join":
            self.graph.steps.count()
        else:
            packed_graph(self.graph)

    def walks(self, walkers: int, length: int, p: float | None = None, q: float | None = None, first: int = 0) -> DataFrame:
        """Walks of walkers from number ``first`` on: uniform, or of second order where p and q are given."""
        if (p is None) != (q is None) or p is not None and not (p > 0 and q > 0):
            raise ValueError("p and q: both above 0, or none")
        if self.uses_kernel:
            return kernel_walks(self.graph, walkers, length, self.seed, p, q, limit=self.limit, first=first)
        if p is not None:
            return node2vec(self.graph, walkers, length, p, q, self.seed, first=first)
        walk = deepwalk if self.strategy == "join" or self.strategy == "auto" and are_few(self.graph, walkers) else packed_walks
        return walk(self.graph, walkers, length, self.seed, first=first)

    def paths(self, walkers: int, length: int, p: float | None = None, q: float | None = None) -> DataFrame:
        """walker_id, path: a row a walker, which the kernel makes as such."""
        if self.uses_kernel:
            return kernel_walks(self.graph, walkers, length, self.seed, p, q, limit=self.limit, paths=True)
        return paths(self.walks(walkers, length, p, q))

    def deepwalk(self, length: int, walkers: int | None = None, epochs: int | None = None) -> DataFrame:
        """Uniform walks; ``epochs`` means that many walkers per vertex on average, their starts drawn."""
        return self.walks(self._walkers(walkers, epochs), length)

    def node2vec(self, length: int, p: float, q: float, walkers: int | None = None, epochs: int | None = None) -> DataFrame:
        """Second-order walks."""
        return self.walks(self._walkers(walkers, epochs), length, p, q)

    def batches(self, walkers: int, length: int, free_bytes: int) -> list[tuple[int, int]]:
        """Walker batches that fit a memory bound."""
        return epoch_plan(walkers, length, free_bytes)

    def _written(self, sizes: list[int], length: int, p: float | None, q: float | None, folder: str) -> Iterator[DataFrame]:
        """Batch after batch, each written to ``folder`` before the next; those that are there in whole are read, not walked again."""
        spark, done = self.graph.edges.sparkSession, 0
        plan = json.dumps({"seed": self.seed, "length": length, "p": p, "q": q, "on_sink": self.graph.on_sink, "graph": self.graph.counts, "first": sizes[:1]})
        note = f"{folder}/plan.json"
        if file_there(spark, note) and read_note(spark, note) != plan:
            raise ValueError(f"{folder} holds batches of other walks")
        write_note(spark, note, plan)
        for k, n in enumerate(sizes):
            path = f"{folder}/batch={k:06}"
            if not file_there(spark, f"{path}/_SUCCESS"):
                self.walks(n, length, p, q, first=done).write.mode("overwrite").option("compression", "zstd").parquet(path)
            yield spark.read.schema("walker_id long, step int, vertex long").parquet(path)
            done += n

    def in_batches(self, length: int, walkers: int, free_bytes: int, p: float | None = None, q: float | None = None, folder: str | None = None) -> DataFrame:
        """Walks made batch after batch, each within a memory bound and written before the next; the rows are those of ``walks``.

        With a ``folder``, a run that was cut short goes on after the last whole batch.
        """
        sizes = [n for _, n in self.batches(walkers, length, free_bytes)]
        if not sizes:
            return self.walks(0, length, p, q)
        return reduce(DataFrame.unionByName, self._written(sizes, length, p, q, folder or new_path(self.graph.edges.sparkSession, "batches")))

    def until_converged(self, length: int, walkers: int, most: int = 100, p: float | None = None, q: float | None = None, folder: str | None = None) -> tuple[DataFrame, bool]:
        """Walks, a batch of ``walkers`` more at a time, until their transitions pass the convergence gate; at most ``most`` batches.

        What was counted is kept in buckets of the vertex that is left, and a batch's counts, in the same buckets, are added to it: earlier walks
        are not read again. Second-order walks are held against the second-order law, whose rows are degree squared at hubs.
        """
        spark = self.graph.edges.sparkSession
        keys, at = (("src", "dst"), ("src",)) if p is None else (("prev", "cur", "next"), ("prev", "cur"))
        tasks, kept, parts, law, passed = int(spark.conf.get("spark.sql.shuffle.partitions")), None, [], None, False
        if p is not None:
            law = stage(second_order_law(self.graph.arcs, p, q), "law")
        for batch in self._written([walkers] * most, length, p, q, folder or new_path(spark, "batches")):
            parts.append(batch)
            if p is None:
                more = validate.transitions(batch).groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"))
            else:
                more = validate.second_order_counts(batch)
            more = stage_bucketed(more, "more", at[-1], tasks)
            merged = more if kept is None else more.unionByName(kept).groupBy(*keys).agg(F.sum("observed").alias("observed"))
            counts = more if kept is None else stage_bucketed(merged, "counts", at[-1], tasks)
            discard(*([] if kept is None else [more, kept]))
            kept = counts
            if p is None:
                found = self.graph.weights.join(counts, list(keys), "left").select("src", "dst", "weight", F.coalesce("observed", F.lit(0)).alias("observed"))
            else:
                found = validate.against_law(law, counts)
            far = stage(validate.distances(found, at), "distances")
            passed = validate.converged(validate.distance_summary(far)).first()[0]
            discard(far)
            if passed:
                break
        discard(*[x for x in (kept, law) if x is not None])
        return reduce(DataFrame.unionByName, parts), bool(passed)
