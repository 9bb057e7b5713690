"""Walks in one pass for graphs that fit a task: the packed adjacency is broadcast, no step is shuffled.

The same draws as the join strategy, so the same walks, row for row. ``fits`` checks the size first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import RANGE, draw_values
from .graph import Graph

#: Bytes up to which the adjacency is gathered and sent to every executor.
LIMIT = 256 << 20


def kernel_bytes(graph: Graph) -> int:
    """Bytes that the driver holds to pack the adjacency: 32 per vertex, 16 per arc (of which 16 and 4 are sent)."""
    vertices, arcs = graph.counts
    return 32 * vertices + 16 * arcs


def fits(graph: Graph, limit: int = LIMIT) -> bool:
    """Whether the kernel may be used."""
    return 16 * graph.arc_count <= limit and kernel_bytes(graph) <= limit


def packed_adjacency(graph: Graph, limit: int = LIMIT) -> dict[str, np.ndarray]:
    """Sorted names, row offsets and neighbours (as places among the names) of a graph within ``limit``.

    Tasks sort the arcs and turn names into places; the driver puts what they packed one behind the other.
    """
    if not fits(graph, limit):
        raise ValueError("the adjacency exceeds what is broadcast; walk by joins")
    names = np.sort(graph.names.toArrow().column(0).to_numpy())
    sent = graph.edges.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for at, batch in enumerate(batches):
            src, dst = (np.searchsorted(sent.value, c.to_numpy()).astype("<i4") for c in batch.columns)
            ends, count = np.unique(src, return_counts=True)
            packed = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (ends, count, dst)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int32()), *packed], names=["part", "at", "ends", "count", "to"])

    found = graph.arcs.select("src", "dst").orderBy("src", "dst").mapInArrow(run, "part int, at int, ends binary, count binary, to binary").toArrow()
    degree, to, filled = np.zeros(len(names), np.int64), np.empty(graph.arc_count, "<i4"), 0
    for i in np.lexsort((found.column("at").to_numpy(), found.column("part").to_numpy())).tolist():
        ends, count, here = (np.frombuffer(found.column(c)[i].as_buffer(), "<i4") for c in ("ends", "count", "to"))
        degree[ends] += count
        to[filled : filled + len(here)] = here
        filled += len(here)
    return {"names": names, "offsets": np.concatenate([[0], np.cumsum(degree)]), "to": to}


class _Walker:
    """Steps of batches of walkers (``ids``) over the packed adjacency."""

    def __init__(self, graph: dict[str, np.ndarray], seed: int, second_order: bool):
        self.names, self.offsets, self.to = graph["names"], graph["offsets"], graph["to"]
        self.degree = np.diff(self.offsets)
        self.ids, self.seed = np.zeros(0, np.int64), seed
        # Arcs as numbers, to look pairs up in; only second-order steps ask.
        self.keys = np.repeat(np.arange(len(self.names)), self.degree) * len(self.names) + self.to if second_order else None

    def draws(self, which: np.ndarray, step: int, salt: int = 0) -> np.ndarray:
        return draw_values(self.seed, self.ids[which], step, salt)

    def has_arc(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        want = src.astype(np.int64) * len(self.names) + dst
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return self.keys[at] == want

    def uniform(self, alive: np.ndarray, cur: np.ndarray, step: int) -> np.ndarray:
        return self.to[self.offsets[cur] + self.draws(alive, step) % self.degree[cur]]

    def second_order(self, alive: np.ndarray, prev: np.ndarray, cur: np.ndarray, step: int, p: float, q: float, rounds: int) -> np.ndarray:
        back, out = 1.0 / p, 1.0 / q
        upper = max(1.0, back, out)
        found = np.full(len(cur), -1)
        open_ = np.arange(len(cur))
        for r in range(rounds):
            if not len(open_):
                return found
            cand = self.to[self.offsets[cur[open_]] + self.draws(alive[open_], step, 2 * r) % self.degree[cur[open_]]]
            u = self.draws(alive[open_], step, 2 * r + 1) / float(RANGE) * upper
            level = np.where(cand == prev[open_], back, np.where(self.has_arc(prev[open_], cand), 1.0, out))
            ok = u < level
            found[open_[ok]] = cand[ok]
            open_ = open_[~ok]
        last = self.draws(alive[open_], step, 2 * rounds) / float(RANGE)
        for i, u in zip(open_.tolist(), last.tolist(), strict=True):
            ends, weight = np.unique(self.to[self.offsets[cur[i]] : self.offsets[cur[i] + 1]], return_counts=True)
            level = np.where(ends == prev[i], back, np.where(self.has_arc(np.full(len(ends), prev[i]), ends), 1.0, out))
            mass = np.cumsum(weight * level)
            found[i] = ends[min(np.searchsorted(mass, u * mass[-1], side="right"), len(ends) - 1)]
        return found


def kernel_walks(graph: Graph, walkers: int, length: int, seed: int = 1, p: float | None = None, q: float | None = None, rounds: int = 3, limit: int = LIMIT, first: int = 0, paths: bool = False) -> DataFrame:
    """walker_id (from ``first`` on), step, vertex: uniform walks, or second-order ones where p and q are given; with ``paths`` a row a walker: walker_id, path."""
    spark = graph.edges.sparkSession
    if not fits(graph, limit):
        raise ValueError("the adjacency exceeds what is broadcast; walk by joins")
    if "_sent" not in graph.__dict__:  # once for any number of walks
        graph.__dict__["_sent"] = spark.sparkContext.broadcast(packed_adjacency(graph, limit))
    sent = graph.__dict__["_sent"]
    stop = graph.on_sink == "stop"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Walker(sent.value, seed, p is not None)
        for batch in batches:
            ids = w.ids = batch.column(0).to_numpy()
            alive = np.arange(len(ids))
            cur = w.draws(alive, 0) % max(len(w.names), 1)
            prev = np.full(len(ids), -1)
            rows = [(alive, 0, w.names[cur])]
            for step in range(1, length):
                ended = w.degree[cur] == 0
                if ended.any():
                    if not stop:
                        raise ValueError(f"walker at a vertex without arcs: {w.names[cur[ended][0]]}")
                    alive, cur, prev = alive[~ended], cur[~ended], prev[~ended]
                new = w.uniform(alive, cur, step) if p is None or step == 1 else w.second_order(alive, prev, cur, step, p, q, rounds)
                prev, cur = cur, new
                rows.append((alive, step, w.names[cur]))
            if paths:
                # Walkers end and never come back, so a walker's rows, in order of steps, are its path.
                at = np.concatenate([a for a, _, _ in rows])
                order = np.argsort(at, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(ids)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v for _, _, v in rows])[order]))], names=["walker_id", "path"])
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[a] for a, _, _ in rows])), pa.array(np.concatenate([np.full(len(a), s, np.int32) for a, s, _ in rows])), pa.array(np.concatenate([v for _, _, v in rows]))],
                names=["walker_id", "step", "vertex"],
            )

    return spark.range(first, first + walkers).select(F.col("id").alias("walker_id")).mapInArrow(run, "walker_id long, path array<bigint>" if paths else "walker_id long, step int, vertex long")
