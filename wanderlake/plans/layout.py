"""Partition diagnostics, walker batches and run metrics."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def group_bits(vertices: int, groups: int = 128) -> tuple[int, int]:
    """The smallest power of two that makes at most ``groups`` groups, and their number."""
    bits = 0
    while vertices >> bits > groups:
        bits += 1
    return bits, -(-vertices // (1 << bits))


def assign_partitions(ranked: DataFrame, bits: int) -> DataFrame:
    """vid, pid: ranges of 2 ** bits vertices."""
    return ranked.select("vid", F.shiftright("vid", bits).alias("pid"))


def partition_stats(ranked: DataFrame, bits: int) -> DataFrame:
    """pid, edges, min_degree, max_degree."""
    return ranked.groupBy(F.shiftright("vid", bits).alias("pid")).agg(F.sum("degree").alias("edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


def snake_deal(ranked: DataFrame, bits: int, threads: int) -> DataFrame:
    """vid, pid, slot: vertices of the first ``threads`` partitions dealt to and fro, so that degrees even out; the rest as they are."""
    count = ranked.count()
    hot = min(threads, count >> bits)
    turn, j = F.floor(F.col("vid") / F.lit(max(hot, 1))), F.col("vid") % F.lit(max(hot, 1))
    dealt = F.col("vid") < F.lit(hot << bits)
    pid = F.when(dealt, F.when(turn % 2 == 0, j).otherwise(hot - 1 - j)).otherwise(F.shiftright("vid", bits))
    slot = F.when(dealt, turn).otherwise(F.col("vid").bitwiseAND(F.lit((1 << bits) - 1)))
    return ranked.select("vid", pid.alias("pid"), slot.alias("slot"))


def epoch_plan(walkers: int, length: int, free_bytes: int) -> list[tuple[int, int]]:
    """(epoch, walkers) so that an epoch's positions and messages fit ``free_bytes``."""
    cap = free_bytes // (4 * (2 * length + 3))
    if walkers <= 0:
        return []
    if cap <= 0:
        raise ValueError("no memory for a walker")
    epochs = ceil(walkers / min(cap, walkers))
    size = ceil(walkers / epochs)
    return [(e, min(size, walkers - e * size)) for e in range(epochs) if walkers > e * size]


def walk_metrics(walks: DataFrame, seconds: float | None = None, threads: int = 1) -> DataFrame:
    """walkers, vertices, transitions[, seconds, vertices_per_second, ns_per_step]."""
    out = walks.agg(F.countDistinct("walker_id").alias("walkers"), F.count(F.lit(1)).alias("vertices")).withColumn("transitions", F.col("vertices") - F.col("walkers"))
    if seconds is None:
        return out
    per = F.when(F.col("vertices") > 0, F.lit(seconds * 1e9 * threads) / F.col("vertices")).otherwise(0.0)
    return out.withColumns({"seconds": F.lit(seconds), "vertices_per_second": F.col("vertices") / F.lit(seconds), "ns_per_step": per})


def watched(walks: DataFrame, name: str = "walks") -> tuple[DataFrame, Observation]:
    """The walks, and what is counted of them as they are written or read for the first time: walkers, vertices, transitions, last_step; no pass of its own."""
    seen = Observation(name)
    first = F.count_if(F.col("step") == 0)
    return walks.observe(seen, first.alias("walkers"), F.count(F.lit(1)).alias("vertices"), (F.count(F.lit(1)) - first).alias("transitions"), F.max("step").alias("last_step")), seen


def walk_info(walks: DataFrame, ends: DataFrame) -> DataFrame:
    """band, vertices, arcs, visits, starts: by the power of two under a vertex's degree (-1: no arcs), what the graph has and where the walks went.

    ``ends``: name, degree. Visits are added up by vertex before they meet degrees, so a hub is one row.
    """
    visits = walks.groupBy(F.col("vertex").alias("name")).agg(F.count(F.lit(1)).alias("visits"), F.count_if(F.col("step") == 0).alias("starts"))
    band = F.when(F.col("degree") > 0, F.length(F.bin("degree")) - 1).otherwise(-1).alias("band")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return ends.join(visits, "name", "left").groupBy(band).agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("arcs"), total("visits"), total("starts"))
