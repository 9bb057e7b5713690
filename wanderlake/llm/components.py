"""Connected components of links as DataFrame joins: nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """Small tables in few files: what is known to be ``rows`` rows at most, in as many parts as that takes."""
    return df.coalesce(max(1, -(-rows // each)))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, root (the smallest id reachable) for every id that has a link.

    Each round hooks every node to its least neighbour, follows those hooks four steps, and draws each
    node into where it got: links inside vanish, so rounds get smaller, and a chain shrinks to a fourth.
    The least id of a class never hooks, so it is what the class ends as. Each round is written.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a)))
    size = 2 * links.count()
    edges = stage(_few(both.filter("u != v").distinct(), size), "edges")
    found = None
    while True:
        hooks = edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("up"))
        hooks = stage(_few(hooks, size), "hooks")
        for _ in range(2):
            further = hooks.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
            hooks = stage(_few(hooks.join(further, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up")), size), "hooks")
        step = hooks.select(F.col("id").alias("_id"), "up")
        if found is None:
            found = hooks.select("id", F.col("up").alias("root"))
        else:
            found = stage(_few(found.join(step, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("up", "root").alias("root")), size), "roots")
        left = edges.join(step, F.col("u") == F.col("_id")).select(F.col("up").alias("u"), "v")
        left = left.join(step, F.col("v") == F.col("_id")).select("u", F.col("up").alias("v"))
        shorter = stage(_few(left.filter("u != v").distinct(), size), "edges")
        discard(edges)
        edges = shorter
        if edges.isEmpty():
            return found
