"""Random graphs from stateless draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw


def random_multigraph(spark: SparkSession, vertices: int, edges: int, seed: int = 1) -> DataFrame:
    """edge_idx, src, dst: the first ``vertices`` edges leave each vertex once; loops and duplicates may occur."""
    if not 0 < vertices <= edges:
        raise ValueError("vertices: 1 to the number of edges")
    i = F.col("id")
    src = F.when(i < vertices, i).otherwise(draw(seed, i, 0) % vertices)
    return spark.range(edges).select(i.alias("edge_idx"), src.alias("src"), (draw(seed, i, 1) % vertices).alias("dst"))


def random_simple_graph(spark: SparkSession, vertices: int, edges: int, seed: int = 1) -> DataFrame:
    """edge_idx, src, dst: both directions of at most ``edges`` distinct undirected pairs without loops.

    Every vertex gets a pair; draws that repeat a pair are one.
    """
    if vertices < 2:
        raise ValueError("vertices: at least 2")
    i = F.col("id")
    a = F.when(i < vertices, i).otherwise(draw(seed, i, 0) % vertices)
    b = (a + 1 + draw(seed, i, 1) % (vertices - 1)) % vertices
    pairs = spark.range(max(edges, vertices)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), i)
    pairs = pairs.groupBy("a", "b").agg(F.min("id").alias("id"))
    both = F.array(F.struct((2 * i).alias("edge_idx"), F.col("a").alias("src"), F.col("b").alias("dst")), F.struct((2 * i + 1).alias("edge_idx"), F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.explode(both).alias("e")).select("e.edge_idx", "e.src", "e.dst")
