"""Command line: walks over a graph file, and conversion of graph files.

python -m wanderlake deepwalk -f text -g GRAPH -l 80 -e 10 [-o WALKS]
python -m wanderlake node2vec -f text -g GRAPH -l 80 -w 1000000 -p 2 -q 0.5 [-o WALKS]
python -m wanderlake dense -i TEXT -o BINARY
python -m wanderlake edges -i ADJACENCY [ADJACENCY ...] [-b BINARY] [-t TEXT]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators import graph as g
from .plans.layout import walk_info, watched
from .plans.staging import stage
from .plans.strategy import STRATEGIES, WalkEngine
from .sources import edges as io


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wanderlake")
    kinds = top.add_subparsers(dest="command", required=True)
    for name in ("deepwalk", "node2vec"):
        p = kinds.add_parser(name)
        p.add_argument("-f", choices=["text", "binary", "adjacency"], required=True, help="format of the graph")
        p.add_argument("-g", required=True, help="graph file or folder")
        p.add_argument("-l", type=int, required=True, help="vertices per walk")
        count = p.add_mutually_exclusive_group(required=True)
        count.add_argument("-e", type=int, help="walkers per vertex, on average")
        count.add_argument("-w", type=int, help="walkers")
        p.add_argument("--directed", action="store_true")
        p.add_argument("--on-sink", choices=["error", "stop"], default="error")
        p.add_argument("--strategy", choices=list(STRATEGIES), default="auto")
        p.add_argument("--seed", type=int, default=1)
        p.add_argument("-o", help="folder for the walks, as Parquet")
        p.add_argument("--info", action="store_true", help="also visits by degree")
        if name == "node2vec":
            p.add_argument("-p", type=float, required=True, help="return parameter")
            p.add_argument("-q", type=float, required=True, help="in-out parameter")
    p = kinds.add_parser("dense", help="text edges to binary ones with dense first-seen numbers, and the sidecar of counts")
    p.add_argument("-i", required=True)
    p.add_argument("-o", required=True)
    p = kinds.add_parser("edges", help="adjacency lists to edges")
    p.add_argument("-i", nargs="+", required=True)
    p.add_argument("-b", help="binary output")
    p.add_argument("-t", help="text output")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict | None:
    """Runs a command; walks return their metrics."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("wanderlake").getOrCreate()
    if args.command == "dense":
        found = stage(io.read_text_edges(spark, args.i), "edges")
        names = stage(g.dictionary(found), "names")
        io.write_binary_edges(g.relabel(found, names), args.o)
        io.write_info(args.o, names.count(), found.count(), spark)
        return None
    if args.command == "edges":
        found = stage(io.read_adjacency_text(spark, args.i), "edges")
        if args.b:
            io.write_binary_edges(found, args.b)
        if args.t:
            io.write_text_edges(found, args.t)
        return None
    phases, began = {}, time.perf_counter()

    def ended(phase: str) -> None:
        nonlocal began
        phases[f"{phase}_seconds"] = round(time.perf_counter() - began, 3)
        began = time.perf_counter()

    graph = g.Graph.load(spark, args.g, args.f, args.directed, args.on_sink)
    ended("load")
    engine = WalkEngine(graph, args.strategy, seed=args.seed)
    engine.prepare(args.command == "node2vec")
    ended("prepare")
    how = {"walkers": args.w, "epochs": args.e}
    walks = engine.deepwalk(args.l, **how) if args.command == "deepwalk" else engine.node2vec(args.l, args.p, args.q, **how)
    walks, seen = watched(walks)  # counted as they are written
    if args.o:
        walks.write.parquet(args.o)
        walks = spark.read.parquet(args.o)
    else:
        walks = stage(walks, "walks")
    ended("walk")
    row = seen.get
    seconds, threads = phases["walk_seconds"], spark.sparkContext.defaultParallelism
    row |= {"seconds": seconds, "vertices_per_second": row["vertices"] / seconds, "ns_per_step": seconds * 1e9 * threads / row["vertices"] if row["vertices"] else 0.0, **phases}
    print(row)
    if args.info:
        walk_info(walks, graph.ends).orderBy("band").show(100, False)
    return row


if __name__ == "__main__":
    main()
