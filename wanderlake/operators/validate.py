"""Checks of walks against graphs and laws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import weighted_arcs

# Limits of average, median and 99th percentile under which walks count as converged.
GATES = {"bhattacharyya": (0.005, 0.005, 0.015), "linf": (0.01, 0.01, 0.03)}


def transitions(walks: DataFrame) -> DataFrame:
    """walker_id, step, src, dst of each move."""
    nxt = F.lead("vertex").over(Window.partitionBy("walker_id").orderBy("step"))
    return walks.select("walker_id", "step", F.col("vertex").alias("src"), nxt.alias("dst")).filter("dst is not null")


def illegal_transitions(walks: DataFrame, arcs: DataFrame) -> DataFrame:
    """The moves that follow no arc."""
    return transitions(walks).join(arcs.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def path_transition_counts(paths: DataFrame, arcs: DataFrame) -> DataFrame:
    """As ``transition_counts``, of walks with a row a walker (``path``): each path is cut into its moves where it is.

    Moves are dealt by (src, dst), as arcs are: nearly all of a task's are different, so that adding them up before would gain nothing.
    """
    n = F.size("path") - 1
    moves = F.arrays_zip(F.slice("path", F.lit(1), n).alias("src"), F.slice("path", F.lit(2), n).alias("dst"))
    moves = paths.filter(F.size("path") > 1).select(F.inline(moves)).toDF("src", "dst")
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = moves.repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("observed"))
    return weighted_arcs(arcs).join(seen, ["src", "dst"], "left").select("src", "dst", "weight", F.coalesce("observed", F.lit(0)).alias("observed"))


def transition_counts(walks: DataFrame, arcs: DataFrame) -> DataFrame:
    """src, dst, weight, observed of every distinct arc."""
    seen = transitions(walks).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("observed"))
    return weighted_arcs(arcs).join(seen, ["src", "dst"], "left").select("src", "dst", "weight", F.coalesce("observed", F.lit(0)).alias("observed"))


def second_order_transitions(walks: DataFrame) -> DataFrame:
    """walker_id, step, prev, cur, next of each move but a walker's first."""
    walker = Window.partitionBy("walker_id").orderBy("step")
    return walks.select("walker_id", "step", F.col("vertex").alias("prev"), F.lead("vertex").over(walker).alias("cur"), F.lead("vertex", 2).over(walker).alias("next")).filter("next is not null")


def second_order_counts(walks: DataFrame) -> DataFrame:
    """prev, cur, next, observed of every transition that was made."""
    return second_order_transitions(walks).groupBy("prev", "cur", "next").agg(F.count(F.lit(1)).alias("observed"))


def against_law(law: DataFrame, counts: DataFrame) -> DataFrame:
    """prev, cur, next, weight (by the law) and observed (0 if never) of every transition of the law."""
    found = law.join(counts, ["prev", "cur", "next"], "left")
    return found.select("prev", "cur", "next", F.col("prob").alias("weight"), F.coalesce("observed", F.lit(0)).alias("observed"))


def distances(counts: DataFrame, at: tuple[str, ...] = ("src",)) -> DataFrame:
    """``at``, bhattacharyya, linf, tvd between the expected and observed distribution of the moves from a vertex, or from a pair of them.

    Where no walk leaves it has 10, 1 and 1.
    """
    here = counts.groupBy(*at).agg(F.sum("weight").alias("_w"), F.sum("observed").alias("_o"))
    a, b = F.col("weight") / F.col("_w"), F.col("observed") / F.nullif(F.col("_o"), F.lit(0))
    rows = counts.join(here, list(at))
    out = rows.groupBy(*at).agg(F.max("_o").alias("_o"), F.sum(F.sqrt(a * b)).alias("_c"), F.max(F.abs(a - b)).alias("_m"), (F.sum(F.abs(a - b)) / 2).alias("_t"))
    seen = F.col("_o") > 0
    return out.select(*at, F.when(seen, -F.ln("_c")).otherwise(10.0).alias("bhattacharyya"), F.when(seen, F.col("_m")).otherwise(1.0).alias("linf"), F.when(seen, F.col("_t")).otherwise(1.0).alias("tvd"))


def at_places(found: DataFrame, places: dict[tuple[str, int], int], buckets: int = 1024) -> dict[tuple[str, int], float]:
    """The exact values at ``places`` ((column, any tag) -> 0-based place) of sorted columns without nulls, with no sort.

    Each pass counts the rows of equal buckets of the span that a place is known to lie in, and goes on in the bucket that has
    it, whose smallest and largest row are known; as those fall into different buckets, spans shrink until the place is an end of
    its span. A pass reads the columns once for all places and sends a bucket a row to the driver.
    """
    ends = found.agg(*[f(c).alias(f"{n}_{c}") for c in {c for c, _ in places} for n, f in (("lo", F.min), ("hi", F.max))]).first()
    spans = {k: (ends[f"lo_{k[0]}"], ends[f"hi_{k[0]}"], 0) for k in places}
    out: dict[tuple[str, int], float] = {}
    while True:
        out |= {k: lo for k, (lo, hi, _) in spans.items() if lo == hi}
        open_ = [k for k in places if k not in out]
        if not open_:
            return out
        parts = []
        for i, k in enumerate(open_):
            (lo, hi, _), x = spans[k], F.col(k[0])
            bucket = F.least(F.floor((x - lo) / (hi / 2 - lo / 2) * (buckets / 2)), F.lit(buckets - 1))
            parts.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(i).alias("i"), bucket.alias("bucket"), x.alias("x"))))
        rows = found.select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).groupBy("p.i", "p.bucket")
        rows = rows.agg(F.count(F.lit(1)).alias("n"), F.min("p.x").alias("lo"), F.max("p.x").alias("hi")).collect()
        for i, k in enumerate(open_):
            below = spans[k][2]
            for r in sorted((r for r in rows if r["i"] == i), key=lambda r: r["bucket"]):
                if places[k] < below + r["n"]:
                    ends_at = {below: r["lo"], below + r["n"] - 1: r["hi"]}
                    spans[k] = (ends_at[places[k]],) * 2 + (below,) if places[k] in ends_at else (r["lo"], r["hi"], below)
                    break
                below += r["n"]


def distance_summary(found: DataFrame, metrics: tuple[str, ...] = ("bhattacharyya", "linf")) -> DataFrame:
    """metric, avg, median, p99: the values at places n // 2 and int(0.99 n) of the sorted distances; null where there are none."""
    row = found.agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics]).first()
    n = row["n"]
    got = at_places(found, {(m, k): at for m in metrics for k, at in enumerate((n // 2, int(n * 0.99)))}) if n else {}
    rows = [(m, row[m], got.get((m, 0)), got.get((m, 1))) for m in metrics]
    return found.sparkSession.createDataFrame(rows, "metric string, avg double, median double, p99 double")


def converged(summary: DataFrame) -> DataFrame:
    """converged: whether every metric lies under its limits."""
    ok = F.lit(False)
    for metric, (avg, median, p99) in GATES.items():
        ok = ok | ((F.col("metric") == metric) & (F.col("avg") < avg) & (F.col("median") < median) & (F.col("p99") < p99))
    return summary.agg(F.min(ok).alias("converged"))


def partition_faults(assigned: DataFrame) -> DataFrame:
    """pid, fault of partitions that do not continue where the last one ended; ``assigned``: vid, pid."""
    spans = assigned.groupBy("pid").agg(F.min("vid").alias("lo"), F.max("vid").alias("hi"), F.count(F.lit(1)).alias("n"))
    # One row per partition.
    before = F.lag("hi").over(Window.orderBy("pid"))
    spans = spans.withColumn("_before", before)
    fault = F.when(F.col("n") != F.col("hi") - F.col("lo") + 1, "gap inside").when(F.coalesce(F.col("_before") + 1, F.lit(0)) != F.col("lo"), "gap before")
    return spans.select("pid", fault.alias("fault")).filter("fault is not null")
