"""Joins of many rows to one row per key, where a key may hold a large part of the many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def spread_join(many: DataFrame, one: DataFrame, on: list[str], how: str = "inner", least: int = 10_000) -> DataFrame:
    """``many`` joined (``inner`` or ``left``) with ``one``, which has at most one row a key; no key's rows meet in one task.

    Keys are counted first. A key is hot if it has ``least`` rows and over a quarter of an even share of a task: by that, there are
    at most four a task, however many rows there are. What ``one`` says of them is broadcast, after a check of that number, so
    their rows stay where they are; all others meet in a shuffle. ``many`` is read twice more, so it should be staged. A null key
    matches nothing. Columns: the keys, ``many``'s others, ``one``'s others.
    """
    if how not in ("inner", "left"):
        raise ValueError("how: inner or left")
    spark = many.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [*on, *[c for c in many.columns if c not in on], *[c for c in one.columns if c not in on]]
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = stage(counts.filter(F.col("_n") >= F.lit(max(least, many.count() // (4 * tasks)))).drop("_n"), "hot")
    found = hot.count()
    if not found:
        return many.join(one, on, how).select(names)
    if found > 4 * tasks + 1:
        raise ValueError("more hot keys than there can be")  # by the counts this cannot happen
    known = stage(one.join(F.broadcast(hot), on, "left_semi"), "hot_rows")
    if known.count() > found:
        raise ValueError("one: several rows of a key")
    here = many.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(known), on, how)
    rest = many.join(F.broadcast(hot), on, "left_anti").join(one, on, how)
    return reduce(DataFrame.unionByName, [x.select(names) for x in (here, rest)])
