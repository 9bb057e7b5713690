"""Second-order laws from triangles: which arcs' ends have which neighbours in common, without walking all pairs of neighbours.

Edges are oriented from the end with fewer neighbours to the other, so no vertex has more than about sqrt(2 E) of them going out, and
pairs of those number E^1.5 at most, hubs or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from ..plans.staging import stage
from .graph import weighted_arcs

#: Edges of a task that looks for triangles, about; pairs of them that it makes at a time.
EDGES, PAIRS = 3_000_000, 2_000_000
#: Arcs of a list of the second-order law.
LIST = 512


def oriented_edges(weights: DataFrame) -> DataFrame:
    """lo, hi, hi_size, up, down: an edge between two vertices, the one with fewer neighbours (then the smaller name) first, with
    the arcs' weights both ways; 0 where there is none. Loops are left out."""
    edges = weights.filter("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    edges = stage(edges.agg(F.sum(F.expr("if(src < dst, weight, 0)")).alias("ab"), F.sum(F.expr("if(src < dst, 0, weight)")).alias("ba")), "edges")
    sizes = stage(edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("size")), "sizes")
    for end in ("a", "b"):
        edges = spread_join(edges, sizes.select(F.col("v").alias(end), F.col("size").alias(f"{end}_size")), [end])
    turn = F.struct(F.col("b_size"), F.col("b")) < F.struct(F.col("a_size"), F.col("a"))
    pick = lambda x, y, name: F.when(turn, F.col(x)).otherwise(F.col(y)).alias(name)
    return edges.select(pick("b", "a", "lo"), pick("a", "b", "hi"), pick("a_size", "b_size", "hi_size"), pick("ba", "ab", "up"), pick("ab", "ba", "down"))


def _deal(edges: DataFrame) -> DataFrame:
    """Edges with ``i, j, k``, the three vertex groups of a task: each edge goes to those tasks whose groups hold both of its ends.

    Of n groups of vertices an edge reaches n tasks, of which n (n + 1) (n + 2) / 6 hold ``EDGES`` edges or so each: what is shuffled
    is n rows an edge, and n grows as the square root of the edges, where the pairs of edges at a vertex are many times as many.
    """
    n = max(4, ceil(sqrt(6 * edges.count() / EDGES)))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    third = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = edges.withColumn("_g", F.array(group("lo"), group("hi"))).withColumn("_x", third)
    dealt = dealt.withColumn("_g", F.array_sort(F.concat("_g", F.array("_x"))))
    return dealt.select(*[F.col("_g")[at].alias(c) for at, c in enumerate("ijk")], "lo", "hi", "hi_size", "up", "down", group("lo").alias("lo_group"), group("hi").alias("hi_group"))


def _meetings(part: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a task's edges those three (as places: a to b, a to c, b to c) that make a triangle of one vertex of each of its groups.

    Vertices are numbered by (size, name), the order in which edges point; a source's pairs are made ``PAIRS`` or so at a time.
    """
    lo, hi, size = (part.column(c).to_numpy() for c in ("lo", "hi", "hi_size"))
    wanted = np.array([part.column(c)[0].as_py() for c in "ijk"])
    # A digit to base four for each of the groups counts how many vertices are of it.
    digit = np.zeros(wanted.max() + 1, np.int64)
    digit[np.unique(wanted)] = 4 ** np.arange(len(np.unique(wanted)))
    # A vertex that is the lower end of all its edges has no size here; it is never b or c of a pair, so any number will do.
    names, place = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    sizes = np.zeros(len(names), np.int64)
    sizes[place[: len(hi)]] = size
    number = np.empty(len(names), np.int64)
    number[np.lexsort((names, sizes))] = np.arange(len(names))
    src, dst = number[place[len(hi) :]], number[place[: len(hi)]]
    group = np.empty(len(names), np.int64)
    group[src], group[dst] = digit[part.column("lo_group").to_numpy()], digit[part.column("hi_group").to_numpy()]
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    keys = src * len(names) + dst
    # Each edge is the first of a pair with all later edges of its source.
    last = np.searchsorted(src, src, side="right")
    count = last - np.arange(len(src)) - 1
    upto = np.cumsum(count)
    begin = 0
    while begin < len(src):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")))
        here = count[begin:end]
        one = np.repeat(np.arange(begin, end), here)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(here) - here, here)
        right = group[src[one]] + group[dst[one]] + group[dst[two]] == digit[wanted].sum()
        one, two = one[right], two[right]
        want = dst[one] * len(names) + dst[two]
        at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        met = keys[at] == want
        yield order[one[met]], order[two[met]], order[at[met]]
        begin = end


def triangles(weights: DataFrame) -> DataFrame:
    """a, b, c of each triangle once, and the weights ab, ba, ac, ca, bc, cb of its arcs, 0 where there is none."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        found = [np.concatenate(x) for x in zip(*_meetings(part), strict=True)]
        column = lambda name, at: part.column(name).take(pa.array(at)).combine_chunks()
        one, two, three = found
        cols = [column("lo", one), column("hi", one), column("hi", two)]
        cols += [column(x, at) for at in (one, two, three) for x in ("up", "down")]
        return pa.Table.from_arrays(cols, names=["a", "b", "c", "ab", "ba", "ac", "ca", "bc", "cb"])

    edges = stage(oriented_edges(weights), "oriented")
    return _deal(edges).groupBy("i", "j", "k").applyInArrow(run, "a long, b long, c long, ab long, ba long, ac long, ca long, bc long, cb long")


def common_weights(weights: DataFrame) -> DataFrame:
    """prev, cur, w_common: the weight of cur's arcs to other vertices that prev leads to as well, where there are any; prev leads to cur and is not cur.

    Triangles are added up by edge in the tasks that find them, and never are rows.
    """

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        up, down = (part.column(c).to_numpy() for c in ("up", "down"))
        there, back = np.zeros(len(up), np.int64), np.zeros(len(up), np.int64)
        for ab, ac, bc in _meetings(part):
            # An edge, and the arcs of its lower and of its higher end to the third vertex.
            for at, low, high in ((ab, up[ac], up[bc]), (ac, up[ab], down[bc]), (bc, down[ab], down[ac])):
                there += np.bincount(at, np.where(low > 0, high, 0), len(up)).astype(np.int64)
                back += np.bincount(at, np.where(high > 0, low, 0), len(up)).astype(np.int64)
        some = np.flatnonzero((there > 0) | (back > 0))
        take = lambda name: part.column(name).take(pa.array(some)).combine_chunks()
        return pa.Table.from_arrays([take("lo"), take("hi"), pa.array(np.where(up > 0, there, 0)[some]), pa.array(np.where(down > 0, back, 0)[some])], names=["lo", "hi", "there", "back"])

    edges = stage(oriented_edges(weights), "oriented")
    found = _deal(edges).groupBy("i", "j", "k").applyInArrow(run, "lo long, hi long, there long, back long")
    sums = found.groupBy("lo", "hi").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    ways = F.array(F.struct(F.col("lo").alias("prev"), F.col("hi").alias("cur"), F.col("there").alias("w_common")), F.struct(F.col("hi").alias("prev"), F.col("lo").alias("cur"), F.col("back").alias("w_common")))
    found = sums.select(F.explode(ways).alias("w")).select("w.*").filter("w_common > 0")
    both = found.unionByName(_looped(weights).select("prev", "cur", F.col("weight").alias("w_common")))
    return both.groupBy("prev", "cur").agg(F.sum("w_common").alias("w_common"))


def common_neighbours(weights: DataFrame) -> DataFrame:
    """prev, cur, next, weight (of cur to next) where prev leads to cur, cur to next and prev to next, next is not prev, and prev is not cur."""
    found = stage(triangles(weights), "triangles")
    ways = [F.struct(F.col(x).alias("prev"), F.col(y).alias("cur"), F.col(z).alias("next"), F.col(x + y).alias("_1"), F.col(x + z).alias("_2"), F.col(y + z).alias("weight")) for x, y, z in permutations("abc")]
    found = found.select(F.explode(F.array(*ways)).alias("t")).filter("t._1 > 0 and t._2 > 0 and t.weight > 0").select("t.prev", "t.cur", "t.next", "t.weight")
    return found.unionByName(_looped(weights).select("prev", "cur", F.col("cur").alias("next"), "weight"))


def _looped(weights: DataFrame) -> DataFrame:
    """prev, cur, weight (of cur's loop): who comes from elsewhere to a vertex with a loop has that vertex itself for a common neighbour."""
    loops = weights.filter("src = dst").select(F.col("src").alias("cur"), "weight")
    return spread_join(weights.filter("src != dst").select(F.col("src").alias("prev"), F.col("dst").alias("cur")), loops, ["cur"])


def arc_masses(weights: DataFrame, common: DataFrame, p: float, q: float) -> DataFrame:
    """prev, cur, total (arcs of cur), mass: what all second-order transitions after prev, cur weigh together; and what else ``common`` (prev, cur, w_common) has.

    W / q + (1/p - 1/q) w_back + (1 - 1/q) w_common; a walker that came along a loop has all but the loop in common.
    """
    back, out = 1.0 / p, 1.0 / q
    totals = stage(weights.groupBy("src").agg(F.sum("weight").alias("total")), "totals")
    arcs = spread_join(weights.select(F.col("src").alias("prev"), F.col("dst").alias("cur"), F.col("weight").alias("here")), totals.withColumnRenamed("src", "cur"), ["cur"])
    arcs = arcs.join(weights.select(F.col("src").alias("cur"), F.col("dst").alias("prev"), F.col("weight").alias("w_back")), ["cur", "prev"], "left")
    arcs = arcs.join(common, ["prev", "cur"], "left")
    w_back = F.coalesce("w_back", F.lit(0))
    w_common = F.when(F.col("prev") == F.col("cur"), F.col("total") - F.col("here")).otherwise(F.coalesce("w_common", F.lit(0)))
    mass = w_back * back + w_common + (F.col("total") - w_back - w_common) * out
    return arcs.select("prev", "cur", "total", mass.alias("mass"), *[c for c in common.columns if c not in ("prev", "cur", "w_common")])


def acceptance(arcs: DataFrame, p: float, q: float) -> DataFrame:
    """prev, cur, accept_prob: how likely one round of rejection moves a walker; from arcs and triangles alone."""
    weights = stage(weighted_arcs(arcs), "weights")
    upper = max(1.0, 1.0 / p, 1.0 / q)
    found = arc_masses(weights, common_weights(weights), p, q)
    return found.select("prev", "cur", (F.col("mass") / (F.col("total") * F.lit(upper))).alias("accept_prob"))


def second_order_law(arcs: DataFrame, p: float, q: float) -> DataFrame:
    """prev, cur, next, prob. The rows are all pairs of arcs that meet, and are made last: what is shuffled is a row a pair of arc and list.

    cur's arcs lie in lists of about ``LIST``, by a hash of where they lead, so a hub's pairs are made in many tasks. An arc to cur
    goes to each of these lists with those of its common neighbours that are in it, and there is laid out against the list's arcs.
    """
    weights = stage(weighted_arcs(arcs), "weights")
    common = common_neighbours(weights).groupBy("prev", "cur").agg(F.sum("weight").alias("w_common"), F.collect_list("next").alias("_common"))
    lists = weights.groupBy(F.col("src").alias("cur")).agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("_lists"))
    lists = stage(lists, "lists")
    of = lambda c: F.pmod(F.xxhash64(c), F.col("_lists")).cast("int")
    second = spread_join(weights.select(F.col("src").alias("cur"), F.col("dst").alias("next"), "weight"), lists, ["cur"])
    second = second.groupBy("cur", of("next").alias("_list")).agg(F.collect_list(F.struct("next", "weight")).alias("_arcs"))
    first = spread_join(stage(arc_masses(weights, common, p, q), "masses"), lists, ["cur"])
    first = first.withColumn("_list", F.explode(F.sequence(F.lit(0), F.col("_lists") - 1)))
    here = F.when(F.col("_lists") == 1, F.col("_common")).otherwise(F.filter("_common", lambda x: of(x) == F.col("_list")))
    first = first.select("prev", "cur", "_list", "mass", F.coalesce(here, F.array().cast("array<bigint>")).alias("_common"))
    rows = first.join(second, ["cur", "_list"]).select("prev", "cur", "mass", "_common", F.inline("_arcs"))
    bias = F.when(F.col("next") == F.col("prev"), 1.0 / p).when((F.col("prev") == F.col("cur")) | F.array_contains("_common", F.col("next")), 1.0).otherwise(1.0 / q)
    return rows.select("prev", "cur", "next", (F.col("weight") * bias / F.col("mass")).alias("prob"))


def breakpoints(pairs: DataFrame, weights: DataFrame, p: float, q: float) -> DataFrame:
    """prev, cur, low, high, to, first, weight, until, whole: the second-order law of ``pairs`` (prev, prev_degree, cur, degree) as few rows.

    cur's slots weigh 1/q each but for those that lead back or to a common neighbour, which a row each tells; a first row, of no
    slots, tells what comes before. A row's own ``weight`` slots, from ``first`` on, have the mass from ``low`` to ``high``, the plain slots behind
    them, up to slot ``until``, the mass from ``high`` to ``to`` (null: to the end); ``whole`` is the mass of all. Common neighbours are
    sought in the shorter of the two lists, and in none where q is 1. ``weights``: src, dst, weight, first.
    """
    back, out = 1.0 / p, 1.0 / q
    parts = [pairs.select("prev", "cur", "degree", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("weight"), F.lit(0.0).alias("bias"))]
    there = weights.select(F.col("src").alias("cur"), F.col("dst").alias("prev"), "weight", "first")
    parts.append(pairs.join(there, ["cur", "prev"]).select("prev", "cur", "degree", "first", "weight", F.lit(back).alias("bias")))
    if q != 1:
        by_prev = F.col("prev_degree") < F.col("degree")
        few = pairs.select("prev", "cur", "degree", by_prev.alias("by_prev"), F.when(by_prev, F.col("prev")).otherwise(F.col("cur")).alias("src"), F.when(by_prev, F.col("cur")).otherwise(F.col("prev")).alias("other"))
        listed = few.join(weights, "src").filter("dst != prev")
        other = weights.select(F.col("src").alias("other"), "dst", F.col("weight").alias("other_weight"), F.col("first").alias("other_first"))
        met = listed.join(other, ["other", "dst"])
        pick = lambda name: F.when(F.col("by_prev"), F.col(f"other_{name}")).otherwise(F.col(name)).alias(name)
        parts.append(met.select("prev", "cur", "degree", pick("first"), pick("weight"), F.lit(1.0).alias("bias")))
    points = reduce(DataFrame.unionByName, parts)
    pair = Window.partitionBy("prev", "cur")
    before = pair.orderBy("first", "weight").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda x, over: F.coalesce(F.sum(x).over(over), F.lit(0))
    own = F.col("weight") * F.col("bias")
    low = (F.col("first") - so_far("weight", before)) * out + so_far(own, before)
    whole = (F.col("degree") - F.sum("weight").over(pair)) * out + F.sum(own).over(pair)
    points = points.select("*", low.alias("low"), (low + own).alias("high"), whole.alias("whole"))
    order = pair.orderBy("first", "weight")
    return points.select("prev", "cur", "low", "high", F.lead("low").over(order).alias("to"), "first", "weight", F.coalesce(F.lead("first").over(order), F.col("degree")).alias("until"), "whole")


def drawn_slots(walkers: DataFrame, weights: DataFrame, p: float, q: float) -> DataFrame:
    """walker_id, vertex, k: the slot that each of ``walkers`` (walker_id, prev, prev_degree, vertex, degree, u) takes by the second-order law,
    u in [0, 1) telling how far into the mass of all slots. A walker meets a row for each common neighbour and two more, never its vertex's list."""
    pairs = stage(walkers.select("prev", "prev_degree", F.col("vertex").alias("cur"), "degree").distinct(), "pairs")
    points = breakpoints(pairs, weights, p, q).withColumnRenamed("cur", "vertex")
    at = F.col("u") * F.col("whole")
    found = walkers.select("walker_id", "prev", "vertex", "u").join(points, ["prev", "vertex"]).filter((at >= F.col("low")) & (F.col("to").isNull() | (at < F.col("to"))))
    plain = F.col("first") + F.col("weight") + F.floor((at - F.col("high")) * q)
    k = F.when(at < F.col("high"), F.col("first")).otherwise(F.least(plain, F.col("until") - 1))
    return found.groupBy("walker_id").agg(F.max("vertex").alias("vertex"), F.min(k).alias("k"))
