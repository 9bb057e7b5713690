from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wanderlake.operators import graph as g
from wanderlake.operators.graph import Graph
from wanderlake.plans import layout
from wanderlake.plans.joins import spread_join
from wanderlake.plans.staging import ordered_index, running_total, stage

SCHEMA = "edge_idx long, src long, dst long"


def edges_of(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], SCHEMA)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=30))
def test_small_multigraphs(spark, pairs):
    edges = edges_of(spark, pairs)
    arcs = g.expand_arcs(edges)
    want = Counter(pairs) + Counter((b, a) for a, b in pairs)
    assert Counter({(r.src, r.dst): r.weight for r in g.weighted_arcs(arcs).collect()}) == want
    degree = {r.src: r.degree for r in g.degrees(arcs).collect()}
    assert sum(degree.values()) == 2 * len(pairs)
    seen = list(dict.fromkeys(x for p in pairs for x in p))
    assert {r.name: r.raw_id for r in g.dictionary(edges).collect()} == {n: i for i, n in enumerate(seen)}
    slots = {(r.src, r.k): r.dst for r in g.slots(arcs).collect()}
    for v, n in degree.items():
        own = [slots[v, k] for k in range(n)]
        assert own == sorted(b for (a, b), c in want.items() if a == v for _ in range(c))


def test_self_loop_counts_twice(spark):
    arcs = g.expand_arcs(edges_of(spark, [(3, 3)]))
    assert [(r.src, r.degree) for r in g.degrees(arcs).collect()] == [(3, 2)]


def test_degree_rank_breaks_ties_by_larger_number(spark):
    graph = g.Graph(edges_of(spark, [(10, 20), (30, 20), (40, 50)]))
    got = [(r.name, r.degree) for r in graph.vertices.orderBy("vid").collect()]
    assert got == [(20, 2), (50, 1), (40, 1), (30, 1), (10, 1)]
    offsets = [(r.vid, r.offset) for r in g.degree_offsets(graph.vertices).orderBy("vid").collect()]
    assert offsets == [(0, 0), (1, 2), (2, 3), (3, 4), (4, 5)]


def test_adjacency_and_neighbors(spark):
    arcs = g.expand_arcs(edges_of(spark, [(1, 2), (1, 2), (2, 3)]), directed=True)
    assert {r.src: (r.degree, r.nbrs) for r in g.adjacency(arcs).collect()} == {1: (2, [2, 2]), 2: (1, [3])}
    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    assert {(r.src, r.dst): r.has_neighbor for r in g.has_neighbor(pairs, arcs).collect()} == {(1, 2): True, (2, 1): False, (2, 3): True}


def test_multiset_diff(spark):
    a, b = edges_of(spark, [(1, 2), (1, 2), (3, 4)]), edges_of(spark, [(1, 2), (3, 4), (5, 6)])
    assert {(r.src, r.dst): r.surplus for r in g.edge_multiset_diff(a, b).collect()} == {(1, 2): 1, (5, 6): -1}


def test_ordered_index_and_running_total(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 as x").repartition(7)
    got = ordered_index(df, df["x"]).collect()
    assert all(r.x == r.idx for r in got) and len(got) == 1000
    total = running_total(spark.range(100).selectExpr("id as i", "id as v"), "i", "v", "t", chunk=8)
    assert {r.i: r.t for r in total.collect()} == {i: i * (i - 1) // 2 for i in range(100)}
    assert ordered_index(df.filter("x < 0"), df["x"]).count() == 0


def test_layout():
    assert layout.group_bits(128) == (0, 128) and layout.group_bits(2100) == (5, 66)
    plan = layout.epoch_plan(1000, 8, 4 * 19 * 300)
    assert sum(n for _, n in plan) == 1000 and max(n for _, n in plan) <= 300
    assert layout.epoch_plan(0, 8, 100) == []
    with pytest.raises(ValueError):
        layout.epoch_plan(5, 80, 10)


def test_graph_arguments(spark):
    with pytest.raises(ValueError):
        g.Graph(edges_of(spark, [(1, 2)]), on_sink="ignore")
    assert g.csr_bytes(10, 20) == 200


def test_slots_of_a_hub_lie_in_several_tasks(spark):
    """A star of 10^6 arcs, two ways: the hub's slots are numbered without a gap, in many tasks of about equal size."""
    edges = spark.range(500_000).selectExpr("id as edge_idx", "5L as src", "(id * 7919) % 1000003 as dst")
    plan = g.slots(g.expand_arcs(edges))
    row = plan.filter("src = 5").selectExpr("count(*) n", "count(distinct k) d", "min(k) lo", "max(k) hi").first()
    assert row.n >= 500_000 and (row.d, row.lo, row.hi) == (row.n, 0, row.n - 1)
    sizes = sorted(r["count"] for r in plan.filter("src = 5").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) > 1
    text = plan._jdf.queryExecution().toString()
    assert "Window" not in text
    # In order of (dst, edge_idx): a slot's destination never falls.
    assert plan.filter("src = 5").orderBy("k").limit(1000).select("dst").collect() == edges.unionByName(edges.selectExpr("edge_idx", "dst as src", "src as dst").filter("src = 5")).select("dst").orderBy("dst").limit(1000).collect()


def test_slots_that_go_on_over_partitions(spark):
    """Sources that begin, end or go on at partitions' borders."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("2", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for pairs in ([(1, i) for i in range(60)], [(i // 20, i) for i in range(60)], [(0, 0)] * 30 + [(1, 1)] * 2 + [(2, 5)] * 30):
                got = sorted((r.src, r.k, r.dst) for r in g.slots(g.expand_arcs(edges_of(spark, pairs), directed=True)).collect())
                want = [(s, k, d) for s in sorted({p[0] for p in pairs}) for k, d in enumerate(sorted(d for a, d in pairs if a == s))]
                assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_spread_join(spark):
    """Hot keys, cold keys, keys without a match and null keys, as an ordinary join has them."""
    many = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id % 50) as key", "id as x").unionByName(spark.sql("select null as key, -1L as x"))
    one = spark.range(5, 60).selectExpr("id as key", "id * 10 as y").unionByName(spark.sql("select null as key, 0L as y"))
    for how in ("inner", "left"):
        want = sorted((r.x, r.y or -9) for r in many.join(one, ["key"], how).collect())
        for least in (1, 100, 10**9):
            assert sorted((r.x, r.y or -9) for r in spread_join(many, one, ["key"], how, least=least).collect()) == want
    with pytest.raises(ValueError):
        spread_join(many, one, ["key"], "right")
    with pytest.raises(ValueError, match="several rows"):
        spread_join(many, one.unionByName(one), ["key"], least=1)


def test_a_hub_in_joins_is_spread(spark):
    """Edges of a star, relabelled and asked for: the largest task is near the median."""
    edges = stage(spark.range(0, 200_000, 1, 4).selectExpr("id as edge_idx", "0L as src", "id % 5000 + 1 as dst"), "star")
    names = stage(g.dictionary(edges), "names")
    found = g.relabel(edges, names)
    sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 200_000 and sizes[-1] < 3 * sizes[len(sizes) // 2]
    steps = Graph(edges).steps
    sizes = sorted(r["count"] for r in steps.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 400_000 and sizes[-1] < 1.2 * sizes[0]
    asked = spark.range(50_000).selectExpr("0L as src", "if(id % 2 = 0, 1, id % 9000) as dst")
    found = g.has_neighbor(asked, g.expand_arcs(edges))
    assert found.filter("has_neighbor").count() == asked.filter("dst between 1 and 5000").count()
