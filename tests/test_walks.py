import math
from collections import Counter

import numpy as np
import pytest

from wanderlake.functions.draws import RANGE, draw, draw_values
from wanderlake.operators import generators, kernel, packed, triangles, validate, walks
from wanderlake.operators.graph import Graph, Reached
from wanderlake.plans.layout import walk_metrics
from wanderlake.plans.strategy import WalkEngine

SCHEMA = "edge_idx long, src long, dst long"
TAIL = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (0, 1)]


def graph_of(spark, pairs, **how):
    return Graph(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], SCHEMA), **how)


def taken(df):
    return sorted((r.walker_id, r.step, r.vertex) for r in df.collect())


def law(pairs, p, q):
    """Second-order law by enumeration."""
    m = Counter(pairs) + Counter((b, a) for a, b in pairs)
    out = {}
    for t, v in m:
        mass = {x: c * (1 / p if x == t else 1.0 if (t, x) in m else 1 / q) for (a, x), c in m.items() if a == v}
        for x, w in mass.items():
            out[t, v, x] = w / sum(mass.values())
    return out


def test_draws_agree(spark):
    rows = spark.range(50)
    got = {r.id: r.d for r in rows.select("id", draw(3, rows["id"], 2, 1).alias("d")).collect()}
    assert got == dict(enumerate(draw_values(3, np.arange(50), 2, 1).tolist()))


@pytest.mark.parametrize("pairs", [TAIL, [(1, 2)], [(7, 7)], [(0, i) for i in range(1, 9)], [(1, 2), (3, 4)]])
def test_kernel_equals_join(spark, pairs):
    graph = graph_of(spark, pairs)
    assert taken(walks.deepwalk(graph, 20, 6, 3, every=2)) == taken(kernel.kernel_walks(graph, 20, 6, 3))


@pytest.mark.parametrize("p,q", [(0.5, 2.0), (2.0, 0.5), (10.0, 10.0)])
def test_second_order_kernel_equals_join(spark, p, q):
    graph = graph_of(spark, TAIL)
    assert taken(walks.node2vec(graph, 30, 5, p, q, 5, rounds=1)) == taken(kernel.kernel_walks(graph, 30, 5, 5, p, q, rounds=1))


@pytest.mark.parametrize("p,q", [(0.5, 2.0), (2.0, 0.5), (10.0, 10.0)])
def test_second_order_law(spark, p, q):
    graph = graph_of(spark, TAIL)
    want = law(TAIL, p, q)
    got = {(r.prev, r.cur, r.next): r.prob for r in walks.second_order_law(graph.arcs, p, q).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    rows = taken(kernel.kernel_walks(graph, 4000, 12, 9, p, q, rounds=2))
    seen, total = Counter(), Counter()
    for a, b, c in zip(rows, rows[1:], rows[2:]):
        if a[0] == c[0]:
            seen[a[2], b[2], c[2]] += 1
            total[a[2], b[2]] += 1
    for (t, v, x), pr in want.items():
        n = total[t, v]
        assert n > 500 and abs(seen[t, v, x] / n - pr) < 5 * math.sqrt(pr * (1 - pr) / n) + 1e-9


def test_acceptance_of_the_first_order_case_is_sure(spark):
    assert all(math.isclose(r.accept_prob, 1.0) for r in walks.acceptance(graph_of(spark, TAIL).arcs, 1.0, 1.0).collect())


def test_duplicate_edges_weigh(spark):
    got = {(r.src, r.dst): r.prob for r in walks.first_order_law(graph_of(spark, [(0, 1)] * 3 + [(0, 2)]).arcs).collect()}
    assert got[0, 1] == 0.75 and got[0, 2] == 0.25 and got[1, 0] == 1.0


def test_lengths_and_arguments(spark):
    graph = graph_of(spark, TAIL)
    assert {r.step for r in walks.deepwalk(graph, 5, 1).collect()} == {0}
    assert walks.deepwalk(graph, 0, 4).count() == 0 and kernel.kernel_walks(graph, 0, 4).count() == 0
    for bad in (lambda: walks.deepwalk(graph, 5, 0), lambda: walks.node2vec(graph, 5, 3, 0.0, 1.0), lambda: walks.deepwalk(graph, -1, 3), lambda: WalkEngine(graph).deepwalk(3), lambda: WalkEngine(graph, "fast")):
        with pytest.raises(ValueError):
            bad()
    row = walk_metrics(walks.deepwalk(graph, 7, 4)).first()
    assert (row.walkers, row.vertices, row.transitions) == (7, 28, 21)


def test_sinks(spark):
    pairs = [(0, 1), (1, 2)]
    stop = graph_of(spark, pairs, directed=True, on_sink="stop")
    got = taken(walks.deepwalk(stop, 12, 5, 2, every=2))
    assert got == taken(kernel.kernel_walks(stop, 12, 5, 2))
    by = {}
    for w, s, v in got:
        by.setdefault(w, []).append(v)
    assert all(path == list(range(path[0], 3)) for path in by.values()) and len(by) == 12
    with pytest.raises(Exception, match="without arcs"):
        walks.deepwalk(graph_of(spark, pairs, directed=True), 12, 5, 2).collect()


def test_engine_picks_by_size(spark):
    graph = graph_of(spark, TAIL)
    small, large = WalkEngine(graph, limit=10, seed=4), WalkEngine(graph, seed=4)
    assert not small.uses_kernel and large.uses_kernel
    assert taken(small.deepwalk(4, walkers=10)) == taken(large.deepwalk(4, walkers=10))
    assert large.deepwalk(3, epochs=2).count() == 2 * 5 * 3
    with pytest.raises(ValueError):
        kernel.kernel_walks(graph, 5, 3, limit=10)


def test_walks_converge_and_are_legal(spark):
    graph = Graph(generators.random_multigraph(spark, 30, 90, 11))
    rows = kernel.kernel_walks(graph, 20_000, 40, 1)
    assert validate.illegal_transitions(rows, graph.arcs).count() == 0
    found = validate.distances(validate.transition_counts(rows, graph.arcs)).persist()
    assert validate.converged(validate.distance_summary(found)).first().converged
    few = validate.distances(validate.transition_counts(kernel.kernel_walks(graph, 5, 3, 1), graph.arcs))
    assert not validate.converged(validate.distance_summary(few)).first().converged
    assert max(r.bhattacharyya for r in few.collect()) == 10.0


def test_generators(spark):
    rows = generators.random_simple_graph(spark, 20, 60, 5).collect()
    pairs = [(r.src, r.dst) for r in rows]
    assert len(set(pairs)) == len(pairs) and all(a != b and (b, a) in set(pairs) for a, b in pairs)
    assert {a for a, _ in pairs} == set(range(20))
    multi = generators.random_multigraph(spark, 10, 40, 5).collect()
    assert [r.src for r in sorted(multi, key=lambda r: r.edge_idx)[:10]] == list(range(10))
    with pytest.raises(ValueError):
        generators.random_multigraph(spark, 10, 5)


def test_partition_faults(spark):
    good = spark.createDataFrame([(i, i // 4) for i in range(10)], "vid long, pid long")
    assert validate.partition_faults(good).count() == 0
    assert validate.partition_faults(good.filter("vid != 5")).count() == 1


def test_draws_are_even_and_independent():
    """Chi-squared over cells of single draws, and of pairs that differ in step, salt, seed or walker by one."""
    n, k = 400_000, 16
    ids = np.concatenate([np.arange(n), (1 << 40) + np.arange(n)])

    def cells(x, buckets):
        return (x % buckets, x * buckets // RANGE) if buckets < 1 << 11 else (x % buckets,)

    def even(x, buckets):
        n_ = np.bincount(x, minlength=buckets)
        want = len(x) / buckets
        assert ((n_ - want) ** 2 / want).sum() < buckets + 6 * np.sqrt(2 * buckets)

    first = draw_values(1, ids, 3, 0)
    assert first.min() >= 0 and first.max() < RANGE and len(np.unique(first)) > 0.999 * len(ids)
    for buckets in (2, 3, 10, 97, 1000):
        for c in cells(first, buckets):
            even(c, buckets)
    for other in (draw_values(1, ids, 4, 0), draw_values(1, ids, 3, 1), draw_values(2, ids, 3, 0), draw_values(1, ids + 1, 3, 0)):
        for a, b in zip(cells(first, k), cells(other, k)):
            even(a * k + b, k * k)


def test_batches_are_the_same_walks_and_end_when_converged(spark):
    edges = spark.createDataFrame([(i, i % 5, (i * 3 + 1) % 5) for i in range(20)], "edge_idx long, src long, dst long")
    engine = WalkEngine(Graph(edges), seed=3)
    whole = sorted(walks.deepwalk(engine.graph, 50, 6, 3).collect())
    assert sorted(engine.in_batches(6, 50, free_bytes=4 * 15 * 20).collect()) == whole
    found, ok = engine.until_converged(40, 500, most=6)
    assert ok and found.select("walker_id").distinct().count() % 500 == 0
    found, ok = engine.until_converged(2, 1, most=2)
    assert not ok and found.count() == 4


@pytest.mark.parametrize("pairs", [TAIL, [(1, 2)], [(7, 7)], [(0, i) for i in range(1, 9)], [(1, 2), (3, 4)]])
def test_packed_lists_equal_joins(spark, pairs, monkeypatch):
    monkeypatch.setattr(packed, "LIST", 4)
    want = taken(walks.deepwalk(graph_of(spark, pairs), 20, 6, 3))
    graph = packed.PackedGraph(graph_of(spark, pairs))
    assert taken(graph.walks(20, 6, 3)) == want == taken(graph.walks(20, 6, 3, every=2))
    assert taken(graph.walks(5, 6, 3, first=15)) == [r for r in want if r[0] >= 15]
    assert taken(graph.walks(5, 1, 3)) == [r for r in want if r[0] < 5 and r[1] == 0] and graph.walks(0, 3).count() == 0
    with pytest.raises(ValueError):
        graph.walks(5, 0)


def test_packed_lists_at_sinks_and_where_many_arcs_lead_to_few(spark):
    """A vertex that all arcs lead to and one leaves lies there in copies."""
    pairs = [(i, 0) for i in range(1, 40)] + [(0, 99), (99, 5)]
    stop = graph_of(spark, [*pairs, (5, 100)], directed=True, on_sink="stop")
    assert taken(packed.packed_walks(stop, 60, 7, 2)) == taken(walks.deepwalk(stop, 60, 7, 2))
    copies = {r.name: r.copies for r in packed.packed_ends(stop).collect()}
    assert copies[0] == 4 and copies[99] == copies[7] == 1
    with pytest.raises(Exception, match="without arcs"):
        packed.packed_walks(graph_of(spark, [(0, 1)], directed=True), 12, 5, 2).collect()


def test_packed_plan_neither_broadcasts_nor_sorts(spark):
    graph = packed.PackedGraph(graph_of(spark, [(i, i * i % 50) for i in range(50)]))
    here = spark.range(10).selectExpr("id as walker_id", "1L as step", "id as vertex", "2L as degree", "1 as copies", "cast(array() as array<bigint>) as path")
    with packed.fixed_plan(spark):
        text = "SELECT * FROM {here}"
        for _ in (1, 2):
            text = graph._step(text, 1)
        plan = spark.sql(text, here=here, lists=graph.lists)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 2 and "Broadcast" not in plan and "SortMergeJoin" not in plan
    assert plan.count("ReusedExchange") == 1  # the second step reads the lists as the first dealt them
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_all_strategies_give_the_same_rows(spark):
    graph = graph_of(spark, [(i % 9, (i * i + 1) % 9) for i in range(40)])
    rows = [taken(WalkEngine(graph, way, seed=4).deepwalk(9, walkers=30)) for way in ("kernel", "packed", "join")]
    assert rows[0] == rows[1] == rows[2]
    assert taken(WalkEngine(graph, limit=10, seed=4).deepwalk(9, walkers=30)) == rows[0]


def test_few_walkers_look_at_their_own_lists_only(spark, monkeypatch):
    """Walks of few walkers are those of all ways, at sinks too, and a graph that the kernel can't hold is walked."""
    pairs = [(i % 9, (i * i + 1) % 9) for i in range(40)]
    graph, sinks = graph_of(spark, pairs), graph_of(spark, [(0, 1), (1, 2), (1, 0), (2, 3)], directed=True, on_sink="stop")
    want = [taken(kernel.kernel_walks(graph, 12, 5, 4)), taken(kernel.kernel_walks(graph, 12, 5, 4, 3.0, 0.25)), taken(kernel.kernel_walks(sinks, 12, 5, 4))]
    monkeypatch.setattr(walks, "MANY", 1)
    graph, sinks = graph_of(spark, pairs), graph_of(spark, [(0, 1), (1, 2), (1, 0), (2, 3)], directed=True, on_sink="stop")
    engine = WalkEngine(graph, limit=10, seed=4)
    got = [taken(engine.deepwalk(5, walkers=12)), taken(engine.node2vec(5, 3.0, 0.25, walkers=12)), taken(walks.deepwalk(sinks, 12, 5, 4))]
    assert got == want
    assert not {"slots", "steps", "weights", "starts"} & set(graph.__dict__)  # no table of all arcs was made
    assert Reached(graph, spark.createDataFrame([(3,)], "vertex long")).slots.filter("src != 3").count() == 0
    with pytest.raises(Exception, match="without arcs"):
        walks.deepwalk(graph_of(spark, [(0, 1)], directed=True), 12, 5, 2).collect()


def test_moves_counted_on_paths(spark):
    """A row a walker gives the counts that a row a step gives, with no window over walkers, and with walks that end."""
    graph = graph_of(spark, [(0, 1), (1, 2), (1, 0), (2, 3), (0, 1)], directed=True, on_sink="stop")
    engine = WalkEngine(graph, seed=4)
    made, rows = engine.paths(12, 5), engine.deepwalk(5, walkers=12)
    assert {r.walker_id: r.path for r in made.collect()} == {r.walker_id: r.path for r in walks.paths(rows).collect()}
    counts = validate.path_transition_counts(made, graph.arcs)
    assert sorted(counts.collect()) == sorted(validate.transition_counts(rows, graph.arcs).collect())
    assert "Window" not in counts._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("p,q", [(0.01, 100.0), (0.5, 2.0), (2.0, 0.5), (3.0, 1.0)])
def test_drawn_slots_are_those_of_all_arcs(spark, p, q):
    """The slot drawn from breakpoints alone is the one that sums over all arcs give, for every arc walked and many draws."""
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 12, (60, 2))] + [(0, 1), (0, 1), (5, 5)]
    for directed in (False, True):
        graph = graph_of(spark, pairs, directed=directed)
        slots = sorted((r.src, r.k, r.dst) for r in graph.slots.collect())
        lists = {}
        for s, k, d in slots:
            lists.setdefault(s, []).append(d)
        known = {(s, d) for s, _, d in slots}
        asked = [(prev, cur, u) for prev, cur in sorted(known) if cur in lists for u in (0.0, 0.13, 0.5, 0.77, 0.999)]
        rows = [(i, prev, len(lists[prev]), cur, len(lists[cur]), u) for i, (prev, cur, u) in enumerate(asked)]
        found = triangles.drawn_slots(spark.createDataFrame(rows, "walker_id long, prev long, prev_degree long, vertex long, degree long, u double"), graph.weights, p, q)
        got = {r.walker_id: lists[r.vertex][r.k] for r in found.collect()}
        for i, (prev, cur, u) in enumerate(asked):
            mass = np.array([1 / p if x == prev else 1.0 if (prev, x) in known else 1 / q for x in lists[cur]])
            total = mass.cumsum()
            near = [lists[cur][int(np.searchsorted(total, (u + e) * total[-1], side="right").clip(0, len(total) - 1))] for e in (-1e-9, 1e-9)]
            assert got[i] in near, (prev, cur, u)


def test_a_walker_at_a_hub_meets_few_rows(spark):
    """A star of 10^5 arcs with p = 0.01, q = 100: the law of a pair at the hub is two rows."""
    edges = spark.range(100_000).selectExpr("id as edge_idx", "0L as src", "id + 1 as dst")
    graph = Graph(edges)
    pairs = spark.createDataFrame([(k, 1, 0, 100_000) for k in (1, 500, 100_000)], "prev long, prev_degree long, cur long, degree long")
    points = triangles.breakpoints(pairs, graph.weights, 0.01, 100.0).collect()
    assert len(points) == 6 and {round(r.whole, 6) for r in points} == {round(100 + 99_999 / 100, 6)}
    rows = taken(walks.node2vec(graph, 40, 4, 0.01, 100.0, 5, rounds=1))
    assert len(rows) == 160 and all((a[2] == 0) != (b[2] == 0) for a, b in zip(rows, rows[1:]) if a[0] == b[0])


@pytest.mark.parametrize("directed", [False, True])
def test_laws_from_triangles_by_enumeration(spark, directed):
    rng = np.random.default_rng(8)
    for n, m in ((6, 20), (15, 40), (4, 30)):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
        graph = graph_of(spark, pairs, directed=directed)
        weight = Counter(pairs) + (Counter() if directed else Counter((b, a) for a, b in pairs))
        p, q = 0.5, 4.0
        law_, sure = {}, {}
        for t, v in weight:
            mass = {x: c * (1 / p if x == t else 1.0 if (t, x) in weight else 1 / q) for (a, x), c in weight.items() if a == v}
            if mass:
                sure[t, v] = sum(mass.values()) / (2.0 * sum(c for (a, _), c in weight.items() if a == v))
            for x, w in mass.items():
                law_[t, v, x] = w / sum(mass.values())
        got = {(r.prev, r.cur): r.accept_prob for r in triangles.acceptance(graph.arcs, p, q).collect()}
        assert got.keys() == sure.keys() and all(math.isclose(got[k], sure[k]) for k in sure)
        got = {(r.prev, r.cur, r.next): r.prob for r in triangles.second_order_law(graph.arcs, p, q).collect()}
        assert got.keys() == law_.keys() and all(math.isclose(got[k], law_[k]) for k in law_)


def test_law_and_triangles_in_many_pieces(spark, monkeypatch):
    """Lists of a few arcs, tasks of a few edges and a few pairs at a time give the rows that whole ones give."""
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 25, (150, 2))] + [(0, i) for i in range(1, 25)]
    graph = graph_of(spark, pairs, directed=False)
    monkeypatch.setattr(triangles, "LIST", 4)
    monkeypatch.setattr(triangles, "EDGES", 25)
    monkeypatch.setattr(triangles, "PAIRS", 7)
    want = law(pairs, 0.5, 4.0)
    got = {(r.prev, r.cur, r.next): r.prob for r in triangles.second_order_law(graph.arcs, 0.5, 4.0).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    near = {v: {b for a, b in [*pairs, *((b, a) for a, b in pairs)] if a == v} - {v} for v in range(25)}
    found = [frozenset(r[:3]) for r in triangles.triangles(graph.weights).collect()]
    assert len(set(found)) == len(found) and set(found) == {frozenset((a, b, c)) for a in near for b in near[a] for c in near[a] & near[b]}


def test_pairs_of_arcs_are_made_behind_all_shuffles(spark):
    """The law's degree-squared rows are laid out last, and triangles' pairs of edges are never rows."""
    graph = graph_of(spark, TAIL)
    law_plan = triangles.second_order_law(graph.arcs, 0.5, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < law_plan.find("Generate inline") < law_plan.find("Join")
    plan = triangles.triangles(graph.weights)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_star_makes_no_pairs_of_its_arcs(spark):
    """Edges go out from the leaves, so a hub of any size has none to pair."""
    graph = graph_of(spark, [(0, i) for i in range(1, 2000)] + [(1, 2)])
    edges = triangles.oriented_edges(graph.weights)
    assert edges.groupBy("lo").count().agg({"count": "max"}).first()[0] == 2
    assert [tuple(r)[:3] for r in triangles.triangles(graph.weights).collect()] == [(1, 2, 0)]


@pytest.mark.parametrize("p,q", [(0.5, 2.0), (2.0, 0.5), (10.0, 10.0)])
def test_second_order_walks_agree_with_the_law(spark, p, q):
    engine = WalkEngine(graph_of(spark, TAIL), seed=6)
    found, ok = engine.until_converged(60, 2000, most=8, p=p, q=q)
    assert ok and found.select("walker_id").distinct().count() % 2000 == 0
    assert not WalkEngine(graph_of(spark, TAIL), seed=6).until_converged(4, 3, most=2, p=p, q=q)[1]


def test_batches_go_on_where_they_were_cut_short(spark, tmp_path):
    import os
    import shutil

    folder = str(tmp_path / "walks")
    graph = graph_of(spark, TAIL)
    how = {"length": 5, "walkers": 50, "free_bytes": 4 * 13 * 20, "p": 2.0, "q": 0.5}
    want = taken(kernel.kernel_walks(graph, 50, 5, 3, 2.0, 0.5))
    assert taken(WalkEngine(graph, seed=3).in_batches(**how, folder=folder)) == want
    times = {k: os.path.getmtime(f"{folder}/batch=00000{k}/_SUCCESS") for k in range(3)}
    os.remove(f"{folder}/batch=000001/_SUCCESS")
    shutil.rmtree(f"{folder}/batch=000002")
    assert taken(WalkEngine(graph, seed=3).in_batches(**how, folder=folder)) == want
    assert os.path.getmtime(f"{folder}/batch=000000/_SUCCESS") == times[0] and os.path.getmtime(f"{folder}/batch=000001/_SUCCESS") > times[1]
    with pytest.raises(ValueError, match="other walks"):
        WalkEngine(graph, seed=4).in_batches(**how, folder=folder)
    rows = [taken(WalkEngine(graph, way, seed=3).in_batches(5, 50, 4 * 13 * 20)) for way in ("join", "packed")]
    assert rows[0] == rows[1] == taken(kernel.kernel_walks(graph, 50, 5, 3))


def test_values_at_places_without_a_sort(spark):
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=3000), np.round(rng.exponential(size=2000), 1), np.array([5.0]), np.array([1.0, 1.0]), np.concatenate([np.zeros(999), [1e-12, 1e9]])):
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        places = {("x", k): k for k in {0, len(x) - 1, len(x) // 2, int(len(x) * 0.99)}}
        for buckets in (2, 1024):
            got = validate.at_places(df, places, buckets) if len(x) < 5 or buckets > 2 else {}
            assert all(got[k] == np.sort(x)[k[1]] for k in got)
    assert validate.distance_summary(df.selectExpr("x as bhattacharyya", "x as linf").filter("false")).first().avg is None
