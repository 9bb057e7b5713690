import random
import struct

import numpy as np
import pytest

from wanderlake.operators import graph as g
from wanderlake.sources import edges as io


def rows(df):
    return [(r["src"], r["dst"]) for r in df.orderBy("edge_idx").collect()]


def test_text_keeps_order_and_skips_comments(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("# src dst\n1 2\n\n3\t4 weight\n1 2\n4294967295 0\n")
    found = io.read_text_edges(spark, str(p))
    assert rows(found) == [(1, 2), (3, 4), (1, 2), (4294967295, 0)]
    assert [r[0] for r in found.select("edge_idx").orderBy("edge_idx").collect()] == [0, 1, 2, 3]


def test_malformed_lines(spark, tmp_path):
    p = tmp_path / "b.txt"
    p.write_text("1 2\nx y\n5\n3 4\n")
    assert rows(io.read_text_edges(spark, str(p), malformed="drop")) == [(1, 2), (3, 4)]
    with pytest.raises(Exception, match="malformed edge"):
        io.read_text_edges(spark, str(p)).collect()


def test_name_out_of_range(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("1 4294967296\n")
    with pytest.raises(Exception, match="out of range"):
        io.read_text_edges(spark, str(p)).collect()


def test_many_text_files_in_order(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    want = []
    for i in range(5):
        lines = [(i * 100 + k, k) for k in range(50 + i)]
        want += lines
        (d / f"part-{i}.txt").write_text("".join(f"{a} {b}\n" for a, b in lines))
    assert rows(io.read_text_edges(spark, str(d))) == want


def test_binary_with_trailing_part(spark, tmp_path):
    p = tmp_path / "g.bin"
    p.write_bytes(struct.pack("<6I", 1, 2, 3, 4, 4294967295, 0) + b"\x01\x02\x03")
    assert rows(io.read_binary_edges(spark, str(p))) == [(1, 2), (3, 4), (4294967295, 0)]


def test_binary_roundtrip_and_info(spark, tmp_path):
    edges = spark.createDataFrame([(i, (i * 7919) % 4294967296, (i * 104729 + 10) % 256) for i in range(500)], "edge_idx long, src long, dst long")
    path = str(tmp_path / "out")
    io.write_binary_edges(edges, path)
    assert rows(io.read_binary_edges(spark, path)) == rows(edges)
    io.write_info(path, 12, 500, spark)
    assert io.read_info(spark, path) == {"vertex_num": 12, "edge_num": 500}


def test_text_roundtrip(spark, tmp_path):
    edges = spark.createDataFrame([(i, i % 7, i % 3) for i in range(100)], "edge_idx long, src long, dst long")
    path = str(tmp_path / "text")
    io.write_text_edges(edges, path, header="a\nb")
    assert sorted(rows(io.read_text_edges(spark, path))) == sorted(rows(edges))


def test_adjacency(spark, tmp_path):
    p = tmp_path / "adj.txt"
    p.write_text("1 2 5 6\n2 0\n3 1 1\n")
    assert rows(io.read_adjacency_text(spark, str(p))) == [(1, 5), (1, 6), (3, 1)]
    p.write_text("1 1 2 3 1 4\n5 3 6\n7\n\n8 9\n0 0 0 9 0\n")
    assert rows(io.read_adjacency_text(spark, str(p))) == [(1, 2), (3, 4), (5, 6), (5, 7), (5, 8)]
    other = tmp_path / "b.txt"
    other.write_text("4 2 1\n1\n")
    (tmp_path / "c.txt").write_text("2 1 2\n")
    both = [str(p), str(other), str(tmp_path / "c.txt")]
    assert rows(io.read_adjacency_text(spark, both)) == [(1, 2), (3, 4), (5, 6), (5, 7), (5, 8), (4, 1), (4, 1), (2, 2)]
    for short in ("1 3 5 6\n", "1 1 2 3\n", "1 1 2 3 2\n4\n"):
        p.write_text(short)
        with pytest.raises(Exception, match="shorter"):
            io.read_adjacency_text(spark, str(p)).collect()
    p.write_text("1 3 5 6\n")
    with pytest.raises(Exception, match="shorter"):
        io.read_adjacency_text(spark, str(p)).collect()


def test_binary_files_are_of_bounded_size(spark, tmp_path):
    edges = spark.createDataFrame([(i, i % 7, i % 3) for i in range(100)], "edge_idx long, src long, dst long")
    path = str(tmp_path / "binary")
    io.write_binary_edges(edges, path, edges_per_file=30)
    assert spark.read.format("binaryFile").load(path).count() == 4
    assert rows(io.read_binary_edges(spark, path)) == rows(edges.orderBy("edge_idx"))


def test_load(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("0 1\n1 2\n")
    graph = g.Graph.load(spark, str(p))
    assert graph.counts == (3, 4)


def lists(rng, n, spread):
    """Edges of random adjacency lists, and their numbers."""
    edges, numbers = [], []
    for _ in range(n):
        src, dsts = rng.randrange(1 << 32), [rng.randrange(spread) for _ in range(rng.choice([0, 0, 1, 2, 5, 40]))]
        edges += [(src, d) for d in dsts]
        numbers += [src, len(dsts), *dsts]
    return edges, numbers


@pytest.mark.parametrize("seed", range(3))
def test_a_file_of_lists_over_lines_is_read_by_several_tasks(spark, tmp_path, seed):
    """Splits that begin inside lists, inside a record's head, and lists over several splits; destinations that look like degrees."""
    rng = random.Random(seed)
    edges, numbers = lists(rng, 400, rng.choice([3, 50, 1 << 32]))
    edges += [(7, k % 11) for k in range(900)]
    numbers += [7, 900, *(k % 11 for k in range(900))]
    text, at = "", 0
    while at < len(numbers):
        n = rng.choice([1, 1, 2, 3, 7, 30])
        text += " ".join(map(str, numbers[at : at + n])) + rng.choice(["\n", "\n", " \n\n"])
        at += n
    p = tmp_path / "one.txt"
    p.write_text(text)
    (tmp_path / "zwei.txt").write_text("5 1\n6 1 1 8\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 2
        found = io.read_adjacency_text(spark, [str(p), str(tmp_path / "zwei.txt")])
        assert rows(found) == [*edges, (5, 6), (1, 8)]
        assert [r[0] for r in found.select("edge_idx").orderBy("edge_idx").collect()] == list(range(len(edges) + 2))
        p.write_text(text.rstrip() + " 9 2 1\n")
        with pytest.raises(Exception, match="shorter"):
            io.read_adjacency_text(spark, str(p)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_jump_tables_by_following_each_number():
    from wanderlake.sources import adjacency as a

    rng = random.Random(9)
    for _ in range(60):
        t = np.array([rng.choice([0, 1, 2, 3, 9, 1 << 31]) for _ in range(rng.randrange(1, 40))], np.int64)
        state, src = a.leaves(t, a.last_starts(t))
        for o in range(len(t)):
            at = o
            while at + 1 < len(t) and at + 2 + t[at + 1] < len(t):
                at += 2 + int(t[at + 1])
            assert src[o] == t[at] and state[o] == (at + 2 + t[at + 1] - len(t) if at + 1 < len(t) else a.PENDING)


def test_a_large_binary_file_is_read_by_several_tasks(spark, tmp_path):
    """100 MB in one file with a trailing part: many ranges, in order, none read twice."""
    n = 13_000_000
    p = tmp_path / "large.bin"
    src = np.arange(n, dtype="<u4")
    np.stack([src, src * 7 + 1], 1).astype("<u4").tofile(p)
    with p.open("ab") as f:
        f.write(b"\x01\x02\x03")
    found = io.read_binary_edges(spark, str(p), records=2_000_000)
    assert found.rdd.getNumPartitions() == 7
    row = found.selectExpr("count(*) n", "sum(edge_idx) i", "sum(src) s", "bool_and(edge_idx = src and dst = (src * 7 + 1) % 4294967296) ok").first()
    assert (row.n, row.i, row.s, row.ok) == (n, n * (n - 1) // 2, n * (n - 1) // 2, True)
    small = tmp_path / "small.bin"
    src[:23].tofile(small)
    found = io.read_binary_edges(spark, str(small), records=4)
    assert found.rdd.getNumPartitions() == 3 and rows(found) == [(2 * i, 2 * i + 1) for i in range(11)]


def test_files_in_other_stores_are_read_whole(spark, tmp_path):
    from wanderlake.sources import binary as b

    (tmp_path / "x").mkdir()
    for i in range(3):
        (tmp_path / "x" / f"{i}.bin").write_bytes(struct.pack("<4I", i, 1, i, 2) + b"\x01" * i)
    files = spark.read.format("binaryFile").load(str(tmp_path / "x"))
    base = {r["path"]: 2 * k for k, r in enumerate(files.select("path").orderBy("path").collect())}
    assert rows(b._whole(files, base)) == rows(io.read_binary_edges(spark, str(tmp_path / "x"))) == [(i, k) for i in range(3) for k in (1, 2)]


def test_binary_parts_stay_small(spark, tmp_path):
    """A task holds a part whole, so a larger table makes more parts, not larger ones."""
    edges = spark.range(2_500_000).selectExpr("id as edge_idx", "id as src", "id % 7 as dst")
    path = str(tmp_path / "parts")
    io.write_binary_edges(edges, path)
    sizes = [f.stat().st_size for f in (tmp_path / "parts").glob("part-*")]
    assert max(sizes) < 12 << 20
    back = io.read_binary_edges(spark, path)
    assert back.selectExpr("count(*)", "sum(src)", "max(edge_idx)", "count_if(src != edge_idx or dst != src % 7)").first()[:] == (2_500_000, 2_500_000 * 2_499_999 // 2, 2_499_999, 0)
