import pytest

from wanderlake.__main__ import main
from wanderlake.sources import edges as io


def test_commands(spark, tmp_path):
    text, adj = tmp_path / "g.txt", tmp_path / "a.txt"
    text.write_text("# c\n5 9\n9 7\n7 5\n")
    adj.write_text("1 2 2 3\n2 1 3\n")
    row = main(["deepwalk", "-f", "text", "-g", str(text), "-l", "5", "-e", "4", "-o", str(tmp_path / "w")], spark)
    assert (row["walkers"], row["vertices"], row["transitions"]) == (12, 60, 48)
    assert spark.read.parquet(str(tmp_path / "w")).count() == 60 and row["last_step"] == 4
    assert all(row[f"{phase}_seconds"] > 0 for phase in ("load", "prepare", "walk"))
    row = main(["node2vec", "-f", "text", "-g", str(text), "-l", "4", "-w", "6", "-p", "2", "-q", "0.5", "--strategy", "join", "--info"], spark)
    assert row["vertices"] == 24
    main(["dense", "-i", str(text), "-o", str(tmp_path / "d")], spark)
    assert [(r.src, r.dst) for r in io.read_binary_edges(spark, str(tmp_path / "d")).orderBy("edge_idx").collect()] == [(0, 1), (1, 2), (2, 0)]
    assert io.read_info(spark, str(tmp_path / "d")) == {"vertex_num": 3, "edge_num": 3}
    main(["edges", "-i", str(adj), "-t", str(tmp_path / "t"), "-b", str(tmp_path / "b")], spark)
    for found in (io.read_text_edges(spark, str(tmp_path / "t")), io.read_binary_edges(spark, str(tmp_path / "b"))):
        assert [(r.src, r.dst) for r in found.orderBy("edge_idx").collect()] == [(1, 2), (1, 3), (2, 3)]


def test_exactly_one_count(capsys):
    for bad in (["deepwalk", "-f", "text", "-g", "x", "-l", "5"], ["deepwalk", "-f", "text", "-g", "x", "-l", "5", "-e", "1", "-w", "1"], ["node2vec", "-f", "text", "-g", "x", "-l", "5", "-e", "1"]):
        with pytest.raises(SystemExit):
            main(bad)
