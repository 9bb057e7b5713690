"""Adjacency lists as streams of numbers, read split by split whatever their lines are.

Numbers ``src degree d1 .. dn`` follow one another, and line ends mean no more than blanks, so only what stands before a split says where its
first record starts. What a split can say by itself is a table: a record that starts at this number makes the split end in that
state. States are the numbers that the open record still lacks, or ``PENDING`` where its degree is the next number. Followed from
each file's beginning, a table's entry a split, the tables tell every split its state, and all splits can be read at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import discard, stage, stage_parts
from .names import checked

#: A state: the next number is the degree of the open record.
PENDING = -1
#: Entries of a table that make a row.
CHUNK = 1 << 16


def last_starts(t: np.ndarray) -> np.ndarray:
    """For a record that starts at each number, where the last one starts that begins in this split; by doubling of jumps."""
    n = len(t)
    here = np.arange(n)
    nxt = np.full(n, n)
    if n > 1:
        nxt[:-1] = np.minimum(here[:-1] + 2 + t[1:], n)
    last = here
    while len(nxt) and (nxt < n).any():
        inside = nxt < n
        to = np.where(inside, nxt, 0)
        last = np.where(inside, last[to], last)
        nxt = np.where(inside, nxt[to], n)
    return last


def leaves(t: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and source at the split's end, by where the last record starts."""
    n = len(t)
    degree = np.where(last + 1 < n, t[np.minimum(last + 1, n - 1)], 0)
    return np.where(last + 1 < n, last + 2 + degree - n, PENDING), t[last]


def edges_of(t: np.ndarray, state: int, src: int) -> tuple[np.ndarray, np.ndarray]:
    """src, dst of the edges whose destinations stand in this split, entered in ``state`` with ``src`` open."""
    n = len(t)
    begin = state
    lead = slice(0, min(state, n)) if state >= 0 else slice(1, min(1 + int(t[0]), n)) if n else slice(0, 0)
    if state == PENDING:
        begin = 1 + int(t[0]) if n else 0
    starts = []
    while begin < n:
        starts.append(begin)
        begin += 2 + int(t[begin + 1]) if begin + 1 < n else n
    at = np.array(starts, np.int64)
    first = np.minimum(at + 2, n)
    count = np.minimum(np.where(at + 1 < n, t[np.minimum(at + 1, n - 1)] if n else 0, 0), n - first)
    where = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(at) else np.zeros(0, np.int64)
    head = t[lead]
    return np.concatenate([np.full(len(head), src, np.int64), np.repeat(t[at], count) if len(at) else head[:0]]), np.concatenate([head, t[where]])


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split of a file: its numbers, and whether every line is a whole list."""
    at, parts, whole = None, [], True

    def row() -> pa.RecordBatch:
        numbers = np.concatenate(parts).astype("<u4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([len(numbers) // 4], pa.int64()), pa.array([whole]), pa.array([numbers], pa.large_binary()).cast(pa.binary())], names=["file", "start", "n", "whole", "t"])

    for batch in batches:
        lists, files, starts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        cuts = [0, *(i for i in range(1, len(files)) if (files[i], starts[i]) != (files[i - 1], starts[i - 1])), len(files)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (files[a], starts[a]) != at:
                if at:
                    yield row()
                at, parts, whole = (files[a], starts[a]), [], True
            low, size = bounds[a:b], np.diff(bounds[a : b + 1])
            parts.append(flat[bounds[a] : bounds[b]])
            whole &= bool((size >= 2).all()) and bool((flat[low + 1] + 2 == size).all())
    if at:
        yield row()


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A split's table in rows of ``CHUNK`` entries; entry 0 is that of ``PENDING``, entry 1 + i that of number i."""
    for batch in batches:
        for no, numbers in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = np.frombuffer(numbers.as_buffer(), "<u4").astype(np.int64)
            state, src = leaves(t, last_starts(t))
            begin = 1 + int(t[0])  # with the degree first, the list's end is where the next record starts
            first = (state[begin], src[begin]) if begin < len(t) else (begin - len(t), -1)  # -1: the source that was open
            state, src = np.concatenate([[first[0]], state]), np.concatenate([[first[1]], src])
            for k in range(0, len(state), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([k // CHUNK], pa.int64()), pa.array([state[k : k + CHUNK].tolist()], pa.list_(pa.int64())), pa.array([src[k : k + CHUNK].tolist()], pa.list_(pa.int64()))], names=["no", "chunk", "state", "src"])


def _followed(tables: DataFrame, splits: list[tuple[str, int, int, int]]) -> list[tuple[int, int, int]]:
    """no, state, src that each split (file, start, n, no) is entered with; all files take a step at a time, each by one entry of one table."""
    of: dict[str, list[tuple[int, int]]] = {}
    for file, _, n, no in sorted(splits):
        of.setdefault(file, []).append((n, no))
    at, state, out = dict.fromkeys(of, 0), dict.fromkeys(of, (0, -1)), []
    while True:
        asked = {}
        for file, own in of.items():
            while at[file] < len(own):
                n, no = own[at[file]]
                left, src = state[file]
                out.append((no, left, src))
                if left < n:
                    asked[no] = (file, 0 if left == PENDING else left + 1, src)
                    break
                state[file] = (left - n, src)  # a list that goes on through the whole split
                at[file] += 1
        if not asked:
            break
        here = F.lit(False)
        for no, (_, k, _) in asked.items():
            here = here | ((F.col("no") == no) & (F.col("chunk") == k // CHUNK))
        place = F.element_at(F.create_map(*[F.lit(x) for no, (_, k, _) in asked.items() for x in (no, k % CHUNK)]), F.col("no").cast("int"))
        for r in tables.filter(here).select("no", F.get("state", place).alias("state"), F.get("src", place).alias("src")).collect():
            file, _, src = asked[r["no"]]
            state[file] = (r["state"], src if r["src"] == -1 else r["src"])
            at[file] += 1
    for file, (left, _) in state.items():
        if left:
            raise ValueError(f"adjacency list shorter than its degree at the end of {file}")
    return out


def read_adjacency_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Numbers ``src degree d1 .. dn`` over and over as edges in order; line ends mean no more than blanks.

    Splits are read in parallel, however records lie over lines and splits. Where every line of a file is one list, each split starts with
    a record; other files' splits make tables first. A list shorter than its degree is an error, as is a name out of range.
    """
    from .edges import add_edge_index

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    numbers = F.transform(F.split(F.btrim("value", F.lit(" \t\r")), r"\s+"), lambda x: checked(x.cast("long")))
    lines = lines.filter(F.btrim("value", F.lit(" \t\r")) != "").select(numbers.alias("t"), "file", "start")
    splits = stage(lines.mapInArrow(_splits, "file string, start long, n long, whole boolean, t binary"), "splits")
    known = sorted((r["file"], r["start"], r["n"], r["whole"]) for r in splits.select("file", "start", "n", "whole").collect())  # one row a split
    mixed = {file for file, _, _, whole in known if not whole}
    spots = [(file, start, n, no) for no, (file, start, n, _) in enumerate(known)]
    numbered = splits.join(F.broadcast(spark.createDataFrame([(f, s, no, f in mixed) for f, s, _, no in spots], "file string, start long, no long, mixed boolean")), ["file", "start"])
    entered = {no: (0, -1) for *_, no in spots}
    if mixed:
        tables = stage_parts(numbered.filter("mixed").select("no", "t").mapInArrow(_tables, "no long, chunk long, state array<long>, src array<long>"), "tables", "no")
        entered |= {no: (state, src) for no, state, src in _followed(tables, [s for s in spots if s[0] in mixed])}
        discard(tables)
    states = spark.createDataFrame([(no, *entered[no]) for *_, no in spots], "no long, state long, open long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, state, open_, t in zip(*(batch.column(i) for i in range(5)), strict=True):
                src, dst = edges_of(np.frombuffer(t.as_buffer(), "<u4").astype(np.int64), state.as_py(), open_.as_py())
                for k in range(0, len(src), 1 << 20):
                    s = pa.array(src[k : k + (1 << 20)])
                    yield pa.RecordBatch.from_arrays([s, pa.array(dst[k : k + (1 << 20)]), pa.array([file.as_py()] * len(s)), pa.array([start.as_py()] * len(s), pa.int64())], names=["src", "dst", "_file", "_start"])

    rows = numbered.join(F.broadcast(states), "no").select("file", "start", "state", "open", "t")
    return add_edge_index(rows.mapInArrow(run, "src long, dst long, _file string, _start long")).select("edge_idx", "src", "dst")
