"""Operator 7, scoring with Brown class-based n-grams.

Words of at least ``min_count`` training tokens belong to ``classes`` word classes, which exchange
clustering finds; rarer words form classes by magnitude of count, the end mark is a class of its own. A
text's probability is the product over its tokens of class transition (smoothed by class frequency)
and word emission (absolute discounting; what is discounted goes to unknown words, from all classes).

The exchange runs on all training tokens in parallel sweeps. Words take turns (``TURNS``, by hash): in a
word's turn it goes to the class where it raises the likelihood of the class sequence most, against the counts at
the sweep's start less its own share. A sweep that together lowers the likelihood is taken back, and half as
many words may move in that turn's next one. Sweeps end when a whole round of turns gains less than ``tolerance`` of all that was gained.

Texts are kept as blocks of word numbers, each with its own dictionary, in buckets by block, so that no sweep
shuffles a text. Dictionaries meet shard by shard (words by 64-bit hash), where words get their counts and places;
from then on a block and a shard exchange places, neighbouring classes and new classes of words. No vocabulary is
broadcast: what is gathered grows with the corpus. Only class-by-class matrices reach the driver.

Defined results: a null or empty text is the end mark alone; a null key is never held out; with no
training text every probability is 1; repeated rows count and return each; further columns are ignored.
A very long text is one row of one block, which must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..plans.staging import discard, stage, stage_bucketed
from .common import in_fold, small_batches

#: Half of the words may move in a sweep, the other half in the next.
TURNS = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROW = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("x", T.BinaryType()),
        T.StructField("y", T.BinaryType()),
        T.StructField("z", T.BinaryType()),
        T.StructField("n", T.BinaryType()),
        T.StructField("sums", T.ArrayType(T.LongType())),
    ]
)


def _packed(values: np.ndarray, kind: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _loose(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _rising(values: np.ndarray) -> bytes:
    """Ascending whole numbers as their steps, which pack well."""
    return _packed(np.diff(values, prepend=0), "<i4")


def _risen(blob: bytes) -> np.ndarray:
    return np.cumsum(_loose(blob, "<i4"), dtype=np.int64)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    return values[first], np.diff(np.append(first, len(values)))


class _Numbers(dict):
    """Word -> its number in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _batch(rows: list[tuple], more: T.StructType | None = None) -> pa.RecordBatch:
    """(kind, block, shard, x, y, z, n, sums) rows as a batch; columns of ``more`` are null."""
    want = to_arrow_schema(_ROW)
    cols = list(zip(*rows, strict=True)) or [()] * len(want)
    arrays = [pa.array(list(c), f.type) for c, f in zip(cols, want, strict=True)]
    extra = [] if more is None else [f for f in to_arrow_schema(more) if f.name not in want.names]
    return pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(rows), f.type) for f in extra]], names=[*want.names, *[f.name for f in extra]])


def word_blocks(docs: DataFrame, key: str, text: str, held: Column, shards: int, block_tokens: int = 2_000_000) -> DataFrame:
    """Rows of kind ``texts`` (block, lengths x, numbers y, keys, held: a block's texts as word numbers) and ``words``
    (block, shard, ascending hashes x, numbers y, training counts z: its dictionary)."""
    source = docs.select(F.col(key).alias("key"), held.alias("held"), F.col(text).alias("text"))
    schema = T.StructType([*_ROW.fields, T.StructField("keys", T.ArrayType(source.schema["key"].dataType)), T.StructField("held", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        numbers, texts, keys, out = _Numbers(), [], [], []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            flags = np.array(out, bool)
            lengths = np.array([len(t) for t in texts], np.int64)
            ids = np.concatenate([*texts, np.zeros(0, np.int32)])
            whole = _batch([("texts", block, None, _packed(lengths, "<i4"), _packed(ids, "<i4"), None, None, None)])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(flags)], pa.int32()), pa.concat_arrays(keys)), pa.array([flags.tolist()])]
            yield pa.RecordBatch.from_arrays([*whole.columns, *lists], names=schema.names)
            trained = np.bincount(ids[np.repeat(~flags, lengths)], minlength=len(numbers))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            order = np.lexsort((hashes, shard := (hashes % np.uint64(shards)).astype(np.int64)))
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = []
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[s] : cuts[s + 1]]
                rows.append(("words", block, s, _packed(hashes[at], "<u8"), _packed(at, "<i4"), _packed(trained[at], "<i8"), None, None))
            if rows:
                yield _batch(rows, schema)

        for batch in batches:
            flags = batch.column(1).to_pylist()
            for at in range(0, batch.num_rows, 500):
                part = batch.column(2).slice(at, 500).to_pylist()
                for t in part:
                    words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
                    texts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    size += len(words)
                keys.append(batch.column(0).slice(at, 500))
                out += flags[at : at + 500]
                if size >= block_tokens:
                    yield from flush()
                    block += 1
                    numbers, texts, keys, out, size = _Numbers(), [], [], [], 0
        if out:
            yield from flush()

    return source.mapInArrow(run, schema)


class Layout:
    """Numbers of the classes: rare words by bits of their count, then the end mark, then the learned classes."""

    def __init__(self, min_count: int, classes: int):
        self.min_count, self.rare = min_count, max(1, (min_count - 1).bit_length())
        self.end, self.first, self.total = self.rare, self.rare + 1, self.rare + 1 + classes
        self.learned = classes

    def rare_class(self, counts: np.ndarray) -> np.ndarray:
        """The class of words by count alone; unknown words go with those seen once."""
        return np.minimum(np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1, self.rare - 1)

    def mixed(self, shard: int, places: np.ndarray) -> np.ndarray:
        """A hash of each word of a shard by its place there."""
        x = (places.astype(np.uint64) + np.uint64((shard << 32) + 1)) * _ODD
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)

    def start(self, mixed: np.ndarray) -> np.ndarray:
        """The class that a word has before its first turn."""
        return self.first + ((mixed >> np.uint64(8)) % np.uint64(self.learned)).astype(np.int64)

    def turn(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed % np.uint64(TURNS)).astype(np.int64)


def count_words(words: DataFrame, layout: Layout) -> DataFrame:
    """By shard: ``place`` (block: numbers x, ascending places in the shard y, training counts of all blocks z), ``state``
    (training counts x and classes y of the shard's words) and ``sum`` (totals)."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [(b, _loose(x, "<u8"), y, _loose(z, "<i8")) for b, x, y, z in zip(*(table.column(c).to_pylist() for c in ("block", "x", "y", "z")), strict=True)]
        words, own = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, own, np.concatenate([p[3] for p in parts]))
        known = counts[counts > 0]
        start = layout.start(layout.mixed(shard, np.arange(len(words))))
        types = np.bincount(layout.rare_class(known[known < layout.min_count]), minlength=layout.total) + np.bincount(start[counts >= layout.min_count], minlength=layout.total)
        rows = [
            ("sum", None, shard, None, None, None, None, [len(known), int(known.sum()), int((known == 1).sum()), int((known == 2).sum()), *types.tolist()]),
            ("state", None, shard, _packed(counts, "<i8"), _packed(start, "<i2"), None, None, None),
        ]
        at = 0
        for b, x, y, _ in parts:
            mine = own[at : at + len(x)]
            at += len(x)
            rows.append(("place", b, shard, y, _rising(mine), _packed(counts[mine], "<i8"), None, None))
        return pa.Table.from_batches([_batch(rows)])

    return words.select(*_ROW.names).groupBy("shard").applyInArrow(run, _ROW)


class Block:
    """A block's tokens with their counts and classes, one end mark behind each text."""

    def __init__(self, row: dict, layout: Layout, ends: int):
        self.number = row["block"]
        lengths, ids = _loose(row["x"], "<i4").astype(np.int64), _loose(row["y"], "<i4")
        n = int(ids.max()) + 1 if len(ids) else 0
        counts = np.zeros(n + 1, np.int64)
        # Per shard, the words that take part in the exchange: numbers here, places there, turns.
        self.often: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for p in row["places"] or []:
            numbers, c = _loose(p["x"], "<i4"), _loose(p["z"], "<i8")
            counts[numbers] = c
            pick = c >= layout.min_count
            place = _risen(p["y"])[pick]
            self.often.append((p["shard"], numbers[pick], place, layout.mixed(p["shard"], place)))
        counts[n] = ends
        classes = layout.rare_class(counts).astype(np.int16)
        moved = [{p["shard"]: p["x"] for p in row[f"moved{t}"] or []} for t in range(TURNS)]
        for shard, numbers, _, mixed in self.often:
            classes[numbers] = layout.start(mixed)
            for t in range(TURNS):
                if shard in moved[t]:
                    classes[numbers[layout.turn(mixed) == t]] = _loose(moved[t][shard], "<i2")
        classes[n] = layout.end
        stops = np.cumsum(lengths + 1) - 1
        self.tokens = np.full(len(ids) + len(lengths), n, np.int32)
        inner = np.ones(len(self.tokens), bool)
        inner[stops] = False
        self.tokens[inner] = ids
        self.held, self.keys = np.array(row["held"], bool), row["keys"]
        self.train = np.repeat(~self.held, lengths + 1)
        self.starts, self.lengths = stops - lengths, lengths
        self.counts, self.classes = counts, classes
        self.seq_class = classes[self.tokens]
        self.before = np.concatenate([[layout.end], self.seq_class[:-1]]).astype(np.int16) if len(self.tokens) else self.seq_class

    def near(self, layout: Layout, turn: int) -> list[tuple]:
        """How often each class stands left and right of the words of a turn, one row per shard: their places x, and
        per neighbouring class (left, then right) the word y, the class z, the count n."""
        parts = [(s, numbers[own], place[own]) for s, numbers, place, mixed in self.often if (own := layout.turn(mixed) == turn).any()]
        if not parts:
            return []
        wide = 2 * layout.total
        starts = np.cumsum([0, *[len(p[1]) for p in parts]])
        order = np.full(len(self.counts), -1, np.int64)
        for (_, numbers, _), first in zip(parts, starts, strict=False):
            order[numbers] = first + np.arange(len(numbers))
        at = np.flatnonzero(self.train & (order[self.tokens] >= 0))
        mine = order[self.tokens[at]] * wide
        kind = np.int32 if starts[-1] * wide < 1 << 31 else np.int64
        slots, n = _runs(np.sort(np.concatenate([mine + self.before[at], mine + layout.total + self.seq_class[at + 1]]).astype(kind)))
        word = slots // wide
        cuts = np.searchsorted(word, starts)
        return [
            ("near", self.number, s, _rising(place), _rising(word[p:q] - first), _packed(slots[p:q] % wide, "<i2"), _packed(n[p:q], "<i4"), None)
            for (s, _, place), first, p, q in zip(parts, starts, cuts, cuts[1:], strict=False)
        ]


def _over_blocks(texts: DataFrame, places: DataFrame, moved: list[DataFrame | None]) -> DataFrame:
    """One row per block: its texts, its words' places and counts, the classes they have moved to. Texts stay in their buckets."""
    lists = places.groupBy("block").agg(F.collect_list(F.struct("shard", "x", "y", "z")).alias("places"))
    out = texts.select("block", "x", "y", "keys", "held").join(lists.hint("shuffle_hash"), "block", "left")
    for t, rows in enumerate(moved):
        if rows is None:
            out = out.withColumn(f"moved{t}", F.lit(None).cast("array<struct<shard:int,x:binary>>"))
        else:
            classes = rows.filter("kind = 'class'").groupBy("block").agg(F.collect_list(F.struct("shard", "x")).alias(f"moved{t}"))
            out = out.join(classes.hint("shuffle_hash"), "block", "left")
    return out


def _blocks_of(batches: Iterator[pa.RecordBatch], layout: Layout, ends: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0], layout, ends)


def _neighbours(rows: DataFrame, layout: Layout, ends: int, turn: int) -> DataFrame:
    """Kinds ``matrix`` (sums: class transitions, flat, one row a task) and ``near`` (see ``Block.near``)."""
    wide = layout.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros(wide * wide, np.int64)
        for b in _blocks_of(batches, layout, ends):
            matrix += np.bincount(b.before[b.train].astype(np.int32) * wide + b.seq_class[b.train], minlength=wide * wide)
            yield _batch(b.near(layout, turn))
        if matrix.any():
            yield _batch([("matrix", None, None, None, None, None, None, matrix.tolist())])

    return rows.mapInArrow(run, _ROW)


def _matrix(stats: DataFrame, layout: Layout) -> np.ndarray:
    """Class transitions of all blocks; classes squared numbers, whatever the corpus."""
    flat = stats.filter("kind = 'matrix'").select(F.posexplode("sums").alias("at", "n")).filter("n > 0").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(layout.total**2)
    for r in flat.collect():
        out[r["at"]] = r["n"]
    return out.reshape(layout.total, layout.total)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _likelihood(matrix: np.ndarray) -> float:
    """What of the training log likelihood depends on the classes."""
    return _xlogx(matrix).sum() - 2 * _xlogx(matrix.sum(0)).sum()


def best_classes(now: np.ndarray, counts: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray, matrix: np.ndarray, layout: Layout, chunk: int = 256) -> np.ndarray:
    """The class of each word (of classes ``now``) that raises the likelihood most, all others standing still.

    ``word`` (ascending), ``slot``, ``n``: how often a class stands left (slot) or right (slot less the number of classes) of a word.
    """
    size = matrix.sum(0)[layout.first :]
    sides = np.concatenate([matrix[:, layout.first :], matrix[layout.first :].T])
    out = now.copy()
    for at in range(0, len(now), chunk):
        mine, own = now[at : at + chunk] - layout.first, counts[at : at + chunk, None]
        rows = np.arange(len(mine))
        here = mine[:, None] == np.arange(layout.learned)
        rest = np.maximum(size - own * here, 0)
        gain = -2 * (_xlogx(rest + own) - _xlogx(rest))
        p, q = np.searchsorted(word, [at, at + len(mine)])
        if q > p:
            w, m = word[p:q] - at, n[p:q, None]
            old = np.maximum(sides[slot[p:q]] - m * here[w], 0)
            turns = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[turns]] += np.add.reduceat(_xlogx(old + m) - _xlogx(old), turns, axis=0)
        # A word stays where another class is no better than by rounding.
        best = gain.argmax(1)
        out[at : at + chunk] = layout.first + np.where(gain[rows, best] > gain[rows, mine] + 1e-9, best, mine)
    return out


def _exchange(state: DataFrame, stats: DataFrame, matrix: np.ndarray, layout: Layout, turn: int, narrow: int, sweep: int) -> DataFrame:
    """After a turn in which one word of 2 ** ``narrow`` may move: ``class`` (by block: the classes x of the turn's words, in order of place), ``state`` and ``sum`` (words per class)."""
    wide = layout.total

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shard = rows[0]["shard"]
        mine = next(r for r in rows if r["kind"] == "state")
        counts, new = _loose(mine["x"], "<i8"), _loose(mine["y"], "<i2").astype(np.int64)
        near = [(r["block"], _risen(r["x"]), _risen(r["y"]), _loose(r["z"], "<i2"), _loose(r["n"], "<i4")) for r in rows if r["kind"] == "near"]
        if near:
            keys = np.concatenate([place[word] * 2 * wide + slot for _, place, word, slot, _ in near])
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.diff(keys[order], prepend=-1))
            n = np.add.reduceat(np.concatenate([p[4] for p in near])[order].astype(np.float64), first) if len(first) else np.zeros(0)
            keys = keys[order][first]
            mixed = layout.mixed(shard, np.arange(len(new)))
            chosen = ((mixed >> np.uint64(16)) + np.uint64(sweep)) % np.uint64(1 << narrow) == 0
            may = np.flatnonzero((layout.turn(mixed) == turn) & (counts >= layout.min_count) & chosen)
            word = keys // (2 * wide)
            number = np.full(len(new), -1)
            number[may] = np.arange(len(may))
            pick = number[word] >= 0
            new[may] = best_classes(new[may], counts[may].astype(np.float64), number[word[pick]], keys[pick] % (2 * wide), n[pick], matrix, layout)
        out = [
            ("sum", None, shard, None, None, None, None, np.bincount(new[counts >= layout.min_count], minlength=wide).tolist()),
            ("state", None, shard, mine["x"], _packed(new, "<i2"), None, None, None),
        ]
        out += [("class", p[0], shard, _packed(new[p[1]], "<i2"), None, None, None, None) for p in near]
        return pa.Table.from_batches([_batch(out)])

    return state.filter("kind = 'state'").union(stats.filter("kind = 'near'")).groupBy("shard").applyInArrow(run, _ROW)


class ClassModel:
    """Log10 transition and emission tables of the class bigram."""

    def __init__(self, matrix: np.ndarray, types: np.ndarray, discount: float, layout: Layout, smooth: float = 5.0):
        size = matrix.sum(0)
        total = size.sum()
        share = size / total if total else np.full(len(size), 1 / len(size))
        move = (matrix + smooth * share) / (matrix.sum(1, keepdims=True) + smooth)
        self.discount = np.full(layout.total, discount)
        self.discount[layout.end] = 0.0
        with np.errstate(divide="ignore"):
            self.move, self.size = np.log10(move), np.log10(np.maximum(size, 1))
            self.unknown = np.log10(np.maximum(move @ (self.discount * types / np.maximum(size, 1)), 1e-300))


def exchange(texts: DataFrame, places: DataFrame, state: DataFrame, layout: Layout, ends: int, sweeps: int, tolerance: float) -> tuple[list[DataFrame | None], DataFrame, np.ndarray]:
    """For each turn the table of classes that its words have moved to, the shards' states, and the class transitions.

    Sweeps until a round of turns gains less than ``tolerance`` of all gained so far, at most ``sweeps``.
    """
    moved: list[DataFrame | None] = [None] * TURNS
    narrow, recent, tried = [0] * TURNS, [], None
    best = start = matrix = None
    for sweep in range(sweeps + 1):
        turn, last = sweep % TURNS, (sweep - 1) % TURNS
        trial = moved if tried is None else [tried if t == last else m for t, m in enumerate(moved)]
        stats = stage(_neighbours(_over_blocks(texts, places, trial), layout, ends, turn), "near")
        found = _matrix(stats, layout)
        gain = _likelihood(found)
        if best is None:
            best, start, matrix = gain, gain, found
        elif gain >= best:
            if moved[last] is not None:
                discard(moved[last])
            recent.append(gain - best)
            moved, state, best, matrix = trial, tried, gain, found
        else:
            # Moves that were good one by one were not together: fewer at a time, from the best so far.
            narrow[last] += 1
            recent.append(0.0)
            discard(tried, stats)
            stats = stage(_neighbours(_over_blocks(texts, places, moved), layout, ends, turn), "near")
        done = len(recent) >= TURNS and sum(recent[-TURNS:]) <= tolerance * (best - start) and (best > start or not any(narrow))
        if done or sweep == sweeps:
            discard(stats)
            break
        tried = stage(_exchange(state, stats, matrix, layout, turn, narrow[turn], sweep // TURNS), "classes")
        discard(stats)
    return moved, state, matrix


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None, min_count: int = 5, classes: int = 64, sweeps: int = 20, tolerance: float = 0.02, block_tokens: int = 2_000_000) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score; rows under ``held`` are not learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    layout = Layout(min_count, classes)
    kind = docs.select(F.col(key)).schema[0].dataType
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    # What a task gets: about 64 MB of texts as blocks, or the words of as much.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))
    made = word_blocks(docs, key, text, F.coalesce(held, F.lit(False)) if held is not None else F.lit(False), buckets, block_tokens)
    blocks = stage_bucketed(made, "blocks", "block", buckets, "kind")
    texts = blocks.filter("kind = 'texts'")
    dicts = stage(count_words(blocks.filter("kind = 'words'"), layout), "dicts")
    places = stage_bucketed(dicts.filter("kind = 'place'").select("block", "shard", "x", "y", "z").repartition(buckets, "block"), "places", "block", buckets)
    ends = texts.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(4 + layout.total)]
    first = [x or 0 for x in dicts.filter("kind = 'sum'").agg(*sums).first()]
    n_types, n_train, ones, twos = first[0] + (ends > 0), first[1] + ends, first[2], first[3]
    moved, state, matrix = exchange(texts, places, dicts, layout, ends, sweeps, tolerance)
    types = np.array(first[4:], float)
    if state is not dicts:
        counted = [x or 0 for x in state.filter("kind = 'sum'").agg(*sums[: layout.total]).first()]
        types[layout.first :] = counted[layout.first :]
    types[layout.end] = 1
    rows = _over_blocks(texts, places, moved)
    model = vars(ClassModel(matrix, types, min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5, layout))
    floor = np.log10(n_train + n_types + 1)
    schema = T.StructType([T.StructField(key, kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    as_keys = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks_of(batches, layout, ends):
            known = b.counts > 0
            base = np.log10(b.counts + 1) - floor
            if n_train:
                emit = np.log10(np.maximum(b.counts - model["discount"][b.classes], 1e-300)) - model["size"][b.classes]
                each = np.where(known[b.tokens], model["move"][b.before, b.seq_class] + emit[b.tokens], model["unknown"][b.before])
            else:
                each = np.zeros(len(b.tokens))
            add = lambda v: np.add.reduceat(v, b.starts)
            cols = [pa.array(b.keys, as_keys), pa.array(b.held), pa.array(b.lengths + 1), pa.array(add(known[b.tokens].astype(np.int64))), pa.array(np.full(len(b.held), n_train, np.int64)), pa.array(add(base[b.tokens])), pa.array(add(each))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    out = stage(rows.mapInArrow(run, schema), "scores")
    discard(blocks, dicts, places, *[m for m in moved if m is not None])
    return out


def op7_brown_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, held=in_fold(F.col("doc_id"), 7, 2))


QUERIES = {"op7_brown_scoring": op7_brown_scoring}
ORACLES: dict[str, str] = {}
