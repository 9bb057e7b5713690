"""Operator 6, hierarchical residual best-fit packing.

``token_pieces`` turns texts into token pieces; ``pack`` packs rows with a length. Each partition
packs its items best-fit, longest first. Bins that are nearly full are final; the others are items
of the next round, in which partitions are merged in a tree until one task's worth is left. A task
never holds more than ``task_items`` bins: where more underfull bins remain than that (as when no
two of them fit together), rounds go on in as many tasks as needed and end when they gain nothing.

Defined results: a null or empty text is the end token alone; repeated rows are packed as often as
they occur; an empty table gives no sequence; further columns are ignored. Long texts are encoded
whole, word by word: the vocabulary drops white space, so tokens never cross it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage

def _byte_letters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class WordIds(dict):
    """Word -> its token ids as little-endian unsigned 32-bit bytes; forgets all beyond ``limit`` words.

    Case and one last comma or full stop behind a letter never change the rest of a word's ids, so
    unseen words are encoded without them; words of letters alone are one piece of the vocabulary's
    own pattern and go to its merges directly, all others through the whole tokenizer.
    """

    kept: dict[str, WordIds] = {}

    def __init__(self, vocabulary: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(vocabulary), limit
        self.letters = _byte_letters()
        self.ends = {c: self._alone(c) for c in (b",", b".")}

    def _alone(self, word: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, word: bytes) -> bytes:
        """The ids of a word without last comma or full stop."""
        found = self.get(word)
        if found is None:
            if word.isalpha():
                pieces = self.tokenizer.model.tokenize(word.decode("ascii").lower())
            elif not word.isascii() and (s := word.decode()).isalpha() and max(s) < "\u0100":
                pieces = self.tokenizer.model.tokenize(s.lower().encode().decode("latin-1").translate(self.letters))
            else:
                pieces = None
            found = self._alone(word) if pieces is None else b"".join([p.id.to_bytes(4, "little") for p in pieces])
            self[word] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        core, last = word.lower() if word.isascii() else word, word[-1:]
        if last in self.ends and core[-2:-1].isalpha():
            self[word] = found = self._core(core[:-1]) + self.ends[last]
        else:
            self[word] = found = self._core(core)
        return found

    @classmethod
    def of(cls, vocabulary: str) -> WordIds:
        """This process's table for a vocabulary: a worker's later tasks know the words of its earlier ones."""
        if vocabulary not in cls.kept:
            cls.kept[vocabulary] = cls(vocabulary)
        return cls.kept[vocabulary]

    def encode(self, texts: list[bytes | None], end: bytes) -> list[bytes]:
        """The ids of each text (in UTF-8) and then ``end``."""
        if len(self) > self.limit:
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, (t.lower() if t.isascii() else t).split())) + end if t else end for t in texts]


def token_pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32[, ids]: each document's tokens and one end token, cut at ``capacity``."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema.add("ids", T.BinaryType())
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordIds.of(vocabulary)
        for batch in batches:
            raw = pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary()
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, b in enumerate(cache.encode(part.column(1).cast(raw).to_pylist(), end)):
                    for k, s in enumerate(range(0, len(b), 4 * capacity)):
                        p = b[s : s + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(p) // 4)
                        crc.append(zlib.crc32(p))
                        if with_ids:
                            ids.append(p)
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.binary())] if with_ids else [])], names=schema.names)

    return source.mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the place in it of each size, taken in the given order; each goes where least room is left.

    Bins lie in stacks by room; a bit for each room that has a bin finds the tightest one.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = count = 0
    bins, places = [], []
    for s in sizes:
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins.append(b)
        places.append(capacity - room)
        left = room - s
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins, places


def _packed(fill: np.ndarray, members: pa.ListArray, capacity: int) -> pa.RecordBatch:
    """One round over the given bins: bins of bins, with their members' places moved along."""
    order = np.argsort(-fill, kind="stable")
    bins, places = (np.asarray(x, np.int64) for x in best_fit(fill[order].tolist(), capacity))
    by_bin = np.argsort(bins, kind="stable")
    order, bins, places = order[by_bin], bins[by_bin], places[by_bin]
    offsets, inner = members.offsets.to_numpy(), members.values
    counts = np.diff(offsets)[order]
    first = np.repeat(offsets[:-1][order] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    take = first + np.arange(counts.sum())
    moved = inner.take(pa.array(take))
    at = moved.field("offset").to_numpy(zero_copy_only=False) + np.repeat(places, counts)
    names = [f.name for f in inner.type]
    fields = [pa.array(at, pa.int64()) if n == "offset" else moved.field(n) for n in names]
    n_bins = int(bins[-1]) + 1 if len(bins) else 0
    sizes = np.bincount(np.repeat(bins, counts), minlength=n_bins)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(fields, names=names))
    return pa.RecordBatch.from_arrays([pa.array(np.bincount(bins, fill[order], n_bins).astype(np.int64)), lists], names=["fill", "members"])


def _round(bins: DataFrame, capacity: int, task_items: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("members").combine_chunks()
            return _packed(table.column("fill").to_numpy(), lists, capacity)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= task_items:
                yield done()
                held, rows = [], 0
        if rows:
            yield done()

    return bins.mapInArrow(run, bins.schema)


def pack(items: DataFrame, capacity: int = 2048, length: str = "length", nearly_full: float = 0.995, task_items: int = 200_000, fan_in: int = 8) -> DataFrame:
    """The rows of ``items`` with sequence_id and offset (which replace columns so named); no sequence exceeds ``capacity``, none has gaps.

    ``nearly_full``: bins filled to that part are final; ``fan_in``: partitions that a round merges into one.
    """
    items = items.drop("sequence_id", "offset")
    member = F.struct(*[F.col(c) for c in items.columns], F.lit(0).cast("long").alias("offset"))
    items = stage(items, "items")
    bins = items.select(F.col(length).cast("long").alias("fill"), F.array(member).alias("members"))
    limit = int(nearly_full * capacity)
    # As few parts as a task's bound allows: the more items a part has, the tighter it packs.
    bins = stage(_round(bins.coalesce(max(1, -(-items.count() // task_items))), capacity, task_items), "bins")
    final, parts, before = [], None, None
    while True:
        left = bins.filter(F.col("fill") < limit)
        count = left.count()
        stuck = before is not None and count > 0.995 * before
        if count <= 1 or (before is not None and parts == 1) or (stuck and count > task_items):
            final.append(bins)
            break
        final.append(bins.filter(F.col("fill") >= limit))
        now = bins.rdd.getNumPartitions() if parts is None else parts
        parts, before = max(-(-now // fan_in), -(-count // task_items), 1), count
        bins = stage(_round(left.coalesce(parts), capacity, task_items), "bins")
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    # Numbered before members are taken apart: in one select, each member would get a number.
    out = out.withColumn("sequence_id", F.monotonically_increasing_id())
    out = out.select("sequence_id", F.explode("members").alias("m"))
    return out.select(*[F.col(f"m.{c}").alias(c) for c in items.columns], "sequence_id", F.col("m.offset").alias("offset"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES: dict[str, str] = {}
