"""Operator 3, benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (ASCII letters lower-cased; digits, ASCII letters and everything beyond
ASCII make words). Each benchmark word becomes one character, any other word a blank, so that a
document is a string of one character a word: the automaton of all windows scans it once, and a
match's place is a word number, which maps back to offsets in the original text.

The automaton holds one block of items of a stated size; a benchmark of more than one block is
scanned block by block over all documents, each block's hits added to the rows. So what goes to
the executors is bounded and every item counts.

Defined results: a null or empty text has no words and no hits; an item without words has no
window; a null item_id counts as the empty string; repeated items and rows count each; an empty
benchmark hits nothing; other columns are passed along, but for those that have a result's name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage

#: Lower-cases A-Z and blanks every other ASCII byte that is no letter or digit.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int, window: int) -> Iterator[list[tuple[int, str, list[bytes]]]]:
    """The benchmark's items (number, name, words) in blocks of at most ``block_words``, read as a stream.

    An item that is longer falls into pieces that overlap by all but one word of a window, so none of its windows is lost.
    """
    held, words = [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text))
    for k, (name, said) in enumerate(rows.toLocalIterator()):
        own = normal_words(said)
        step = max(1, block_words - window + 1)
        for at in range(0, max(1, len(own) - window + 1), step) if own else ():
            piece = own[at : at + step + window - 1]
            if held and words + len(piece) > block_words:
                yield held
                held, words = [], 0
            held.append((k, name, piece))
            words += len(piece)
    if held:
        yield held


class Windows:
    """The automaton over the windows of a block of items."""

    def __init__(self, items: list[tuple[int, str, list[bytes]]], size: int):
        import ahocorasick

        self.names = [(number, name) for number, name, _ in items]
        self.char: dict[bytes, str] = {}
        found: dict[str, list[int]] = {}
        for k, (_, _, words) in enumerate(items):
            coded = "".join(self._coded(w) for w in words)
            n = min(size, len(coded))
            for i in range(len(coded) - n + 1):
                owners = found.setdefault(coded[i : i + n], [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.automaton = ahocorasick.Automaton()
        for window, owners in found.items():
            self.automaton.add_word(window, (len(window), owners))
        self.automaton.make_automaton()
        self.any = bool(found)

    def _coded(self, word: bytes) -> str:
        if word not in self.char:
            k = len(self.char) + 256
            self.char[word] = chr(k if k < 0xD800 else k + 0x800)
        return self.char[word]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Half-open word ranges of all windows that occur, merged, and the items they come from."""
        if not self.any:
            return [], set()
        get = self.char.get
        ranges: list[tuple[int, int]] = []
        owners: set[int] = set()
        found = sorted((end + 1 - n, end + 1, own) for end, (n, own) in self.automaton.iter("".join([get(w, " ") for w in words])))
        for start, end, own in found:
            owners.update(own)
            if ranges and start <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
            else:
                ranges.append((start, end))
        return ranges, owners


#: The automaton of the block that this Python worker used last.
_built: dict[str, Windows] = {}


def _windows_of(sent, size: int) -> Windows:
    """The automaton of a broadcast block, made once per Python worker."""
    if sent.id not in _built:
        _built.clear()
        _built[sent.id] = Windows(sent.value, size)
    return _built[sent.id]


class _Sent:
    """A broadcast block with what tells it from others."""

    def __init__(self, broadcast, number: str):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self) -> list:
        return self.broadcast.value


def _merged(a: list[dict], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([(x["first"], x["past"]) for x in a] + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_RANGES = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 500_000, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) with n_words, n_hit, item_ids, word_ranges, spans (code point
    offsets of hit passages in the original text) and contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    made = ("n_words", "n_hit", "item_ids", "word_ranges", "spans", "contaminated")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    # The text travels once, beside the other columns.
    others = [c for c in keep if c != text]
    struct = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    rows = docs.select(struct.alias("row"), F.col(text).alias("text"))
    owners = T.ArrayType(T.StructType([T.StructField("number", T.LongType()), T.StructField("name", T.StringType())]))
    empty = rows.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_RANGES).alias("ranges"), F.array().cast(owners).alias("items"), F.array().cast(_SPANS).alias("spans"))

    def scanned(before: DataFrame, sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = _windows_of(sent, window)
            kinds = None
            for batch in (part.slice(at, 1000) for part in batches for at in range(0, part.num_rows, 1000)):
                kinds = [f.type for f in batch.schema]
                n_words, ranges, items, spans = [], [], [], []
                for said, had, had_items in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    words = normal_words(said)
                    own, found = windows.scan(words)
                    own = _merged(had, own) if had else own
                    at = [m.span() for m in _WORD.finditer(said)] if own else []
                    n_words.append(len(words))
                    ranges.append([{"first": s, "past": e} for s, e in own])
                    items.append(sorted({(x["number"], x["name"]) for x in had_items} | {windows.names[k] for k in found}))
                    spans.append([{"start": at[s][0], "end": at[e - 1][1]} for s, e in own])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, kinds[2]), pa.array(ranges, kinds[3]), pa.array(items, kinds[4]), pa.array(spans, kinds[5])], schema=batch.schema)

        return before.mapInArrow(run, before.schema)

    out, done = empty, 0
    for block in blocks(benchmark, item, item_text, block_words, window):
        out = scanned(stage(out, "scanned") if done else out, _Sent(spark.sparkContext.broadcast(block), uuid.uuid4().hex))
        done += 1
    if not done:
        out = scanned(out, _Sent(spark.sparkContext.broadcast([]), uuid.uuid4().hex))
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, x: a + x["past"] - x["first"])
    return out.select(*[F.col("text" if c == text else f"row.{c}").alias(c) for c in keep], "n_words", hit.alias("n_hit"), F.transform("items", lambda x: x["name"]).alias("item_ids"), F.col("ranges").alias("word_ranges"), "spans", (hit > 0).alias("contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = find_contamination(docs, benchmark, keep=["doc_id"])
    ids = F.array_join(F.array_sort("item_ids"), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, row_number() OVER () AS k,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
v AS (SELECT item, k, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM v),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
l AS (SELECT DISTINCT n FROM win),
x AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l),
y AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM x),
z AS (SELECT doc_id, y.n, i, item, k FROM y JOIN win ON y.s = win.s AND y.n = win.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM z) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item, k FROM z) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": ORACLE}
