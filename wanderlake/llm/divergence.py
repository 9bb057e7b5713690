"""Operator 12, an audit of how far sources of a language differ in their words.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. One pass over the texts counts them by language
and source; a language keeps the terms of enough documents. Kept terms lie in ranges of their order: in a task, the range's
sorted terms are its dictionary, ``searchsorted`` gives terms integers in UTF-8 order, and ``bincount`` makes each source a dense
vector over them. Vectors are compared in 64-bit integers, source with source and source with language, and what ranges found is added up.

Shares are p = 1 + floor(10^9 (count + 2) / (N + 2 V)) of V kept terms with N occurrences, divergence is floor((p - q)^2 / (p + q)).

Defined results: a null text, language or source is the empty one; a group without terms has no occurrences of any term, so it
still diverges from others; a language without kept terms gives divergences of 0 and no terms; a source alone in its
language has no pairs; repeated rows count each; an empty table gives an empty result; other columns are ignored. A long text is
counted piece by piece, cut between terms. Counts of a group must stay below 2^53.

A task's memory: counters of ``HELD`` entries; then a range of about ``RANGE_TERMS`` terms, ``CELLS`` numbers of a matrix and the pairs of
``BLOCK`` sources. Ranges that many sources share are sent once for each block of these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import salted_lookup, small_batches, stage

#: Lower-cases A-Z and blanks every other ASCII byte that is no letter.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: Entries of a task's counters before they are sent on.
HELD = 300_000
#: Kept terms of a range, numbers of a dense matrix, and sources whose pairs a task makes.
RANGE_TERMS, CELLS, BLOCK = 20_000, 1 << 20, 256
#: Shares are multiples of one over this, which is STEP three times over.
SCALE, STEP = 10**9, 1000


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a whole text, some at a time."""
    plain, at = text.translate(_TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of terms by language and source; each group also has a row without a term."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        keys = [(*group, t) for group, (n, _) in held.items() for t in (None, *n)]
        counts = [(x, y) for n, docs in held.values() for x, y in ((0, 0), *zip(n.values(), map(docs.__getitem__, n), strict=True))]
        columns = [pa.array(c, pa.binary()).cast(pa.string()) for c in zip(*keys, strict=True)] + [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources, texts = (batch.column(i).cast(pa.binary()) for i in range(3))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts, strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            said: set[bytes] = set()
            for words in pieces(text.as_py()):
                n.update(words)
                said.update(words)
            docs.update(said)
            size += len(n)
            if size + len(held) > HELD:
                yield rows()
                held.clear()
                size = 0
    if held:
        yield rows()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10) -> DataFrame:
    """lang, source, term, n of the terms in ``least`` documents of their language; a row without a term and with n = 0 for each group.

    Rows are dealt by term, with one shuffle for counts by source and documents by language.
    """
    small_batches(docs.sparkSession)
    said = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    partial = said.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    spread = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return counts.withColumn("docs", spread).filter((F.col("docs") >= least) | F.col("term").isNull()).select("lang", "source", "term", "n")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total), by long division: a product with SCALE could pass 64 bits."""
    whole, rest = np.divmod(counts, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * STEP, total)
        whole = whole * STEP + digit
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)), at most 2 * SCALE + 2."""
    return (p - q) ** 2 // (p + q)


def _texts(column: pa.ChunkedArray) -> np.ndarray:
    """Strings as bytes, whose order is that of UTF-8."""
    out = np.empty(len(column), object)
    out[:] = column.cast(pa.binary()).to_pylist()
    return out


def compare(key: tuple, rows: pa.Table, groups: pa.Table, tops: int = 10) -> pa.Table:
    """Of a range of terms and a block of sources: the part of each pair's divergence, and the terms that may be among the first."""
    lang, block = key[0].as_py(), key[2].as_py()
    names = _texts(groups.column("source"))
    order = np.argsort(names)
    names, total, kept = names[order], groups.column("total").to_numpy()[order], int(groups.column("kept")[0].as_py()) if len(groups) else 0
    mine = range(block * BLOCK, min(block * BLOCK + BLOCK, len(names)))
    said = _texts(rows.column("term"))
    terms = np.array(sorted(set(said)), object)
    ids, of, n = np.searchsorted(terms, said), np.searchsorted(names, _texts(rows.column("source"))), rows.column("n").to_numpy()
    sums = np.zeros((len(mine), len(names)), np.int64)
    best: dict[int, list[tuple[int, int]]] = {i: [] for i in mine}
    width = max(1, CELLS // max(len(names), 1))
    for low in range(0, len(terms), width):
        w = min(width, len(terms) - low)
        here = (ids >= low) & (ids < low + w)
        counts = np.bincount(of[here] * w + ids[here] - low, weights=n[here], minlength=len(names) * w).astype(np.int64).reshape(len(names), w)
        p = shares(counts + 2, (total + 2 * kept)[:, None])
        q = shares(counts.sum(0) + 2, np.int64(total.sum() + 2 * kept))
        for row, i in enumerate(mine):
            sums[row, i + 1 :] += divergence(p[i], p[i + 1 :]).sum(1)
            own = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = divergence(p[i, own], q[own])
            first = np.lexsort((own, -value))[:tops]
            best[i] = sorted(best[i] + [(-v, t) for v, t in zip(value[first].tolist(), (own[first] + low).tolist(), strict=True)])[:tops]
    pairs = [(i, j) for i in mine for j in range(i + 1, len(names))]
    found = [(i, t, -v) for i in mine for v, t in best[i]]
    source = [names[i] for i, _ in pairs] + [names[i] for i, _, _ in found]
    item = [names[j] for _, j in pairs] + [terms[t] for _, t, _ in found]
    value = [int(sums[i - mine.start, j]) for i, j in pairs] + [v for _, _, v in found]
    return pa.table(
        {
            "lang": pa.array([lang] * len(value), pa.string()),
            "source": pa.array(source, pa.binary()).cast(pa.string()),
            "part": pa.array(["pair"] * len(pairs) + ["term"] * len(found), pa.string()),
            "item": pa.array(item, pa.binary()).cast(pa.string()),
            "value": pa.array(value, pa.int64()),
        }
    )


def _of_lang(rows: DataFrame, langs: DataFrame, spread: str, small: int) -> DataFrame:
    """Rows with what is known of their language: by broadcast for up to ``small`` languages, else by a salted join."""
    if langs.count() <= small:
        return rows.join(F.broadcast(langs), "lang", "left")
    return salted_lookup(rows, langs, "lang", F.col(spread))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, tops: int = 10, small: int = 50_000) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each source from each other of its language (``pair``), and the
    ``tops`` terms it has more of than its language (``term``)."""
    counts = stage(term_counts(docs, text, lang, source, least), "terms")
    named = counts.filter("term is not null")
    groups = stage(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), "groups")
    kept = named.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")).join(kept, "lang", "left")
    langs = stage(langs.select("lang", "blocks", F.coalesce("kept", F.lit(0)).alias("kept")), "langs")
    ranges = 1 + (langs.agg(F.sum("kept")).first()[0] or 0) // RANGE_TERMS
    ranged = stage(named.repartitionByRange(ranges, "lang", "term").withColumn("range", F.spark_partition_id()), "ranges")
    # A range of a language for each block of its sources; range -1 has no terms and makes all pairs known.
    places = ranged.select("lang", "range").distinct().unionByName(langs.select("lang", F.lit(-1).alias("range")))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = _of_lang(ranged, langs.select("lang", "blocks"), "term", small).select("lang", "range", each, "source", "term", "n")
    right = _of_lang(groups, langs, "source", small).join(places, "lang").select("lang", "range", each, "source", "total", "kept")
    right = right.select(F.col("lang").alias("lang_"), F.col("range").alias("range_"), F.col("block").alias("block_"), "source", "total", "kept")

    def run(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
        return compare(key, rows, groups, tops)

    found = left.groupBy("lang", "range", "block").cogroup(right.groupBy("lang_", "range_", "block_")).applyInArrow(run, "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    as_is, turned = F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    both = F.when(F.col("part") == "pair", F.array(as_is, turned)).otherwise(F.array(as_is))
    found = found.select("lang", "part", "value", F.explode(both).alias("x")).select("lang", "x.source", "part", "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= tops))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all sources of all languages of the documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, total, v,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (total + 2 * v) AS p
  FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 2)) // (sum(total) + 2 * any_value(v)) AS q FROM p GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM gn a JOIN gn b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
tops AS (
  SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value
  FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM tops),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLES = {"op12_source_divergence": ORACLE}
