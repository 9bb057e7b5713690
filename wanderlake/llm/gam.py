"""Operator 13, text quality by a generalised additive model with pairwise interactions.

A text is a row of dense features: lengths, rates of characters by kind, repetition of words, windows and lines. Each feature has
a lookup table over its bins, which cyclic boosting learns: round after round, feature after feature, a tree of a few leaves is
fitted to what is still unexplained and added to the table. Pairs of features that explain most of the rest get
tables over both, learned likewise by trees of two cuts. A score is the sum of looked-up numbers, as a probability; a
batch is scored by one ``searchsorted`` and one addition a table.

Tables are fitted on a bounded sample of labelled rows, about ``max_rows`` chosen by hash of their key, of which a quarter says
when to stop. Every whole text is scored. Defined results: a null or empty text has all features 0; rows without a label are scored,
not learned from; a key with several labels has their mean, from one half on as good; with labels of one kind only, every
score is that label's; with none, 0; repeated rows count and return each; an empty table gives an empty result; kept columns named
score or predicted are replaced, others may have any name. A very long text is counted in one task, with a few numbers a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_fold, small_batches

FEATURES = [
    "log_words",
    "word_length",
    "capitals",
    "digits",
    "symbols",
    "punctuation",
    "bangs",
    "beyond_ascii",
    "symbol_ends",
    "lone_symbols",
    "distinct_words",
    "top_word",
    "repeat_windows",
    "repeat_lines",
    "line_words",
    "line_ends",
    "evenness",
]
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>@^~=+_{}[]\\"))
_MARKS = np.isin(np.arange(256), list(b"!\"'(),-./:;?`")) | _SYMBOLS
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def text_features(text: bytes) -> list[float]:
    """The features of a whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text, np.uint8)
    kinds = np.bincount(data, minlength=256)
    chars = int(kinds[:128].sum() + kinds[192:].sum())
    seen = max(chars - int(kinds[_BLANK].sum()), 1)
    upper, lower = int(kinds[65:91].sum()), int(kinds[97:123].sum())
    marked, blank = _MARKS[data], np.concatenate([[True], _BLANK[data], [True]])
    ends = marked & blank[2:]
    said = Counter(words)
    number = dict(zip(said, range(len(said)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    again = 0.0
    if n > 2:
        # Exact: windows of three numbers, of which two make one.
        two = np.unique(ids[:-1] * len(said) + ids[1:], return_inverse=True)[1]
        _, times = np.unique(two[:-1] * len(said) + ids[2:], return_counts=True)
        again = 1 - len(times) / (n - 2)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    closed = sum(x.rstrip()[-1:] in b".!?:;" for x in lines)
    share = kinds[kinds > 0] / len(data)
    return [
        float(np.log1p(n)),
        seen / n,
        upper / max(upper + lower, 1),
        int(kinds[48:58].sum()) / seen,
        int(kinds[_SYMBOLS].sum()) / seen,
        int(kinds[_MARKS].sum()) / seen,
        int(kinds[33]) / n,
        int(kinds[192:].sum()) / seen,
        int((ends & _SYMBOLS[data]).sum()) / n,
        int((ends & blank[:-2]).sum()) / n,
        len(said) / n,
        max(said.values()) / n,
        again,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        closed / len(lines),
        float(-(share * np.log(share)).sum()),
    ]


def with_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and the features of each whole text."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("_features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([text_features(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=schema.names)

    return source.mapInArrow(run, schema)


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders of at most ``bins`` bins with about equally many values; equal values share a bin."""
    found = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)
    return found[found > values.min()] if len(found) else found


@dataclass
class Additive:
    """Lookup tables of features and of pairs; ``cuts`` are borders of bins."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def terms(self, x: np.ndarray) -> np.ndarray:
        """What each table adds to each row's margin: rows by features, then pairs."""
        single = [t[np.searchsorted(c, x[:, f], side="right")] for f, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True))]
        both = [t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")] for (i, j), t in zip(self.pairs, self.pair_tables, strict=True)]
        return np.stack(single + both, 1) if len(x) else np.zeros((0, len(single) + len(both)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The score of each row of features."""
        return sigmoid(self.intercept + self.terms(x).sum(1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _gain(g: np.ndarray, h: np.ndarray, calm: float) -> np.ndarray:
    return g * g / (h + calm)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, calm: float, least: float) -> np.ndarray:
    """The step of each bin: a tree of at most ``leaves`` ranges of bins, cut where most is gained; no leaf weighs less than ``least``."""
    sums_g, sums_h = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    edges = [0, len(g)]
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(edges, edges[1:], strict=False):
            mid = np.arange(a + 1, b)
            lg, lh = sums_g[mid] - sums_g[a], sums_h[mid] - sums_h[a]
            rg, rh = sums_g[b] - sums_g[mid], sums_h[b] - sums_h[mid]
            won = _gain(lg, lh, calm) + _gain(rg, rh, calm) - _gain(sums_g[b] - sums_g[a], sums_h[b] - sums_h[a], calm)
            won = np.where((lh >= least) & (rh >= least), won, 0)
            if len(won) and won.max() > best:
                best, at = won.max(), int(mid[won.argmax()])
        if at is None:
            break
        edges = sorted([*edges, at])
    step = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        step[a:b] = (sums_g[b] - sums_g[a]) / (sums_h[b] - sums_h[a] + calm)
    return step


def crossed_tree(g: np.ndarray, h: np.ndarray, calm: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree of one cut on each of two features; ``g`` and ``h`` are over both features' bins."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))

    def corners(c: np.ndarray) -> list[np.ndarray]:
        low, left, top, all_ = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [low, left - low, top - low, all_ - left - top + low]

    gs, hs = corners(cg), corners(ch)
    if not gs[0].size:
        return 0.0, np.zeros(g.shape)
    won = sum(_gain(a, b, calm) for a, b in zip(gs, hs, strict=True)) - _gain(cg[-1, -1], ch[-1, -1], calm)
    won = np.where(np.min(hs, axis=0) >= least, won, 0)
    i, j = np.unravel_index(won.argmax(), won.shape)
    if won[i, j] <= 0:
        return 0.0, np.zeros(g.shape)
    step = np.empty(g.shape)
    for (rows, cols), a, b in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), gs, hs, strict=True):
        step[rows, cols] = a[i, j] / (b[i, j] + calm)
    return float(won[i, j]), step


def _loss(y: np.ndarray, margin: np.ndarray) -> float:
    return float(np.logaddexp(0, margin).mean() - (y * margin).mean()) if len(y) else 0.0


def _boost(index: list[np.ndarray], tables: list[np.ndarray], grow: callable, y: np.ndarray, margin: np.ndarray, held: np.ndarray, rate: float, rounds: int, patience: int) -> list[np.ndarray]:
    """Cyclic boosting of ``tables``, whose cells ``index`` gives for each row; the tables of the round with the least loss on ``held`` rows.

    ``margin`` has the margin of those tables when it returns.
    """
    train, start = ~held, margin.copy()
    best, since, kept = _loss(y[held], margin[held]), 0, [t.copy() for t in tables]
    for _ in range(rounds):
        for k, (cells, table) in enumerate(zip(index, tables, strict=True)):
            p = sigmoid(margin[train])
            g = np.bincount(cells[train], weights=y[train] - p, minlength=table.size).reshape(table.shape)
            h = np.bincount(cells[train], weights=p * (1 - p), minlength=table.size).reshape(table.shape)
            step = rate * grow(g, h)
            tables[k] = table + step
            margin += step.ravel()[cells]
        loss = _loss(y[held], margin[held])
        if loss < best - 1e-6:
            best, since, kept = loss, 0, [t.copy() for t in tables]
        elif (since := since + 1) >= patience:
            break
    margin[:] = start + sum((t.ravel()[c] for t, c in zip(kept, index, strict=True)), np.zeros(len(y)))
    return kept


def fit_additive(x: np.ndarray, y: np.ndarray, held: np.ndarray, bins: int = 64, pair_bins: int = 16, pairs: int = 12, leaves: int = 3, rate: float = 0.1, rounds: int = 400, patience: int = 25, calm: float = 1.0, least: float = 1.0) -> Additive:
    """Learns tables of all features, then of the ``pairs`` of features that explain most of the rest; ``held`` rows decide when to stop."""
    count = x.shape[1]
    cuts = [cut_points(x[~held, f], bins) for f in range(count)]
    coarse = [cut_points(x[~held, f], pair_bins) for f in range(count)]
    mean = float(np.clip(y[~held].mean(), 1e-3, 1 - 1e-3))
    intercept = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), intercept)
    index = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    tables = _boost(index, [np.zeros(len(c) + 1) for c in cuts], lambda g, h: shallow_tree(g, h, leaves, calm, least), y, margin, held, rate, rounds, patience)
    # Pairs by the gain of one crossed tree on what the features leave.
    rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]
    p = sigmoid(margin[~held])
    found = []
    for i in range(count):
        for j in range(i + 1, count):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            cells = (rough[i] * shape[1] + rough[j])[~held]
            g, h = (np.bincount(cells, weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in (y[~held] - p, p * (1 - p)))
            found.append((-crossed_tree(g, h, calm, least)[0], i, j))
    chosen = [(i, j) for gain, i, j in sorted(found)[:pairs] if gain < 0]
    shapes = [(len(coarse[i]) + 1, len(coarse[j]) + 1) for i, j in chosen]
    both = [rough[i] * s[1] + rough[j] for (i, j), s in zip(chosen, shapes, strict=True)]
    pair_tables = _boost(both, [np.zeros(s) for s in shapes], lambda g, h: crossed_tree(g, h, calm, least)[1], y, margin, held, rate, rounds, patience)
    # Tables get a mean of 0 over what was learned from, so that each says how far a feature moves a text from the average.
    for k, cells in enumerate([*index, *both]):
        table = tables[k] if k < count else pair_tables[k - count]
        shift = float(table.ravel()[cells[~held]].mean())
        table -= shift
        intercept += shift
    return Additive(intercept, cuts, tables, chosen, coarse, pair_tables)


@dataclass
class QualityModel:
    """Fitted tables, or the one score there is reason for."""

    additive: Additive | None
    constant: float = 0.0

    def score(self, docs: DataFrame, keep: list[str], text: str = "text", good: float = 0.7) -> DataFrame:
        """The ``keep`` columns with score and predicted (whether the score reaches ``good``)."""
        keep = [c for c in keep if c not in ("score", "predicted")]
        rest = F.struct(*[F.col(c) for c in keep], F.lit(None).cast("int").alias("_none")).alias("_rest")
        if self.additive is None:
            out = docs.select(rest, F.lit(self.constant).alias("score"))
        else:
            small_batches(docs.sparkSession)
            model = docs.sparkSession.sparkContext.broadcast(self.additive)  # some thousand numbers
            source = docs.select(rest, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
            schema = T.StructType([source.schema["_rest"], T.StructField("score", T.DoubleType())])

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    x = np.array([text_features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.probability(x))], names=schema.names)

            out = source.mapInArrow(run, schema)
        return out.select(*[F.col("_rest")[c].alias(c) for c in keep], "score", (F.col("score") >= good).cast("int").alias("predicted"))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> QualityModel:
    """Fits on the rows of ``labels`` (which the caller has restricted), at most about ``max_rows`` of them; their features, no texts, reach the driver."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_k"), (F.col(label) > 0).cast("double").alias("_y"))
    share = min(1.0, max_rows / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("_k"), F.lit(1_000_000)) < F.lit(int(1e6 * share)))
    known = known.groupBy("_k").agg((F.avg("_y") >= 0.5).cast("double").alias("_y"))
    # Bounded by max_rows, whatever the size of the table.
    sample = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(known), "_k")
    rows = with_features(sample.select("_y", (F.pmod(F.xxhash64("_k", F.lit(7)), F.lit(4)) == 0).alias("_held"), "_t"), ["_y", "_held"], "_t").toArrow()
    y, held = rows.column("_y").to_numpy(), rows.column("_held").to_numpy(zero_copy_only=False).astype(bool)
    if len(np.unique(y)) < 2:
        return QualityModel(None, float(y[0]) if len(y) else 0.0)
    x = np.array(rows.column("_features").to_pylist())
    order = np.lexsort((*x.T, y, held))  # the rows' order is Spark's, the model's is not
    x, y, held = x[order], y[order], held[order]
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        x, y, held = np.concatenate([x, x]), np.concatenate([y, y]), np.arange(2 * len(y)) < len(y)
    return QualityModel(fit_additive(x, y, held))


def op13_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from three folds of four."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.filter(~in_fold(F.col("doc_id"), 4, 2)))
    out = model.score(docs, ["doc_id"])
    return out.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


QUERIES = {"op13_quality_gam": op13_quality_gam}
ORACLES: dict[str, str] = {}
