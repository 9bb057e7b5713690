"""Operator 5, language identification with interpolated Kneser-Ney character models.

One model per language over the letters of a word and its two ends, orders 1 to ``order``. The models
of all languages lie side by side in sorted arrays of n-gram hashes: one search gives every language's
log probability. A text's cross-entropy is the sum over its words' letters divided by their number;
the language with the lowest is chosen, and a text is rejected whose cross-entropy lies further above
that language's own level, in units of the spread at its length, than all but ``REJECTED`` of calibration texts'.

Models are fitted on a bounded sample: at most about ``max_docs`` documents a language, chosen by hash of their key,
equal texts once; a third of it calibrates.
Prediction reads every whole text. Defined results: a null text, or one without a letter, is ``und``,
score 0, rejected; ties go to the first language by name; languages without letters in the sample
are not learned; with nothing to learn from, everything is ``und``; repeated rows return as often.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_fold, small_batches, stage
from .tokens import TokenTable

_LETTERS = re.compile(r"[^\W\d_]+")
_EDGE = " "
#: The share of calibration texts beyond the reach of their language.
REJECTED = 0.001
#: A text so far out counts beside the calibration texts, and as ``USUAL`` texts the usual spread of a letter (nats) and of a text's level do.
FAR_TEXT, USUAL, USUAL_NOISE, USUAL_SPREAD = 15.0, 10, 1.0, 0.03


def _letters(text: str) -> list[str]:
    """Runs of letters; the pattern also lets other numerals pass, which are taken out here."""
    found = _LETTERS.findall(text)
    return found if all(map(str.isalpha, found)) else [x for p in found if (x := "".join(filter(str.isalpha, p)))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k codes that end at each place (garbage before place k - 1)."""
    out, seen = [], np.zeros(len(codes), np.uint64)
    for k in range(order):
        back = np.zeros(len(codes), np.uint64)
        back[k:] = codes[: len(codes) - k]
        seen = _mix(seen + (back + np.uint64(k + 1)) * np.uint64(0xD6E8FEB86659FD93 + 2 * k))
        out.append(seen)
    return out


@dataclass
class LanguageModels:
    """Sorted hash arrays per order: ``grams`` with log probabilities, ``contexts`` with log back-off weights."""

    languages: list[str]
    order: int
    unknown: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray | None = None
    spread: float = 0.0
    noise: float = 0.0
    reach: float = 1.0
    temperature: float = 1.0

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Per word: log probability in each language, then the number of letters and ends scored."""
        parts = [_letters(w.decode("utf-8", "replace").lower()) for w in words]
        flat = [p for ps in parts for p in ps]
        out = np.zeros((len(words), len(self.languages) + 1))
        if not flat:
            return out
        joined = _EDGE + _EDGE.join(flat) + _EDGE
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        edge = codes == ord(_EDGE)
        depth = np.arange(len(codes)) - np.maximum.accumulate(np.where(np.concatenate([[True], edge[:-1]]), np.arange(len(codes)) - 1, 0)) + 1
        hashes = _gram_hashes(codes, self.order)
        score = np.zeros((len(codes), len(self.languages)))
        open_ = np.ones(len(codes), bool)
        open_[0] = False
        for k in range(self.order, 0, -1):
            places = np.flatnonzero(open_ & (depth >= k))
            keys, values = self.grams[k - 1]
            hit, at = _find(keys, hashes[k - 1][places])
            score[places[hit]] += values[at[hit]]
            open_[places[hit]] = False
            rest = places[~hit]
            if k > 1 and len(rest):
                keys, values = self.contexts[k - 2]
                hit, at = _find(keys, hashes[k - 2][rest - 1])
                score[rest[hit]] += values[at[hit]]
            elif k == 1:
                score[rest] += self.unknown
        ends = np.flatnonzero(edge)
        sums = np.add.reduceat(score, ends[:-1] + 1, axis=0)
        n = np.diff(ends)
        owner = np.repeat(np.arange(len(words)), [len(ps) for ps in parts])
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(owner, sums[:, j], len(words))
        out[:, -1] = np.bincount(owner, n, len(words))
        return out

    def judge(self, totals: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """From summed word scores: language, confidence, cross-entropy and rejection of each text."""
        n = totals[:, -1]
        if not self.languages:
            return ["und"] * len(n), np.zeros(len(n)), np.full(len(n), np.nan), np.ones(len(n), bool)
        best = totals[:, :-1].argmax(1)
        top = totals[np.arange(len(n)), best]
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = np.where(n > 0, -top / n, np.nan)
        share = 1 / np.exp((totals[:, :-1] - top[:, None]) / self.temperature).sum(1)
        bad = n == 0
        if self.mean is not None:
            far = (entropy - self.mean[best]) / (self.spread + self.noise / np.sqrt(np.maximum(n, 1)))
            bad = bad | (far > self.reach)
        names = ["und" if x == 0 else self.languages[b] for x, b in zip(n, best, strict=True)]
        return names, np.where(n > 0, share, 0.0), entropy, bad


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _sorted(grams: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams' hashes (all of one length) in order, and their rows."""
    if not grams:
        return np.zeros(0, np.uint64), values
    k = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes = _gram_hashes(codes, k)[-1][k - 1 :: k]
    by = np.argsort(hashes)
    return hashes[by], values[by]


def kneser_ney(counts: dict[str, dict[str, int]], order: int) -> LanguageModels:
    """Models from the counts of the grams that end at each letter: language -> gram -> count.

    A gram is the last ``order`` symbols up to a letter or word end, or all from the word's start.
    Lower orders count the distinct symbols seen in front, except for grams from the word's start.
    """
    languages = sorted(counts)
    levels, totals, backs, discounts = [], [], [], []
    for lang in languages:
        level: list[dict[str, int]] = [{} for _ in range(order + 1)]
        for gram, c in counts[lang].items():
            level[len(gram)][gram] = level[len(gram)].get(gram, 0) + c
        for k in range(order, 1, -1):
            for gram in level[k]:
                level[k - 1][gram[1:]] = level[k - 1].get(gram[1:], 0) + 1
        total: dict[str, int] = {}
        kinds: dict[str, int] = {}
        discount = [0.0] * (order + 1)
        for k in range(1, order + 1):
            ones, twos = sum(c == 1 for c in level[k].values()), sum(c == 2 for c in level[k].values())
            discount[k] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            for g, c in level[k].items():
                total[g[:-1]] = total.get(g[:-1], 0) + c
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        levels.append(level)
        totals.append(total)
        discounts.append(discount)
        backs.append({h: discount[len(h) + 1] * n / total[h] for h, n in kinds.items()})
    alphabet = len({g for level in levels for g in level[1]}) + 1
    memo: list[dict[str, float]] = [{"": 1 / alphabet} for _ in languages]

    def prob(j: int, gram: str) -> float:
        if gram not in memo[j]:
            rest, head = prob(j, gram[1:]), gram[:-1]
            if head in totals[j]:
                c = levels[j][len(gram)].get(gram, 0)
                rest = max(c - discounts[j][len(gram)], 0) / totals[j][head] + backs[j][head] * rest
            memo[j][gram] = rest
        return memo[j][gram]

    grams, contexts = [], []
    for k in range(1, order + 1):
        keys = sorted(set().union(*[level[k] for level in levels]))
        grams.append(_sorted(keys, np.log([[prob(j, g) for j in range(len(languages))] for g in keys]).reshape(len(keys), len(languages))))
        if k > 1:
            heads = sorted({g[:-1] for g in keys})
            contexts.append(_sorted(heads, np.log([[backs[j].get(h, 1.0) for j in range(len(languages))] for h in heads]).reshape(len(heads), len(languages))))
    unknown = np.log([backs[j].get("", 1.0) / alphabet for j in range(len(languages))])
    return LanguageModels(languages, order, unknown, grams, contexts)


def letter_grams(docs: DataFrame, lang: str, text: str, order: int) -> DataFrame:
    """lang, gram, n over the words of the texts."""
    words = docs.select(F.col(lang).alias("lang"), F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).filter("word != ''")
    words = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    padded = words.select("lang", F.concat(F.lit(_EDGE), "word", F.lit(_EDGE)).alias("p"), "n")
    cut = f"transform(sequence(2, length(p)), i -> substring(p, greatest(1, i - {order - 1}), least(i, {order})))"
    return padded.select("lang", F.explode(F.expr(cut)).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _totals(docs: DataFrame, sent, keep: list[str], text: str, judge: bool) -> DataFrame:
    """The kept columns and either the summed scores or the judgement of each text; the text travels once."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep) if text in keep else docs.select(*keep, text)
    place = source.columns.index(text)
    schema = T.StructType([source.schema[c] for c in keep])
    for name, kind in [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType())] if judge else [("totals", T.ArrayType(T.DoubleType()))]:
        schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = LanguageModels(**sent.value)
        table = TokenTable(len(models.languages) + 1, models.word_scores)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sums = np.stack([table.matrix[r].sum(0) for r in table.rows(part.column(place).to_pylist())])
                kept = [part.column(i) for i in range(len(keep))]
                if judge:
                    names, share, entropy, bad = models.judge(sums)
                    found = [pa.array(names), pa.array(share), pa.array(entropy, mask=np.isnan(entropy)), pa.array(bad)]
                else:
                    found = [pa.array(sums.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=schema.names)

    return source.mapInArrow(run, schema)


def fit_languages(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", order: int = 5, max_docs: int = 1800) -> LanguageModels:
    """Models of the languages named in ``lang``, with calibrated temperature and rejection, which a third of the sample sets.

    Rows without a key, or tables without that column, are chosen by hash of the text.
    """
    spark = docs.sparkSession
    spot = F.xxhash64(text)
    if key in docs.columns:
        spot = F.when(F.col(key).isNull(), spot).otherwise(F.xxhash64(key))
    known = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), spot.alias("spot"))
    parts = known.groupBy("lang").agg((F.lit(1e6) * F.least(F.lit(1.0), F.lit(max_docs) / F.count(F.lit(1)))).alias("part"))
    # One row per language, so few; beyond a count that holds for languages, Spark picks the join.
    parts = stage(parts, "languages")
    parts = F.broadcast(parts) if parts.count() <= 10_000 else parts
    sample = known.join(parts, "lang").filter(F.col("text").isNotNull() & (F.pmod("spot", F.lit(1_000_000)) < F.col("part"))).select("lang", "text", F.xxhash64("text").alias("mark"))
    sample = sample.dropDuplicates(["lang", "mark"]).select("lang", "text", (F.pmod(F.xxhash64("mark"), F.lit(3)) == 0).alias("held")).persist()
    counts: dict[str, dict[str, int]] = {}
    for row in letter_grams(sample.filter("not held"), "lang", "text", order).collect():
        counts.setdefault(row["lang"], {})[row["gram"]] = row["n"]
    models = kneser_ney(counts, order)
    if models.languages:
        # A third of a sample bounded by max_docs a language.
        held = _totals(sample.filter("held"), spark.sparkContext.broadcast(vars(models)), ["lang"], "text", False).collect()
        held = [(models.languages.index(r["lang"]), np.array(r["totals"])) for r in held if r["lang"] in counts and r["totals"][-1] > 0]
        if held:
            _calibrate(models, held)
    sample.unpersist()
    return models


def _calibrate(models: LanguageModels, held: list[tuple[int, np.ndarray]]) -> None:
    """Level of each language, spread of long and of short texts about it, reach and temperature.

    Texts count with the language chosen for them, as when they are judged. Spreads are median deviations, so odd texts don't widen them; ``reach`` is the place
    that all but ``REJECTED`` of the calibration texts and one at ``FAR_TEXT`` lie within, so few calibration texts reject only what is far out.
    """
    true, totals = np.array([j for j, _ in held]), np.stack([t for _, t in held])
    n, chosen = totals[:, -1], totals[:, :-1].argmax(1)
    entropy = -totals[np.arange(len(n)), chosen] / n
    models.mean = mean = np.array([np.median(entropy[chosen == j]) if (chosen == j).any() else np.median(entropy) for j in range(len(models.languages))])
    off = entropy - mean[chosen]
    models.spread = _deviation(off[n >= np.median(n)], USUAL_SPREAD)
    models.noise = _deviation((off * np.sqrt(n))[n <= np.median(n)], USUAL_NOISE)
    far = np.sort(np.append(off / (models.spread + models.noise / np.sqrt(n)), FAR_TEXT))
    models.reach = float(far[int(np.ceil(len(far) * (1 - REJECTED))) - 1])
    best = None
    for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0):
        x = totals[:, :-1] / t
        x = x - x.max(1, keepdims=True)
        # Less the worst hundredth: texts that are labelled wrongly or mix languages say nothing of confidence.
        each = np.sort(np.log(np.exp(x).sum(1)) - x[np.arange(len(n)), true])
        loss = each[: -(-99 * len(each) // 100)].mean()
        if best is None or loss < best[0]:
            best = (loss, t)
    models.temperature = best[1]


def _deviation(values: np.ndarray, usual: float) -> float:
    """The median deviation as that of a normal law, with the usual one as ``USUAL`` further values."""
    return float(1.4826 * np.median(np.append(np.abs(values), np.full(USUAL, usual / 1.4826))))


def identify(docs: DataFrame, models: LanguageModels, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The ``keep`` columns (default: all) with lang_pred, score, cross_entropy and rejected, which replace columns so named."""
    made = ("lang_pred", "score", "cross_entropy", "rejected")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    return _totals(docs, docs.sparkSession.sparkContext.broadcast(vars(models)), keep, text, True)


def training_rows(docs: DataFrame, key: Column) -> DataFrame:
    """The rows that may be learned from: all but one fold of four."""
    return docs.filter(~in_fold(key, 4, 2))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    models = fit_languages(training_rows(docs, F.col("doc_id")))
    out = identify(docs, models, keep=["doc_id"])
    return out.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op5_language": op5_language}
ORACLES: dict[str, str] = {}
