"""Operator 4, toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon, of both in obfuscated spelling
(look-alike characters, letters set apart by punctuation), nearness of lexicon words to words in the
second person, and rates of capitals, punctuation, exclamation marks and obfuscated words. Spark's
gradient-boosted trees give a margin; isotonic regression on a part of the labelled rows that the
trees have not seen turns it into a probability.

The learned lexicon, trees and calibration are fitted on a bounded sample of labelled rows: about
``max_rows``, chosen by hash of their key; the learned lexicon has at most ``max_words`` words and the calibration at most
``POINTS`` steps. Every whole text is scored. Defined results: a null or empty
text has all features 0; rows without a label are scored, not learned from; a key with several labels has
their mean, from one half on as toxic; with labels of one kind
only, every score is that label's; with none, 0; repeated rows count and return each; kept columns named score or predicted are
replaced, others may have any name. A very long text is counted word by word in one task, with a row of numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_fold, small_batches
from .tokens import TokenTable

# Insults.
INSULTS = """airhead bastard bigot brainless bum clown coward creep cretin crook degenerate dimwit dirtbag disgusting
dumb dumbass dunce failure fool fraud freak garbage gross hate hideous idiot idiotic imbecile jerk kill lame liar loser
lowlife lunatic maggot miserable moron moronic nasty nitwit pathetic pig rat repulsive rotten scum scumbag shameful
shameless sick sicko sleazy slimy slob stupid subhuman sucks trash twit ugly useless vermin vile weirdo worthless
wretch""".split()

# Second person in English, French, German and Spanish.
SECOND_PERSON = "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes tus su vosotros ti contigo".split()

# Characters written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

FEATURES = ["fixed_density", "fixed_any", "learned_density", "learned_weight", "obfuscated_density", "nearness", "second_person", "capitals", "shouted", "punctuation", "exclaims", "odd_words", "log_words", "word_length"]
_LOOK = str.maketrans(LOOKALIKES)
#: Steps of the calibration that are kept.
POINTS = 200
#: Columns of the word table.
_FIXED, _LEARNED, _WEIGHT, _HIDDEN, _SECOND, _UPPER, _LETTERS, _PUNCT, _BANG, _ODD, _SHOUT, _CHARS = range(12)


def plain_word(word: str) -> str:
    """Lower case, without punctuation at the ends."""
    return word.lower().strip(".,;:!?\"'()[]{}<>|*#%&$-_~…«»“”‘’")


def unmasked(word: str) -> str:
    """A word with look-alikes turned into letters and marks between letters taken out; repeated letters shortened."""
    letters = [c for c in word.lower().rstrip(".,;:!?").translate(_LOOK) if c.isalpha()]
    return "".join(c for i, c in enumerate(letters) if i < 2 or not c == letters[i - 1] == letters[i - 2])


def word_features(lexicon: dict[str, float]) -> callable:
    """What is counted of a word, as rows for a table of words."""
    fixed, second = set(INSULTS), set(SECOND_PERSON)

    def learn(words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), 12))
        for i, raw in enumerate(words):
            word = raw.decode("utf-8", "replace")
            bare = plain_word(word)
            row = out[i]
            row[_CHARS] = len(word)
            row[_FIXED] = bare in fixed
            if bare in lexicon:
                row[_LEARNED], row[_WEIGHT] = 1, lexicon[bare]
            row[_SECOND] = bare in second
            upper = sum(map(str.isupper, word))
            letters = sum(map(str.isalpha, word))
            row[_UPPER], row[_LETTERS] = upper, letters
            row[_PUNCT], row[_BANG] = sum(not c.isalnum() for c in word), word.count("!")
            row[_SHOUT] = letters > 2 and upper == letters
            if letters and not bare.isalpha() and bare:
                inner = any(not c.isalpha() for c in bare[1:-1]) or bare[0] in LOOKALIKES or bare[-1] in LOOKALIKES
                if inner and "-" not in bare and "'" not in bare or sum(c in LOOKALIKES for c in bare):
                    row[_ODD] = 1
                    clear = unmasked(bare)
                    row[_HIDDEN] = clear in fixed or clear in lexicon
        return out

    return learn


def text_features(values: np.ndarray) -> list[float]:
    """The features of a text from the rows of its words, in order."""
    n = len(values)
    if not n:
        return [0.0] * len(FEATURES)
    s = values.sum(0)
    hits = np.flatnonzero((values[:, _FIXED] + values[:, _LEARNED] + values[:, _HIDDEN]) > 0)
    near = 0.0
    if len(hits):
        said = np.flatnonzero(values[:, _SECOND])
        if len(said):
            at = np.searchsorted(said, hits)
            gap = np.minimum(np.abs(said[np.minimum(at, len(said) - 1)] - hits), np.abs(said[np.maximum(at - 1, 0)] - hits))
            near = 1.0 / (1.0 + gap.min())
    return [
        100 * s[_FIXED] / n,
        float(s[_FIXED] > 0),
        100 * s[_LEARNED] / n,
        s[_WEIGHT],
        100 * s[_HIDDEN] / n,
        near,
        100 * s[_SECOND] / n,
        s[_UPPER] / max(s[_LETTERS], 1),
        s[_SHOUT] / n,
        s[_PUNCT] / max(s[_CHARS], 1),
        100 * s[_BANG] / n,
        s[_ODD] / n,
        float(np.log1p(n)),
        s[_CHARS] / n,
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and the features of each whole text."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(f, T.DoubleType()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenTable(12, word_features(lexicon), np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = table.rows(part.column(part.num_columns - 1).to_pylist())
                found = np.array([text_features(table.matrix[r]) for r in rows], np.float64)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns - 1)], *[pa.array(c) for c in np.ascontiguousarray(found.T)]], names=schema.names)

    return source.mapInArrow(run, schema)


def learn_lexicon(sample: DataFrame, text: str = "text", label: str = "label", least: int = 5, most: int = 5000) -> dict[str, float]:
    """Words far commoner in positive texts: word -> log odds ratio, the ``most`` strongest.

    Equal whole texts of one label (but for case and white space) count once, so that copies of one
    text don't make its words insults; every other text counts with its own label and all its words.
    """
    said = F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+")
    bare = F.transform(said, lambda w: F.btrim(w, F.lit(".,;:!?\"'()[]{}<>|*#%&$-_~")))
    whole = F.sha2(F.array_join(F.filter(said, lambda w: w != ""), " "), 256)
    words = sample.groupBy(whole.alias("whole"), F.col(label).alias("label")).agg(F.max(text).alias("t"))
    total = words.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).first()
    n, k = total["n"], total["k"] or 0
    if not n or not k or k == n:
        return {}
    counts = words.withColumnRenamed("t", text).select("label", F.explode(F.array_distinct(bare)).alias("w")).filter("w != ''")
    counts = counts.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).filter(F.col("k") >= least)
    odds = F.log((F.col("k") + 0.5) / (F.col("n") - F.col("k") + 0.5)) - F.lit(float(np.log(k / (n - k))))
    top = counts.withColumn("odds", odds).filter("odds > 2.3").orderBy(F.desc("odds"), "w").limit(most)
    return {r["w"]: r["odds"] for r in top.collect()}


class ToxicityModel:
    """Fitted lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], trees, points: list[tuple[float, float]], constant: float | None):
        self.lexicon, self.trees, self.points, self.constant = lexicon, trees, points, constant

    def score(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """The ``keep`` columns with score and predicted."""
        keep = [c for c in keep if c not in ("score", "predicted")]
        rest = F.struct(*[F.col(c) for c in keep], F.lit(None).cast("int").alias("_none"))
        if self.constant is not None:
            out = docs.select(rest.alias("_rest"), F.lit(self.constant).alias("score"))
        else:
            found = with_features(docs.select(rest.alias("_rest"), F.col(text).alias("_said")), self.lexicon, ["_rest"], "_said")
            out = _margins(found, self.trees).select("_rest", self._calibrated(F.col("margin")).alias("score"))
        return out.select(*[F.col("_rest")[c].alias(c) for c in keep], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

    def _calibrated(self, x: Column) -> Column:
        """Straight lines between the points of the isotonic fit, of which at most ``POINTS`` count."""
        every = np.unique(np.linspace(0, len(self.points) - 1, POINTS).round().astype(int))
        xs, ys = (F.array(*[F.lit(float(self.points[i][k])) for i in every]) for k in (0, 1))
        at = F.size(F.filter(xs, lambda v: v <= x))
        low, high = F.greatest(at - 1, F.lit(0)), F.least(at, F.lit(len(every) - 1))
        x0, x1, y0, y1 = F.get(xs, low), F.get(xs, high), F.get(ys, low), F.get(ys, high)
        return F.when((at == 0) | (x1 <= x0), y0).otherwise(y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))


def _margins(rows: DataFrame, trees) -> DataFrame:
    """The rows with the trees' margin."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows))
    return out.withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000, max_words: int = 5000, rounds: int = 12, depth: int = 3) -> ToxicityModel:
    """Fits on the rows of ``labels`` (which the caller has restricted), at most about ``max_rows`` of them."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_k"), (F.col(label) > 0).cast("double").alias("label"))
    count = known.count()
    spot = F.pmod(F.xxhash64("_k"), F.lit(1_000_000))
    chosen = known.filter(spot < F.lit(int(1e6 * min(1.0, max_rows / max(count, 1)))))
    chosen = chosen.groupBy("_k").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    # Bounded by max_rows, whatever the size of the table.
    sample = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(chosen), "_k").withColumn("held", F.pmod(F.xxhash64("_k", F.lit(7)), F.lit(4)) == 0).persist()
    kinds = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(kinds) < 2:
        sample.unpersist()
        return ToxicityModel({}, None, [], kinds.pop() if kinds else 0.0)
    lexicon = learn_lexicon(sample.filter("not held"), most=max_words)
    rows = with_features(sample, lexicon, ["label", "held"]).coalesce(8).persist()
    train = rows.filter("not held")
    if train.select("label").distinct().count() < 2 or rows.filter("held").select("label").distinct().count() < 2:
        train = held = rows
    else:
        held = rows.filter("held")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(train).select("label", "_features").persist()
    trees = GBTClassifier(labelCol="label", featuresCol="_features", maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, maxBins=32, seed=7).fit(vectors)
    fit = IsotonicRegression(labelCol="label", featuresCol="margin").fit(_margins(held, trees).select("label", "margin"))
    points = list(zip(fit.boundaries.toArray().tolist(), fit.predictions.toArray().tolist(), strict=True))
    for df in (sample, rows, vectors):
        df.unpersist()
    return ToxicityModel(lexicon, trees, points, None)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from four folds of five."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.filter(~in_fold(F.col("doc_id"), 5, 0)))
    out = model.score(docs, ["doc_id"])
    return out.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
