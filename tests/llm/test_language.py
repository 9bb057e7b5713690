import math
import random

import numpy as np
import pytest
from helpers import ODD_TEXTS, documents, nothing
from pyspark.sql import functions as F

from wanderlake.llm import language as lg

SF = "/root/testdata/sf0.001"


def grams_of(words, order):
    out = {}
    for w in words:
        p = f" {w} "
        for i in range(1, len(p)):
            g = p[max(0, i - order + 1) : i + 1]
            out[g] = out.get(g, 0) + 1
    return out


def brute(counts, order, word):
    """Interpolated Kneser-Ney by the formula, for one language alone."""
    level = [{} for _ in range(order + 1)]
    for g, c in counts.items():
        level[len(g)][g] = c
    for k in range(order, 1, -1):
        for g in level[k]:
            level[k - 1][g[1:]] = level[k - 1].get(g[1:], 0) + 1
    size = len(level[1]) + 1
    ds = []
    for k in range(order + 1):
        n1, n2 = (sum(c == n for c in level[k].values()) for n in (1, 2))
        ds.append(min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5)

    def prob(g):
        if not g:
            return 1 / size
        own = {h: c for h, c in level[len(g)].items() if h[:-1] == g[:-1]}
        if not own:
            return prob(g[1:])
        total, d = sum(own.values()), ds[len(g)]
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * prob(g[1:])

    p = f" {word} "
    return sum(math.log(prob(p[max(0, i - order + 1) : i + 1])) for i in range(1, len(p)))


def test_model_equals_the_formula():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    counts = grams_of(words, 4)
    models = lg.kneser_ney({"x": counts}, 4)
    for w in [*words[:20], "a", "zz", "abcabcabc", "aéz"]:
        assert models.word_scores([w.encode()])[0, 0] == pytest.approx(brute(counts, 4, w))
    # Probabilities of what may follow a context sum to at most one, the rest being unknown letters.
    head = models.word_scores([b"ab"])[0, 0] - 0
    assert head < 0


def test_two_languages_side_by_side():
    a, b = grams_of(["aba", "abab", "bab"], 3), grams_of(["cdc", "dcd", "cab"], 3)
    models = lg.kneser_ney({"a": a, "b": b}, 3)
    got = models.word_scores([b"abab", "cd,ab!".encode(), b"123"])
    assert got[:, 2].tolist() == [5, 6, 0] and got[0, 0] > got[0, 1]
    # A word of two runs scores as both.
    two = models.word_scores([b"cd", b"ab"])[:, :2].sum(0)
    assert np.allclose(got[1, :2], two)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = lg.fit_languages(lg.training_rows(docs, F.col("doc_id")))
    held = lg.identify(docs.join(lg.training_rows(docs, F.col("doc_id")).select("doc_id"), "doc_id", "left_anti"), models).toPandas()
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98
    assert held.rejected.mean() < 0.01 and held.score.between(0, 1).all()
    odd = {r.doc_id: r for r in lg.identify(documents(spark), models, keep=["doc_id"]).collect()}
    for i, t in enumerate(ODD_TEXTS):
        if not t or not any(map(str.isalpha, t)):
            assert (odd[i].lang_pred, odd[i].score, odd[i].rejected) == ("und", 0.0, True)
    for lang in held.lang.unique():
        own = held[held.lang == lang]
        assert (own.lang_pred == lang).mean() > 0.95 and own.rejected.sum() <= 1, lang
    rng = random.Random(4)
    noise = [
        "zqxj wvkqz xxqj zzkw qjxv " * 40,
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600)),
        "съешь же ещё этих мягких французских булок да выпей чаю " * 10,
        "Onko sinulla koskaan ollut sellainen tunne että kaikki menee pieleen mutta silti hymyilet " * 5,
        *["".join(rng.sample(t, len(t))) for t in held.text[held.text.str.len().between(500, 5000)].tolist()[:5]],
    ]
    assert lg.identify(spark.createDataFrame([(t,) for t in noise], "text string"), models).filter("rejected").count() == len(noise)


def test_reach_is_a_quantile_of_calibration_texts():
    """With many calibration texts one in a thousand is beyond; with few, what is far out still is."""
    rng = np.random.default_rng(2)

    def calibrated(rows):
        models = lg.LanguageModels(["x"], 1, np.zeros(1), [], [])
        n = rng.integers(20, 3000, rows).astype(float)
        entropy = 2 + 0.05 * rng.standard_normal(rows) + 2 / np.sqrt(n) * rng.standard_normal(rows)
        totals = np.column_stack([-entropy * n, n])
        lg._calibrate(models, [(0, t) for t in totals])
        return models, models.judge(totals)[3].mean()

    models, share = calibrated(20_000)
    assert 0.0005 <= share <= 0.0011 and models.reach < 5
    for rows in (1, 5, 200):
        models, share = calibrated(rows)
        assert share == 0 and models.reach <= lg.FAR_TEXT
        assert models.judge(np.array([[-5 * 500.0, 500.0], [-2 * 500.0, 500.0]]))[3].tolist()[0]


def test_ties_between_languages(spark):
    """Languages with the same texts: the first by name."""
    text = "aba cada bra abra cadabra " * 5
    docs = spark.createDataFrame([(i, f"{text} {'abc'[i % 3]}", lang) for i in range(60) for lang in ("b", "a")], "doc_id long, text string, lang string")
    models = lg.fit_languages(docs)
    assert models.languages == ["a", "b"]
    assert {r.lang_pred for r in lg.identify(docs, models, keep=["doc_id"]).collect()} == {"a"}


def test_a_group_of_copies_is_one_text_of_the_sample(spark):
    """Copies of one text, however many, neither fill the sample nor stay out of it as a whole."""
    rows = [(i, "same words here again and again", "x") for i in range(500)] + [(1000 + i, f"text {chr(97 + i % 26)}{chr(97 + i // 26)} of its own", "x") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = lg.fit_languages(docs, max_docs=600)
    plain = lg.fit_languages(docs.filter("doc_id = 0 or doc_id >= 1000"), max_docs=600)
    assert np.allclose(models.word_scores([b"same", b"own"]), plain.word_scores([b"same", b"own"]))


def test_nothing_to_learn_from(spark):
    models = lg.fit_languages(nothing(spark))
    out = lg.identify(documents(spark), models).collect()
    assert len(out) == documents(spark).count() and {r.lang_pred for r in out} == {"und"}
    assert lg.identify(nothing(spark), models).count() == 0
