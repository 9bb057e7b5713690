import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import documents, nothing
from pyspark.sql import functions as F

from wanderlake.llm import gam
from wanderlake.llm.common import in_fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return gam.fit_quality(docs, labels.filter(~in_fold(F.col("doc_id"), 4, 2)))


def test_held_out(spark, fitted):
    """Every language with held-out bad texts: all but one in twenty bad ones found, no good one lost."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = fitted.score(docs, ["doc_id", "lang"]).join(labels.filter(in_fold(F.col("doc_id"), 4, 2)), "doc_id").toPandas()
    assert len(got) > 80 and got.score.between(0, 1).all()
    assert (got[got.quality == 1].predicted == 1).mean() >= 0.98
    for lang, part in got[got.quality == 0].groupby("lang"):
        assert (part.predicted == 0).mean() >= 0.95, lang
    assert (got[got.quality == 1].score.values[:, None] > got[got.quality == 0].score.values[None]).mean() > 0.99


def test_features_by_hand():
    text = "Good WORDS are good.\nGood WORDS are #1 !!\n\nGood WORDS are #1 !! é é\n"
    got = dict(zip(gam.FEATURES, gam.text_features(text.encode()), strict=True))
    words, chars = text.split(), re.sub(r"\s", "", text)
    windows = list(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    want = {
        "log_words": np.log1p(len(words)),
        "word_length": len(chars) / len(words),
        "capitals": sum(c.isupper() for c in text) / sum(c.isascii() and c.isalpha() for c in text),
        "digits": 2 / len(chars),
        "symbols": 2 / len(chars),
        "punctuation": 7 / len(chars),
        "bangs": 4 / len(words),
        "beyond_ascii": 2 / len(chars),
        "symbol_ends": 0,
        "lone_symbols": 0,
        "distinct_words": len(set(words)) / len(words),
        "top_word": max(Counter(words).values()) / len(words),
        "repeat_windows": 1 - len(set(windows)) / len(windows),
        "repeat_lines": 0,
        "line_words": np.log1p(len(words) / len(lines)),
        "line_ends": 2 / 3,
    }
    assert {k: got[k] for k in want} == pytest.approx(want)
    odd = dict(zip(gam.FEATURES, gam.text_features(b"a | b# c* | |\na | b# c* | |"), strict=True))
    assert (odd["lone_symbols"], odd["symbol_ends"], odd["repeat_lines"]) == (0.5, 10 / 12, 0.5)


def test_windows_are_told_apart_exactly():
    rng = random.Random(4)
    for _ in range(40):
        words = [rng.choice("abcdef") for _ in range(rng.randrange(3, 60))]
        windows = list(zip(words, words[1:], words[2:]))
        got = gam.text_features(" ".join(words).encode())[gam.FEATURES.index("repeat_windows")]
        assert got == pytest.approx(1 - len(set(windows)) / len(windows))


def test_odd_texts(spark, fitted):
    docs = documents(spark)
    out = fitted.score(docs, ["doc_id"]).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert len({r.score for r in out if r.doc_id in (0, 1, 2)}) == 1  # null, empty and blank are alike
    assert fitted.score(nothing(spark), ["doc_id"]).count() == 0
    odd = docs.withColumns({"predicted": F.lit(7), "_text": F.lit("t"), "_rest": F.lit("r"), "capitals": F.lit("c")})
    got = fitted.score(odd, odd.columns)
    assert got.columns == [*[c for c in odd.columns if c not in ("score", "predicted")], "score", "predicted"]
    assert {(r.capitals, r._text, r._rest) for r in got.select("capitals", "_text", "_rest").collect()} == {("c", "t", "r")}


def test_few_labels(spark):
    docs = documents(spark)

    def scores(rows):
        return {r.score for r in gam.fit_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int")).score(docs, ["doc_id"]).collect()}

    assert scores([]) == {0.0} and scores([(None, 1), (3, None)]) == {0.0}
    assert scores([(1, 1), (2, 1), (None, 0)]) == {1.0} and scores([(1, 0), (1, 0), (1, 1)]) == {0.0}
    assert all(0 <= s <= 1 for s in scores([(0, 1), (2, 0), (5, 1), (4, 0)]))
    assert scores([(0, 1), (0, 0), (5, 0), (7, 1)]) == scores([(7, 1), (5, 0), (0, 0), (0, 1)])


def test_pairs_explain_what_features_cannot():
    """A target of two features' signs together: no table of one feature tells it, a table of both does, and that pair is chosen."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0)).astype(float)
    held = np.arange(4000) % 4 == 0
    alone = gam.fit_additive(x, y, held, pairs=0)
    both = gam.fit_additive(x, y, held, pairs=1)
    right = lambda m: ((m.probability(x[held]) > 0.5) == y[held]).mean()
    assert both.pairs == [(1, 3)] and right(alone) < 0.6 < 0.97 < right(both)


def test_scores_are_sums_of_looked_up_numbers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = gam.fit_additive(x, y, np.arange(600) % 4 == 0, rounds=30)
    for row in np.concatenate([x[:20], [[-99, 99, 0]]]):
        bin_of = lambda cuts, v: sum(v >= c for c in cuts)
        margin = m.intercept + sum(t[bin_of(c, v)] for c, t, v in zip(m.cuts, m.tables, row, strict=True))
        margin += sum(t[bin_of(m.coarse[i], row[i]), bin_of(m.coarse[j], row[j])] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        assert m.probability(row[None])[0] == pytest.approx(1 / (1 + np.exp(-margin)))


def brute_cut(g, h, calm):
    """The best two leaves by trying each cut."""
    far = lambda a: sum(g[a]) ** 2 / (sum(h[a]) + calm)
    return max(range(1, len(g)), key=lambda c: far(slice(0, c)) + far(slice(c, None)))


def test_trees_against_every_cut():
    rng = np.random.default_rng(5)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        step = gam.shallow_tree(g, h, 2, 1.0, 0.0)
        cut = int(np.flatnonzero(np.diff(step))[0]) + 1
        assert cut == brute_cut(g, h, 1.0) and step[0] == pytest.approx(g[:cut].sum() / (h[:cut].sum() + 1))
        assert len(np.unique(gam.shallow_tree(g, h, 3, 1.0, 0.0))) <= 3
        g2, h2 = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
        far = lambda i, j, a, b: g2[a, b].sum() ** 2 / (h2[a, b].sum() + 1)
        four = lambda i, j: [far(i, j, a, b) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None))]
        best = max(sum(four(i, j)) for i in range(1, 4) for j in range(1, 5)) - g2.sum() ** 2 / (h2.sum() + 1)
        gain, step = gam.crossed_tree(g2, h2, 1.0, 0.0)
        assert gain == pytest.approx(max(best, 0)) and len(np.unique(step)) <= 4
