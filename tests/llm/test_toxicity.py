import numpy as np
import pytest
from helpers import documents, nothing
from pyspark.sql import functions as F

from wanderlake.llm import toxicity as tx
from wanderlake.llm.common import in_fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return tx.fit_toxicity(docs, labels.filter(~in_fold(F.col("doc_id"), 5, 0)))


def test_held_out(spark, fitted):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = fitted.score(docs, ["doc_id", "lang"]).join(labels.filter(in_fold(F.col("doc_id"), 5, 0)), "doc_id").toPandas()
    good = got[got.toxic == 0].score.values
    bad = {lang: part.score.values for lang, part in got[got.toxic == 1].groupby("lang")}
    assert len(bad) >= 3
    for lang, scores in bad.items():
        assert len(scores) < 3 or (scores[:, None] > good[None]).mean() > (0.85 if len(scores) > 5 else 0.7), lang
    assert (got[got.toxic == 0].predicted == 0).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_texts(spark, fitted):
    docs = documents(spark)
    out = fitted.score(docs, ["doc_id"]).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert fitted.score(nothing(spark), ["doc_id"]).count() == 0


def test_few_labels(spark):
    docs = documents(spark)
    none = tx.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in none.score(docs, ["doc_id"]).collect()} == {0.0}
    ones = tx.fit_toxicity(docs, spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, toxic int"))
    assert {r.predicted for r in ones.score(docs, ["doc_id"]).collect()} == {1}
    both = tx.fit_toxicity(docs, spark.createDataFrame([(0, 1), (2, 0), (5, 1), (4, 0)], "doc_id long, toxic int"))
    assert both.score(docs, ["doc_id"]).count() == docs.count()


def test_several_labels_of_a_key_and_clashing_columns(spark, fitted):
    """Labels of one key count as their mean, however they are ordered; repeated rows return each; columns named as results or features pass."""
    docs = documents(spark)
    rows = [(0, 1), (0, 0), (1, 0), (2, 0), (2, 0), (2, 1), (4, 0), (5, 1), (5, 1)]
    models = [tx.fit_toxicity(docs, spark.createDataFrame(r, "doc_id long, toxic int")) for r in (rows, rows[::-1])]
    a, b = (sorted((r.doc_id or -1, r.score) for r in m.score(docs, ["doc_id"]).collect()) for m in models)
    assert a == b and len(a) == docs.count()
    odd = docs.withColumns({"predicted": F.lit(7), "capitals": F.lit("c"), "_text": F.lit("t"), "margin": F.lit("m")})
    out = fitted.score(odd, odd.columns)
    assert out.columns == [*[c for c in odd.columns if c not in ("score", "predicted")], "score", "predicted"]
    assert {(r.capitals, r._text, r.margin) for r in out.select("capitals", "_text", "margin").collect()} == {("c", "t", "m")}


def test_calibration_is_piecewise_linear(spark):
    rng = np.random.default_rng(1)
    xs = np.sort(rng.normal(size=700))
    ys = np.sort(rng.random(700))
    model = tx.ToxicityModel({}, None, list(zip(xs.tolist(), ys.tolist())), None)
    at = np.concatenate([xs[::50], rng.normal(size=60), [-99.0, 99.0]])
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in at], "x double").select(model._calibrated(F.col("x"))).collect()]
    kept = np.unique(np.linspace(0, 699, tx.POINTS).round().astype(int))
    assert got == pytest.approx(np.interp(at, xs[kept], ys[kept]))


def test_texts_that_begin_alike_are_learned_from_each(spark):
    """Texts share an opening of over 64 characters; equal whole texts count once."""
    header = "From the archive of messages to the list, kept in order of arrival: " * 2
    rows = [(f"{header} number{i} vermazoid", 1.0) for i in range(10)] + [(f"{header} zzz{i} pleasant", 0.0) for i in range(40)]
    rows += [(f"{header}  Number0 VERMAZOID copied", 1.0)] * 30
    found = tx.learn_lexicon(spark.createDataFrame(rows, "text string, label double"))
    # 11 different toxic texts have the word, no clean one: log(11.5 / 0.5) less the log odds of 11 to 40.
    assert found == {"vermazoid": pytest.approx(np.log(11.5 / 0.5) - np.log(11 / 40))}


def test_spelling():
    assert tx.unmasked("1d10t") == "idiot" and tx.unmasked("s.c.u.m") == "scum" and tx.unmasked("$tup!d.") == "stupid"
    row = tx.word_features({})([b"You", b"1D10T!", b"idiot,", b"e-mail", b"v2.0", "é%%%".encode()])
    assert row[:, tx._HIDDEN].tolist() == [0, 1, 0, 0, 0, 0] and row[:, tx._FIXED].tolist() == [0, 0, 1, 0, 0, 0]
    assert row[0, tx._SECOND] == 1
    near = tx.text_features(row[[0, 1]])[tx.FEATURES.index("nearness")]
    assert near == 0.5 and tx.text_features(row[:0]) == [0.0] * len(tx.FEATURES)
