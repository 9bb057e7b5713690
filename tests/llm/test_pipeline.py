import random

import corpus_pipeline as cp
from helpers import ODD_TEXTS, documents, nothing
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = set(texts)
    assert [n for n, _ in cp.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    for name, step in cp.STAGES[:-1]:
        docs = cp.stage(step(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        now = {r.doc_id for r in rows}
        assert len(now) == len(rows) and now <= left and all(texts[r.doc_id] == r.text for r in rows)
        assert len(now) >= 0.4 * len(left), name
        left = now
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == left


def test_run_equals_the_stages(spark):
    out = cp.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in cp.STAGES:
        docs = cp.stage(step(spark, docs, SF), name)
    told = ["doc_id", "piece", "start", "length", "ids_crc32"]  # sequences may be numbered otherwise
    assert sorted(tuple(r[c] for c in told) for r in out) == sorted(tuple(r[c] for c in told) for r in docs.collect())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for parts in by.values():
        parts.sort(key=lambda r: r.piece)
        assert [r.start for r in parts] == [2048 * k for k in range(len(parts))]
    assert len(out) > 50


def test_planted_cases(spark, tmp_path):
    """A near copy, a benchmark passage and a short text go; clean texts stay."""
    rng = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 20]
    vocab = [w for r in docs.filter("lang = 'en'").limit(60).collect() for w in r.text.split() if w.isalpha()]
    clean = [" ".join(rng.choice(vocab) for _ in range(200)) for _ in range(20)]
    rows = [(10_000 + i, t, "en", "src1", len(t)) for i, t in enumerate(clean)]
    near = clean[0].split()
    near[50] = "changed"
    rows += [(20_000, " ".join(near), "en", "src1", 0), (20_001, f"{clean[1][:300]} {bench[0]} {clean[2][:300]}", "en", "src1", 0), (20_002, "too short", "en", "src1", 0)]
    rows += [(20_003, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000)), None, "src1", 0), (20_004, "съешь же ещё этих мягких французских булок да выпей чаю " * 20, None, "src1", 0), (20_005, "1234 ### 5678 " * 200, "en", "src1", 0)]
    mixed = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    goes = {"language": {20_003, 20_004, 20_005}, "quality": {20_002}, "near_duplicates": {20_000}, "decontamination": {20_001}}
    there = {r.doc_id for r in mixed.select("doc_id").collect()}
    for name, step in cp.STAGES[:-1]:
        mixed = cp.stage(step(spark, mixed, SF), name)
        kept = {r.doc_id for r in mixed.select("doc_id").collect()}
        assert there - kept >= goes[name] and kept >= set(range(10_000, 10_020)), name
        assert not (there - kept) & set().union(*[v for k, v in goes.items() if k != name]), name
        assert name != "language" or len(there - kept - goes[name]) <= 0.02 * len(there)
        there = kept


def test_odd_rows_through_the_stages(spark):
    """Nulls in every column, empty and very long texts, repeated rows and further columns with names of results pass or go, and nothing fails."""
    good = [f"{w} of the and on is" for w in ("thion", "ereste", "andor", "hesher")]
    rng = random.Random(5)
    base = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").select("text").limit(40)
    texts = [*[r.text for r in base.collect()], " ".join(rng.choice(good) for _ in range(60_000))]
    docs = documents(spark, texts=[*ODD_TEXTS, *texts])
    for extra in ("kept", "component_id", "rejected", "n_hit", "contaminated", "_text", "key", "id", "cross_entropy"):
        docs = docs.withColumn(extra, F.lit("x"))
    for name, step in cp.STAGES[:-1]:
        before, docs = docs.dtypes, cp.stage(step(spark, docs, SF), name)
        assert docs.dtypes == before and "x" == (docs.select("kept").first() or ["x"])[0], name
    assert docs.count() > 5
    assert cp.STAGES[-1][1](spark, docs, SF).count() > 5


def test_near_duplicates_from_four_fifths_on(spark):
    """The stage's contract is five words and 0.8: pairs from there to 0.85 are one class, pairs below are not."""
    words = [[f"w{k}x{i}" for i in range(200)] for k in range(4)]

    def changed(k, n):
        return [f"new{i}" if i in range(20, 20 + 40 * n, 40) else w for i, w in enumerate(words[k])]

    pairs = [(words[0], words[0] + [f"more{i}" for i in range(45)]), (words[1], changed(1, 4)), (words[2], changed(2, 5)), (words[3], words[3] + [f"more{i}" for i in range(50)])]

    def jaccard(a, b, size):
        a, b = ({tuple(x[i : i + size]) for i in range(len(x) - size + 1)} for x in (a, b))
        return len(a & b) / len(a | b)

    assert [jaccard(a, b, 5) >= 0.8 for a, b in pairs] == [True, True, False, False]
    assert not any(jaccard(a, b, 4) >= 0.85 for a, b in pairs)
    rows = [(10 * k + j, " ".join(t), "en", "src1", 0) for k, pair in enumerate(pairs) for j, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()} == {0, 10, 20, 21, 30, 31}


def test_empty(spark):
    docs = nothing(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, step in cp.STAGES:
        assert step(spark, docs, SF).count() == 0
