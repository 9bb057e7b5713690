import random
import re

import numpy as np
import pytest
from helpers import documents, nothing

from wanderlake.llm import jaccard as jc
from wanderlake.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size=4, percent=85):
    """(number, key, set size, class) by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted((-1 if k is None else k, len(s), least.get(root(i), -1)) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n=260):
    """Random texts with near copies at all distances, chains, shared passages and short texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(12)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 60, 150]))] for _ in range(40)]
    texts = []
    for i in range(n):
        w = list(rng.choice(base)) if i >= len(base) else list(base[i])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w = w + passage
        if rng.random() < 0.2:
            w = w[: max(1, len(w) - rng.randrange(4))]
        texts.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"leaf": 2}), (3, {"leaf": 2, "block": 5}), (4, {"small": 0}), (5, {"hot": 3, "leaf": 4}), (6, {"hot": 3, "small": 20})])
def test_against_all_pairs(spark, seed, how):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jc.near_duplicate_classes(docs, **how).collect())
    assert got == brute(rows)


def test_other_thresholds(spark):
    rows = corpus(9, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jc.near_duplicate_classes(docs, size=2, percent=60).collect())
    assert got == brute(rows, 2, 60)


def test_odd_rows(spark):
    docs = documents(spark)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jc.near_duplicate_classes(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert jc.near_duplicate_classes(nothing(spark)).count() == 0


def test_a_chain_of_near_copies(spark):
    """Neighbours link, ends do not; a large bucket must not lose the links between."""
    rng = random.Random(7)
    w = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(80):
        rows.append((i, " ".join(w)))
        w[rng.randrange(len(w))] = f"n{i}"
        w[rng.randrange(len(w))] = f"m{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jc.near_duplicate_classes(docs, leaf=3).collect()) == brute(rows)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    for percent in (60, 85):
        base = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64)
        sets = sorted((np.unique(np.concatenate([rng.choice(base[:60], rng.integers(20, 60), False), rng.choice(base, rng.integers(0, 20), False)])) for _ in range(90)), key=len)
        bits = [np.frombuffer(jc._bitmap(s), np.uint64) for s in sets]
        tree = jc._Bucket(np.array([len(s) for s in sets]), bits, percent)
        found, _ = tree.pairs(np.arange(len(sets)), None, False)
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    assert (i, j) in found


def test_one_per_class(spark):
    rows = corpus(11, 120) + [(None, "null key"), (5, corpus(11, 120)[5][1]), (7, "another text of the same key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jc.one_per_class(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    classes = {r.component_id for r in jc.near_duplicate_classes(docs).collect() if r.component_id is not None}
    assert kept.count(None) == 1 and sorted(k for k in kept if k is not None) == sorted(classes)
    assert sorted(r.doc_id for r in jc.one_per_class(docs.filter("doc_id is not null"), small=0).collect()) == sorted(classes)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, 6), (6, 5), (9, 9), (2, 160)]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 2 for i in range(100, 161)}, 2: 2, 5: 5, 6: 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
