import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, nothing
from pyspark.sql import functions as F

from wanderlake.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, tops=10):
    """All rows of the audit, by the definition, in Python's integers."""
    docs = [((r.lang or ""), (r.source or ""), TERM.findall((r.text or "").translate(LOWER))) for r in rows]
    spread, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        spread[lang].update(set(words))
        groups[lang, source].update(words)
    out = set()
    for lang in spread:
        kept = sorted((t for t, k in spread[lang].items() if k >= least), key=lambda t: t.encode())
        here = {s: c for (g, s), c in groups.items() if g == lang}
        n = {s: sum(c[t] for t in kept) for s, c in here.items()}
        share = lambda k, total: 1 + 10**9 * (k + 2) // (total + 2 * len(kept))
        far = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: [share(c[t], n[s]) for t in kept] for s, c in here.items()}
        q = [share(sum(c[t] for c in here.values()), sum(n.values())) for t in kept]
        for s in here:
            pairs = [(-sum(map(far, p[s], p[o])), o.encode()) for o in here if o != s]
            terms = [(-far(p[s][i], q[i]), t.encode()) for i, t in enumerate(kept) if here[s][t] and p[s][i] > q[i]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:tops])):
                out |= {(lang, s, part, x.decode(), -v, k + 1) for k, (v, x) in enumerate(found)}
    return out


def seen(df):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(spark, n=120, seed=1):
    rng = random.Random(seed)
    words = [*"abcdefghij", "Été", "été", "Zażółć", "你好", "éa", "🙂", "zz-top", "x1y", "ﬀ", "z"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", "z", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for _ in range(n)]
    rows += [("one", "alone", "a b")] * 12 + [("few", "x", "rare"), ("few", "y", "words"), ("mute", "x", None), ("mute", "y", "...")]
    return spark.createDataFrame(rows, "lang string, source string, text string")


def test_equals_brute_force(spark):
    docs = corpus(spark)
    rows = docs.collect()
    for least, tops in ((10, 10), (1, 3), (1000, 10)):
        assert seen(dv.audit(docs, least=least, tops=tops)) == brute(rows, least, tops), (least, tops)


def test_parts_of_any_size(spark, monkeypatch):
    """Several ranges, matrices of few columns, blocks of sources, counters that are sent on, texts in pieces and joins without broadcast change nothing."""
    docs = corpus(spark, 80, 2)
    monkeypatch.setattr(dv, "RANGE_TERMS", 4)
    want = brute(docs.collect(), 2)
    assert seen(dv.audit(docs, least=2, small=0)) == want
    groups = docs.filter("lang = 'en'").selectExpr("coalesce(source, '') as source").distinct().collect()
    assert [x for piece in dv.pieces(b"Aa b\xc3\xa9  c1d " * 3, 2) for x in piece] == [b"aa", "bé".encode(), b"c", b"d"] * 3
    assert len(groups) == 5


def test_blocks_of_sources_and_matrix_columns(monkeypatch):
    """A range's parts over blocks of sources and bits of the matrix are those of the whole."""
    import pyarrow as pa

    rng = random.Random(5)
    names, terms = [f"s{i}" for i in range(9)], [f"t{i:02}" for i in range(40)]
    cells = [(s, t, rng.randrange(1, 50)) for s in names for t in terms if rng.random() < 0.6]
    totals = Counter()
    for s, _, n in cells:
        totals[s] += n
    rows = pa.table({"source": [c[0] for c in cells], "term": [c[1] for c in cells], "n": pa.array([c[2] for c in cells], pa.int64())})
    groups = pa.table({"source": names, "total": pa.array([totals[s] for s in names], pa.int64()), "kept": pa.array([40] * 9, pa.int64())})

    def parts(block, cells):
        monkeypatch.setattr(dv, "BLOCK", block)
        monkeypatch.setattr(dv, "CELLS", cells)
        keys = [(pa.scalar("en"), pa.scalar(0), pa.scalar(b)) for b in range(-(-9 // block))]
        return sorted(tuple(r.values()) for k in keys for r in dv.compare(k, rows, groups, 4).to_pylist())

    whole = parts(256, 1 << 20)
    assert len([r for r in whole if r[2] == "pair"]) == 36
    assert parts(4, 20) == whole == parts(2, 1)


def test_counters_are_sent_on(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dv, "HELD", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["s"] * 4), pa.array(["a b c d", "a", "e f a a", ""])], names=["lang", "source", "text"])
    out = list(dv._count(iter([batch])))
    total = Counter()
    for part in out:
        for r in part.to_pylist():
            total[r["term"]] += r["n"]
    assert len(out) > 1 and total == Counter({"a": 4, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, None: 0})


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        total = rng.randrange(1, 10 ** rng.randrange(1, 16))
        count = rng.randrange(0, total + 1)
        assert dv.shares(np.array([count], np.int64), np.array([total], np.int64))[0] == 1 + 10**9 * count // total


def test_odd_tables(spark):
    assert dv.audit(nothing(spark)).count() == 0
    docs = documents(spark, langs=("en", None, ""))
    docs = docs.unionByName(docs).withColumns({"term": F.lit("x"), "n": F.lit(1), "rank": F.lit(1), "part": F.lit("p")})
    for least in (1, 2, 10):
        assert seen(dv.audit(docs, least=least)) == brute(docs.collect(), least)


def test_a_planted_difference_comes_first(spark):
    plain = "the of and to in a is that for it " * 3
    rows = [("en", s, plain + ("quark gluon " if s == "physics" else "")) for s in ("news", "physics", "blog") for _ in range(40)]
    out = dv.audit(spark.createDataFrame(rows, "lang string, source string, text string")).collect()
    assert {r.item for r in out if r.source == "physics" and r.part == "term" and r["rank"] <= 2} == {"gluon", "quark"}
    near = {(r.source, r.item): r.value for r in out if r.part == "pair"}
    assert near["news", "blog"] == 0 < near["news", "physics"] == near["physics", "news"]
    assert pytest.approx(near["blog", "physics"]) == near["news", "physics"]
