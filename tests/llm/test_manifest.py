import hashlib
from collections import Counter, defaultdict

import pytest
from helpers import documents, nothing
from pyspark.sql import functions as F

from wanderlake.llm import manifest as m


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    said = [None if row[c] is None else str(row[c]) for c in m.FIELDS]
    return sha("".join("-" if s is None else f"{len(s.encode())}:{s}" for s in said))


def climb(nodes, fanout):
    """The root over nodes, and for each the siblings up to it as (left, right)."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, own = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for j, who in enumerate(owners[at : at + fanout]):
                for i in who:
                    proofs[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            own.append(sum(owners[at : at + fanout], []))
        nodes, owners = up, own
    return nodes[0], proofs


def brute(rows, fanout=2):
    """(doc_id, lang, leaf, subroot, siblings) of all rows, and the root."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in langs]
    root, upper = climb([t[0] for t in trees], fanout) if trees else (None, [])
    out = [(x[3]["doc_id"], g, x[2], sub, p + above) for g, (sub, proofs), above in zip(langs, trees, upper) for x, p in zip(sorted(groups[g], key=lambda x: x[:3]), proofs)]
    return out, root


def seen(df):
    kept = df.select("doc_id", "lang", m.hex_text(F.col("h")).alias("h"), m.hex_text(F.col("subroot")).alias("s"), F.transform("proof", lambda x: F.array(m.hex_text(x["left"]), m.hex_text(x["right"]))).alias("p"))
    return Counter((r.doc_id, r.lang, r.h, r.s, tuple(map(tuple, r.p))) for r in kept.collect())


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_equals_brute_force(spark, fanout):
    docs = documents(spark, langs=("en", None, "é", "en", "zz", "en"))
    got, root = m.manifest(m.document_leaves(docs), "lang", "doc_id", fanout)
    want, top = brute([r.asDict() for r in docs.collect()], fanout)
    assert root.hex() == top
    assert seen(got) == Counter((d, g, h, s, tuple(p)) for d, g, h, s, p in want)
    again = got.select(m.folded(F.col("h"), F.col("proof")).alias("r"), m.proof_digest(F.col("proof")).alias("d"))
    assert {bytes(r.r).hex() for r in again.collect()} == {top}
    assert Counter(bytes(r.d).hex() for r in again.collect()) == Counter(sha("".join(a + b for a, b in p)) for *_, p in want)


def test_many_groups_join_salted(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id as doc_id", "if(id % 7 = 0, null, concat('g', id % 7)) as lang", "'s' as source", "id as n_chars", "string(id) as text")
    whole = m.numbered
    monkeypatch.setattr(m, "numbered", lambda leaves, group, order: whole(leaves, group, order, small=0))
    got, root = m.manifest(m.document_leaves(docs), "lang", "doc_id")
    want, top = brute([r.asDict() for r in docs.collect()])
    assert root.hex() == top and seen(got) == Counter((d, g, h, s, tuple(p)) for d, g, h, s, p in want)


def test_odd_tables(spark):
    for docs in (nothing(spark), documents(spark, texts=["alone"]).limit(1), documents(spark, texts=[None]).filter("doc_id is null")):
        got, root = m.manifest(m.document_leaves(docs), "lang", "doc_id")
        want, top = brute([r.asDict() for r in docs.collect()])
        assert (root.hex() if root else None) == top
        assert seen(got) == Counter((d, g, h, s, tuple(p)) for d, g, h, s, p in want)


def test_clashing_columns_and_fanout(spark):
    leaves = m.document_leaves(documents(spark)).withColumns({"subroot": F.lit("x"), "proof": F.lit("y"), "own": F.lit("o"), "at": F.lit(3), "g": F.lit("g"), "kids": F.lit("k"), "n": F.lit(9)})
    got, _ = m.manifest(leaves, "lang", "doc_id")
    assert {(r.own, r["at"], r.g, r.kids, r.n) for r in got.collect()} == {("o", 3, "g", "k", 9)}
    assert got.schema["subroot"].dataType.simpleString() == "binary"
    with pytest.raises(ValueError):
        m.manifest(leaves, "lang", "doc_id", fanout=1)


def test_a_changed_field_is_found_out(spark):
    """Any changed field of a row, and only of that row, leads to another root."""
    docs = documents(spark, texts=[f"text {i}" for i in range(11)])
    sound = {c: F.col(c) for c in m.FIELDS}
    for field, other in {"text": F.lit("other"), "source": F.lit(None).cast("string"), "n_chars": F.col("n_chars") + 1, "lang": F.lit("")}.items():
        bad = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
        leaves = m.document_leaves(docs, m.FIELDS, bad, {field: other})
        got, root = m.manifest(leaves, "lang", "doc_id")
        out = got.select("doc_id", (m.folded(F.col("found"), F.col("proof")) == F.lit(root)).alias("ok")).collect()
        assert all(r.ok == (r.doc_id is None or r.doc_id % 3 != 0) for r in out), field
    assert docs.select(m.leaf_digest(sound)).distinct().count() == 12
