import re

from helpers import documents, nothing

from wanderlake.llm import decontaminate as dc

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(text, items, size=10):
    own, hit, seen = words(text), set(), []
    for name, said in items:
        w = words(said)
        n = min(size, len(w))
        found = False
        for i in range(len(w) - n + 1) if n else []:
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found = True
        if found:
            seen.append("" if name is None else str(name))
    return len(own), len(hit), sorted(seen)


ITEMS = [(1, " ".join(f"q{i}" for i in range(25))), (2, "Cat sat on"), (3, None), (4, "..."), (None, "éa Éb"), (2, "a b c"), (10, "you 你好 é")]


def check(spark, **how):
    long_item = ITEMS[0][1].upper()
    texts = [None, "", "the CAT, sat; on -- the mat", f"intro: {long_item}! outro", " ".join(long_item.split()[3:14]), " ".join(long_item.split()[3:12]), "éA Éb éa", "Éb", "a b c a b c", "cat sat on " * 3000, "Say: You 你好 é!"]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for r in dc.find_contamination(docs, bench, **how).collect():
        n, hit, seen = brute(r.text, ITEMS)
        assert (r.n_words, r.n_hit, sorted(r.item_ids), r.contaminated) == (n, hit, seen, hit > 0), r.text
        # Spans lead back to the hit words in the text itself.
        assert [w for s in r.spans for w in words(r.text[s.start : s.end])] == [w for x in r.word_ranges for w in words(r.text)[x.first : x.past]]


def test_against_brute_force(spark):
    check(spark)


def test_in_blocks(spark):
    check(spark, block_words=3)


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.find_contamination(nothing(spark), bench).count() == 0
    out = dc.find_contamination(documents(spark), bench.filter("false"))
    assert out.filter("contaminated").count() == 0 and out.count() == documents(spark).count()


def test_an_item_longer_than_a_block(spark):
    """Its windows all count, and the item once, however many pieces of it a text has."""
    words = [f"w{i}" for i in range(400)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("other", " ".join(f"v{i}" for i in range(12)))], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words[43:57]) + " y " + " ".join(words[200:211])), (3, " ".join(words[90:99]))], "doc_id long, text string")
    for block in (20, 50, 10_000):
        got = {r.doc_id: (r.n_hit, r.item_ids) for r in dc.find_contamination(docs, bench, block_words=block).collect()}
        assert got == {1: (400, ["long"]), 2: (25, ["long"]), 3: (0, [])}, block
