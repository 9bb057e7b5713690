import random
import re
from collections import Counter

from helpers import documents, nothing

from wanderlake.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    again = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_measures_of_odd_texts(spark):
    docs = documents(spark)
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.document_measures(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}
    assert quality.apply_host_rules(docs).count() == docs.count()


def test_empty_table(spark):
    assert quality.apply_host_rules(nothing(spark)).count() == 0
    assert quality.keep_by_host_rules(nothing(spark)).columns == nothing(spark).columns


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good, "clean") for i in range(200)] + [(200 + i, "short text", "bad") for i in range(300)] + [(500, good, "bad"), (501, "too short", "tiny"), (502, good, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality.apply_host_rules(docs).collect()}
    # A good text of a host that fails as a rule goes; a small host is drawn to the mean and stays.
    assert out[500].host_rejected and not out[500].base_failed and not out[500].kept
    assert out[502].kept and not out[501].kept and all(out[i].kept for i in range(200))
    assert {r.doc_id for r in quality.keep_by_host_rules(docs).collect()} == {*range(200), 502}


def test_windows_with_equal_hashes(spark):
    """Windows whose hashes collide are told apart, and repeats among them still found."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for mask in (-1, 1, 0):
        got = {r.doc_id: r.n_repeat_words for r in quality.document_measures(docs, hash_mask=mask).collect()}
        assert got == {i: brute(t)[4] for i, t in enumerate(texts)}, mask


def hosts(spark, fails):
    """Documents of hosts: name -> (documents, how many have too many symbols, which no base rule sees)."""
    good = " ".join(f"w{i}" for i in range(60))
    bad = " ".join(f"w{i}###" for i in range(60))
    rows = [(bad if i < k else good, h) for h, (n, k) in fails.items() for i in range(n)]
    return spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string")


def verdicts(spark, fails):
    out = quality.apply_host_rules(hosts(spark, fails))
    assert not out.filter("base_failed").count()
    found = {r.source: r.host_rejected for r in out.select("source", "host_rejected").distinct().collect()}
    assert out.filter("kept").count() == sum(n for h, (n, _) in fails.items() if not found[h])
    return {h for h, bad in found.items() if bad}


def test_planted_hosts_go_and_clean_ones_stay(spark):
    clean = {f"h{i}": (100, i % 9) for i in range(20)}
    assert verdicts(spark, clean) == set()
    assert verdicts(spark, clean | {"bad": (100, 70), "large": (600, 400)}) == {"bad", "large"}


def test_shrinkage_changes_a_verdict(spark):
    """Four failures of five condemn a small host where hosts differ much, not where they are alike."""
    alike = {f"h{i}": (60, 3) for i in range(20)}
    assert verdicts(spark, alike | {"small": (6, 5)}) == set()
    apart = {f"h{i}": (60, 0) for i in range(20)} | {f"b{i}": (60, 60) for i in range(3)}
    assert verdicts(spark, apart | {"small": (6, 5)}) == {"b0", "b1", "b2", "small"}


def test_many_hosts_join_salted(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 3) as text", "if(id < 20, null, concat('h', id % 9)) as source")
    measures = quality.stage(quality.document_measures(docs), "measures")
    a = quality._judged(measures, "doc_id", "source").orderBy("doc_id").collect()
    b = quality._judged(measures, "doc_id", "source", small=0).orderBy("doc_id").select(quality._judged(measures, "doc_id", "source").columns).collect()
    assert a == b


def measured(spark, hosts):
    """Measures of hosts: (documents, how many are short) each."""
    sizes = spark.createDataFrame([(f"h{i}", n, k) for i, (n, k) in enumerate(hosts)], "source string, n long, k long")
    rows = sizes.selectExpr("source", "k", "explode(sequence(1L, n)) as i")
    return rows.selectExpr("source", "if(i <= k, 10L, 100L) as n_words", "0L as n_repeat_words", "0L as n_symbols", "500L as word_chars", "0L as n_dup_lines", "9L as n_lines")


def test_hosts_that_differ_by_chance_shrink_to_one_rate(spark):
    """2,000 hosts of 10 documents that fail one time in twenty, each by itself: what differs is chance, and so all rates come near that one."""
    rng = random.Random(8)
    alike = [(10, sum(rng.random() < 0.05 for _ in range(10))) for _ in range(2000)]
    rates = [r.rate_short for r in quality.host_verdicts(measured(spark, alike)).collect()]
    assert 0.035 < min(rates) and max(rates) < 0.08
    apart = [(10, k) for k in (0, 9) for _ in range(1000)]
    rates = [r.rate_short for r in quality.host_verdicts(measured(spark, apart)).collect()]
    assert min(rates) < 0.06 and max(rates) > 0.8


def test_the_prior_finds_the_spread_it_was_made_with(spark):
    """Hosts of many sizes whose rates come from a beta: the strength of the prior is about its a + b."""
    rng = random.Random(4)
    hosts = []
    for _ in range(3000):
        n, rate = rng.choice([3, 8, 20, 60]), rng.betavariate(2, 18)
        hosts.append((n, sum(rng.random() < rate for _ in range(n))))
    got = quality.host_verdicts(measured(spark, hosts)).filter("host_docs = 60").select("host_docs", "fail_short", "rate_short").collect()
    mean = sum(k for _, k in hosts) / sum(n for n, _ in hosts)
    # rate = (k + mean s) / (n + s), so s = (k - n rate) / (rate - mean).
    strengths = [(r.fail_short - r.host_docs * r.rate_short) / (r.rate_short - mean) for r in got if abs(r.rate_short - mean) > 1e-3]
    assert max(strengths) - min(strengths) < 1e-3 and 15 < strengths[0] < 26
