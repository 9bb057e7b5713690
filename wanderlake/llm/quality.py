"""Operator 1, host-level quality rules, in SQL expressions only.

``document_measures`` measures each whole text; ``host_verdicts`` adds up rule failures by host,
shrinks each rate towards an empirical beta prior, and ``apply_host_rules`` joins the verdicts back.

Defined results: a null or empty text has no words and fails the length rule; a null host is a
host of its own; repeated rows count and return as often as they occur; an empty table gives an
empty result; columns besides key, text and host are ignored. A text is one row's work however
long it is: its windows are one sorted array of longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, WHITE_RE, salted_lookup, stage

#: Rule name -> SQL over the measures; a document fails a rule where it is true.
RULES = {
    "short": "n_words < 50",
    "repetition": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * word_chars",
    "dup_lines": "n_dup_lines > 0 and 2 * n_dup_lines > n_lines",
}
BASE_RULES = ("short", "repetition")
#: A host goes where it credibly (DEVIATIONS of its posterior) fails a rule LIFT times as often as all documents do and in more than
#: LOW of its documents, or in more than HIGH of them.
DEVIATIONS, LIFT, LOW, HIGH = 2.0, 3.0, 0.25, 0.5


def _mark(key: str, text: str, host: str) -> Column:
    """What tells rows of one key apart."""
    return F.xxhash64(F.col(key), F.col(text), F.col(host))


def document_measures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", hash_mask: int = -1) -> DataFrame:
    """key, host, mark (a hash of key, text and host), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words per row.

    Three-word windows become longs, hash above and place below, so one primitive sort brings equal
    windows together; neighbours with equal hashes are then compared word by word, and where such neighbours differ, all
    windows of that hash. ``hash_mask`` is for tests, which let hashes collide.
    """
    out = docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_t"), _mark(key, text, host).alias("mark"))
    out = out.select("*", F.btrim("_t", F.lit(WHITE)).alias("_b"))
    out = out.withColumn("_w", F.split("_b", WHITE_RE)).drop("_b")
    out = out.withColumn("n_words", F.expr("case when _w[0] = '' then 0L else cast(size(_w) as bigint) end"))
    out = out.withColumn("word_chars", F.length(F.translate("_t", WHITE, "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    out = out.withColumn("_lines", lines).drop("_t")
    out = out.withColumn("n_lines", F.size("_lines").cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    out = out.withColumn("_bits", F.expr("length(bin(n_words))"))
    windows = f"""case when n_words < 3 then cast(array() as array<bigint>) else
        sort_array(transform(sequence(1, cast(n_words - 2 as int)),
            i -> shiftleft(xxhash64(_w[i - 1], _w[i], _w[i + 1]) & {hash_mask}L, _bits) | cast(i as bigint))) end"""
    out = out.withColumn("_s", F.expr(windows)).withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1L"))
    near = "shiftright(x, _bits) = shiftright({y}, _bits)"
    same = f"""{near} and _w[int(x & _mask) - 1] = _w[int({{y}} & _mask) - 1]
        and _w[int(x & _mask)] = _w[int({{y}} & _mask)] and _w[int(x & _mask) + 1] = _w[int({{y}} & _mask) + 1]"""
    below, above = "get(_s, i - 1)", "get(_s, i + 1)"
    ties = f"({near.format(y=below)} or {near.format(y=above)}) and exists(_s, y -> y != x and {same.format(y='y')})"
    found = f"filter(_s, (x, i) -> ({same.format(y=below)}) or ({same.format(y=above)}) or ({ties}))"
    out = out.withColumn("_p", F.expr(f"sort_array(transform({found}, x -> x & _mask))"))
    covered = """aggregate(_p, named_struct('e', 1L, 't', 0L),
        (a, q) -> named_struct('e', q + 3L, 't', a.t + q + 3L - greatest(q, a.e)), a -> a.t)"""
    out = out.withColumn("n_repeat_words", F.expr(covered))
    cols = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("_key").alias(key), F.col("_host").alias(host), "mark", *cols)


def host_verdicts(measures: DataFrame, host: str = "source") -> DataFrame:
    """Per host: documents, and for each rule failures, shrunk rate; host_rejected by the posterior of a rate.

    The beta prior of a rule has the mean of all documents and the strength that the method of
    moments gives for the spread of hosts' true rates: the spread of the rates seen, less what hosts of their sizes and one
    rate would show by chance. So a host with few documents stays near the mean, and its wide
    posterior condemns it only where all hosts vary much.
    """
    hosts = stage(
        measures.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.expr(sql).cast("long")).alias(f"fail_{r}") for r, sql in RULES.items()]),
        "hosts",
    )
    total = [F.sum("host_docs").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.expr("cast(host_docs as double) * host_docs")).alias("n2")]
    for r in RULES:
        total += [F.sum(f"fail_{r}").alias(f"f_{r}"), F.sum(F.expr(f"cast(fail_{r} as double) * fail_{r} / host_docs")).alias(f"q_{r}")]
    row = hosts.agg(*total).first()
    n = row["n"] or 0
    out, bad = hosts, F.lit(False)
    for r in RULES:
        mean = (row[f"f_{r}"] or 0) / n if n else 0.0
        # Likeness of documents within hosts: squares between hosts, over what one rate gives, less k - 1.
        one_rate, free = mean * (1 - mean), row["k"] - 1
        room = n - row["n2"] / n - free if n else 0.0
        like = ((row[f"q_{r}"] - n * mean * mean) / one_rate - free) / room if one_rate > 0 and room > 0 else 0.0
        strength = min(1e6, max(1.0, 1 / like - 1)) if like > 0 else 1e6
        a, b = mean * strength, (1 - mean) * strength
        rate, size = (F.col(f"fail_{r}") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b)), F.col("host_docs") + F.lit(a + b)
        out = out.withColumn(f"rate_{r}", rate)
        bad = bad | (rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (size + 1)) > F.lit(max(LOW, min(HIGH, LIFT * mean))))
    return out.withColumn("host_rejected", bad)


def _judged(measures: DataFrame, key: str, host: str, small: int = 50_000) -> DataFrame:
    """The measured rows with base_failed, host_rejected, host rates and kept.

    Verdicts of up to ``small`` hosts are broadcast; more join salted, so that one host with a third
    of all documents lies in many tasks.
    """
    verdicts = stage(host_verdicts(measures, host).select(host, "host_rejected", *[f"rate_{r}" for r in RULES]), "verdicts")
    if verdicts.count() <= small:
        out = measures.join(F.broadcast(verdicts.withColumnRenamed(host, "_of")), F.col(host).eqNullSafe(F.col("_of")), "left").drop("_of")
    else:
        out = salted_lookup(measures, verdicts, host, F.col(key))
    failed = F.lit(False)
    for r in BASE_RULES:
        failed = failed | F.expr(RULES[r])
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def apply_host_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures, base_failed, host_rejected, host rates and kept per row of ``docs``.

    The measures are written once and read twice.
    """
    return _judged(stage(document_measures(docs, key, text, host), "measures"), key, host)


def keep_by_host_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", small: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Only measures are written, not texts; keys and marks of up to ``small`` rejected rows go to the
    documents, more meet them in a join.
    """
    gone = apply_host_rules(docs, key, text, host).filter("not kept")
    gone = stage(gone.select(F.col(key).alias("_key"), F.col("mark").alias("_mark")).distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= small else gone
    return docs.join(gone, F.col(key).eqNullSafe(F.col("_key")) & (_mark(key, text, host) == F.col("_mark")), "left_anti")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    out = apply_host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > 3 * word_chars AS f3,
         n_dup_lines > 0 AND 2 * n_dup_lines > n_lines AS f4 FROM m),
u AS (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS x FROM f),
h AS (SELECT source, rule, count(*) AS n, sum(CAST(x AS INT)) AS k FROM u GROUP BY source, rule),
q AS (SELECT rule, sum(k) / sum(n) AS mean, sum(CAST(k AS DOUBLE) * k / n) - sum(n) * (sum(k) / sum(n)) ^ 2 AS squares, count(*) - 1 AS free,
        sum(n) - sum(CAST(n AS DOUBLE) * n) / sum(n) - (count(*) - 1) AS room FROM h GROUP BY rule),
y AS (SELECT rule, mean, CASE WHEN mean * (1 - mean) > 0 AND room > 0 THEN (squares / (mean * (1 - mean)) - free) / room ELSE 0.0 END AS alike FROM q),
s AS (SELECT rule, mean, CASE WHEN alike > 0 THEN least(1e6, greatest(1.0, 1 / alike - 1)) ELSE 1e6 END AS strength FROM y),
b AS (SELECT h.source, (k + mean * strength) / (n + strength) AS rate, n + strength + 1 AS size, greatest(0.25, least(0.5, 3 * mean)) AS bound FROM h JOIN s USING (rule)),
v AS (SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / size) > bound) AS bad FROM b GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT bad AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

QUERIES = {"op1_host_quality": op1_host_quality}
ORACLES = {"op1_host_quality": ORACLE}
