"""A training corpus from the table of documents, in stages that are each written and read again.

language: texts whose language is rejected go. quality: texts that fail the quality rules, or whose host
does, go. near_duplicates: of each class of near duplicates one text stays. decontamination: texts with
benchmark passages go. packing: what is left, as token sequences.

Defined results: texts without letters, null and empty ones among them, go in the first stage; of rows with one doc_id
that are left at the third stage one stays, rows with a null doc_id all do; null languages and hosts are taken as they come, a null host being
one of its own; whole texts count, however long; an empty table gives empty results; further columns, also ones named as a
stage's results, are kept up to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderlake.llm.common import stage
from wanderlake.llm.decontaminate import find_contamination
from wanderlake.llm.jaccard import one_per_class
from wanderlake.llm.language import fit_languages, identify, training_rows
from wanderlake.llm.packing import pack, token_pieces
from wanderlake.llm.quality import keep_by_host_rules


def _aside(docs: DataFrame) -> DataFrame:
    """The text, and the other columns out of the way of results' names."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest"), "text")


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns as they were."""
    return found.select(*[F.col("text" if c == "text" else f"_rest.{c}").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    models = fit_languages(training_rows(docs, F.col("doc_id")))
    return _back(identify(_aside(docs), models).filter("not rejected"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that do."""
    return keep_by_host_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose five-word shingles have a similarity of 0.8 or more."""
    return one_per_class(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    found = find_contamination(_aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _back(found.filter("not contaminated"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

# Language models, near-duplicate classes and packing are beyond SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
