"""What the corpus operators share: staging (of the library), folds, salted lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import discard, new_path, shared_dir, stage  # noqa: F401

#: The six ASCII white-space characters; everything else belongs to words.
WHITE = " \t\n\x0b\f\r"
WHITE_RE = "[\\x20\\x09-\\x0D]+"

def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Whole texts and blocks of texts go to Python: bounds the bytes of a batch, as rows may be of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def in_fold(key: Column, modulus: int, rest: int) -> Column:
    """Whether the key falls into that fold (a null key never does)."""
    return F.coalesce(fold(key, modulus) == rest, F.lit(False))


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = 32) -> DataFrame:
    """Left join of many rows to one row per key, null keys included; a key with a third of all
    rows is spread over ``salts`` tasks, and each right row is copied that many times."""
    many = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    one = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    names = [c for c in right.columns if c != key]
    many, one = many.alias("l"), one.alias("r")
    on = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("l._salt") == F.col("r._salt"))
    return many.join(one, on, "left").select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in names])
