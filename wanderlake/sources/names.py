"""Vertex names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NAME = (1 << 32) - 1


def checked(name: Column) -> Column:
    """The name, or an error where it is no unsigned 32-bit number."""
    ok = name.between(0, MAX_NAME)
    return F.when(ok, name).otherwise(F.raise_error(F.concat(F.lit("vertex name out of range: "), F.coalesce(name.cast("string"), F.lit("null")))).cast("long"))
