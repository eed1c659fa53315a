"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.tables import cut, drop, shared_dir

__all__ = ["WORD", "cut", "drop", "hash32", "shared_dir", "table", "words"]

#: Words are runs of anything but the six ASCII blanks.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)).cast("long"), F.lit(0).cast("long"))


def hash32(col: Column, seed: str) -> Column:
    """First 32 bits of md5 of ``seed:value`` as a long; DuckDB computes the same."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
