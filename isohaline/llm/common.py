"""Helpers that several text operators share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a longest run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def travels(module: str) -> None:
    """Send the module's functions to the executors with the task, so that the package need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text, so it falls into fold 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def partitions_of(df: DataFrame) -> int:
    """Partitions for a keyed repartition that follows the session, never under 4 a core slot."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4)
