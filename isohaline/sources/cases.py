"""Labelled evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohaline.functions.measures import is_finite, to_number
from isohaline.schema import ContractError
from isohaline.vocabulary import CASE_COLUMNS

_NUMBERS = [c for c in CASE_COLUMNS if c.split("_")[-1] in ("value", "mean", "std", "current")]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return type_cases(raw)


def type_cases(raw: DataFrame) -> DataFrame:
    """Exactly the fourteen columns; non-numeric and non-finite numbers become NULL."""
    if set(raw.columns) != set(CASE_COLUMNS):
        raise ContractError("case columns do not match the frozen evaluation schema")
    numbers = {c: F.when(is_finite(to_number(F.col(c))), to_number(F.col(c))) for c in _NUMBERS}
    return raw.withColumns(numbers).select(*CASE_COLUMNS)
