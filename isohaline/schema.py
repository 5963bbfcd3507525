"""Declared schemas and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohaline.vocabulary import CONTRACT_COLUMNS, EXPORT_COLUMNS

RAW_EXPORT = T.StructType([T.StructField(name, T.StringType()) for name in EXPORT_COLUMNS])

SELECTION = (
    "selection_id string, label string, latitude double, longitude double, region_id string, "
    "south double, north double, west double, east double, radius_km double, radius_explicit boolean, "
    "date_from date, date_to date, month int, calendar_month int, season string, query_type string, "
    "parameters array<string>, include_anomaly boolean, coordinate_precision int"
)

CLIMATOLOGY = (
    "baseline_type string, policy_version string, input_artifact_sha256 string, parameter string, "
    "selection_type string, selection_id string, grid_lat double, grid_lon double, calendar_month int, "
    "mean double, std double, n bigint, distinct_float_count bigint, year_min int, year_max int"
)


class ContractError(ValueError):
    """A table does not have the shape that its readers rely on."""


def check_observations(df: DataFrame) -> DataFrame:
    missing = sorted(set(CONTRACT_COLUMNS) - set(df.columns))
    if missing:
        raise ContractError(f"observation table lacks columns: {', '.join(missing)}")
    return df


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project to a flat schema given as DDL; absent columns become typed NULLs."""
    have = set(df.columns)
    fields = [part.split(" ", 1) for part in ddl.split(", ")]
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields])
