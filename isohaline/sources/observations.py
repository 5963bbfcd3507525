"""Observation table and climatology tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohaline.functions.geo import cell_index, curve_block, curve_cell
from isohaline.operators.selection import search_cells
from isohaline.schema import CLIMATOLOGY, ContractError, check_observations, conform
from isohaline.vocabulary import IDENTITY_COLUMNS

_TEMPERATURE = ["temp", "temp_qc", "temp_adjusted", "temp_adjusted_qc"]
_SALINITY = ["psal", "psal_qc", "psal_adjusted", "psal_adjusted_qc"]
_PAIRED = ["temp_adjusted", "temp_adjusted_qc", "psal_adjusted", "psal_adjusted_qc"]


def columns_for(parameter: str, available) -> list[str]:
    """Identity columns, those of the asked parameter and the paired ones, as far as they exist."""
    own = {
        "temperature": _TEMPERATURE,
        "shallow_sst_proxy": _TEMPERATURE,
        "salinity": _SALINITY,
    }.get(parameter, _TEMPERATURE + _SALINITY)
    have = set(available)
    return [c for c in dict.fromkeys(IDENTITY_COLUMNS + own + _PAIRED) if c in have]


def read_observations(spark: SparkSession, path: str, parameter: str = "all") -> DataFrame:
    """Column-pruned scan; filters added by the caller are pushed into Parquet."""
    df = check_observations(spark.read.parquet(path))
    return df.select(*columns_for(parameter, df.columns))


def write_observations(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """zstd Parquet by year and block of the Z-order curve, rows in curve order inside a file, with their ``cell``.

    Tasks take equal ranges of (year, cell, hash of the profile): Spark samples the rows for the bounds, so a crowded
    piece of sea is cut into as many files as its rows need, an empty one makes none, and the rows of a profile at one
    place and time stay together. A year holds at most 276 blocks, whatever its number of rows. Rows without a position
    or year are kept, in a folder of their own.
    """
    cell = curve_cell(cell_index(F.col("latitude")), cell_index(F.col("longitude")))
    placed = df.withColumn("cell", cell).withColumn("block", curve_block(F.col("cell"))).withColumn("_profile", F.xxhash64("profile_id"))
    (
        placed.repartitionByRange("year", "cell", "_profile")
        .sortWithinPartitions("year", "block", "cell", "_profile", "profile_id", "pres")
        .drop("_profile")
        .write.option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("year", "block")
        .parquet(path)
    )


def in_searched_cells(stored: DataFrame, selections: DataFrame, widen: bool = True) -> DataFrame:
    """Rows of a store written by ``write_observations`` in the cells and years that some selection may search.

    A semi-join with the selections' years and blocks prunes the files while the job runs (dynamic partition pruning),
    a second one with their cells drops rows before any join that multiplies. Both lists are bounded by the map, not by
    the selections: at most 276 blocks a year and 16,471 cells. ``widen=False`` looks no further than each selection's
    own radius; otherwise every radius that an answer may try is covered, so the result stands for the whole table there.
    """
    cells = search_cells(selections, widen)
    cells = cells.withColumn("cell", curve_cell(F.col("_cy"), F.col("_cx"))).withColumn("block", curve_block(F.col("cell")))
    years = F.explode(F.sequence(F.year("_from"), F.year("_to"))).alias("year")
    blocks = cells.select("block", "_from", "_to").distinct().select("block", years).distinct()
    found = stored.join(F.broadcast(blocks), ["year", "block"], "left_semi")
    return found.join(F.broadcast(cells.select("cell").distinct()), "cell", "left_semi").select(*stored.columns)


def read_selected(spark: SparkSession, path: str, selections: DataFrame, parameter: str = "all", widen: bool = True) -> DataFrame:
    """Column-pruned scan of the files and rows that the selections may search (``in_searched_cells``)."""
    stored = check_observations(spark.read.parquet(path))
    found = in_searched_cells(stored, selections, widen)
    return found.select(*columns_for(parameter, found.columns))


def write_climatology(table: DataFrame, production_path: str, validation_path: str) -> None:
    """Two separate tables, so that a reader of one can never meet the other."""
    for kind, path in (("production", production_path), ("validation", validation_path)):
        part = conform(table.where(F.col("baseline_type") == kind), CLIMATOLOGY)
        part.repartition(8, "parameter", "selection_id").write.option("compression", "zstd").parquet(path)


def read_climatology(spark: SparkSession, path: str) -> DataFrame:
    """The production table; refuses any row of another kind."""
    table = spark.read.parquet(path)
    return guard_production(table)


def guard_production(table: DataFrame) -> DataFrame:
    if "baseline_type" not in table.columns:
        raise ContractError("climatology has no baseline_type")
    foreign = table.where(F.col("baseline_type").isNull() | (F.col("baseline_type") != "production"))
    if not foreign.limit(1).isEmpty():
        raise ContractError("climatology holds rows that are not production")
    return table


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
