"""Nested profile documents -> observation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohaline.functions.measures import profile_key
from isohaline.vocabulary import ACCEPTED_MODES, CONTRACT_COLUMNS

# ``data`` is column-major; ``data_info`` holds keys, labels and [unit, mode] pairs, so its three parts
# differ in shape and are read as JSON text first.
DOCUMENT = (
    "_id string, geolocation struct<coordinates: array<double>>, timestamp string, cycle_number string, "
    "geolocation_argoqc string, data_info array<string>, data array<array<double>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line, kept as text in column ``body``."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def cap_documents(df: DataFrame, limit: int, order: str = "body") -> DataFrame:
    """A preview: at most ``limit`` documents per selection, in a declared order. Loading never goes through it."""
    rank = F.row_number().over(Window.partitionBy("selection_id").orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def _part(keys: Column, parts: Column, name: str) -> Column:
    at = F.array_position(keys, name)
    return F.when(at > 0, F.get(parts, (at - 1).cast("int")))


def flatten_documents(df: DataFrame, body: str = "body", carry=()) -> DataFrame:
    """Levels of every well-formed document, in the column contract of the observation table.

    An adjusted value counts only if its own mode is accepted. A malformed document yields no rows.
    """
    doc = F.from_json(F.col(body), DOCUMENT)
    keys = F.from_json(F.get("d.data_info", F.lit(0)), "array<string>")
    modes = F.from_json(F.get("d.data_info", F.lit(2)), "array<array<string>>")
    # Generated as one row, so that the tests for NULL below stay behind the parser: pushed through it, each would build and
    # parse the document once more.
    parsed = df.select(*carry, F.inline(F.array(F.struct(doc.alias("d"))))).withColumns({"_keys": keys, "_modes": modes})

    def column(name):
        return _part(F.col("_keys"), F.col("d.data"), name)

    def mode(name):
        return F.get(_part(F.col("_keys"), F.col("_modes"), name), F.lit(1))

    t_mode, s_mode = mode("temperature"), mode("salinity")
    row_mode = (
        F.when(t_mode.isin(*ACCEPTED_MODES), t_mode)
        .when(s_mode.isin(*ACCEPTED_MODES), s_mode)
        .otherwise(F.coalesce(F.when(t_mode != "", t_mode), s_mode, F.lit("")))
    )
    shaped = parsed.select(
        *carry,
        F.regexp_replace("d._id", "_[^_]*$", "").alias("platform_number"),
        F.col("d.cycle_number").alias("cycle_number"),
        F.col("d.timestamp").try_cast("timestamp").alias("time"),
        F.get("d.geolocation.coordinates", F.lit(1)).alias("latitude"),
        F.get("d.geolocation.coordinates", F.lit(0)).alias("longitude"),
        F.coalesce("d.geolocation_argoqc", F.lit("")).alias("position_qc"),
        row_mode.alias("data_mode"),
        F.when(t_mode.isin(*ACCEPTED_MODES), column("temperature")).alias("_t"),
        F.when(s_mode.isin(*ACCEPTED_MODES), column("salinity")).alias("_s"),
        column("temperature_argoqc").alias("_tq"),
        column("salinity_argoqc").alias("_sq"),
        column("pressure").alias("_p"),
    )
    usable = shaped.dropna(subset=["platform_number", "cycle_number", "latitude", "longitude", "time"])
    levels = usable.select("*", F.posexplode("_p").alias("_i", "pres"))

    def level(name):
        return F.get(name, F.col("_i"))

    def flag(name):
        return level(name).cast("bigint").cast("string")

    rows = levels.select(
        *carry,
        "platform_number", "cycle_number",
        profile_key(F.col("platform_number"), F.col("cycle_number")).alias("profile_id"),
        "time", "latitude", "longitude", "pres", "data_mode", "position_qc",
        level("_t").alias("temp_adjusted"), flag("_tq").alias("temp_adjusted_qc"),
        level("_s").alias("psal_adjusted"), flag("_sq").alias("psal_adjusted_qc"),
    )
    return rows.select(*carry, *CONTRACT_COLUMNS)
