"""Raw text exports -> clean, de-duplicated observation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohaline.functions.geo import wrap_longitude
from isohaline.functions.measures import clean_text, mode_rank, profile_key, to_number, to_utc
from isohaline.vocabulary import (
    DERIVED_COLUMNS,
    EXPORT_COLUMNS,
    MANDATORY_COLUMNS,
    MEASURE_COLUMNS,
    TEXT_COLUMNS,
)


def drop_repeated_headers(raw: DataFrame) -> DataFrame:
    return raw.where(F.coalesce(F.col("platform_number") != "platform_number", F.lit(True)))


def clean_rows(raw: DataFrame) -> DataFrame:
    """Typed and trimmed rows that have all mandatory columns, with profile key and calendar parts.

    The mandatory columns are generated as one row. So their test for NULL stays behind the typing, which is done once, and the
    code that Spark generates falls into methods small enough for the JVM to compile.
    """
    typed = {
        **{c: clean_text(F.col(c)) for c in TEXT_COLUMNS},
        **{c: to_number(F.col(c)) for c in MEASURE_COLUMNS if c != "longitude"},
        "longitude": wrap_longitude(to_number(F.col("longitude"))),
        "time": to_utc(F.col("time")),
    }
    rest = [c for c in raw.columns if c not in MANDATORY_COLUMNS]
    must = F.struct(*[typed[c].alias(c) for c in MANDATORY_COLUMNS])
    rows = drop_repeated_headers(raw).select(*rest, F.inline(F.array(must)))
    keyed = rows.na.drop(subset=MANDATORY_COLUMNS).withColumns(
        {
            **{c: e for c, e in typed.items() if c not in MANDATORY_COLUMNS},
            "profile_id": profile_key(F.col("platform_number"), F.col("cycle_number")),
            "calendar_month": F.month("time"),
            "year": F.year("time"),
        }
    )
    return keyed.select(*EXPORT_COLUMNS, *DERIVED_COLUMNS)


def dedup_levels(df: DataFrame, scope: str = "file") -> DataFrame:
    """One row per (file, profile, pressure): best data mode, then lowest source row.

    ``scope="global"`` de-duplicates across files. The rank-1 filter is pushed below the shuffle, so a level
    with very many copies sends one row per task.
    """
    keys = (["_source_file"] if scope == "file" else []) + ["profile_id", "pres"]
    order = [mode_rank(F.col("data_mode")), F.col("source_row")]
    if scope != "file":
        order.append(F.col("_source_file"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", best).where(F.col("_rank") == 1).drop("_rank")


def shallowest_row(judged: DataFrame, keys=("selection_id", "parameter")) -> DataFrame:
    """The kept 0-10 dbar row nearest the surface of each profile."""
    order = Window.partitionBy(*keys, "profile_id").orderBy("pres", "source_row")
    rows = judged.where(F.col("kept") & F.col("pres").between(0, 10))
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def coverage(clean: DataFrame, keys=()) -> DataFrame:
    """Rows, extent in space and time, profiles and floats.

    Profiles are collapsed first, so the distinct counts run over profiles instead of observations.
    """
    profiles = clean.groupBy(*keys, "profile_id", "platform_number").agg(
        F.count("*").alias("_n"),
        F.min("latitude").alias("_s"), F.max("latitude").alias("_nn"),
        F.min("longitude").alias("_w"), F.max("longitude").alias("_e"),
        F.min("time").alias("_t0"), F.max("time").alias("_t1"),
    )
    return profiles.groupBy(*keys).agg(
        F.sum("_n").alias("processed_rows"),
        F.min("_s").alias("latitude_min"),
        F.max("_nn").alias("latitude_max"),
        F.min("_w").alias("longitude_min"),
        F.max("_e").alias("longitude_max"),
        F.min("_t0").alias("date_min"),
        F.max("_t1").alias("date_max"),
        F.count_distinct("profile_id").alias("total_profiles"),
        F.count_distinct("platform_number").alias("total_floats"),
    )
