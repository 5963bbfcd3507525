"""Driver tables seen as observations, selections, questions and documents.

Order = profile, customer bucket = float, line = level. Everything is derived from the given tables, so the
work of every query grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEPTH = "CAST((l_linenumber - 1) * 90 AS DOUBLE) + l_quantity"
_COLUMNS = {
    "platform_number": "CAST(o_custkey % 97 AS {text})",
    "cycle_number": "CAST(o_orderkey AS {text})",
    "profile_id": "concat(CAST(o_custkey % 97 AS {text}), ':', CAST(o_orderkey AS {text}))",
    "time": "o_orderdate",
    "latitude": "5.0E0 + CAST((o_custkey * 7919) % 2200 AS DOUBLE) / 100.0E0",
    "longitude": "45.0E0 + CAST((o_custkey * 104729) % 5500 AS DOUBLE) / 100.0E0",
    "pres": _DEPTH + " - 1.0E0",
    "temp_adjusted": "CASE WHEN CAST(round(l_discount * 100) AS INT) = 10 THEN NULL ELSE 30.0E0 - 0.03E0 * ("
    + _DEPTH
    + ") + CAST(l_partkey % 200 AS DOUBLE) / 100.0E0 END",
    "temp_adjusted_qc": "CASE WHEN CAST(round(l_discount * 100) AS INT) = 1 THEN '4' ELSE '1' END",
    "psal_adjusted": "CASE WHEN CAST(round(l_tax * 100) AS INT) = 8 THEN NULL "
    "ELSE 34.0E0 + CAST(l_suppkey % 20 AS DOUBLE) / 10.0E0 END",
    "psal_adjusted_qc": "CASE WHEN CAST(round(l_tax * 100) AS INT) = 1 THEN '4' ELSE '1' END",
    "data_mode": "CASE WHEN l_returnflag = 'R' THEN 'D' WHEN l_returnflag = 'A' THEN 'A' ELSE 'R' END",
    "position_qc": "CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN '4' ELSE '1' END",
    "calendar_month": "CAST(month(o_orderdate) AS INT)",
    "year": "CAST(year(o_orderdate) AS INT)",
    "_source_file": "concat('part_', CAST(year(o_orderdate) AS {text}), '.csv')",
    "source_row": "CAST(l_partkey * 1000 + l_suppkey AS BIGINT)",
}

# A table of point and region selections, one per supplier. All choices come from the supplier key.
_REGION_PICK = (
    "CASE s_suppkey % 15 WHEN 0 THEN 'bay-of-bengal' WHEN 5 THEN 'arabian-sea' WHEN 10 THEN 'gulf-of-aden' END"
)
_SELECTION = {
    "selection_id": "concat('S', CAST(s_suppkey AS {text}))",
    "region_id": _REGION_PICK,
    "south": "CASE s_suppkey % 15 WHEN 0 THEN 5.0E0 WHEN 5 THEN 8.0E0 WHEN 10 THEN 10.0E0 END",
    "north": "CASE s_suppkey % 15 WHEN 0 THEN 22.0E0 WHEN 5 THEN 25.0E0 WHEN 10 THEN 16.0E0 END",
    "west": "CASE s_suppkey % 15 WHEN 0 THEN 80.0E0 WHEN 5 THEN 55.0E0 WHEN 10 THEN 43.0E0 END",
    "east": "CASE s_suppkey % 15 WHEN 0 THEN 100.0E0 WHEN 5 THEN 75.0E0 WHEN 10 THEN 52.0E0 END",
    "latitude": "CASE s_suppkey % 15 WHEN 0 THEN 13.5E0 WHEN 5 THEN 16.5E0 WHEN 10 THEN 13.0E0 "
    "ELSE -2.0E0 + CAST((s_suppkey * 7907) % 3200 AS DOUBLE) / 100.0E0 END",
    "longitude": "CASE s_suppkey % 15 WHEN 0 THEN 90.0E0 WHEN 5 THEN 65.0E0 WHEN 10 THEN 47.5E0 "
    "ELSE 38.0E0 + CAST((s_suppkey * 104723) % 6600 AS DOUBLE) / 100.0E0 END",
    "radius_km": "100.0E0 + CAST(s_suppkey % 7 AS DOUBLE) * 50.0E0",
    "radius_explicit": "s_suppkey % 3 = 0",
    "date_from": "CAST(concat(CAST(1995 + s_suppkey % 3 AS {text}), '-0', CAST(1 + s_suppkey % 6 AS {text}), '-15') AS DATE)",
    "date_to": "CAST(concat(CAST(1999 + s_suppkey % 3 AS {text}), '-0', CAST(2 + s_suppkey % 6 AS {text}), '-20') AS DATE)",
    "calendar_month": "CASE WHEN s_suppkey % 8 = 1 THEN CAST(s_suppkey % 12 + 1 AS INT) END",
    "season": "CASE WHEN s_suppkey % 16 = 2 THEN 'winter' WHEN s_suppkey % 16 = 10 THEN 'monsoon' END",
    "query_type": "CASE WHEN s_suppkey % 5 = 0 THEN 'regional_average' WHEN s_suppkey % 2 = 0 THEN 'time_series' ELSE 'profile' END",
    "family": "CAST(s_suppkey % 4 AS INT)",
}
SELECTION_COLUMNS = (
    "selection_id label latitude longitude region_id south north west east radius_km radius_explicit date_from date_to "
    "month calendar_month season query_type parameters include_anomaly coordinate_precision"
).split()


def _sql(columns: dict[str, str], text: str) -> list[str]:
    return [f"{expr.format(text=text)} AS {name}" for name, expr in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines are spread by order before they are joined: the shuffle a large join makes anyway, and it keeps a
    # table of one row group from being worked on by one task.
    lines, orders = table(spark, sf_dir, "lineitem").repartition("l_orderkey"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*_sql(_COLUMNS, "STRING"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").selectExpr(*_sql(_SELECTION, "STRING"))
    lit = F.lit
    parameters = (
        F.when(F.col("family") == 0, F.array(lit("temperature"), lit("salinity")))
        .when(F.col("family") == 1, F.array(lit("salinity")))
        .when(F.col("family") == 2, F.array(lit("shallow_sst_proxy")))
        .otherwise(F.array(lit("temperature")))
    )
    return base.withColumns(
        {
            "label": F.coalesce("region_id", "selection_id"),
            "month": lit(None).cast("int"),
            "parameters": parameters,
            "include_anomaly": lit(True),
            "coordinate_precision": lit(2),
        }
    ).select(*SELECTION_COLUMNS)


# -- the same in the SQL of the checker ------------------------------------------------------------
OBS = (
    "obs AS (SELECT " + ", ".join(_sql(_COLUMNS, "VARCHAR")) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
SEL = "sel AS (SELECT " + ", ".join(_sql(_SELECTION, "VARCHAR")) + " FROM supplier)"
SEL_PARAM = (
    "selp AS (SELECT sel.*, p.parameter FROM sel JOIN (VALUES (0,'temperature'),(0,'salinity'),(1,'salinity'),"
    "(2,'shallow_sst_proxy'),(3,'temperature')) p(family, parameter) ON p.family = sel.family)"
)
