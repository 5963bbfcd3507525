"""The auditable quality filter, for every selection and parameter in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohaline.functions.measures import flag_column, reject_reason, value_column
from isohaline.vocabulary import LOW_PROFILE_COUNT, REJECT_REASONS

KEYS = ("selection_id", "parameter")


def judge(rows: DataFrame, parameter: str | None = None) -> DataFrame:
    """Add value, reject_reason and kept for one parameter, or for a ``parameter`` column."""
    if parameter is not None:
        rows = rows.withColumn("parameter", F.lit(parameter))
    rows = rows.withColumn("value", value_column(F.col("parameter")).cast("double"))
    reason = reject_reason(F.col("position_qc"), F.col("data_mode"), flag_column(F.col("parameter")), F.col("value"))
    rows = rows.withColumn("reject_reason", reason)
    return rows.withColumn("kept", F.col("reject_reason").isNull())


def by_parameter(rows: DataFrame) -> DataFrame:
    """One judged row per asked parameter of the selection."""
    return judge(rows.withColumn("parameter", F.explode("parameters")).drop("parameters"))


def judged_both(obs: DataFrame) -> DataFrame:
    """Temperature and salinity of every row in one scan."""
    both = F.array(F.lit("temperature"), F.lit("salinity"))
    return judge(obs.withColumn("parameter", F.explode(both)))


def paired(rows: DataFrame) -> DataFrame:
    """Rows that pass the filter for temperature and for salinity."""
    def ok(value: str, flag: str):
        return reject_reason(F.col("position_qc"), F.col("data_mode"), F.col(flag), F.col(value)).isNull()

    return rows.where(ok("temp_adjusted", "temp_adjusted_qc") & ok("psal_adjusted", "psal_adjusted_qc"))


def reason_counts(judged: DataFrame, keys=KEYS) -> DataFrame:
    """Rows under each reason that occurs."""
    return judged.where(~F.col("kept")).groupBy(*keys, "reject_reason").agg(F.count("*").alias("n_rows"))


def quality_audit(facts: DataFrame, keys=KEYS) -> DataFrame:
    """Row, profile and float counts, pass rate, reason map and low-data warning, from profile facts.

    Profiles are unique in ``facts``, so only the float count needs a distinct aggregate.
    """
    sums = [F.sum(f"n_{r}").alias(f"n_{r}") for r in REJECT_REASONS]
    totals = facts.groupBy(*keys).agg(
        F.sum("raw_rows").alias("raw_count"),
        F.sum("valid_rows").alias("valid_count"),
        F.count("*").alias("raw_profile_count"),
        F.count_if(F.col("valid_rows") > 0).alias("valid_profile_count"),
        F.count_distinct("platform_number").alias("distinct_float_count"),
        *sums,
    )
    return audit_of(totals, keys)


def audit_of(totals: DataFrame, keys=KEYS) -> DataFrame:
    """The audit from its totals."""
    entries = F.array(*[F.struct(F.lit(r).alias("key"), F.col(f"n_{r}").alias("value")) for r in REJECT_REASONS])
    return totals.select(
        *keys,
        "raw_count",
        "valid_count",
        (F.col("raw_count") - F.col("valid_count")).alias("excluded_count"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0)).alias("exclusion_reasons"),
        F.try_divide("valid_count", "raw_count").alias("qc_pass_rate"),
        "raw_profile_count",
        "valid_profile_count",
        (F.col("raw_profile_count") - F.col("valid_profile_count")).alias("excluded_profile_count"),
        "distinct_float_count",
        (F.col("valid_profile_count") < LOW_PROFILE_COUNT).alias("data_quality_warning"),
    )


def excluded_profiles(facts: DataFrame, keys=KEYS) -> DataFrame:
    """Profiles with rows of which none was kept."""
    return facts.where(F.col("valid_rows") == 0).select(*keys, "profile_id", "raw_rows")
