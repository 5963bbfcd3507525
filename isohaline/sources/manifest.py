"""The manifest document: artifacts, readiness and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohaline.schema import ContractError
from isohaline.sources.exports import file_digests

MANIFEST = (
    "status string, dataset_version string, source struct<name: string>, "
    "evidence_grade_policy struct<reviewed: boolean, insufficient_valid_profile_threshold: int, "
    "baseline_min_n: int, min_distinct_floats: int, min_qc_pass_rate: double>, "
    "artifacts array<struct<path: string, kind: string, sha256: string, size_bytes: bigint, row_count: bigint>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def artifacts(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.inline("artifacts"))


def verify_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per declared artifact: present, and equal in size and digest. ``files`` come from file_digests."""
    have = files.select(F.col("name").alias("_name"), F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"))
    name = F.element_at(F.split("path", "/"), -1)
    return (
        artifacts(manifest)
        .join(have, name == F.col("_name"), "left")
        .select(
            "path", "kind",
            F.col("_name").isNotNull().alias("present"),
            F.coalesce(F.col("_size") == F.col("size_bytes"), F.lit(False)).alias("size_ok"),
            F.coalesce(F.col("_sha") == F.col("sha256"), F.lit(False)).alias("digest_ok"),
        )
    )


def single(manifest: DataFrame) -> DataFrame:
    """The manifest, refused unless it is one document: nothing could say which of several counts."""
    if len(manifest.select("status").limit(2).collect()) != 1:
        raise ContractError("a manifest is exactly one document")
    return manifest


def readiness(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row: ready flag and the reason, checked in a fixed order."""
    checked = verify_artifacts(manifest, files).agg(
        F.count("*").alias("n"),
        F.bool_and("present").alias("all_present"),
        F.bool_or(F.col("kind") == "profiles").alias("has_profiles"),
        F.bool_or(F.col("kind") == "production_baseline").alias("has_baseline"),
    )
    state = single(manifest).select("status").withColumn("_k", F.lit(1)).join(checked.withColumn("_k", F.lit(1)), "_k")
    reason = (
        F.when(F.coalesce(F.col("status"), F.lit("")) != "ready", "status is not ready")
        .when(F.col("n") == 0, "no files declared")
        .when(~F.col("all_present"), "declared files are missing")
        .when(~F.coalesce("has_profiles", F.lit(False)), "no file of profiles declared")
        .when(~F.coalesce("has_baseline", F.lit(False)), "no file of the baseline declared")
    )
    fine = "profiles and baseline are in place"
    return state.select(reason.isNull().alias("ready"), F.coalesce(reason, F.lit(fine)).alias("detail"))


def thresholds(manifest: DataFrame) -> dict:
    """Grade thresholds of the single manifest document."""
    p = single(manifest).select("evidence_grade_policy.*").first()
    return {
        "min_valid_profiles": 5 if p[1] is None else p[1],
        "min_baseline_n": p[2],
        "min_distinct_floats": p[3],
        "min_qc_pass_rate": p[4],
        "reviewed": bool(p[0]),
    }


def audit_files(spark: SparkSession, manifest: DataFrame, glob: str) -> DataFrame:
    return verify_artifacts(manifest, file_digests(spark, glob))
