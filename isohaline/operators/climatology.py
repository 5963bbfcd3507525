"""Monthly climatology tables from the observation table, and the reports about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohaline.functions.geo import cell_edge, grid_id, haversine_km, in_box
from isohaline.operators.profiles import observation_sets, profile_sets
from isohaline.operators.quality import judged_both
from isohaline.vocabulary import CLIMATOLOGY_PERIODS, CLIMATOLOGY_POLICY, REGIONS

CLIMATOLOGY_REGIONS = [r for r in REGIONS if r[7]]


def region_tags(lat, lon, regions=CLIMATOLOGY_REGIONS):
    """Ids of all boxes that hold a position (boxes overlap), as a native array expression."""
    inside = [
        F.when(in_box(lat, lon, *map(F.lit, (s, n, w, e))), F.lit(rid)) for rid, s, n, w, e, *_ in regions
    ]
    return F.array_compact(F.array(*inside))


def tag_regions(df: DataFrame, regions=CLIMATOLOGY_REGIONS) -> DataFrame:
    """One row per box that contains the position."""
    return df.withColumn("region_id", F.explode(region_tags(F.col("latitude"), F.col("longitude"), regions)))


def climatology_sets(obs: DataFrame) -> DataFrame:
    """parameter (six names), profile_id, platform, time, position, profile_value."""
    return profile_sets(observation_sets(obs), keys=("parameter",))


def build_climatology(sets: DataFrame, input_sha256: str = "", periods=CLIMATOLOGY_PERIODS) -> DataFrame:
    """Mean, sample spread, profiles, floats and year range per parameter x selection x calendar month.

    Overlapping selections and periods multiply profile rows (about 2 + regions each), never observations;
    the counts are combined on the map side before the only shuffle of this step.
    """
    lat, lon, year = F.col("latitude"), F.col("longitude"), F.year("time")
    none = F.lit(None).cast("double")

    def entry(place, la, lo):
        return F.struct(place.cast("int").alias("place"), la.alias("grid_lat"), lo.alias("grid_lon"))

    # Rows carry numbers: 0 for all, 1 for the grid, 2 and more for the regions. Names are put on the groups.
    inside = [F.when(in_box(lat, lon, *map(F.lit, r[1:5])), entry(F.lit(i), none, none)) for i, r in enumerate(CLIMATOLOGY_REGIONS, 2)]
    whole = [entry(F.lit(0), none, none), entry(F.lit(1), cell_edge(lat), cell_edge(lon))]
    kinds = F.array_compact(F.array(*[F.when(year.between(a, b), F.lit(i)) for i, (a, b) in enumerate(periods.values())]))
    flat = sets.select(
        "parameter", "platform_number", "profile_value", year.alias("year"), F.month("time").alias("calendar_month"),
        kinds.alias("kinds"), F.inline(F.array_compact(F.array(*whole, *inside))),
    ).withColumn("kind", F.explode("kinds"))
    stats = flat.groupBy("kind", "parameter", "place", "grid_lat", "grid_lon", "calendar_month").agg(
        F.avg("profile_value").alias("mean"),
        F.stddev_samp("profile_value").alias("std"),
        F.count("*").alias("n"),
        F.count_distinct("platform_number").alias("distinct_float_count"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
    )

    def named(names, number: str):
        return F.get(F.array(*map(F.lit, names)), F.col(number))

    region_id = F.get(F.array(*[F.lit(r[0]) for r in CLIMATOLOGY_REGIONS]), F.col("place") - 2)
    grid = F.when(F.col("place") == 1, grid_id(F.col("grid_lat"), F.col("grid_lon")))
    stats = stats.withColumns(
        {
            "baseline_type": named(periods, "kind"),
            "selection_type": F.when(F.col("place") == 0, "global").when(F.col("place") == 1, "grid").otherwise("region"),
            "selection_id": F.when(F.col("place") == 0, "all-available").when(F.col("place") > 1, region_id).otherwise(grid),
        }
    )
    return stats.select(
        "baseline_type",
        F.lit(CLIMATOLOGY_POLICY).alias("policy_version"),
        F.lit(input_sha256).alias("input_artifact_sha256"),
        "parameter", "selection_type", "selection_id", "grid_lat", "grid_lon", "calendar_month",
        "mean", "std", "n", "distinct_float_count", "year_min", "year_max",
    )


def quality_totals(obs: DataFrame) -> DataFrame:
    """Per parameter: raw and passed rows, pass rate, passed profiles and floats."""
    judged = judged_both(obs)
    profiles = judged.groupBy("parameter", "profile_id", "platform_number").agg(
        F.count("*").alias("raw"), F.count_if("kept").alias("passed")
    )
    ok = F.col("passed") > 0
    return profiles.groupBy("parameter").agg(
        F.sum("raw").alias("raw_observations"),
        F.sum("passed").alias("qc_passed_observations"),
        (F.sum("passed") / F.sum("raw")).alias("qc_pass_rate"),
        F.count_distinct(F.when(ok, F.col("profile_id"))).alias("qc_passed_profiles"),
        F.count_distinct(F.when(ok, F.col("platform_number"))).alias("distinct_floats"),
    )


def spread_of(column: str) -> Column:
    """Exact min, p10, median, p90 and max with linear interpolation, as one array.

    Meant for counts such as ``n`` of a climatology: few distinct values, so the counters stay small.
    """
    return F.percentile(column, F.array(*[F.lit(q) for q in (0.0, 0.1, 0.5, 0.9, 1.0)]))


def named_region_rows(climatology: DataFrame) -> DataFrame:
    ids = [r[0] for r in CLIMATOLOGY_REGIONS]
    return climatology.where(F.col("selection_id").isin(*ids)).groupBy("selection_id").agg(F.count("*").alias("n_rows"))


def climatology_audit(climatology: DataFrame) -> DataFrame:
    """One row per baseline type: row count and the distributions of n and of float counts, in one pass."""
    found = {"n": spread_of("n"), "floats": spread_of("distinct_float_count")}
    out = climatology.groupBy("baseline_type").agg(F.count("*").alias("n_rows"), *[c.alias(f"_{k}") for k, c in found.items()])
    names = ("min", "p10", "median", "p90", "max")
    return out.select("baseline_type", "n_rows", *[F.element_at(f"_{k}", i).alias(f"{k}_{name}") for k in found for i, name in enumerate(names, 1)])


# ---- Fixed values: pinned selections whose coverage is reported ---------------------------------
PINNED = [
    {"probe_id": "mumbai_50km_july_2024_temperature_profiles", "parameter": "temperature",
     "years": (2024, 2024), "month": 7, "circle": (19.0, 72.8, 50.0)},
    {"probe_id": "mumbai_50km_2015_2024_shallow_temperature_profiles", "parameter": "temperature_shallow",
     "years": (2015, 2024), "circle": (19.0, 72.8, 50.0)},
    {"probe_id": "bay_of_bengal_2023_upper_100_salinity_profiles", "parameter": "salinity_upper_100",
     "years": (2023, 2023), "box": (5.0, 22.0, 80.0, 100.0)},
]


def coverage_probe(sets: DataFrame, probes=PINNED) -> DataFrame:
    """Profiles behind each pinned selection (zero where there are none) and whether all are present.

    Profiles are unique in a set, so one pass with a conditional count per probe answers all of them.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    counts = []
    for probe in probes:
        hit = (F.col("parameter") == probe["parameter"]) & F.year("time").between(*probe["years"])
        if probe.get("month"):
            hit = hit & (F.month("time") == probe["month"])
        if "circle" in probe:
            la, lo, radius = probe["circle"]
            hit = hit & (haversine_km(F.lit(la), F.lit(lo), lat, lon) <= radius)
        else:
            hit = hit & in_box(lat, lon, *map(F.lit, probe["box"]))
        counts.append(F.count_if(hit))
    rows = F.array(*[F.struct(F.lit(p["probe_id"]).alias("probe_id"), c.alias("profiles")) for p, c in zip(probes, counts)])
    out = sets.agg(rows.alias("r"))
    present = F.forall("r", lambda e: e["profiles"] > 0)
    return out.select(F.explode("r").alias("e"), present.alias("all_pinned_selections_present")).select(
        "e.*", "all_pinned_selections_present"
    )
