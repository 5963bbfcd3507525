"""Selection of rows, quality filter and profile statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.fixture import OBS, SEL, observations, selections, table
from catalog.sqlparts import BATCH, BATCH_FACTS, BIN, DIST, LONG, ROWS, WHEN, box, dist, facts, with_
from isohaline.operators import ingest, levels, lineage, pools, profiles, quality, selection
from isohaline.operators.climatology import tag_regions
from isohaline.operators.quality import judged_both
from isohaline.session import written
from isohaline.vocabulary import TRACE_LIMIT


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


def selected(spark, sf_dir) -> DataFrame:
    return selection.select_observations(observations(spark, sf_dir), selections(spark, sf_dir))


def judged(spark, sf_dir) -> DataFrame:
    return quality.by_parameter(selected(spark, sf_dir))


def batch_facts(spark, sf_dir) -> DataFrame:
    return profiles.selected_facts(observations(spark, sf_dir), selections(spark, sf_dir))


def batch_pools(spark, sf_dir, *also) -> pools.Pools:
    return pools.pooled(observations(spark, sf_dir), selections(spark, sf_dir), *also)


# -- one literal selection --------------------------------------------------------------------------
def box_select(spark, sf_dir):
    rows = selection.box_select(observations(spark, sf_dir), 8.0, 25.0, 55.0, 75.0, "1996-01-01", "1998-12-31")
    return rows.select("profile_id", "source_row", "pres", r6("latitude"), r6("longitude"))


def radius_select(spark, sf_dir):
    rows = selection.radius_select(observations(spark, sf_dir), 15.0, 70.0, 300.0, "1995-01-01", "2001-12-31")
    return rows.select("profile_id", "source_row", "pres", r6("distance_km"))


def recurring_month(spark, sf_dir):
    rows = selection.recurring_select(observations(spark, sf_dir), calendar_month=7)
    return rows.groupBy("year").agg(F.count("*").alias("n_rows"), F.count_distinct("profile_id").alias("n_profiles"))


def recurring_season(spark, sf_dir):
    rows = selection.recurring_select(observations(spark, sf_dir), season="winter")
    return rows.groupBy("year", "calendar_month").agg(F.count("*").alias("n_rows"))


# -- tables of selections ---------------------------------------------------------------------------
def select_batch(spark, sf_dir):
    """Point and region selections of the whole table, row by row."""
    packs, members = selection.select_packed(observations(spark, sf_dir), selections(spark, sf_dir), ("source_row", "pres"))
    return selection.unpacked(packs.withColumn("distance_km", r6("distance_km")), members)


def select_batch_shuffled(spark, sf_dir):
    """The same join on the way taken when the selections are too many to broadcast."""
    rows = pools.row_sums(observations(spark, sf_dir), selections(spark, sf_dir), max_broadcast_rows=0, distances=True)
    return rows.select("selection_id", "n_rows", F.round("sum_km", 3).alias("sum_km"), "sum_row")


def qc_reasons(spark, sf_dir):
    return pools.reason_counts(batch_pools(spark, sf_dir))


def qc_audit(spark, sf_dir):
    out = pools.quality_audit(batch_pools(spark, sf_dir))
    reasons = F.concat_ws(
        ";", F.transform(F.array_sort(F.map_entries("exclusion_reasons")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    )
    return out.withColumns({"exclusion_reasons": reasons, "qc_pass_rate": F.round("qc_pass_rate", 6)})


def qc_excluded_profiles(spark, sf_dir):
    return profiles.excluded_profiles(observations(spark, sf_dir), selections(spark, sf_dir))


def paired_rows(spark, sf_dir):
    rows = quality.paired(observations(spark, sf_dir))
    return rows.groupBy("platform_number").agg(F.count("*").alias("n_rows"), F.count_distinct("profile_id").alias("n_profiles"))


def _global_facts(spark, sf_dir):
    return profiles.observation_sets(observations(spark, sf_dir))


def _profile_set(name):
    def query(spark, sf_dir):
        out = profiles.profile_set(_global_facts(spark, sf_dir), name, ("parameter",))
        return out.select(
            "parameter", "profile_id", "platform_number", r6("latitude"), r6("longitude"),
            F.date_format("time", "yyyy-MM-dd").alias("day"), r6("profile_value"),
        )

    query.__doc__ = f"Profile values of the {name} set."
    return query


def shallowest_rows(spark, sf_dir):
    rows = ingest.shallowest_row(judged_both(observations(spark, sf_dir)), ("parameter",))
    return rows.select("parameter", "profile_id", "pres", "source_row", r6("value"))


def region_tags(spark, sf_dir):
    return tag_regions(observations(spark, sf_dir)).groupBy("region_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct("profile_id").alias("n_profiles")
    )


# -- radius decisions -------------------------------------------------------------------------------
def _resolved(spark, sf_dir):
    return selection.resolve_radii(observations(spark, sf_dir), selections(spark, sf_dir))


def radius_expand(spark, sf_dir):
    return _resolved(spark, sf_dir).select(
        "selection_id", "requested_radius_km", "actual_radius_km", "radius_expanded", "matched"
    )


def no_data_probe(spark, sf_dir):
    out = selection.no_data_probe(_resolved(spark, sf_dir))
    return out.withColumn("nearest_available_km", F.round("nearest_available_km", 6))


def nearest_obs(spark, sf_dir):
    near = pools.nearest(batch_pools(spark, sf_dir))
    return near.withColumn("nearest_observation_km", F.round("nearest_observation_km", 6))


def selection_violations(spark, sf_dir):
    """Broken rules of records made from the events table, which breaks every rule somewhere."""
    e = F.col("event_id")
    records = table(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), (e - F.when(e % 29 == 1, 1).otherwise(0)).cast("string")).alias("selection_id"),
        (e % 9 - 2).cast("int").alias("coordinate_precision"),
        F.when(e % 11 != 0, (e % 200 - 95).cast("double")).alias("latitude"),
        F.when((e % 11 != 0) & (e % 13 != 0), (e % 400 - 190).cast("double")).alias("longitude"),
        F.when(e % 6 == 0, "arabian-sea").alias("region_id"),
        F.when(e % 4 == 0, 8.0).alias("south"),
        F.when(e % 4 == 0, F.when(e % 8 == 0, 5.0).otherwise(25.0)).alias("north"),
        F.when(e % 4 == 0, 55.0).alias("west"),
        F.when(e % 4 == 0, F.when(e % 12 == 0, 185.0).otherwise(75.0)).alias("east"),
        (F.col("value") * 30.0).alias("radius_km"),
        F.when(e % 17 != 0, F.to_date(F.lit("2010-01-01"))).alias("date_from"),
        F.when(e % 5 == 0, F.to_date(F.lit("2009-01-01"))).otherwise(F.to_date(F.lit("2012-01-01"))).alias("date_to"),
        F.when(e % 7 == 0, (e % 14).cast("int")).alias("month"),
        F.when(e % 3 == 0, (e % 12 + 1).cast("int")).alias("calendar_month"),
        F.when(e % 9 == 0, F.when(e % 2 == 0, "monsoon").otherwise("spring")).alias("season"),
        F.when(e % 10 == 0, "pie_chart").otherwise("profile").alias("query_type"),
        F.when(e % 19 == 0, F.array(F.lit("oxygen"))).otherwise(F.array(F.lit("salinity"))).alias("parameters"),
    )
    out = selection.selection_violations(records)
    return out.select("selection_id", F.concat_ws(",", "violations").alias("violations"))


def float_positions(spark, sf_dir):
    out = pools.float_positions(batch_pools(spark, sf_dir))
    return out.select("selection_id", "parameter", "platform_number", r6("latitude"), r6("longitude"), "profile_count")


def over_levels(view, spark, sf_dir, *also) -> DataFrame:
    """A view over level arrays; selections that ask for the same rows (and agree in ``also``) meet the profiles once."""
    unique, members = selection.alike(selections(spark, sf_dir), *also)
    return selection.for_members(view(levels.selected_levels(observations(spark, sf_dir), unique)), members)


def trace_rows(spark, sf_dir):
    """Every source row behind every asked view, with its bin and month."""
    unique, members = selection.alike(selections(spark, sf_dir), "query_type")
    return levels.traced_rows(levels.selected_levels(observations(spark, sf_dir), written(unique, "selections")), members)


def trace_bins(spark, sf_dir):
    return pools.trace_counts(batch_pools(spark, sf_dir, "query_type"), "bin_no")


def trace_months(spark, sf_dir):
    return pools.trace_counts(batch_pools(spark, sf_dir, "query_type"), "month")


def trace(spark, sf_dir):
    """The sample that an evidence panel shows: first 25 of each list."""
    out = over_levels(lambda lv: levels.trace(lv, TRACE_LIMIT), spark, sf_dir, "query_type")
    lists = {c: F.concat_ws(",", c) for c in ("profile_ids", "float_ids", "source_records")}
    return out.withColumns(lists)


def light_trace(spark, sf_dir):
    return pools.light_trace(batch_pools(spark, sf_dir))


QUERIES = {
    "box_select": box_select,
    "radius_select": radius_select,
    "recurring_month": recurring_month,
    "recurring_season": recurring_season,
    "select_batch": select_batch,
    "select_batch_shuffled": select_batch_shuffled,
    "qc_reasons": qc_reasons,
    "qc_audit": qc_audit,
    "qc_excluded_profiles": qc_excluded_profiles,
    "paired_rows": paired_rows,
    "profile_medians": _profile_set("full"),
    "profile_upper100": _profile_set("upper_100"),
    "profile_shallow": _profile_set("shallow"),
    "shallowest_rows": shallowest_rows,
    "region_tags": region_tags,
    "radius_expand": radius_expand,
    "no_data_probe": no_data_probe,
    "nearest_obs": nearest_obs,
    "selection_violations": selection_violations,
    "float_positions": float_positions,
    "trace": trace,
    "trace_rows": trace_rows,
    "trace_bins": trace_bins,
    "trace_months": trace_months,
    "light_trace": light_trace,
}

_SETROWS = (
    "SELECT parameter, profile_id, platform_number, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, "
    "strftime(time, '%Y-%m-%d') AS day, round({c}, 6) AS profile_value FROM facts WHERE {c} IS NOT NULL"
)
_PAIR_OK = (
    "position_qc = '1' AND data_mode IN ('A','D') AND temp_adjusted_qc = '1' AND psal_adjusted_qc = '1' "
    "AND temp_adjusted IS NOT NULL AND psal_adjusted IS NOT NULL"
)
# Tiers and probe, tested one radius at a time.
_PROBE_R = "least(2000.0, greatest(500.0, s.radius_km * 1.5, s.radius_km + 250.0))"


def _tier(radius: str, extra: str = "TRUE") -> str:
    return (
        f"SELECT s.selection_id, {radius} AS tier, {DIST} AS km FROM obs o JOIN sel s ON {WHEN} AND {box(radius)} "
        f"WHERE s.region_id IS NULL AND {extra} AND {DIST} <= {radius}"
    )


_RESOLVE = (
    "tiers AS (SELECT selection_id, min(tier) AS tier FROM ("
    + " UNION ALL ".join(
        [_tier("s.radius_km")]
        + [_tier(f"{t}", f"NOT s.radius_explicit AND {t} > s.radius_km") for t in ("500.0", "750.0")]
    )
    + ") GROUP BY selection_id), near AS (SELECT selection_id, min(km) AS km FROM ("
    + _tier(_PROBE_R, f"{_PROBE_R} > s.radius_km")
    + ") GROUP BY selection_id)"
)
_VIOLATIONS = [
    ("coordinates_incomplete", "(lat IS NULL) <> (lon IS NULL)"),
    ("coordinates_missing", "lat IS NULL AND lon IS NULL"),
    ("coordinates_out_of_range", "coalesce(lat < -90 OR lat > 90, FALSE) OR coalesce(lon < -180 OR lon > 180, FALSE)"),
    ("region_without_bounds", "e % 6 = 0 AND e % 4 <> 0"),
    ("point_with_bounds", "e % 6 <> 0 AND e % 4 = 0"),
    ("bounds_inverted", "e % 8 = 0"),
    ("bounds_out_of_range", "e % 12 = 0"),
    ("precision_out_of_range", "e % 9 - 2 < 0 OR e % 9 - 2 > 4"),
    ("duplicate_id", "e % 29 = 1 AND e - 1 IN (SELECT event_id FROM events) OR e % 29 = 0 AND e + 1 IN (SELECT event_id FROM events)"),
    ("radius_out_of_range", "value * 30.0 < 1 OR value * 30.0 > 2000"),
    ("dates_inverted", "e % 17 <> 0 AND e % 5 = 0"),
    ("dates_missing", "e % 17 = 0"),
    ("month_out_of_range", "e % 7 = 0 AND (e % 14 < 1 OR e % 14 > 12)"),
    ("month_and_season", "e % 9 = 0"),
    ("month_and_calendar_month", "e % 21 = 0"),
    ("unknown_season", "e % 9 = 0 AND e % 2 <> 0"),
    ("unknown_view", "e % 10 = 0"),
    ("unknown_parameter", "e % 19 = 0"),
]


# Which rows stand behind a view: 0-100 dbar for a regional average, all kept rows otherwise, unless the view has no value.
TRACED = (
    "traced AS (SELECT j.selection_id, j.parameter, s.query_type AS view, j.profile_id, j.platform_number, "
    "CASE WHEN (s.query_type = 'regional_average' AND f.upper_100_value IS NOT NULL) OR (s.query_type = 'time_series' AND "
    "CASE WHEN j.parameter = 'shallow_sst_proxy' THEN f.shallow_value ELSE f.full_value END IS NOT NULL) THEN strftime(f.time, '%Y-%m') END AS month, "
    f"CASE WHEN s.query_type = 'profile' AND j.pres BETWEEN 0 AND 500 THEN CAST({BIN} AS INT) END AS bin_no, j._source_file, j.source_row "
    "FROM judged j JOIN sel s ON s.selection_id = j.selection_id "
    "JOIN facts f ON f.selection_id = j.selection_id AND f.parameter = j.parameter AND f.profile_id = j.profile_id "
    "JOIN (SELECT selection_id, parameter, sum(rows_0_500) AS u, count(shallow_value) AS sh FROM facts GROUP BY ALL) g "
    "ON g.selection_id = j.selection_id AND g.parameter = j.parameter WHERE j.reason IS NULL AND CASE s.query_type "
    "WHEN 'regional_average' THEN j.pres BETWEEN 0 AND 100 WHEN 'profile' THEN g.u > 0 ELSE j.parameter <> 'shallow_sst_proxy' OR g.sh > 0 END)"
)


def _firsts(name: str, source: str, order: str, shown: str) -> str:
    return (
        f"{name} AS (SELECT selection_id, parameter, string_agg(shown, ',' ORDER BY rk) FILTER (rk <= 25) AS {name}, max(rk) > 25 AS more "
        f"FROM (SELECT selection_id, parameter, {shown} AS shown, row_number() OVER (PARTITION BY selection_id, parameter ORDER BY {order}) AS rk "
        f"FROM (SELECT DISTINCT selection_id, parameter, {order} FROM {source})) GROUP BY selection_id, parameter)"
    )


ORACLES = {
    "box_select": with_(OBS)
    + "SELECT profile_id, source_row, pres, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM obs "
    "WHERE latitude BETWEEN 8 AND 25 AND longitude BETWEEN 55 AND 75 AND time >= DATE '1996-01-01' AND time < DATE '1999-01-01'",
    "radius_select": with_(OBS)
    + "SELECT profile_id, source_row, pres, round(km, 6) AS distance_km FROM (SELECT *, "
    + dist("15.0", "70.0", "latitude", "longitude")
    + " AS km FROM obs WHERE abs(latitude - 15.0) <= 300.0 / 110.574 AND abs(longitude - 70.0) <= 300.0 / (111.320 * cos(radians(15.0)))) "
    "WHERE km <= 300.0",
    "recurring_month": with_(OBS)
    + "SELECT year, count(*) AS n_rows, count(DISTINCT profile_id) AS n_profiles FROM obs WHERE month(time) = 7 GROUP BY year",
    "recurring_season": with_(OBS)
    + "SELECT year, calendar_month, count(*) AS n_rows FROM obs WHERE month(time) IN (12, 1, 2) GROUP BY ALL",
    "select_batch": with_(OBS, SEL, ROWS)
    + "SELECT selection_id, profile_id, source_row, pres, round(distance_km, 6) AS distance_km FROM hit",
    "select_batch_shuffled": with_(OBS, SEL, ROWS)
    + "SELECT selection_id, count(*) AS n_rows, round(sum(distance_km), 3) AS sum_km, CAST(sum(source_row) AS BIGINT) AS sum_row "
    "FROM hit GROUP BY selection_id",
    "qc_reasons": with_(BATCH)
    + "SELECT selection_id, parameter, reason AS reject_reason, count(*) AS n_rows FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "qc_audit": with_(
        BATCH,
        "r AS (SELECT selection_id, parameter, string_agg(reason || '=' || n, ';' ORDER BY reason) AS reasons FROM "
        "(SELECT selection_id, parameter, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY ALL)",
    )
    + "SELECT j.selection_id, j.parameter, count(*) AS raw_count, count(*) FILTER (reason IS NULL) AS valid_count, "
    "count(*) FILTER (reason IS NOT NULL) AS excluded_count, coalesce(any_value(r.reasons), '') AS exclusion_reasons, "
    "round(count(*) FILTER (reason IS NULL) / count(*), 6) AS qc_pass_rate, count(DISTINCT profile_id) AS raw_profile_count, "
    "count(DISTINCT profile_id) FILTER (reason IS NULL) AS valid_profile_count, "
    "count(DISTINCT profile_id) - count(DISTINCT profile_id) FILTER (reason IS NULL) AS excluded_profile_count, "
    "count(DISTINCT platform_number) FILTER (reason IS NULL) AS distinct_float_count, "
    "count(DISTINCT profile_id) FILTER (reason IS NULL) < 5 AS data_quality_warning "
    "FROM judged j LEFT JOIN r ON r.selection_id = j.selection_id AND r.parameter = j.parameter GROUP BY j.selection_id, j.parameter",
    "qc_excluded_profiles": with_(BATCH)
    + "SELECT selection_id, parameter, profile_id, count(*) AS raw_rows FROM judged GROUP BY ALL HAVING count(*) FILTER (reason IS NULL) = 0",
    "paired_rows": with_(OBS)
    + f"SELECT platform_number, count(*) AS n_rows, count(DISTINCT profile_id) AS n_profiles FROM obs WHERE {_PAIR_OK} GROUP BY 1",
    "profile_medians": with_(LONG, facts("parameter")) + _SETROWS.format(c="full_value"),
    "profile_upper100": with_(LONG, facts("parameter")) + _SETROWS.format(c="upper_100_value"),
    "profile_shallow": with_(LONG, facts("parameter")) + _SETROWS.format(c="shallow_value"),
    "shallowest_rows": with_(LONG)
    + "SELECT parameter, profile_id, pres, source_row, round(value, 6) AS value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY parameter, profile_id ORDER BY pres, source_row) AS rk FROM judged WHERE reason IS NULL AND pres BETWEEN 0 AND 10) WHERE rk = 1",
    "region_tags": with_(OBS)
    + "SELECT r.id AS region_id, count(*) AS n_rows, count(DISTINCT profile_id) AS n_profiles FROM obs JOIN (VALUES ('bay-of-bengal', 5, 22, 80, 100), "
    "('arabian-sea', 8, 25, 55, 75), ('lakshadweep-sea', 7, 15, 70, 77), ('andaman-sea', 6, 15, 92, 100), ('equatorial-indian', -10, 10, 40, 100)) "
    "r(id, s, n, w, e) ON latitude BETWEEN r.s AND r.n AND longitude BETWEEN r.w AND r.e GROUP BY 1",
    "radius_expand": with_(OBS, SEL, _RESOLVE)
    + "SELECT s.selection_id, CASE WHEN s.region_id IS NULL THEN s.radius_km END AS requested_radius_km, "
    "CASE WHEN s.region_id IS NULL THEN coalesce(t.tier, s.radius_km) END AS actual_radius_km, "
    "s.region_id IS NULL AND coalesce(t.tier > s.radius_km, FALSE) AS radius_expanded, "
    "CASE WHEN s.region_id IS NULL THEN t.tier IS NOT NULL END AS matched FROM sel s LEFT JOIN tiers t ON t.selection_id = s.selection_id",
    "no_data_probe": with_(OBS, SEL, _RESOLVE)
    + f"SELECT s.selection_id, s.radius_km AS requested_radius_km, {_PROBE_R} AS probe_radius_km, round(n.km, 6) AS nearest_available_km, "
    "least(2000.0, ceil((n.km + 25.0) / 50.0) * 50.0) + CASE WHEN n.km IS NULL THEN NULL ELSE 0 END AS suggested_radius_km FROM sel s "
    "LEFT JOIN near n ON n.selection_id = s.selection_id WHERE s.region_id IS NULL AND s.selection_id NOT IN (SELECT selection_id FROM tiers)",
    "nearest_obs": with_(BATCH)
    + "SELECT selection_id, parameter, round(min(distance_km) FILTER (reason IS NULL), 6) AS nearest_observation_km FROM judged GROUP BY ALL",
    "selection_violations": "WITH ev AS (SELECT event_id AS e, value, CASE WHEN event_id % 11 <> 0 THEN event_id % 200 - 95 END AS lat, "
    "CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN event_id % 400 - 190 END AS lon FROM events) "
    "SELECT 'E' || (e - CASE WHEN e % 29 = 1 THEN 1 ELSE 0 END) AS selection_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _VIOLATIONS)
    + ") AS violations FROM ev",
    "float_positions": with_(BATCH)
    + "SELECT selection_id, parameter, platform_number, round(lat, 6) AS latitude, round(lon, 6) AS longitude, profile_count FROM "
    "(SELECT *, row_number() OVER (PARTITION BY selection_id, parameter ORDER BY profile_count DESC, platform_number) AS rk FROM "
    "(SELECT selection_id, parameter, platform_number, median(latitude) AS lat, median(longitude) AS lon, "
    "count(DISTINCT profile_id) AS profile_count FROM judged WHERE reason IS NULL GROUP BY ALL))",
    "trace_rows": with_(BATCH_FACTS, TRACED) + "SELECT * FROM traced",
    "trace_bins": with_(BATCH_FACTS, TRACED)
    + "SELECT selection_id, parameter, bin_no, count(*) AS observation_count, count(DISTINCT profile_id) AS profile_count, "
    "count(DISTINCT platform_number) AS float_count FROM traced WHERE bin_no IS NOT NULL GROUP BY ALL",
    "trace_months": with_(BATCH_FACTS, TRACED)
    + "SELECT selection_id, parameter, month, count(*) AS observation_count, count(DISTINCT profile_id) AS profile_count, "
    "count(DISTINCT platform_number) AS float_count FROM traced WHERE month IS NOT NULL GROUP BY ALL",
    "trace": with_(
        BATCH_FACTS,
        TRACED,
        "k AS (SELECT * FROM traced)",
        _firsts("profile_ids", "k", "profile_id", "profile_id"),
        _firsts("float_ids", "k", "platform_number", "platform_number"),
        _firsts("source_records", "k", "_source_file, source_row", "_source_file || ':' || source_row"),
    )
    + "SELECT c.*, p.profile_ids, f.float_ids, s.source_records, p.more OR f.more OR s.more AS truncated FROM "
    "(SELECT selection_id, parameter, count(*) AS observation_count, count(DISTINCT profile_id) AS profile_count, "
    "count(DISTINCT platform_number) AS float_count FROM k GROUP BY ALL) c JOIN profile_ids p USING (selection_id, parameter) "
    "JOIN float_ids f USING (selection_id, parameter) JOIN source_records s USING (selection_id, parameter)",
    "light_trace": with_(BATCH)
    + "SELECT selection_id, parameter, count(*) AS observation_count, count(DISTINCT profile_id) AS profile_count, "
    "count(DISTINCT platform_number) AS float_count FROM judged WHERE reason IS NULL GROUP BY ALL",
}
