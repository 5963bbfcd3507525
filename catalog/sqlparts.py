"""Common table expressions of the checking SQL."""

from __future__ import annotations

from catalog.fixture import OBS, SEL, SEL_PARAM

REASON = (
    "CASE WHEN position_qc <> '1' THEN 'position_qc_not_1' WHEN data_mode NOT IN ('A','D') THEN 'real_time_mode_excluded' "
    "WHEN flag <> '1' THEN 'adjusted_qc_not_1' WHEN value IS NULL THEN 'null_adjusted_value' END"
)
VALUE = "CASE WHEN parameter = 'salinity' THEN psal_adjusted ELSE temp_adjusted END"
FLAG = "CASE WHEN parameter = 'salinity' THEN psal_adjusted_qc ELSE temp_adjusted_qc END"
BIN = (
    "CASE WHEN pres < 0 OR pres > 500 THEN NULL WHEN pres < 10 THEN 1 WHEN pres < 25 THEN 2 WHEN pres < 50 THEN 3 "
    "WHEN pres < 100 THEN 4 WHEN pres < 200 THEN 5 WHEN pres < 300 THEN 6 ELSE 7 END"
)
LABEL = "['0–10','10–25','25–50','50–100','100–200','200–300','300–500'][bin_no]"
MID = "[5.0,17.5,37.5,75.0,150.0,250.0,400.0][bin_no]"


def dist(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2), 0.0), 1.0))))"
    )


DIST = dist("s.latitude", "s.longitude", "o.latitude", "o.longitude")


def box(radius: str) -> str:
    half = f"({radius} / (111.320 * greatest(abs(cos(radians(s.latitude))), 0.2)))"
    return (
        f"o.latitude BETWEEN s.latitude - {radius} / 110.574 AND s.latitude + {radius} / 110.574 "
        f"AND o.longitude BETWEEN s.longitude - {half} AND s.longitude + {half}"
    )


WHEN = (
    "o.time >= s.date_from AND o.time < s.date_to + INTERVAL 1 DAY "
    "AND (s.calendar_month IS NULL OR o.calendar_month = s.calendar_month) "
    "AND (s.season IS NULL OR (s.season = 'winter' AND o.calendar_month IN (12, 1, 2)) "
    "OR (s.season = 'monsoon' AND o.calendar_month IN (6, 7, 8, 9)))"
)
REGION = "o.latitude BETWEEN s.south AND s.north AND o.longitude BETWEEN s.west AND s.east"


def hits(name: str, radius: str, table: str = "sel") -> str:
    """Rows of every selection at a given radius expression."""
    return (
        f"{name} AS (SELECT s.selection_id, o.*, CASE WHEN s.region_id IS NULL THEN {DIST} END AS distance_km "
        f"FROM obs o JOIN {table} s ON {WHEN} WHERE (s.region_id IS NOT NULL AND {REGION}) "
        f"OR (s.region_id IS NULL AND {box(radius)} AND {DIST} <= {radius}))"
    )


ROWS = hits("hit", "s.radius_km")
JUDGED = (
    f"val AS (SELECT h.*, p.parameter, {VALUE} AS value, {FLAG} AS flag FROM hit h JOIN (SELECT selection_id, parameter FROM selp) p "
    f"ON p.selection_id = h.selection_id), judged AS (SELECT *, {REASON} AS reason FROM val)"
)


def facts(keys: str, source: str = "judged", name: str = "facts") -> str:
    """Profile statistics, straight from the definition."""
    bins = ", ".join(f"median(value) FILTER (reason IS NULL AND ({BIN}) = {i}) AS bin_{i}" for i in range(1, 8))
    return (
        f"{name} AS (SELECT {keys}, profile_id, count(*) AS raw_rows, count(*) FILTER (reason IS NULL) AS valid_rows, "
        "count(*) FILTER (reason IS NULL AND pres BETWEEN 0 AND 500) AS rows_0_500, "
        "min(platform_number) FILTER (reason IS NULL) AS platform_number, min(time) AS time, min(latitude) AS latitude, "
        "min(longitude) AS longitude, median(value) FILTER (reason IS NULL) AS full_value, "
        "median(value) FILTER (reason IS NULL AND pres BETWEEN 0 AND 100) AS upper_100_value, "
        "arg_min(value, pres * 1e12 + source_row) FILTER (reason IS NULL AND pres BETWEEN 0 AND 10) AS shallow_value, "
        f"{bins} FROM {source} GROUP BY {keys}, profile_id)"
    )


BATCH = ", ".join([OBS, SEL, SEL_PARAM, ROWS, JUDGED])
BATCH_FACTS = BATCH + ", " + facts("selection_id, parameter")


def long_form(p: str = "") -> str:
    """Both parameters of every observation; ``p`` prefixes the names of the tables."""
    return (
        f"{p}val AS (SELECT obs.*, p.parameter, {VALUE} AS value, {FLAG} AS flag FROM obs, "
        f"(VALUES ('temperature'), ('salinity')) p(parameter)), {p}judged AS (SELECT *, {REASON} AS reason FROM {p}val)"
    )


def profile_sets(p: str = "") -> str:
    one = (
        "SELECT parameter || '{suffix}' AS parameter, profile_id, platform_number, time, latitude, longitude, {c} AS profile_value "
        "FROM {p}facts WHERE {c} IS NOT NULL"
    )
    parts = [("", "full_value"), ("_shallow", "shallow_value"), ("_upper_100", "upper_100_value")]
    union = " UNION ALL ".join(one.format(suffix=x, c=c, p=p) for x, c in parts)
    return ", ".join([long_form(p), facts("parameter", f"{p}judged", f"{p}facts"), f"sets AS ({union})"])


LONG = f"{OBS}, {long_form()}"
SETS = f"{OBS}, {profile_sets()}"
_REGIONS = (
    "(VALUES ('bay-of-bengal', 5, 22, 80, 100), ('arabian-sea', 8, 25, 55, 75), ('lakshadweep-sea', 7, 15, 70, 77), "
    "('andaman-sea', 6, 15, 92, 100), ('equatorial-indian', -10, 10, 40, 100)) r(id, s, n, w, e)"
)
CLIM_FROM_SETS = (
    "tagged AS (SELECT sets.*, 'global' AS selection_type, 'all-available' AS selection_id FROM sets "
    "UNION ALL SELECT sets.*, 'grid', 'grid-' || CAST(CAST(floor(latitude / 2) * 2 AS INT) AS VARCHAR) || '-' || "
    "CAST(CAST(floor(longitude / 2) * 2 AS INT) AS VARCHAR) FROM sets "
    f"UNION ALL SELECT sets.*, 'region', r.id FROM sets JOIN {_REGIONS} ON latitude BETWEEN r.s AND r.n AND longitude BETWEEN r.w AND r.e), "
    "clim AS (SELECT k.kind AS baseline_type, parameter, selection_type, selection_id, CAST(month(time) AS INT) AS calendar_month, "
    "avg(profile_value) AS mean, stddev_samp(profile_value) AS std, count(*) AS n, count(DISTINCT platform_number) AS distinct_float_count, "
    "CAST(min(year(time)) AS INT) AS year_min, CAST(max(year(time)) AS INT) AS year_max FROM tagged JOIN "
    "(VALUES ('production', 2000, 2026), ('validation', 2000, 2009)) k(kind, a, b) ON year(time) BETWEEN k.a AND k.b "
    "GROUP BY ALL), prod AS (SELECT * FROM clim WHERE baseline_type = 'production')"
)


CLIM = f"{SETS}, {CLIM_FROM_SETS}"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
