"""Text tables: tags over whole documents and conversations, questions to selections, plan checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.fixture import table
from isohaline import vocabulary as v
from isohaline.functions import text as tx
from isohaline.operators.names import exact_names, like_first, met_groups, spoken
from isohaline.session import spread_if_narrow, written
from isohaline.plans import questions

TODAY = date(2026, 8, 22)


def _tags(df: DataFrame, ids: list[str]) -> DataFrame:
    out = questions.tag_texts(df, "text", TODAY)
    return out.select(
        *ids,
        F.array_join("parameters", "+").alias("parameters"),
        "include_anomaly",
        "topic",
        F.col("_radius.radius_km").alias("radius_km"),
        F.col("_radius.rejected").alias("radius_rejected"),
        F.length("query").cast("bigint").alias("n_chars"),
    )


def document_tags(spark, sf_dir):
    """Intent of every document, over its whole text."""
    return _tags(spread_if_narrow(table(spark, sf_dir, "documents")), ["doc_id"])


def conversation_tags(spark, sf_dir):
    return _tags(spread_if_narrow(table(spark, sf_dir, "conversations")), ["conv_id", "turn"])


def conversation_places(spark, sf_dir):
    """Place, period and view of every conversation turn (most are rejected for want of a place)."""
    out = questions.annotate_questions(spread_if_narrow(table(spark, sf_dir, "conversations")), "text", TODAY)
    return out.select("conv_id", "turn", "label", "region_id", "query_type", F.col("date_from").cast("string").alias("date_from"), "rejection")


KINDS = {"place": questions._names_once(questions._PLACES), "region": questions._names_once(v.REGION_NAME_ORDER)}


def _names(df: DataFrame, ids: list[str]) -> DataFrame:
    """Named and misspelt places and regions of every text, over its whole length."""
    query = tx.squeeze(tx.fold_case(F.coalesce("text", F.lit(""))))
    texts = df.select(*ids, F.monotonically_increasing_id().alias("row"), tx.bare_words(query).alias("bare"))
    texts = written(texts, "bare")
    ranked = {"place": questions.ranked_names(list(questions._PLACES)), "region": questions.ranked_names(v.REGION_NAME_ORDER)}
    names = {name for of in KINDS.values() for name in of}
    groups = written(met_groups(texts, "row", "bare", names, {name for of in ranked.values() for name in of}), "groups")
    like = like_first(groups, "row", KINDS).withColumnsRenamed({k: f"{k}_like" for k in KINDS})
    out = texts.select(*ids, "row").join(exact_names(groups, "row", ranked), "row", "left").join(like, "row", "left")
    return out.select(*ids, "place", "region", "place_like", "region_like")


def document_names(spark, sf_dir):
    return _names(spread_if_narrow(table(spark, sf_dir, "documents")), ["doc_id"])


def conversation_names(spark, sf_dir):
    return _names(spread_if_narrow(table(spark, sf_dir, "conversations")), ["conv_id", "turn"])


# -- questions whose answer is known ------------------------------------------------------------------
# Every order asks one question; its key picks place, parameter, period and radius.
_PLACE = [
    # words, label, latitude, longitude, region
    (" near Mumbai", "Mumbai coast", 19.0, 72.8, None),
    (" near Bombay", "Mumbai coast", 19.0, 72.8, None),
    (" in the Arabian Sea", "Arabian Sea", 16.5, 65.0, "arabian-sea"),
    (" off Mahrasthra", "Maharashtra coast (Arabian Sea)", 17.5, 73.0, None),
    (" at 15.25N, 72.5E", "15.25°N, 72.5°E", 15.25, 72.5, None),
    (" near Atlantis", None, None, None, None),
    (" near Calicat", "Kozhikode coast", 11.26, 75.78, None),
    (" at 45N, 60E", "45°N, 60°E", 45.0, 60.0, None),
]
_WHAT = [
    ("Temperature", "temperature"),
    ("  SALINITY", "salinity"),
    ("Sea–surface temperature", "shallow_sst_proxy"),
    ("Water conditions", "temperature+salinity"),
]
_WHEN = [
    # words, from, to, month, calendar month, season, series, wrong
    (" in July 2024", "2024-07-01", "2024-07-31", 7, None, None, False, None),
    (" from 2018 to 2022", "2018-01-01", "2022-12-31", None, None, None, True, None),
    (" last 3 years", "2024-01-01", "2026-12-31", None, None, None, True, None),
    (" during winter 2023", "2023-12-01", "2024-02-29", None, None, "winter", False, None),
    (" every June", "2000-01-01", "2026-12-31", None, 6, None, False, None),
    (" recently", "2026-03-01", "2026-08-22", None, None, None, False, None),
    ("", "2000-01-01", "2026-12-31", None, None, None, False, None),
    (" in 1999", None, None, None, None, None, False, "year_out_of_range"),
    (" during monsoon of last 2 years", "2025-01-01", "2026-12-31", None, None, "monsoon", True, None),
    (" between 2022 and 2020", None, None, None, None, None, True, "years_inverted"),
]


def _pick(key, options: list[str]):
    chain = F.when(key == 0, options[0])
    for i, text in enumerate(options[1:], 1):
        chain = chain.when(key == i, text)
    return chain


def question_texts(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(
        _pick(k % 4, [w[0] for w in _WHAT]),
        _pick(k % 8, [p[0] for p in _PLACE]),
        _pick(k % 10, [w[0] for w in _WHEN]),
        F.when(k % 15 == 0, " within 120 km").when(k % 49 == 0, " within 5000 km").otherwise(""),
        F.when(k % 23 == 0, " and rainfall").otherwise(""),
        F.lit("?"),
    )
    return spread_if_narrow(table(spark, sf_dir, "orders")).select(F.concat(F.lit("Q"), k.cast("string")).alias("question_id"), text.alias("text"))


def _annotated(spark, sf_dir):
    return questions.annotate_questions(question_texts(spark, sf_dir), "text", TODAY)


def question_tags(spark, sf_dir):
    """Accepted or rejected, and why."""
    return _annotated(spark, sf_dir).select("question_id", "rejection", "topic")


def question_selections(spark, sf_dir):
    """The accepted questions as a selections table."""
    out = questions.assemble_selections(_annotated(spark, sf_dir), "question_id")
    return out.select(
        "selection_id", "label", "latitude", "longitude", "region_id", "radius_km", "radius_explicit",
        F.col("date_from").cast("string").alias("date_from"), F.col("date_to").cast("string").alias("date_to"),
        "month", "calendar_month", "season", "query_type", F.array_join("parameters", "+").alias("parameters"),
    )


# -- ready-made plans ---------------------------------------------------------------------------------
def plan_texts(spark, sf_dir) -> DataFrame:
    """One JSON plan per customer, broken in many ways."""
    k = F.col("c_custkey")

    def field(name, value):
        return F.concat(F.lit(f'"{name}":'), value)

    parts = [
        field("query_type", F.when(k % 31 == 0, '"chart"').when(k % 37 == 0, '"unsupported"').when(k % 41 == 0, "7").otherwise('"profile"')),
        field("parameters", F.when(k % 29 == 0, "[]").when(k % 19 == 0, '["salinity","salinity"]').when(k % 17 == 0, '["temperature","shallow_sst_proxy"]')
              .when(k % 43 == 0, '["oxygen"]').otherwise('["salinity"]')),
        field("lat", F.when(k % 11 == 0, "null").when(k % 47 == 0, '"12"').when(k % 13 == 0, "45.5").otherwise("12.5")),
        field("lon", F.when(k % 11 == 0, "null").otherwise("65")),
        field("region_id", F.when((k % 22 == 0) | (k % 53 == 0), '"arabian-sea"').when(k % 59 == 0, '"black-sea"').otherwise("null")),
        field("location_label", F.when(k % 61 == 0, "null").otherwise('"Somewhere"')),
        field("date_from", F.when(k % 9 == 0, '"2021-13-01"').when(k % 14 == 0, '"1999-05-01"').otherwise('"2020-01-01"')),
        field("date_to", F.when(k % 16 == 0, '"2019-06-30"').otherwise('"2021-06-30"')),
        field("radius_km", F.when(k % 67 == 0, '"300"').when(k % 21 == 0, "5000").otherwise("300.5")),
        field("include_anomaly", F.when(k % 71 == 0, "1").otherwise("true")),
        F.when(k % 6 == 0, field("calendar_month", F.when(k % 12 == 0, F.when(k % 24 == 0, "6.5").otherwise("13")).otherwise("6"))),
        F.when(k % 25 == 0, field("season", F.when(k % 50 == 0, '"autumn"').otherwise('"winter"'))),
        F.when(k % 73 == 0, F.lit('"comment":"x"')),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    text = F.when(k % 79 == 0, F.substring(body, 1, 50)).when(k % 83 == 0, "[1, 2]").otherwise(body)
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), k.cast("string")).alias("plan_id"), text.alias("plan"))


def plan_violations(spark, sf_dir):
    return questions.validate_plans(plan_texts(spark, sf_dir), "plan").drop("plan")


QUERIES = {
    "document_tags": document_tags,
    "conversation_tags": conversation_tags,
    "conversation_places": conversation_places,
    "document_names": document_names,
    "conversation_names": conversation_names,
    "question_tags": question_tags,
    "question_selections": question_selections,
    "plan_violations": plan_violations,
}

# -- checking SQL ---------------------------------------------------------------------------------------
_W = r"\p{L}\p{N}_"


def _family(names: list[str]) -> str:
    bodies = "|".join(n.replace(" ", r"\s+").replace(r"\w*", f"[{_W}]*") for n in names)
    return f"regexp_matches(q, '(^|[^{_W}])({bodies})($|[^{_W}])')".replace("{bodies}", bodies)


def _quoted(names: list[str]) -> list[str]:
    return [n.replace("'", "''") for n in names]


_NORMAL = (
    "trim(regexp_replace(translate(replace(lower(text), 'ß', 'ss'), '–—−’‘“”' || chr(160), '---''''\"\" '), '\\s+', ' ', 'g'))"
)
_ANOMALY = (
    f"({_family(_quoted(v.ANOMALY_PHRASES))} OR regexp_matches(q, '(^|[^{_W}])(is|are|has|have)[^{_W}?][^?]*(rising|falling|increasing|decreasing)($|[^{_W}])'))"
)
_KM = "(km|kilometre|kilometres|kilometer|kilometers)"
_R1 = f"(^|[^{_W}])(within|radius(\\s+of)?)\\s+(\\d+(\\.\\d+)?)\\s*{_KM}($|[^{_W}])"
_R2 = f"(^|[^{_W}])(\\d+(\\.\\d+)?)\\s*{_KM}\\s+(around|radius|from)($|[^{_W}])"


def _tag_sql(source: str, ids: str) -> str:
    topics = _quoted(v.BLOCKED_TOPICS + v.OTHER_OCEANS)
    topic = "CASE " + " ".join(f"WHEN {_family([t])} THEN '{t}'" for t in topics) + " END"
    return (
        f"WITH n AS (SELECT {ids}, {_NORMAL} AS q FROM {source}), f AS (SELECT *, {_family(_quoted(v.SALINITY_PHRASES))} AS salt, "
        f"{_family(_quoted(v.SST_PHRASES))} AS sst, {_family(_quoted(v.TEMPERATURE_PHRASES))} AS warm, {_family(_quoted(v.BOTH_PHRASES))} AS both_, "
        f"TRY_CAST(coalesce(nullif(regexp_extract(q, '{_R1}', 4), ''), nullif(regexp_extract(q, '{_R2}', 2), '')) AS DOUBLE) AS km FROM n) "
        f"SELECT {ids}, CASE WHEN both_ OR ((warm OR sst) AND salt) THEN CASE WHEN sst THEN 'shallow_sst_proxy' ELSE 'temperature' END || '+salinity' "
        "WHEN salt THEN 'salinity' WHEN sst THEN 'shallow_sst_proxy' ELSE 'temperature' END AS parameters, "
        f"{_ANOMALY} AS include_anomaly, {topic} AS topic, coalesce(km, 300.0) AS radius_km, coalesce(km < 1 OR km > 2000, FALSE) AS radius_rejected, length(q) AS n_chars FROM f"
    )


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return str(value).upper() if isinstance(value, bool) else repr(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


_KNOWN = (
    "WITH p(i, label, latitude, longitude, region_id) AS (VALUES "
    + ", ".join("(" + ", ".join(map(_sql, (i, *p[1:]))) + ")" for i, p in enumerate(_PLACE))
    + "), w(i, parameters) AS (VALUES "
    + ", ".join(f"({i}, '{w[1]}')" for i, w in enumerate(_WHAT))
    + "), d(i, date_from, date_to, month, calendar_month, season, series, wrong) AS (VALUES "
    + ", ".join("(" + ", ".join(map(_sql, (i, *w[1:]))) + ")" for i, w in enumerate(_WHEN))
    + "), k AS (SELECT 'Q' || o_orderkey AS id, o_orderkey AS k, p.* EXCLUDE (i), w.* EXCLUDE (i), d.* EXCLUDE (i), "
    "CASE WHEN o_orderkey % 23 = 0 THEN 'out_of_scope' WHEN o_orderkey % 15 <> 0 AND o_orderkey % 49 = 0 THEN 'radius_out_of_range' "
    "WHEN latitude > 30 THEN 'outside_envelope' WHEN latitude IS NULL THEN 'location_missing' ELSE wrong END AS rejection "
    "FROM orders JOIN p ON p.i = o_orderkey % 8 JOIN w ON w.i = o_orderkey % 4 JOIN d ON d.i = o_orderkey % 10) "
)
_BAD_PLAN = [
    ("k % 79 = 0", "malformed_json", "not_json"),
    ("k % 83 = 0", "schema_violation", "not_an_object"),
    ("k % 73 = 0", "schema_violation", "fields"),
    ("k % 31 = 0 OR (k % 41 = 0 AND k % 37 <> 0)", "schema_violation", "query_type"),
    ("k % 29 = 0 OR (k % 43 = 0 AND k % 19 <> 0 AND k % 17 <> 0)", "schema_violation", "parameters"),
    ("k % 47 = 0 AND k % 11 <> 0", "schema_violation", "coordinates"),
    ("k % 59 = 0 AND k % 22 <> 0 AND k % 53 <> 0", "schema_violation", "region_id"),
    ("k % 61 = 0", "schema_violation", "location_label"),
    ("k % 67 = 0", "schema_violation", "radius_km"),
    ("k % 71 = 0", "schema_violation", "include_anomaly"),
    ("k % 12 = 0", "schema_violation", "calendar_month"),
    ("k % 50 = 0", "schema_violation", "season"),
    ("k % 37 = 0", "unsupported_query", "out_of_scope"),
    ("k % 19 = 0", "semantic_validation", "repeated_parameter"),
    ("k % 17 = 0", "semantic_validation", "clashing_parameters"),
    ("k % 11 <> 0 AND k % 53 = 0", "semantic_validation", "region_and_coordinates"),
    ("k % 11 = 0 AND k % 22 <> 0 AND k % 53 <> 0", "semantic_validation", "no_location"),
    ("k % 11 <> 0 AND k % 13 = 0", "unsupported_query", "outside_envelope"),
    ("k % 21 = 0", "semantic_validation", "radius_range"),
    ("k % 9 = 0", "schema_violation", "iso_dates"),
    ("k % 16 = 0 AND k % 14 <> 0", "semantic_validation", "dates_inverted"),
    ("k % 14 = 0", "semantic_validation", "dates_outside_window"),
]

_BEST_BLOCK = (
    "list_max(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), "
    "lambda k: {'k': k, 'i': -i, 'j': strpos(b, substr(a, i, k))}))), lambda h: h.j > 0))"
)


def _names_sql(source: str, ids: str) -> str:
    """Exact names by rank (longest first, variants after names), similar ones by recursive common blocks of every close pair."""
    exact, like = [], []
    for kind, names in (("place", list(questions._PLACES)), ("region", v.REGION_NAME_ORDER)):
        aliases = [a for a in dict(v.ALIASES) if dict(v.ALIASES)[a] in names]
        ranked = [(n, n) for n in sorted(names, key=lambda n: -len(spoken(n)))] + [(a, dict(v.ALIASES)[a]) for a in sorted(aliases, key=lambda a: -len(spoken(a)))]
        exact += [(kind, spoken(n), target, i) for i, (n, target) in enumerate(ranked)]
        like += [(kind, n, target) for n, target in KINDS[kind].items()]
    rows = lambda table: ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in table)
    return (
        f"WITH RECURSIVE exact(kind, name, target, rank) AS (VALUES {rows(exact)}), names(kind, name, target) AS (VALUES {rows(like)}), "
        f"n AS (SELECT {ids}, {_NORMAL} AS q FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM {source})), "
        f"w AS (SELECT {ids}, string_split(trim(regexp_replace(regexp_replace(q, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS ws FROM n), "
        f"g AS (SELECT {ids}, unnest(flatten(list_transform([3, 2, 1], lambda s: list_transform(range(1, len(ws) - s + 2), "
        "lambda i: {'seq': (3 - s) * 100000000 + i, 'gram': array_to_string(ws[i:i + s - 1], ' ')})))) AS x FROM w), "
        f"grams AS (SELECT {ids}, x.seq AS seq, x.gram AS gram FROM g), "
        "some_grams AS (SELECT DISTINCT gram FROM grams WHERE length(gram) BETWEEN 5 AND 60), "
        "pairs AS (SELECT DISTINCT gram, name FROM some_grams JOIN (SELECT DISTINCT name FROM names) ON abs(length(gram) - length(name)) <= 0.15 * (length(gram) + length(name)) "
        "AND levenshtein(gram, name) <= 0.15 * (length(gram) + length(name)) + 1e-9), "
        "parts(gram, name, a, b) AS (SELECT gram, name, name, gram FROM pairs UNION ALL SELECT gram, name, p.a, p.b FROM (SELECT gram, name, unnest(["
        "{'a': substr(a, 1, -h.i - 1), 'b': substr(b, 1, h.j - 1)}, {'a': substr(a, -h.i + h.k), 'b': substr(b, h.j + h.k)}]) AS p "
        f"FROM (SELECT *, {_BEST_BLOCK} AS h FROM parts WHERE a <> '' AND b <> '') WHERE h IS NOT NULL)), "
        f"matched AS (SELECT gram, name, sum(h.k) AS m FROM (SELECT *, {_BEST_BLOCK} AS h FROM parts WHERE a <> '' AND b <> '') WHERE h IS NOT NULL GROUP BY gram, name), "
        "near AS (SELECT gram, kind, target FROM (SELECT *, 2.0::DOUBLE * m / (length(gram) + length(name)) AS ratio FROM matched JOIN names USING (name)) WHERE ratio >= 0.85::DOUBLE "
        "QUALIFY row_number() OVER (PARTITION BY gram, kind ORDER BY ratio DESC, name DESC) = 1), "
        f"found AS (SELECT {ids}, arg_min(target, seq) FILTER (WHERE kind = 'place') AS place_like, arg_min(target, seq) FILTER (WHERE kind = 'region') AS region_like FROM grams JOIN near USING (gram) GROUP BY {ids}), "
        f"named AS (SELECT {ids}, arg_min(target, rank) FILTER (WHERE kind = 'place') AS place, arg_min(target, rank) FILTER (WHERE kind = 'region') AS region FROM grams JOIN exact ON gram = name GROUP BY {ids}) "
        f"SELECT {ids}, place, region, place_like, region_like FROM w LEFT JOIN named USING ({ids}) LEFT JOIN found USING ({ids})"
    )


ORACLES = {
    "document_names": _names_sql("documents", "doc_id"),
    "conversation_names": _names_sql("conversations", "conv_id, turn"),
    "document_tags": _tag_sql("documents", "doc_id"),
    "conversation_tags": _tag_sql("conversations", "conv_id, turn"),
    "question_tags": _KNOWN + "SELECT id AS question_id, rejection, CASE WHEN k % 23 = 0 THEN 'rainfall' END AS topic FROM k",
    "question_selections": _KNOWN
    + "SELECT id AS selection_id, label, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, region_id, "
    "CASE WHEN k % 15 = 0 THEN 120.0::DOUBLE ELSE 300.0::DOUBLE END AS radius_km, k % 15 = 0 AS radius_explicit, date_from, date_to, month, calendar_month, season, "
    "CASE WHEN series THEN 'time_series' WHEN region_id IS NOT NULL THEN 'regional_average' WHEN parameters = 'shallow_sst_proxy' THEN 'time_series' ELSE 'profile' END AS query_type, "
    "parameters FROM k WHERE rejection IS NULL",
    "plan_violations": "WITH c AS (SELECT c_custkey AS k, CASE "
    + " ".join(f"WHEN {cond} THEN '{cat}|{name}'" for cond, cat, name in _BAD_PLAN)
    + " END AS bad FROM customer) SELECT 'P' || k AS plan_id, split_part(bad, '|', 1) AS violation_category, split_part(bad, '|', 2) AS violation FROM c",
}
