"""A table of texts -> tagged texts -> a table of selections.

Row-wise native expressions plus one broadcast join with the place dimension (about 120 rows). Only texts without a known
name are shuffled, as word groups, to look for misspelt ones.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohaline.functions import text as tx
from isohaline.functions.geo import in_envelope
from isohaline.operators.names import fuzzy_names, ngrams, spoken
from isohaline.plans.report import short_number
from isohaline.session import broadcast_if_small, written
from isohaline.vocabulary import ALIASES, PLACES, REGION_NAME_ORDER, REGIONS

_PLACES = {name: (label, lat, lon) for name, lat, lon, label in PLACES}
_REGIONS = {r[5]: r for r in REGIONS}
_ALIAS = dict(ALIASES)


def _by_length(names) -> list[str]:
    return sorted(names, key=lambda n: len(spoken(n)), reverse=True)


def place_dimension(spark) -> DataFrame:
    """name -> label, anchor, region and bounds, with variants resolved to their canonical entry."""
    rows = {}
    for name in list(_PLACES) + REGION_NAME_ORDER:
        canonical = _ALIAS.get(name, name)
        if canonical in _PLACES:
            label, lat, lon = _PLACES[canonical]
            rows[name] = (name, label, lat, lon, None, None, None, None, None)
        else:
            rid, s, n, w, e, _, label, _flag = _REGIONS[canonical]
            rows[name] = (name, label, (s + n) / 2, (w + e) / 2, rid, s, n, w, e)
    ddl = "name string, label string, latitude double, longitude double, region_id string, south double, north double, west double, east double"
    return spark.createDataFrame(list(rows.values()), ddl)


# -- names -----------------------------------------------------------------------------------------
def _first_hit(grams: Column, names: list[str], result: dict[str, str]) -> Column:
    """First of ``names`` (longest first) among the word groups, mapped to its result."""
    listed = F.array(*[F.lit(spoken(n)) for n in names])
    hit = F.get(F.array_intersect(listed, grams), F.lit(0))
    answers: dict[str, str] = {}
    for n in names:
        answers.setdefault(spoken(n), result[n])
    pairs = [F.lit(x) for kv in answers.items() for x in kv]
    return F.element_at(F.create_map(*pairs), hit)


def match_names(grams: Column, names: list[str]) -> Column:
    """Longest whole-word name, else the target of the longest spelling variant."""
    strict = _first_hit(grams, _by_length(names), {n: n for n in names})
    aliases = [a for a in _by_length(_ALIAS) if _ALIAS[a] in set(names)]
    return F.coalesce(strict, _first_hit(grams, aliases, _ALIAS))


def ranked_names(names: list[str]) -> dict[str, str]:
    """Spoken name -> target in the order in which ``match_names`` tries them."""
    aliases = [a for a in _by_length(_ALIAS) if _ALIAS[a] in set(names)]
    out: dict[str, str] = {}
    for name, target in [(n, n) for n in _by_length(names)] + [(a, _ALIAS[a]) for a in aliases]:
        out.setdefault(spoken(name), target)
    return out


def _names_once(names) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in names:
        out.setdefault(spoken(n), _ALIAS.get(n, n))
    return out


# -- tagging ---------------------------------------------------------------------------------------
def tag_texts(df: DataFrame, text_col: str, reference_date: date) -> DataFrame:
    """Add ``query`` (normal form) and what its words ask for; places are left to ``locate``."""
    out = df.withColumn("_folded", tx.fold_case(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumn("query", tx.squeeze(F.col("_folded"))).drop("_folded")
    q = F.col("query")
    out = out.withColumn("_digits", tx.digits(q))
    out = out.withColumns({"topic": tx.blocked_topic(q), "_radius": tx.radius_of(q), **tx.intent_flags(q)})
    out = out.withColumns({"parameters": tx.parameters_of(), "include_anomaly": tx.anomaly_intent()})
    return tx.with_period(out, "query", F.lit(reference_date))


def locate(tagged: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Coordinates first; point words put places before regions, otherwise regions come first."""
    q = F.col("query")
    # One array: four columns of groups made a generated method that the JVM does not compile.
    group = lambda i: F.nullif(F.call_function("regexp_extract", q, F.lit(tx.COORDINATES), i), F.lit(""))
    groups = F.when(tx.digits(q), F.transform(F.array(*map(F.lit, (1, 2, 3, 4))), group))
    lat = F.col("_n1").cast("double") * F.when(F.col("_n2") == "s", -1.0).otherwise(1.0)
    lon = F.col("_n3").cast("double") * F.when(F.col("_n4") == "w", -1.0).otherwise(1.0)
    decimals = F.greatest(*[F.length(F.substring_index(F.concat(c, F.lit(".")), ".", 2)) - F.length(F.substring_index(c, ".", 1)) - 1 for c in (F.col("_n1"), F.col("_n3"))])
    out = tagged.withColumns({"_n": groups, "_point": q.rlike(tx.POINT_WORDS), "_bare": tx.bare_words(q)})
    out = out.withColumns({f"_n{i}": F.get("_n", F.lit(i - 1)) for i in (1, 2, 3, 4)}).drop("_n")
    out = out.withColumns({"_lat": lat, "_lon": lon, "_precision": F.least(F.lit(4), decimals)})
    out = out.withColumn("_words", F.split("_bare", " ")).withColumn("_grams", ngrams(F.col("_words")))
    out = out.withColumns(
        {
            "_place": match_names(F.col("_grams"), list(_PLACES)),
            "_region": match_names(F.col("_grams"), REGION_NAME_ORDER),
        }
    ).drop("_grams", "_words")
    if fuzzy:
        settled = F.col("_lat").isNotNull() | F.when(F.col("_point"), F.col("_place").isNotNull()).otherwise(F.col("_region").isNotNull())
        # Written once: the word groups are taken from it, and the row numbers hold.
        out = out.withColumns({"_ask": F.when(~settled, F.col("_bare")), "_row": F.monotonically_increasing_id()})
        out = written(out, "located")
        kinds = {"place": _names_once(_PLACES), "region": _names_once(REGION_NAME_ORDER)}
        found = written(fuzzy_names(out, "_row", "_ask", kinds), "misspelt").withColumnsRenamed({k: f"_fuzzy_{k}" for k in kinds})
        out = out.join(broadcast_if_small(found)[0], "_row", "left")
        out = out.withColumns({f"_{k}": F.coalesce(f"_{k}", f"_fuzzy_{k}") for k in kinds})
        out = out.drop("_row", "_ask", *[f"_fuzzy_{k}" for k in kinds])
    name = F.when(F.col("_point") & F.col("_place").isNotNull(), F.col("_place")).otherwise(F.coalesce("_region", "_place"))
    out = out.withColumn("_name", F.when(F.col("_lat").isNull(), name))
    dim = place_dimension(tagged.sparkSession)
    dim = dim.select(F.col("name").alias("_name"), F.struct(*dim.columns[1:]).alias("_at"))
    out = out.join(F.broadcast(dim), "_name", "left")
    numeric = F.concat(
        short_number(F.abs("_lat")), F.lit("°"), F.when(F.col("_lat") >= 0, "N").otherwise("S"), F.lit(", "),
        short_number(F.abs("_lon")), F.lit("°"), F.when(F.col("_lon") >= 0, "E").otherwise("W"),
    )
    return out.withColumns(
        {
            "label": F.coalesce(numeric, "_at.label"),
            "latitude": F.coalesce("_lat", "_at.latitude"),
            "longitude": F.coalesce("_lon", "_at.longitude"),
            **{c: F.col(f"_at.{c}") for c in ("region_id", "south", "north", "west", "east")},
            "coordinate_precision": F.when(F.col("_lat").isNotNull(), F.col("_precision")).otherwise(2),
        }
    ).drop("_at", "_place", "_region", "_point", "_bare", "_precision", "_name", "_n1", "_n2", "_n3", "_n4")


def annotate_questions(df: DataFrame, text_col: str, reference_date: date, fuzzy: bool = True) -> DataFrame:
    """Every input row with its selection columns, and ``rejection`` (NULL = accepted)."""
    out = locate(tag_texts(df, text_col, reference_date), fuzzy)
    period = F.col("_period")
    coordinates = F.col("_lat").isNotNull()
    rejection = (
        F.when(F.col("query") == "", "empty")
        .when(F.col("topic").isNotNull(), "out_of_scope")
        .when(F.col("_radius.rejected"), "radius_out_of_range")
        .when(coordinates & ~(F.col("_lat").between(-90, 90) & F.col("_lon").between(-180, 180)), "coordinates_out_of_range")
        .when(coordinates & ~in_envelope(F.col("_lat"), F.col("_lon")), "outside_envelope")
        .when(F.col("latitude").isNull(), "location_missing")
        .otherwise(period["rejected"])
    )
    view = tx.view_of(F.col("parameters"), F.col("include_anomaly"), F.col("region_id").isNotNull())
    flags = [c for c in out.columns if c.startswith("_is_")]
    return out.withColumns(
        {
            "query_type": view,
            "radius_km": F.col("_radius.radius_km"),
            "radius_explicit": F.col("_radius.explicit"),
            **{c: period[c] for c in ("date_from", "date_to", "month", "calendar_month", "season")},
            "rejection": rejection,
        }
    ).drop("_radius", "_period", "_lat", "_lon", "_digits", *flags)


SELECTION_COLUMNS = (
    "label latitude longitude region_id south north west east radius_km radius_explicit date_from date_to month "
    "calendar_month season query_type parameters include_anomaly coordinate_precision"
).split()


def assemble_selections(annotated: DataFrame, id_col: str) -> DataFrame:
    """The accepted rows as a selections table, ready for the batch join."""
    return annotated.where(F.col("rejection").isNull()).select(
        F.col(id_col).cast("string").alias("selection_id"), *SELECTION_COLUMNS
    )


# -- ready-made plans --------------------------------------------------------------------------------
_REQUIRED = (
    "query_type parameters lat lon region_id location_label date_from date_to radius_km include_anomaly"
).split()
_OPTIONAL = ["calendar_month", "season"]


def validate_plans(df: DataFrame, json_col: str) -> DataFrame:
    """Check a column of JSON plans: violation_category and violation, both NULL for a sound plan.

    Types are read from the parsed VARIANT, so a quoted number is not taken for a number.
    """
    from isohaline.vocabulary import MAX_DATE, MAX_RADIUS_KM, MIN_DATE, MIN_RADIUS_KM, PARAMETERS, SEASON_MONTHS, VIEWS

    fields = _REQUIRED + _OPTIONAL
    doc = df.withColumn("_v", F.try_parse_json(json_col)).withColumn("_keys", F.json_object_keys(F.when(F.col("_v").isNotNull(), F.col(json_col))))
    types = {f"_t_{f}": F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant")) for f in fields}
    doc = doc.withColumns(types)

    def kind(field: str) -> Column:
        return F.col(f"_t_{field}")

    def null(field: str) -> Column:
        return kind(field).isNull() | (kind(field) == "VOID")

    def text(field: str) -> Column:
        return F.when(kind(field) == "STRING", F.try_variant_get("_v", f"$.{field}", "string"))

    def number(field: str) -> Column:
        return kind(field).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")

    def value(field: str) -> Column:
        return F.when(number(field), F.try_variant_get("_v", f"$.{field}", "double"))

    region_ids = [r[0] for r in REGIONS]
    params = F.when(kind("parameters") == "ARRAY<STRING>", F.try_variant_get("_v", "$.parameters", "array<string>"))
    has_region = ~null("region_id")
    has_point = ~null("lat") & ~null("lon")
    start, end = text("date_from").try_cast("date"), text("date_to").try_cast("date")
    iso = r"^\d{4}-\d{2}-\d{2}$"
    dates_ok = text("date_from").rlike(iso) & text("date_to").rlike(iso) & start.isNotNull() & end.isNotNull()
    integer = kind("calendar_month").rlike("^(BIGINT|INT|SMALLINT|TINYINT)")
    schema, semantic, unsupported = "schema_violation", "semantic_validation", "unsupported_query"
    rules = [
        (F.col("_v").isNull(), "malformed_json", "not_json"),
        (F.col("_keys").isNull(), schema, "not_an_object"),
        (
            (F.size(F.array_except(F.array(*map(F.lit, _REQUIRED)), "_keys")) > 0)
            | (F.size(F.array_except("_keys", F.array(*map(F.lit, fields)))) > 0),
            schema,
            "fields",
        ),
        (~F.coalesce(text("query_type").isin(*VIEWS, "unsupported"), F.lit(False)), schema, "query_type"),
        (
            params.isNull() | ~F.size(params).between(1, 2) | F.exists(params, lambda p: ~p.isin(*PARAMETERS)),
            schema,
            "parameters",
        ),
        (~(null("lat") | number("lat")) | ~(null("lon") | number("lon")), schema, "coordinates"),
        (has_region & ~F.coalesce(text("region_id").isin(*region_ids), F.lit(False)), schema, "region_id"),
        (text("location_label").isNull(), schema, "location_label"),
        (text("date_from").isNull() | text("date_to").isNull(), schema, "dates"),
        (~F.coalesce(number("radius_km"), F.lit(False)), schema, "radius_km"),
        (F.coalesce(kind("include_anomaly") != "BOOLEAN", F.lit(True)), schema, "include_anomaly"),
        (~null("calendar_month") & ~(integer & value("calendar_month").between(1, 12)), schema, "calendar_month"),
        (~null("season") & ~F.coalesce(text("season").isin(*SEASON_MONTHS), F.lit(False)), schema, "season"),
        (text("query_type") == "unsupported", unsupported, "out_of_scope"),
        (F.size(F.array_distinct(params)) < F.size(params), semantic, "repeated_parameter"),
        (F.array_contains(params, "temperature") & F.array_contains(params, "shallow_sst_proxy"), semantic, "clashing_parameters"),
        (has_region & has_point, semantic, "region_and_coordinates"),
        (~has_region & ~has_point, semantic, "no_location"),
        (has_point & ~in_envelope(value("lat"), value("lon")), unsupported, "outside_envelope"),
        (~value("radius_km").between(MIN_RADIUS_KM, MAX_RADIUS_KM), semantic, "radius_range"),
        (~dates_ok, schema, "iso_dates"),
        (start > end, semantic, "dates_inverted"),
        ((start < F.lit(MIN_DATE).cast("date")) | (end > F.lit(MAX_DATE).cast("date")), semantic, "dates_outside_window"),
    ]
    chain = F.when(F.coalesce(rules[0][0], F.lit(False)), F.struct(F.lit(rules[0][1]).alias("c"), F.lit(rules[0][2]).alias("n")))
    for broken, category, name in rules[1:]:
        chain = chain.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(category).alias("c"), F.lit(name).alias("n")))
    out = doc.withColumn("_bad", chain)
    return out.select(*df.columns, F.col("_bad.c").alias("violation_category"), F.col("_bad.n").alias("violation"))
