"""Column expressions over free text: normal form, whole-word phrase families, numbers and periods.

Everything is native except the compatibility normal form, which Spark lacks: a pandas UDF handles it, and only
texts with a non-ASCII character are shipped to Python (NULL is shipped for all others).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohaline.vocabulary import (
    ANOMALY_PHRASES,
    BLOCKED_TOPICS,
    BOTH_PHRASES,
    DEFAULT_RADIUS_KM,
    LATEST_OBSERVATION,
    MAX_DATE,
    MAX_RADIUS_KM,
    MAX_YEAR,
    MIN_DATE,
    MIN_RADIUS_KM,
    MIN_YEAR,
    MONTH_SPELLINGS,
    OTHER_OCEANS,
    PROFILE_PHRASES,
    REGIONAL_PHRASES,
    SALINITY_PHRASES,
    SEASON_MONTHS,
    SERIES_PHRASES,
    SST_PHRASES,
    TEMPERATURE_PHRASES,
)

# Word characters as the text rules mean them; look-arounds stand in for Unicode-aware word borders.
WORD = r"[\p{L}\p{N}_]"
START, END = rf"(?<!{WORD})", rf"(?!{WORD})"
SPACES = r"[\s\x1c-\x1f\x85  ]+"

# ---- Fixed values: number patterns ----------------------------------------------------------------
_KM = r"(?:km|kilometre|kilometres|kilometer|kilometers)"
RADIUS = (
    rf"{START}(?:within|radius(?:\s+of)?)\s+(\d+(?:\.\d+)?)\s*{_KM}{END}"
    rf"|{START}(\d+(?:\.\d+)?)\s*{_KM}\s+(?:around|radius|from){END}"
)
DEPTH = rf"{START}(\d{{1,4}}(?:\.\d+)?)\s*(m|metre|meter|metres|meters|dbar){END}"
COORDINATES = (
    r"(\d{1,2}(?:\.\d+)?)\s*[°º]?\s*([ns])\s*[,;/]?\s*(\d{1,3}(?:\.\d+)?)\s*[°º]?\s*([ew])"
)
YEARS = (
    rf"{START}(20\d{{2}})\s*(?:-|to|through)\s*(20\d{{2}}){END}"
    rf"|{START}between\s+(20\d{{2}})\s+and\s+(20\d{{2}}){END}"
)
LAST_N = rf"{START}(?:last|past)\s+(\d{{1,2}})\s+(year|years|month|months){END}"
POINT_WORDS = rf"{START}(?:near|around|off|at|close\s+to|coast\s+of|within\s+\d+(?:\.\d+)?\s*km\s+of){END}"
TREND_QUESTION = rf"{START}(?:is|are|has|have){END}[^?]*{START}(?:rising|falling|increasing|decreasing){END}"


def phrases(family: list[str]) -> str:
    """One alternation for a whole family."""
    bodies = [p.replace(" ", r"\s+").replace(r"\w", WORD) for p in family]
    return f"{START}(?:{'|'.join(bodies)}){END}"


def mentions(text: Column, literals) -> Column:
    """Does any literal occur at all? A byte search that spares most texts the pattern.

    Several are walked as an array: written out, the searches of all families made generated methods that the JVM does not compile.
    """
    first, *rest = dict.fromkeys(literals)
    return F.exists(F.array(*map(F.lit, (first, *rest))), lambda x: text.contains(x)) if rest else text.contains(first)


def has(text: Column, family: list[str]) -> Column:
    stems = [re.split(r"[\s\\]", p)[0] for p in family]
    return mentions(text, stems) & text.rlike(phrases(family))


def word(text: Column, pattern: str, *literals: str) -> Column:
    return mentions(text, literals or [pattern]) & text.rlike(f"{START}(?:{pattern}){END}")


def digits(text: Column) -> Column:
    """Every number pattern needs one; computed once per text."""
    return text.rlike("[0-9]")


def extract(text: Column, pattern: str, group: int) -> Column:
    """Group of the first match, NULL where it did not take part."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


# -- normal form -----------------------------------------------------------------------------------
def _compatibility_fold():
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())

    return fold


def fold_case(text: Column) -> Column:
    foreign = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_compatibility_fold()(F.when(foreign, text)), F.lower(text))


def squeeze(text: Column) -> Column:
    """Plain dashes and quotes, single blanks; expects case-folded text."""
    return F.trim(F.regexp_replace(F.translate(text, "–—−’‘“” ", "---''\"\" "), SPACES, " "))


def bare_words(text: Column) -> Column:
    """Words and blanks only, for matching names."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


# -- intent ----------------------------------------------------------------------------------------
def intent_flags(text: Column) -> dict[str, Column]:
    """Which phrase families occur; every family is one pass over the text."""
    families = {
        "salt": SALINITY_PHRASES, "sst": SST_PHRASES, "warm": TEMPERATURE_PHRASES, "both": BOTH_PHRASES,
        "profile": PROFILE_PHRASES, "series": SERIES_PHRASES, "regional": REGIONAL_PHRASES, "anomaly": ANOMALY_PHRASES,
    }
    flags = {f"_is_{name}": has(text, family) for name, family in families.items()}
    flags["_is_trend"] = mentions(text, ["rising", "falling", "creasing"]) & text.rlike(TREND_QUESTION)
    flags["_is_depth"] = F.col("_digits") & text.rlike(DEPTH)
    flags["_is_years"] = F.col("_digits") & (text.rlike(YEARS) | text.rlike(LAST_N))
    return flags


def parameters_of() -> Column:
    """Asked parameters, from the flags."""
    salt, sst = F.col("_is_salt"), F.col("_is_sst")
    warm = F.col("_is_warm") | sst
    heat = F.when(sst, "shallow_sst_proxy").otherwise("temperature")
    both = F.col("_is_both") | (warm & salt)
    return F.when(both, F.array(heat, F.lit("salinity"))).when(salt, F.array(F.lit("salinity"))).otherwise(F.array(heat))


def anomaly_intent() -> Column:
    return F.col("_is_anomaly") | F.col("_is_trend")


def view_of(parameters: Column, anomaly: Column, in_region: Column) -> Column:
    """The first rule that applies decides."""
    regional = F.col("_is_regional")
    return (
        F.when(F.col("_is_profile") | F.col("_is_depth"), "profile")
        .when(F.col("_is_series") | F.col("_is_years"), "time_series")
        .when(anomaly & ~regional, "time_series")
        .when(regional | in_region, "regional_average")
        .when(F.array_contains(parameters, "shallow_sst_proxy"), "time_series")
        .otherwise("profile")
    )


def radius_of(text: Column) -> Column:
    """struct(radius_km, explicit, rejected)."""
    spelled = F.col("_digits") & mentions(text, ["km", "kilomet"])
    given = F.when(spelled, F.coalesce(extract(text, RADIUS, 1), extract(text, RADIUS, 2))).cast("double")
    return F.struct(
        F.coalesce(given, F.lit(DEFAULT_RADIUS_KM)).alias("radius_km"),
        given.isNotNull().alias("explicit"),
        F.coalesce(~given.between(MIN_RADIUS_KM, MAX_RADIUS_KM), F.lit(False)).alias("rejected"),
    )


def blocked_topic(text: Column) -> Column:
    """First blocked topic or foreign ocean in list order; the list is walked only on a hit."""
    topics = BLOCKED_TOPICS + OTHER_OCEANS
    first = F.coalesce(*[F.when(has(text, [t]), F.lit(t)) for t in topics])
    return F.when(has(text, topics), first)


# -- periods ---------------------------------------------------------------------------------------
def month_of(text: Column) -> Column:
    """Longest month spelling that occurs as a word."""
    spellings = sorted(MONTH_SPELLINGS.items(), key=lambda kv: -len(kv[0]))
    (name, number), *rest = spellings
    chain = F.when(word(text, name), number)
    for name, number in rest:
        chain = chain.when(word(text, name), number)
    return chain


def season_of(text: Column) -> Column:
    return (
        F.when(word(text, r"pre[-\s]?monsoon", "monsoon"), "pre-monsoon")
        .when(word(text, r"post[-\s]?monsoon", "monsoon"), "post-monsoon")
        .when(word(text, "monsoon"), "monsoon")
        .when(word(text, "summer"), "summer")
        .when(word(text, "winter"), "winter")
    )


def _day(year: Column, month, day: int = 1) -> Column:
    month = F.lit(month) if isinstance(month, int) else month
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(day))


def season_window(season: Column, year: Column) -> tuple[Column, Column]:
    """First and last day; winter runs into the next year as far as the supported years go."""
    def month_at(i: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for name, months in SEASON_MONTHS.items() for x in (name, months[i])]), season)

    winter = season == "winter"
    crossing = F.when(year < MAX_YEAR, F.date_sub(_day(year + 1, 3), 1)).otherwise(F.last_day(_day(year, 12)))
    start = _day(year, F.when(winter, 12).otherwise(month_at(0)))
    end = F.when(winter, crossing).otherwise(F.last_day(_day(year, month_at(-1))))
    return start, end


def with_period(df: DataFrame, text: str, reference: Column) -> DataFrame:
    """Add ``_period``: struct(date_from, date_to, month, calendar_month, season, rejected).

    ``reference`` stands for today; numbers of depths and radii are removed first. The first rule that
    applies decides, and ``rejected`` names what is wrong with a period. Done in steps, so that every
    pattern runs once per text.
    """
    today = F.greatest(F.least(reference, F.lit(MAX_DATE).cast("date")), F.lit(MIN_DATE).cast("date"))
    columns = df.columns
    q = F.col("_dq")
    if "_digits" not in columns:
        df = df.withColumn("_digits", digits(F.col(text)))
    numeric = F.col("_digits")
    cleared = F.regexp_replace(F.regexp_replace(text, RADIUS, " "), DEPTH, " ")
    df = df.withColumn("_dq", F.when(numeric, cleared).otherwise(F.col(text)))
    named = F.regexp_extract_all(q, F.lit(rf"{START}(?:19|20|21)\d{{2}}{END}"), F.lit(0))
    df = df.withColumns(
        {
            "_outside": numeric & F.exists(named, lambda y: ~y.cast("int").between(MIN_YEAR, MAX_YEAR)),
            "_month": month_of(q),
            "_season": season_of(q),
            "_first": F.when(numeric, F.coalesce(extract(q, YEARS, 1), extract(q, YEARS, 3)).cast("int")),
            "_last": F.when(numeric, F.coalesce(extract(q, YEARS, 2), extract(q, YEARS, 4)).cast("int")),
            "_single": F.when(numeric, extract(q, rf"{START}(20\d{{2}}){END}", 1).cast("int")),
            "_count": F.when(numeric, extract(q, LAST_N, 1).cast("int")),
            "_unit": F.when(numeric, extract(q, LAST_N, 2)),
            "_relative": F.when(word(q, "recently"), "recently")
            .when(word(q, r"this\s+year", "year"), "this year")
            .when(word(q, r"last\s+year", "year"), "last year")
            .when(word(q, "today|current|latest|now", "today", "current", "latest", "now"), "latest"),
        }
    )
    month, season, outside = F.col("_month"), F.col("_season"), F.col("_outside")
    first, last, single, count = (F.col(c) for c in ("_first", "_last", "_single", "_count"))
    recurring = F.when(season.isNull(), month)
    this_year = F.year(today)
    by_year = F.col("_unit").startswith("year")
    month_start = F.trunc(today, "month")
    last_from = F.when(by_year, _day(this_year - count + 1, 1)).otherwise(F.add_months(month_start, 1 - count))
    last_to = F.when(by_year, _day(this_year, 12, 31)).otherwise(today)
    season_from, season_to = season_window(season, F.coalesce(single, this_year))
    newest = F.least(today, F.lit(LATEST_OBSERVATION).cast("date"))
    relative = F.col("_relative")

    # One year that is asked for: a number, else this or the last year.
    this = single.isNull() & (relative == "this year")
    df = df.withColumn("_asked", F.coalesce(single, F.when(relative == "this year", this_year).when(relative == "last year", this_year - 1)))
    asked = F.col("_asked")

    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")

    def span(start, end, month=none_int, calendar_month=none_int, season=none_text):
        return F.struct(
            start.alias("date_from"), end.alias("date_to"), month.cast("int").alias("month"),
            calendar_month.cast("int").alias("calendar_month"), season.alias("season"),
        )

    def whole_month(year):
        return span(_day(year, month), F.last_day(_day(year, month)), month=month)

    def year_or_month(year, start, end):
        return F.when(month.isNotNull(), whole_month(year)).otherwise(span(start, end))

    window_from, window_to = F.lit(MIN_DATE).cast("date"), F.lit(MAX_DATE).cast("date")
    chosen = (
        F.when(first.isNotNull(), span(_day(first, 1), _day(last, 12, 31), calendar_month=recurring, season=season))
        .when(count.isNotNull(), span(last_from, last_to, calendar_month=recurring, season=season))
        .when(season.isNotNull(), span(season_from, season_to, season=season))
        .when(asked.isNotNull(), year_or_month(asked, _day(asked, 1), F.when(this, today).otherwise(_day(asked, 12, 31))))
        .when(relative == "recently", span(F.add_months(month_start, -5), today, calendar_month=month))
        .when(relative == "latest", span(newest, newest, month=F.month(newest)))
        .otherwise(span(window_from, window_to, calendar_month=month))
    )
    df = df.withColumn("_span", chosen)
    rejected = (
        F.when(outside, "year_out_of_range")
        .when(first > last, "years_inverted")
        .when(first.isNull() & (count < 1), "relative_count_below_one")
        .when(F.col("_span.date_from") > F.col("_span.date_to"), "dates_inverted")
    )
    return df.select(*columns, F.struct("_span.*", rejected.alias("rejected")).alias("_period"))
