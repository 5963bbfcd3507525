"""Column expressions over one observation row or one result row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohaline.vocabulary import (
    ACCEPTED_MODES,
    DEPTH_BINS,
    MONTH_LABELS,
    PURE_WATER,
    REJECT_REASONS,
    SALT_TERM,
    SEASON_MONTHS,
)

# ---- Fixed values: every character that counts as white space --------------------------------------
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


# -- lenient typing ------------------------------------------------------------------------------
def clean_text(c: Column) -> Column:
    """Trim every kind of white space (``trim`` alone removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def to_number(c: Column) -> Column:
    """Double or NULL; never an error, and NaN counts as missing.

    Only decimal notation is a number: the cast alone would also take Java suffixes and hexadecimal floats. NaN is none.
    """
    return F.when(c.cast("string").rlike(NUMBER), c.try_cast("double"))


def to_utc(c: Column) -> Column:
    """Timestamp or NULL. A time of day alone is no time: the cast would date it to the day of the run."""
    return F.when(c.cast("string").rlike(r"^\s*\d{4}"), c.try_cast("timestamp"))


# -- calendar ------------------------------------------------------------------------------------
def month_key(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), month)


def season_months(season: Column) -> Column:
    """Array of the months of a season, NULL for an unknown or absent season."""
    pairs = []
    for name, months in SEASON_MONTHS.items():
        pairs += [F.lit(name), F.array(*[F.lit(m) for m in months])]
    return F.element_at(F.create_map(*pairs), season)


def in_recurring(month: Column, calendar_month: Column, season: Column) -> Column:
    """Recurring calendar month or season; no restriction when both are absent."""
    return F.coalesce(
        F.when(calendar_month.isNotNull(), month == calendar_month).when(
            season.isNotNull(), F.array_contains(season_months(season), month)
        ),
        calendar_month.isNull() & season.isNull(),
    )


# -- identity ------------------------------------------------------------------------------------
def profile_key(platform: Column, cycle: Column) -> Column:
    return F.concat_ws(":", platform, cycle)


def mode_rank(mode: Column) -> Column:
    """Delayed before adjusted before real-time before anything else; case counts."""
    return F.when(mode == "D", 0).when(mode == "A", 1).when(mode == "R", 2).otherwise(99)


# -- quality -------------------------------------------------------------------------------------
def value_column(parameter: Column) -> Column:
    return F.when(parameter == "salinity", F.col("psal_adjusted")).otherwise(F.col("temp_adjusted"))


def flag_column(parameter: Column) -> Column:
    return F.when(parameter == "salinity", F.col("psal_adjusted_qc")).otherwise(F.col("temp_adjusted_qc"))


def reject_reason(position_flag: Column, mode: Column, value_flag: Column, value: Column) -> Column:
    """First failed check in the declared order; NULL for a kept row."""
    passed = [
        clean_text(position_flag) == "1",
        F.upper(clean_text(mode)).isin(*ACCEPTED_MODES),
        clean_text(value_flag) == "1",
        value.isNotNull() & ~F.isnan(value),
    ]
    steps = zip(passed, REJECT_REASONS)
    first_ok, first_reason = next(steps)
    chain = F.when(~F.coalesce(first_ok, F.lit(False)), first_reason)
    for ok, reason in steps:
        chain = chain.when(~F.coalesce(ok, F.lit(False)), reason)
    return chain


# -- depth ---------------------------------------------------------------------------------------
def depth_bin(pres: Column) -> Column:
    """1-based number of the half-open bin, NULL outside 0-500 dbar."""
    edges = [edge for _lo, edge, _hi, _label in DEPTH_BINS]
    chain = F.when(pres < edges[0], 1)
    for i, edge in enumerate(edges[1:], 2):
        chain = chain.when(pres < edge, i)
    return F.when((pres >= 0) & (pres <= 500), chain)


def _bin_value(bin_no: Column, position: int) -> Column:
    return F.element_at(F.array(*[F.lit(b[position]) for b in DEPTH_BINS]), bin_no)


def bin_label(bin_no: Column) -> Column:
    return _bin_value(bin_no, 3)


def bin_min(bin_no: Column) -> Column:
    return _bin_value(bin_no, 0)


def bin_max(bin_no: Column) -> Column:
    return _bin_value(bin_no, 2)


def bin_mid(bin_no: Column) -> Column:
    return (bin_min(bin_no) + bin_max(bin_no)) / 2


# -- sea water -----------------------------------------------------------------------------------
def _horner(x: Column, coefficients) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def seawater_density(t: Column, s: Column) -> Column:
    """Surface density, linear in salinity and without a pressure term."""
    return _horner(t, PURE_WATER) + _horner(t, SALT_TERM) * s


# -- parameters ----------------------------------------------------------------------------------
def unit_of(parameter: Column) -> Column:
    return F.when(parameter == "salinity", "PSU").otherwise("°C")


def climatology_parameter(parameter: Column, view: Column) -> Column:
    """Which climatology a (parameter, view) pair is compared with."""
    return (
        F.when((view == "regional_average") & (parameter == "salinity"), "salinity_upper_100")
        .when(view == "regional_average", "temperature_upper_100")
        .when(parameter == "shallow_sst_proxy", "temperature_shallow")
        .otherwise(parameter)
    )


# -- scores --------------------------------------------------------------------------------------
def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """NULL unless all three are finite and the spread is positive."""
    return F.when(is_finite(value) & is_finite(mean) & is_finite(std) & (std > 0), (value - mean) / std)


def score_label(z: Column) -> Column:
    sign = F.when(z > 0, "positive").otherwise("negative")
    return (
        F.when(F.abs(z) < 1.5, "normal")
        .when(F.abs(z) < 2.5, F.concat(F.lit("mild_"), sign))
        .when(z.isNotNull(), F.concat(F.lit("strong_"), sign))
    )


def band_edge(mean: Column, std: Column, side: int) -> Column:
    """Mean plus or minus one spread; NULL where the spread is not positive."""
    return F.when(std > 0, mean + F.lit(float(side)) * std)
