"""Binning by a table of bounds that the user brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BINS = 1000


def bin_by_bounds(rows: DataFrame, bins: DataFrame, value: str = "pres") -> DataFrame:
    """Adds bin_label, bin_lower, bin_upper: the bin with lower <= value < upper, the highest bin with its upper end too.

    ``bins`` has the columns lower, upper and label and at most ``MAX_BINS`` rows that do not overlap; bounds may leave
    gaps. The table becomes one sorted array, so nothing is shuffled or joined. Values outside, NULL and NaN get NULLs;
    rows of ``bins`` without a bound are refused, as are overlapping ones.
    """
    found = bins.select(F.col("lower").cast("double"), F.col("upper").cast("double"), F.col("label").cast("string")).limit(MAX_BINS + 1).collect()
    if len(found) > MAX_BINS:
        raise ValueError(f"more than {MAX_BINS} bins")
    if any(b["lower"] is None or b["upper"] is None or b["lower"] >= b["upper"] for b in found):
        raise ValueError("every bin needs a lower bound under its upper bound")
    found.sort(key=lambda b: b["lower"])
    if any(a["upper"] > b["lower"] for a, b in zip(found, found[1:])):
        raise ValueError("bins overlap")
    kind = "array<struct<lower:double,upper:double,label:string>>"
    table = F.array(*[F.struct(F.lit(b["lower"]), F.lit(b["upper"]), F.lit(b["label"])) for b in found]).cast(kind)
    top = found[-1]["upper"] if found else None
    v = F.col(value)
    inside = F.filter(table, lambda b: (b["lower"] <= v) & ((v < b["upper"]) | ((v == top) & (b["upper"] == top))))
    hit = F.get(inside, F.lit(0))
    return rows.withColumns({"bin_label": hit["label"], "bin_lower": hit["lower"], "bin_upper": hit["upper"]})
