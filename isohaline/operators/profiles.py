"""One row per (keys, profile): everything the views need, in a single shuffle.

All views except the observation-level ones (month-depth grid, density, pairs) read this table, which is two
to three orders of magnitude smaller than the observations. Partial aggregation runs on the map side, where
the rows of a profile lie together.

A profile normally has one place and one time. ``observation_facts`` relies on that for speed, proves it per
profile with minima and maxima, and sends the profiles where it does not hold through ``profile_facts``,
which takes every "first" value in a declared row order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohaline.functions.measures import depth_bin
from isohaline.operators.quality import KEYS, by_parameter, judged_both
from isohaline.operators.selection import alike, for_members, select_observations, select_profiles, selection_spans, within_hull
from isohaline.session import BROADCAST_ROWS, written
from isohaline.vocabulary import DEPTH_BINS, PROFILE_SETS, REJECT_REASONS

IDENTITY = ("platform_number", "time", "latitude", "longitude")
BIN_COLUMNS = [f"bin_{i}" for i in range(1, len(DEPTH_BINS) + 1)]


def row_order(columns) -> Column:
    """Total order in which the "first" row of a profile is meant."""
    return F.struct(*[c for c in ("_source_file", "pres", "source_row") if c in columns])


def level_order(columns) -> Column:
    return F.struct(*[c for c in ("pres", "source_row") if c in columns])


def _counts(kept: Column, pres: Column, columns) -> list[Column]:
    bins, row = depth_bin(pres), F.col("source_row") if "source_row" in columns else F.lit(None).cast("bigint")
    return [
        F.count("*").alias("raw_rows"),
        F.count_if(kept).alias("valid_rows"),
        F.count_if(kept & pres.between(0, 500)).alias("rows_0_500"),
        F.count_if(kept & pres.between(0, 100)).alias("rows_0_100"),
        F.sum(F.when(kept & pres.between(0, 100), row)).alias("row_sum_0_100"),
        *[F.count_if(kept & (bins == i)).alias(f"rows_{c}") for i, c in enumerate(BIN_COLUMNS, 1)],
        *[F.count_if(F.col("reject_reason") == r).alias(f"n_{r}") for r in REJECT_REASONS],
    ]


def _count_names() -> list[str]:
    bins = [f"rows_{c}" for c in BIN_COLUMNS]
    return ["raw_rows", "valid_rows", "rows_0_500", "rows_0_100", "row_sum_0_100", *bins, *[f"n_{r}" for r in REJECT_REASONS]]


def _bin_medians(kept: Column, pres: Column, value: Column) -> list[Column]:
    bins = depth_bin(pres)
    return [F.median(F.when(kept & (bins == i), value)).alias(c) for i, c in enumerate(BIN_COLUMNS, 1)]


def _running(group: list[str], n: str) -> tuple[Column, Column]:
    """Place of a value among the values of its group, and how many there are."""
    whole = Window.partitionBy(*group)
    return F.count(n).over(whole.orderBy(n).rowsBetween(Window.unboundedPreceding, 0)), F.count(n).over(whole)


def _middle(place: str, size: str) -> Column:
    return (F.col(place) * 2).between(F.col(size), F.col(size) + 2)


def quick_facts(obs: DataFrame, need=None) -> DataFrame:
    """Facts of profiles with one float, place and time each; ``uniform`` says for which profiles that holds.

    ``need`` names the columns of values and counts that are wanted, all unless stated. Medians are the middle of ranked rows, so
    that a profile makes no objects; rows are shuffled once, before they count for each parameter.
    """
    have = obs.columns
    wanted = lambda *names: need is None or any(n in need for n in names)
    columns = [c for c in ("source_row",) if c in have]
    rows = judged_both(obs.repartition("profile_id")).select(
        "parameter", "profile_id", "platform_number", "time", "latitude", "longitude", "pres", *columns, "value", "reject_reason", "kept"
    )
    group = ["parameter", "profile_id", "platform_number"]
    kept, pres, value = F.col("kept"), F.col("pres"), F.col("value")
    upper = F.coalesce(kept & pres.between(0, 100), F.lit(False))
    rows = rows.withColumns({"_v": F.when(kept, value), "_w": F.when(upper, value), "_bin": depth_bin(pres)})
    values: list[Column] = []
    if wanted(*BIN_COLUMNS):
        place, size = _running([*group, "_bin"], "_v")
        rows = rows.withColumns({"_bi": place, "_bn": size})
        values += [F.avg(F.when((F.col("_bin") == i) & _middle("_bi", "_bn"), F.col("_v"))).alias(c) for i, c in enumerate(BIN_COLUMNS, 1)]
    if wanted("full_value", "upper_100_value"):
        # One sort for both: what lies deeper is left out of the running count.
        whole = Window.partitionBy(*group)
        upto = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({f"{p}{n}": F.count(f"_{v}").over(over) for v, p in (("v", "_f"), ("w", "_u")) for n, over in (("i", upto), ("n", whole))})
        values += [F.avg(F.when(_middle("_fi", "_fn"), F.col("_v"))).alias("full_value"), F.avg(F.when(_middle("_ui", "_un"), F.col("_w"))).alias("upper_100_value")]
    if wanted("shallow_value"):
        values.append(F.min_by(value, F.when(kept & pres.between(0, 10), level_order(have))).alias("shallow_value"))
    names = dict(zip(_count_names(), _counts(kept, pres, have)))
    counts = [c for n, c in names.items() if wanted(n)]
    place = ("time", "latitude", "longitude")
    ends = [f(c).alias(f"{n}_{c}") for c in place for f, n in ((F.min, "lo"), (F.max, "hi"), (F.count, "n"))]
    facts = rows.groupBy(*group).agg(*counts, *ends, F.count("*").alias("_rows"), *values)
    same = [F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}")) & F.col(f"n_{c}").isin(F.lit(0), F.col("_rows")) for c in place]
    one_float = F.count("*").over(Window.partitionBy("parameter", "profile_id")) == 1
    out = facts.withColumn("uniform", reduce(Column.__and__, same) & one_float)
    out = out.withColumnsRenamed({f"lo_{c}": c for c in place})
    return out.drop("_rows", *[f"{n}_{c}" for c in place for n in ("hi", "n")])


def finished(quick: DataFrame, keys) -> DataFrame:
    """The columns of ``profile_facts`` from uniform quick facts."""
    ident = F.struct("platform_number", "time", "latitude", "longitude")
    out = quick.withColumns({f"{s}_id": F.when(F.col(f"{s}_value").isNotNull(), ident) for s in PROFILE_SETS})
    if "distance_km" in quick.columns:
        out = out.withColumn("nearest_km", F.when(F.col("valid_rows") > 0, F.col("distance_km")))
    out = out.withColumn("platform_number", F.when(F.col("valid_rows") > 0, F.col("platform_number")))
    return out.drop("time", "latitude", "longitude", "distance_km")


def _mixed_rows(rows: DataFrame, quick: DataFrame) -> DataFrame | None:
    """Observations of the profiles that are not uniform; None when there are none (the usual case)."""
    mixed = quick.where(~F.col("uniform")).select("profile_id").distinct()
    return None if mixed.isEmpty() else rows.join(mixed, "profile_id", "left_semi")


def with_mixed(uniform: DataFrame, exact: DataFrame | None) -> DataFrame:
    return uniform if exact is None else uniform.unionByName(exact.select(*uniform.columns))


def ranked_values(kept: DataFrame) -> DataFrame:
    """Values of the three sets and extent of every (parameter, profile) of kept rows.

    Medians are the middle of ranked rows: one sort of what one shuffle brings, with no object per profile, and a profile of any
    size spills instead of filling memory.
    """
    pres, value = F.col("pres"), F.col("value")
    whole = Window.partitionBy("parameter", "profile_id")
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upper = F.coalesce(pres.between(0, 100), F.lit(False))
    rows = kept.withColumn("_upper", upper.cast("int"))
    rows = rows.withColumns({"_i": F.count("*").over(upto), "_u": F.sum("_upper").over(upto)})
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_m": F.sum("_upper").over(whole)})

    def middle(place: str, size: str) -> Column:
        return (F.col(place) * 2).between(F.col(size), F.col(size) + 2)

    shallow = F.when(pres.between(0, 10), level_order(kept.columns))
    ends = [f(c).alias(f"{n}_{c}") for c in IDENTITY for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return rows.groupBy("parameter", "profile_id").agg(
        *ends,
        F.avg(F.when(middle("_i", "_n"), value)).alias("full_value"),
        F.avg(F.when((F.col("_upper") == 1) & middle("_u", "_m"), value)).alias("upper_100_value"),
        F.min_by(value, shallow).alias("shallow_value"),
    )


def observation_sets(obs: DataFrame) -> DataFrame:
    """Values and identities of the three sets of every profile, for temperature and salinity.

    The columns of ``observation_facts`` that ``profile_set`` and ``profile_sets`` read. Only kept rows are shuffled.
    """
    columns = [c for c in ("source_row",) if c in obs.columns]
    kept = judged_both(obs).where("kept").select("parameter", "profile_id", *IDENTITY, "pres", *columns, "value")
    quick = written(ranked_values(kept), "sets")
    one = [F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}")) for c in IDENTITY]
    quick = quick.withColumn("uniform", reduce(Column.__and__, one))
    identity = F.struct(*[F.col(f"lo_{c}").alias(c) for c in IDENTITY])
    values = [f"{s}_value" for s in PROFILE_SETS]
    ids = [F.when(F.col(f"{s}_value").isNotNull(), identity).alias(f"{s}_id") for s in PROFILE_SETS]
    mixed = _mixed_rows(obs, quick)
    if mixed is None:
        return quick.select("parameter", "profile_id", *values, *ids)
    uniform = quick.join(mixed.select("profile_id").distinct(), "profile_id", "left_anti").select("parameter", "profile_id", *values, *ids)
    return with_mixed(uniform, profile_facts(judged_both(mixed), ("parameter",)))


def observation_facts(obs: DataFrame) -> DataFrame:
    """Facts of every profile for temperature and salinity, keyed by parameter."""
    keys = ("parameter",)
    quick = written(quick_facts(obs), "profiles")
    mixed = _mixed_rows(obs, quick)
    exact = None if mixed is None else profile_facts(judged_both(mixed), keys)
    if exact is not None:
        quick = quick.join(mixed.select("profile_id").distinct(), "profile_id", "left_anti")
    return with_mixed(finished(quick, keys), exact)


def selected_facts(obs: DataFrame, selections: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Facts keyed by selection and asked parameter.

    The observations inside the common box and period are reduced to profiles once, whatever the number
    of selections; only profiles meet the selections.
    """
    quick, exact = reduced_profiles(obs, selections, max_broadcast_rows)
    return with_mixed(finished(select_profiles(quick, selections, max_broadcast_rows), KEYS), exact)


def reduced_profiles(obs: DataFrame, selections: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS, need=None) -> tuple[DataFrame, DataFrame | None]:
    """Quick facts of the uniform profiles, and the facts of all others (if any) per selection and asked parameter.

    ``need`` names the columns that quick facts are wanted for.
    """
    inside = within_hull(obs, selection_spans(selections))
    quick = written(quick_facts(inside, need), "profiles")
    mixed = _mixed_rows(inside, quick)
    if mixed is None:
        return quick, None
    quick = quick.join(mixed.select("profile_id").distinct(), "profile_id", "left_anti")
    return quick, profile_facts(by_parameter(select_observations(mixed, selections, max_broadcast_rows)))


def excluded_profiles(obs: DataFrame, selections: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """As ``quality.excluded_profiles`` of ``selected_facts``: profiles with rows inside a selection of which none was kept.

    Only counts are taken, and only profiles without a kept row meet the selections, those that ask for the same rows once.
    Profiles with several places or times go row by row, as a selection may hold a part of them.
    """
    unique, members = alike(selections)
    unique = written(unique, "selections")
    inside = within_hull(obs, selection_spans(unique))
    place = ("latitude", "longitude", "time")
    ends = [f(c).alias(f"{n}_{c}") for c in place for f, n in ((F.min, "lo"), (F.max, "hi"), (F.count, "n"))]
    counts = judged_both(inside).groupBy("parameter", "profile_id").agg(F.count("*").alias("raw_rows"), F.count_if("kept").alias("_kept"), *ends)
    one = [F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}")) & F.col(f"n_{c}").isin(F.lit(0), F.col("raw_rows")) for c in place]
    counts = counts.withColumn("uniform", reduce(Column.__and__, one)).where(~F.col("uniform") | (F.col("_kept") == 0))
    counts = written(counts.select("parameter", "profile_id", "raw_rows", *[F.col(f"lo_{c}").alias(c) for c in place], "uniform"), "excluded")
    out = select_profiles(counts.where("uniform"), unique, max_broadcast_rows).select(*KEYS, "profile_id", "raw_rows")
    mixed = _mixed_rows(inside, counts)
    if mixed is not None:
        judged = by_parameter(select_observations(mixed, unique, max_broadcast_rows))
        exact = judged.groupBy(*KEYS, "profile_id").agg(F.count("*").alias("raw_rows"), F.count_if("kept").alias("_kept"))
        out = out.unionByName(exact.where("_kept = 0").drop("_kept"))
    return for_members(out, members)


def profile_facts(judged: DataFrame, keys=KEYS) -> DataFrame:
    kept, pres, value = F.col("kept"), F.col("pres"), F.col("value")
    slabs = {"full": kept, "shallow": kept & pres.between(0, 10), "upper_100": kept & pres.between(0, 100)}
    identity = F.struct("platform_number", "time", "latitude", "longitude")
    rows, levels = row_order(judged.columns), level_order(judged.columns)
    aggs = _counts(kept, pres, judged.columns)
    for name, inside in slabs.items():
        order = levels if name == "shallow" else rows
        aggs.append(F.min_by(identity, F.when(inside, order)).alias(f"{name}_id"))
        if name == "shallow":
            aggs.append(F.min_by(value, F.when(inside, levels)).alias("shallow_value"))
        else:
            aggs.append(F.median(F.when(inside, value)).alias(f"{name}_value"))
    aggs += _bin_medians(kept, pres, value)
    if "distance_km" in judged.columns:
        aggs.append(F.min(F.when(kept, F.col("distance_km"))).alias("nearest_km"))
    facts = judged.groupBy(*keys, "profile_id").agg(*aggs)
    return facts.withColumns({"platform_number": F.col("full_id.platform_number"), "uniform": F.lit(False)})


def profile_set(facts: DataFrame, name: str, keys=KEYS) -> DataFrame:
    """keys, profile_id, platform_number, time, latitude, longitude, profile_value of one set."""
    return facts.where(F.col(f"{name}_value").isNotNull()).select(
        *keys, "profile_id", f"{name}_id.*", F.col(f"{name}_value").alias("profile_value")
    )


def profile_sets(facts: DataFrame, keys=("parameter",)) -> DataFrame:
    """The three sets of every parameter below each other, without another pass over the facts."""
    entry = F.array(
        *[
            F.struct(
                F.lit("" if s == "full" else f"_{s}").alias("suffix"),
                F.col(f"{s}_id").alias("id"),
                F.col(f"{s}_value").alias("v"),
            )
            for s in PROFILE_SETS
        ]
    )
    flat = facts.select(*keys, "profile_id", F.explode(entry).alias("e")).where(F.col("e.v").isNotNull())
    others = [k for k in keys if k != "parameter"]
    return flat.select(
        F.concat("parameter", F.col("e.suffix")).alias("parameter"),
        *others,
        "profile_id",
        "e.id.*",
        F.col("e.v").alias("profile_value"),
    )
