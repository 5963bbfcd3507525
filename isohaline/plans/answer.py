"""Whole tables of selections answered in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohaline.functions.measures import climatology_parameter, unit_of
from isohaline.operators import levels, pools
from isohaline.operators.anomaly import baseline_month, lookup_climatology, score
from isohaline.operators.evidence import evidence_checks, evidence_grade, quality_warning, score_allowed
from isohaline.operators.pools import Pools, facts, pooled, raw_counts, representative_values, values_and_audit
from isohaline.operators.quality import KEYS, by_parameter
from isohaline.operators.selection import (
    alike,
    for_members,
    no_data_probe,
    normalise_parameters,
    resolve_radii,
    select_observations,
    selection_violations,
    with_region_bounds,
)
from isohaline.operators.supplementary import (
    anomaly_trend,
    density_profile,
    heat_content,
    month_depth_grid,
    seasonal_cycle,
    ts_pairs,
    year_over_year,
)
from isohaline.operators.views import both_monthly_means, depth_profile
from isohaline.plans.report import LIVE_CAVEAT, SHALLOW_CAVEAT
from isohaline.session import written
from isohaline.vocabulary import FLOAT_POSITION_LIMIT, THRESHOLDS, TRACE_LIMIT


class _Late:
    """A field that may be given as a function, which is called when the field is first read."""

    def __set_name__(self, owner, name):
        self.slot = f"_{name}"

    def __get__(self, obj, owner=None):
        if obj is None:
            raise AttributeError(self.slot)  # no default
        value = getattr(obj, self.slot)
        if callable(value):
            value = value()
            setattr(obj, self.slot, value)
        return value

    def __set__(self, obj, value):
        setattr(obj, self.slot, value)


@dataclass
class Prepared:
    """Selections with their state, judged rows and profile facts: what every view starts from.

    Rows, facts and pools are worked out when they are first read: an answer needs neither judged rows nor single facts.
    """

    rejected: DataFrame
    selections: DataFrame
    judged: DataFrame = _Late()
    facts: DataFrame = _Late()
    found: list[Pools] = _Late()
    sources: list[tuple[DataFrame, DataFrame]] = _Late()


def prepare(obs: DataFrame, selections: DataFrame, keep: bool = True, secondary: DataFrame | None = None) -> Prepared:
    """Validate, resolve radii, select, judge and reduce to profile facts.

    ``secondary`` holds observations of a second source. Dated point selections that match no row of ``obs``, not even after
    widening, take the rows of ``secondary`` at the radius asked for; ``live_source_used`` of the selections tells which did.

    With ``keep`` the resolved selections are written out; the profile table always is. So the branches of an
    answer read two small tables instead of scanning the observations again.
    """
    checked = selection_violations(with_region_bounds(selections))
    valid = checked.where(F.size("violations") == 0).drop("violations")
    valid = valid.withColumn("parameters", normalise_parameters(F.col("parameters")))
    resolved = resolve_radii(obs, valid)
    if keep:
        resolved = written(resolved, "selections")
    sources = [(obs, resolved)]
    found = None
    if secondary is not None:
        dated = F.col("date_from").isNotNull() & F.col("date_to").isNotNull()
        empty = written(resolved.where((F.col("matched") == F.lit(False)) & dated), "without-rows")
        found = [pooled(obs, resolved), pooled(secondary, empty)]
        sources.append((secondary, empty))
        filled = raw_counts(found[1]).select("selection_id").distinct().withColumn("_filled", F.lit(True))
        filled = written(filled, "filled")
        resolved = resolved.join(filled, "selection_id", "left").withColumns({
            "live_source_used": F.coalesce("_filled", F.lit(False)), "matched": F.coalesce("_filled", "matched"),
        }).drop("_filled")

    def judged() -> DataFrame:
        rows = [by_parameter(select_observations(*source)) for source in sources]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)

    rejected = checked.where(F.size("violations") > 0).select("selection_id", "violations")
    prepared = Prepared(rejected, resolved, judged, None, found or (lambda: [pooled(obs, resolved)]), sources)
    prepared.facts = lambda: reduce(DataFrame.unionByName, map(facts, prepared.found))
    return prepared


def targets(prepared: Prepared) -> DataFrame:
    """One row per selection and asked parameter."""
    return prepared.selections.withColumn("parameter", F.explode("parameters"))


def graded(prepared: Prepared, climatology: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    """Audit, representative value, climatology, grade and score of every selection and parameter.

    Selections without rows stay in the result with status ``no_data``.
    """
    keys = list(KEYS)
    values, audit, near = (reduce(DataFrame.unionByName, t) for t in zip(*map(values_and_audit, prepared.found)))
    values = values.withColumnRenamed("view", "query_type")
    base = (
        targets(prepared)
        .join(audit, keys, "left")
        .join(values, [*keys, "query_type"], "left")
        .join(near, keys, "left")
        .withColumn("status", F.when(F.col("raw_count").isNull(), "no_data").otherwise("ok"))
        .fillna(0, ["raw_count", "valid_count", "excluded_count", "raw_profile_count", "valid_profile_count",
                    "excluded_profile_count", "distinct_float_count", "qc_pass_rate"])
        .withColumns(
            {
                "baseline_parameter": climatology_parameter(F.col("parameter"), F.col("query_type")),
                "baseline_month": baseline_month(
                    F.col("query_type"), F.col("calendar_month"), F.col("month"), F.col("last_month"), F.col("date_to")
                ),
            }
        )
    )
    looked = evidence_grade(lookup_climatology(base, climatology), thresholds)
    scored = score(looked)
    gate = {c: F.when(score_allowed(), F.col(c)) for c in ("z_score", "score_label", "direction", "baseline_period")}
    return scored.withColumns(gate).withColumns(
        {"unit": unit_of(F.col("parameter")), "quality_warning": quality_warning(thresholds)}
    )


def answer(
    obs: DataFrame, selections: DataFrame, climatology: DataFrame, thresholds: dict = THRESHOLDS, keep: bool = True, secondary: DataFrame | None = None
) -> DataFrame:
    """One row per selection and parameter: status, value, score, grade and sufficiency.

    Rejected selections appear once, with their violations. With a ``secondary`` source, live_source_used and
    live_source_caveat tell where a value comes from.
    """
    prepared = prepare(obs, selections, keep, secondary)
    return assemble(prepared, graded(prepared, climatology, thresholds))


ANSWER_COLUMNS = (
    "selection_id parameter status query_type current_value unit z_score score_label evidence_grade evidence_reasons "
    "raw_count valid_count raw_profile_count valid_profile_count distinct_float_count qc_pass_rate quality_warning "
    "baseline_parameter baseline_month baseline_selection_id baseline_mean baseline_std baseline_n "
    "requested_radius_km actual_radius_km radius_expanded nearest_observation_km nearest_available_km "
    "suggested_radius_km violations"
).split()


def assemble(prepared: Prepared, rows: DataFrame) -> DataFrame:
    probe = no_data_probe(prepared.selections).select("selection_id", "nearest_available_km", "suggested_radius_km")
    out = rows.join(probe, "selection_id", "left").withColumn("violations", F.array().cast("array<string>"))
    rejected = prepared.rejected.withColumn("status", F.lit("rejected"))
    columns = [*ANSWER_COLUMNS]
    if "live_source_used" in out.columns:
        out = out.withColumn("live_source_caveat", F.when(F.col("live_source_used"), LIVE_CAVEAT))
        columns += ["live_source_used", "live_source_caveat"]
    return out.select(*columns).unionByName(rejected, allowMissingColumns=True)


def any_warning(rows: DataFrame) -> DataFrame:
    """Does any parameter of the selection carry a warning?"""
    return rows.groupBy("selection_id").agg(F.bool_or("quality_warning").alias("data_quality_warning"))


def views(prepared: Prepared) -> DataFrame:
    """Value of every view of the kept rows, the asked one marked primary; views without a value are absent."""
    asked = prepared.selections.select("selection_id", "query_type")
    values = reduce(DataFrame.unionByName, map(representative_values, prepared.found))
    return values.join(asked, "selection_id").withColumn("is_primary", F.col("view") == F.col("query_type")).drop("query_type")


def view_tables(prepared: Prepared) -> dict[str, DataFrame]:
    """The long tables behind the three views."""
    return {"bins": depth_profile(prepared.facts), "months": both_monthly_means(prepared.facts)}


def supplementary_views(prepared: Prepared, climatology: DataFrame) -> dict[str, DataFrame]:
    """The seven extra views; one that has nothing to show is an empty table with its schema."""
    return {
        "ts_diagram": ts_pairs(prepared.judged),
        "density_profile": density_profile(prepared.judged),
        "heat_content": heat_content(prepared.judged),
        "hovmoller": month_depth_grid(prepared.judged),
        "seasonal_cycle": seasonal_cycle(prepared.facts),
        "year_over_year": year_over_year(prepared.facts),
        "anomaly_trend": anomaly_trend(prepared.facts, prepared.selections, climatology),
    }


def _trace(obs: DataFrame, selections: DataFrame, limit: int) -> DataFrame:
    """``trace_sample`` from level arrays; selections that ask for the same rows and view meet the profiles once."""
    unique, members = alike(selections, "query_type")
    return for_members(levels.trace(levels.selected_levels(obs, written(unique, "selections")), limit), members)


def evidence_panel(
    prepared: Prepared, rows: DataFrame, thresholds: dict = THRESHOLDS,
    trace_limit: int = TRACE_LIMIT, position_limit: int = FLOAT_POSITION_LIMIT,
) -> DataFrame:
    """Nested panel per selection and parameter, a report whose arrays are bounded by the two limits.

    The lists of the trace are samples and say so; the whole trace is ``traced_rows``, all positions ``float_positions``.
    """
    keys = list(KEYS)
    profiles = prepared.selections.where(F.col("query_type") == "profile").select("selection_id")
    bins = reduce(DataFrame.unionByName, map(pools.depth_profile, prepared.found)).join(profiles, "selection_id", "left_semi").groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bin_no", "depth_bin", "profile_count"))),
            lambda e: F.struct(e["depth_bin"].alias("depth_bin"), e["profile_count"].alias("profile_count")),
        ).alias("aggregation_counts_per_bin")
    )
    order = F.struct((-F.col("profile_count")).alias("_o"), "platform_number", "latitude", "longitude", "profile_count")
    places = reduce(DataFrame.unionByName, [pools.float_positions(p, position_limit) for p in prepared.found])
    positions = places.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(order)),
            lambda e: F.struct(
                e["platform_number"].alias("float_id"), e["latitude"].alias("latitude"),
                e["longitude"].alias("longitude"), e["profile_count"].alias("profile_count"),
            ),
        ).alias("float_positions")
    )
    sources = reduce(DataFrame.unionByName, [_trace(*source, trace_limit) for source in prepared.sources]).select(
        *keys, "profile_ids", "float_ids", "source_records", F.col("truncated").alias("trace_sample_truncated")
    )
    checked = rows.where(F.col("status") == "ok").withColumn("evidence_checks", evidence_checks(thresholds))
    out = checked.join(bins, keys, "left").join(positions, keys, "left").join(sources, keys, "left")
    panel = F.struct(
        "raw_profile_count", "valid_profile_count", "excluded_profile_count",
        F.col("raw_count").alias("raw_observation_count"), F.col("valid_count").alias("valid_observation_count"),
        F.col("excluded_count").alias("excluded_observation_count"), "distinct_float_count", "qc_pass_rate",
        "exclusion_reasons", "baseline_grid_cell", "baseline_selection_id",
        F.col("baseline_month").alias("baseline_month_used"), "baseline_distinct_float_count",
        "evidence_checks", F.transform("aggregation_counts_per_bin", lambda b: b["depth_bin"]).alias("depth_bins_used"),
        F.when(F.col("parameter") == "shallow_sst_proxy", SHALLOW_CAVEAT).alias("proxy_caveat"), "aggregation_counts_per_bin", "float_positions",
        F.col("profile_ids").alias("contributing_profile_ids"), F.col("float_ids").alias("contributing_float_ids"),
        F.col("source_records").alias("source_record_sample"), "trace_sample_truncated",
    )
    return out.select(*keys, panel.alias("evidence_panel"))
