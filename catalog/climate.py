"""Climatology, its lookup, scores, evidence, trend and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixture import observations, selections, table
from catalog.selecting import batch_pools, r6
from catalog.sqlparts import BATCH_FACTS, CLIM, CLIM_FROM_SETS, SETS, dist, profile_sets, with_
from isohaline.functions.measures import climatology_parameter
from isohaline.operators import anomaly, climatology, evaluate, evidence, pools, selection, supplementary
from isohaline.sources.cases import type_cases


def _sets(spark, sf_dir):
    return climatology.climatology_sets(observations(spark, sf_dir))


def _climatology(spark, sf_dir):
    return climatology.build_climatology(_sets(spark, sf_dir))


def _production(spark, sf_dir):
    return _climatology(spark, sf_dir).where(F.col("baseline_type") == "production")


def _stats():
    return [r6("mean"), r6("std"), "n", "distinct_float_count", "year_min", "year_max"]


def _part(kind):
    def query(spark, sf_dir):
        rows = _production(spark, sf_dir).where(F.col("selection_type") == kind)
        return rows.select("parameter", "selection_id", "calendar_month", *_stats())

    query.__doc__ = f"Production climatology of the {kind} selections."
    return query


def climatology_all(spark, sf_dir):
    return _climatology(spark, sf_dir).select("baseline_type", "parameter", "selection_type", "selection_id", "calendar_month", *_stats())


def quality_totals(spark, sf_dir):
    out = climatology.quality_totals(observations(spark, sf_dir))
    return out.withColumn("qc_pass_rate", F.round("qc_pass_rate", 6))


def climatology_audit(spark, sf_dir):
    out = climatology.climatology_audit(_climatology(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if c.startswith(("n_", "floats_")) and c != "n_rows" else F.col(c) for c in out.columns])


def named_region_rows(spark, sf_dir):
    return climatology.named_region_rows(_production(spark, sf_dir))


_PROBES = [
    {"probe_id": "a_circle", "parameter": "temperature", "years": (1995, 2001), "month": 7, "circle": (15.0, 70.0, 400.0)},
    {"probe_id": "b_shallow", "parameter": "temperature_shallow", "years": (1997, 1999), "circle": (12.0, 60.0, 300.0)},
    {"probe_id": "c_box", "parameter": "salinity_upper_100", "years": (1998, 1998), "box": (5.0, 22.0, 80.0, 100.0)},
]


def coverage_probe(spark, sf_dir):
    return climatology.coverage_probe(_sets(spark, sf_dir), _PROBES)


# -- scores -----------------------------------------------------------------------------------------
def _targets(spark, sf_dir):
    """Representative value of every view of every selection, with what it is compared with."""
    return _compared(pools.representative_values(batch_pools(spark, sf_dir)), spark, sf_dir)


def _compared(values, spark, sf_dir):
    sel = selections(spark, sf_dir).select("selection_id", "region_id", "latitude", "longitude", "calendar_month", "date_to")
    values = values.join(sel, "selection_id")
    month = anomaly.baseline_month(F.col("view"), F.col("calendar_month"), F.lit(None).cast("int"), F.col("last_month"), F.col("date_to"))
    return values.withColumns({"baseline_parameter": climatology_parameter(F.col("parameter"), F.col("view")), "baseline_month": month})


def _looked(spark, sf_dir):
    return anomaly.lookup_climatology(_targets(spark, sf_dir), _climatology(spark, sf_dir))


def climatology_lookup(spark, sf_dir):
    return _looked(spark, sf_dir).select(
        "selection_id", "parameter", "view", "baseline_parameter", "baseline_month", "baseline_selection_type",
        "baseline_selection_id", r6("baseline_mean"), r6("baseline_std"), "baseline_n", F.col("baseline_grid_cell.south").alias("cell_south"),
    )


def anomaly_score(spark, sf_dir):
    out = anomaly.score(_looked(spark, sf_dir))
    return out.select("selection_id", "parameter", "view", r6("z_score"), "score_label", "direction", "baseline_period")


def anomaly_trend(spark, sf_dir):
    found = batch_pools(spark, sf_dir, "region_id", "latitude", "longitude")
    out = supplementary.score_months(pools.full_column_months(found), found.selections, _climatology(spark, sf_dir))
    out = selection.for_members(out, found.members)
    return out.select("selection_id", "parameter", "month", r6("z_score"), "label", r6("current_value"), r6("baseline_mean"))


def _audited(spark, sf_dir):
    values, audit, _near = pools.values_and_audit(batch_pools(spark, sf_dir))
    looked = anomaly.lookup_climatology(_compared(values, spark, sf_dir), _climatology(spark, sf_dir))
    return looked.join(audit, ["selection_id", "parameter"])


def evidence_grade(spark, sf_dir):
    out = evidence.evidence_grade(_audited(spark, sf_dir))
    return out.select(
        "selection_id", "parameter", "view", "evidence_grade", F.concat_ws(",", "evidence_reasons").alias("reasons"),
        evidence.score_allowed().alias("score_allowed"), evidence.quality_warning().alias("quality_warning"),
    )


def evidence_checks(spark, sf_dir):
    out = _audited(spark, sf_dir).select("selection_id", "parameter", "view", F.inline(evidence.evidence_checks()))
    return out.select("selection_id", "parameter", "view", "key", r6("value"), "threshold", "passed")


# -- evaluation -------------------------------------------------------------------------------------
_CASE = {
    "case_id": "concat('C', CAST(p_partkey AS {text}))",
    "label": "CASE p_partkey % 7 WHEN 0 THEN 'upper_ocean_anomaly' WHEN 1 THEN 'upper_ocean_anomaly' WHEN 2 THEN 'measurement_quality_problem' "
    "WHEN 3 THEN 'ambiguous_excluded' ELSE 'normal_ocean_state' END",
    "current_value": "CASE WHEN p_partkey % 31 = 0 THEN 'n/a' ELSE CAST(20.0E0 + p_size * 0.25E0 AS {text}) END",
    "regional_mean": "CAST(25.0E0 AS {text})",
    "regional_std": "CASE WHEN p_partkey % 13 = 0 THEN '0' ELSE CAST(1.0E0 + p_partkey % 5 AS {text}) END",
    "unfiltered_mean": "CAST(26.0E0 AS {text})",
    "unfiltered_std": "CASE WHEN p_partkey % 11 = 0 THEN 'NaN' ELSE '2.5' END",
    "qc_current": "CASE WHEN p_partkey % 17 = 0 THEN 'inf' ELSE CAST(20.0E0 + p_size * 0.25E0 AS {text}) END",
    "production_mean": "CAST(26.5E0 AS {text})",
    "production_std": "CAST(1.5E0 AS {text})",
    "evidence_grade": "CASE p_partkey % 4 WHEN 0 THEN 'Insufficient' WHEN 1 THEN 'Indicative' ELSE 'Supported' END",
    "eligible": "CASE p_partkey % 6 WHEN 0 THEN 'no' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'Yes' ELSE '1' END",
    "dataset_version": "'v1'",
    "label_reference": "p_name",
}
_RATIOS = ("precision", "recall", "query_coverage", "f1", "false_alert_rate")


def method_eval(spark, sf_dir):
    """Labelled cases made from the part table."""
    cases = table(spark, sf_dir, "part").selectExpr(*[f"{e.format(text='STRING')} AS {n}" for n, e in _CASE.items()])
    out = evaluate.evaluate_methods(type_cases(cases))
    return out.select(*[F.round(c, 6).alias(c) if c in _RATIOS else F.col(c) for c in out.columns])


def run_report(spark, sf_dir):
    """The events table as a run log: event type = mode, value = latency."""
    events = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_id") % 10 == 0, "invalid").when(F.col("event_id") % 3 == 0, "wrong").otherwise("correct")
    runs = events.select(F.col("event_type").alias("mode"), outcome.alias("outcome"), F.col("value").alias("latency_ms"))
    out = evaluate.run_report(runs)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("_ms", "_rate")) else F.col(c) for c in out.columns])


QUERIES = {
    "climatology_global": _part("global"),
    "climatology_grid": _part("grid"),
    "climatology_region": _part("region"),
    "climatology_all": climatology_all,
    "quality_totals": quality_totals,
    "climatology_audit": climatology_audit,
    "named_region_rows": named_region_rows,
    "coverage_probe": coverage_probe,
    "climatology_lookup": climatology_lookup,
    "anomaly_score": anomaly_score,
    "anomaly_trend": anomaly_trend,
    "evidence_grade": evidence_grade,
    "evidence_checks": evidence_checks,
    "method_eval": method_eval,
    "run_report": run_report,
}

_ROW = (
    "SELECT parameter, selection_id, calendar_month, round(mean, 6) AS mean, round(std, 6) AS std, n, distinct_float_count, year_min, year_max "
    "FROM prod WHERE selection_type = '{k}'"
)
# Representative values of the three views, by definition.
VALUES = (
    "pm AS (SELECT selection_id, parameter, 'time_series' AS view, strftime(time, '%Y-%m') AS month, "
    "CASE WHEN parameter = 'shallow_sst_proxy' THEN shallow_value ELSE full_value END AS v FROM facts UNION ALL "
    "SELECT selection_id, parameter, 'regional_average', strftime(time, '%Y-%m'), upper_100_value FROM facts), "
    "vals AS (SELECT selection_id, parameter, view, avg(m) AS current_value, max(month) AS last_month FROM "
    "(SELECT selection_id, parameter, view, month, avg(v) AS m FROM pm WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL UNION ALL "
    "SELECT selection_id, parameter, 'profile', avg(full_value), NULL FROM facts GROUP BY selection_id, parameter HAVING sum(rows_0_500) > 0)"
)
# Batch facts and the climatology side by side.
BASE = ", ".join([BATCH_FACTS, profile_sets("c_"), CLIM_FROM_SETS])
LOOK = (
    "tg AS (SELECT v.*, s.region_id, s.latitude, s.longitude, "
    "CASE WHEN view = 'regional_average' AND v.parameter = 'salinity' THEN 'salinity_upper_100' WHEN view = 'regional_average' THEN 'temperature_upper_100' "
    "WHEN v.parameter = 'shallow_sst_proxy' THEN 'temperature_shallow' ELSE v.parameter END AS baseline_parameter, "
    "CAST(coalesce(s.calendar_month, CASE WHEN view = 'time_series' THEN CAST(substr(last_month, 6, 2) AS INT) END, month(s.date_to)) AS INT) AS baseline_month "
    "FROM vals v JOIN sel s USING (selection_id)), "
    "cand AS (SELECT t.selection_id, t.parameter, t.view, c.*, CASE c.selection_type WHEN 'region' THEN 1 WHEN 'grid' THEN 2 ELSE 3 END AS rk "
    "FROM tg t JOIN (SELECT parameter AS bp, selection_type, selection_id AS bsid, calendar_month AS bm, mean, std, n, year_min, year_max FROM prod) c "
    "ON c.bp = t.baseline_parameter AND c.bm = t.baseline_month AND ((c.selection_type = 'region' AND c.bsid = t.region_id) OR c.selection_type = 'global' OR "
    "(c.selection_type = 'grid' AND c.bsid = 'grid-' || CAST(CAST(floor(t.latitude / 2) * 2 AS INT) AS VARCHAR) || '-' || CAST(CAST(floor(t.longitude / 2) * 2 AS INT) AS VARCHAR)))), "
    "best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY selection_id, parameter, view ORDER BY rk) = 1), "
    "looked AS (SELECT tg.*, b.selection_type AS btype, b.bsid, b.mean AS bmean, CASE WHEN b.n IS NOT NULL THEN coalesce(b.std, 0.0) END AS bstd, b.n AS bn, b.year_min, b.year_max "
    "FROM tg LEFT JOIN best b ON b.selection_id = tg.selection_id AND b.parameter = tg.parameter AND b.view = tg.view), "
    "scored AS (SELECT *, CASE WHEN bstd > 0 THEN (current_value - bmean) / bstd END AS z FROM looked)"
)
Z_LABEL = (
    "CASE WHEN abs(z) < 1.5 THEN 'normal' WHEN abs(z) < 2.5 THEN CASE WHEN z > 0 THEN 'mild_positive' ELSE 'mild_negative' END "
    "WHEN z IS NOT NULL THEN CASE WHEN z > 0 THEN 'strong_positive' ELSE 'strong_negative' END END"
)
GRADED = (
    "aud AS (SELECT selection_id, parameter, count(*) FILTER (reason IS NULL) / count(*) AS rate, count(DISTINCT profile_id) FILTER (reason IS NULL) AS vp, "
    "count(DISTINCT platform_number) FILTER (reason IS NULL) AS fl FROM judged GROUP BY ALL), "
    "gr AS (SELECT s.*, rate, vp, fl, coalesce(bn, 0) AS n0, coalesce(bstd, 0.0) AS s0, "
    "CASE WHEN vp < 5 OR coalesce(bstd, 0.0) <= 0 OR coalesce(bn, 0) < 10 THEN 'Insufficient' WHEN fl < 2 OR rate < 0.3 THEN 'Indicative' ELSE 'Supported' END AS grade "
    "FROM scored s JOIN aud USING (selection_id, parameter))"
)
_DEC = "CASE WHEN {s} > 0 THEN abs(({c} - {m}) / {s}) >= 1.5 END"
_NUM = "CASE WHEN isfinite(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END AS {c}"
_DIST5 = ", ".join(
    f"round(quantile_cont({c}, {q}), 6) AS {p}_{n}"
    for c, p in (("n", "n"), ("distinct_float_count", "floats"))
    for n, q in (("min", 0), ("p10", 0.1), ("median", 0.5), ("p90", 0.9), ("max", 1))
)

ORACLES = {
    **{f"climatology_{k}": with_(CLIM) + _ROW.format(k=k) for k in ("global", "grid", "region")},
    "climatology_all": with_(CLIM)
    + "SELECT baseline_type, parameter, selection_type, selection_id, calendar_month, round(mean, 6) AS mean, round(std, 6) AS std, n, "
    "distinct_float_count, year_min, year_max FROM clim",
    "quality_totals": with_(SETS)
    + "SELECT parameter, count(*) AS raw_observations, count(*) FILTER (reason IS NULL) AS qc_passed_observations, "
    "round(count(*) FILTER (reason IS NULL) / count(*), 6) AS qc_pass_rate, count(DISTINCT profile_id) FILTER (reason IS NULL) AS qc_passed_profiles, "
    "count(DISTINCT platform_number) FILTER (reason IS NULL) AS distinct_floats FROM judged GROUP BY parameter",
    "climatology_audit": with_(CLIM) + f"SELECT baseline_type, count(*) AS n_rows, {_DIST5} FROM clim GROUP BY baseline_type",
    "named_region_rows": with_(CLIM) + "SELECT selection_id, count(*) AS n_rows FROM prod WHERE selection_type = 'region' GROUP BY 1",
    "coverage_probe": with_(SETS)
    + "SELECT *, bool_and(profiles > 0) OVER () AS all_pinned_selections_present FROM (SELECT 'a_circle' AS probe_id, count(*) AS profiles FROM sets WHERE parameter = 'temperature' "
    f"AND month(time) = 7 AND {dist('15.0', '70.0', 'latitude', 'longitude')} <= 400 UNION ALL SELECT 'b_shallow', count(*) FROM sets WHERE parameter = 'temperature_shallow' "
    f"AND year(time) BETWEEN 1997 AND 1999 AND {dist('12.0', '60.0', 'latitude', 'longitude')} <= 300 UNION ALL SELECT 'c_box', count(*) FROM sets "
    "WHERE parameter = 'salinity_upper_100' AND year(time) = 1998 AND latitude BETWEEN 5 AND 22 AND longitude BETWEEN 80 AND 100)",
    "climatology_lookup": with_(BASE, VALUES, LOOK)
    + "SELECT selection_id, parameter, view, baseline_parameter, baseline_month, btype AS baseline_selection_type, bsid AS baseline_selection_id, "
    "round(bmean, 6) AS baseline_mean, round(bstd, 6) AS baseline_std, bn AS baseline_n, CASE WHEN btype = 'grid' THEN CAST(floor(latitude / 2) * 2 AS DOUBLE) END AS cell_south FROM looked",
    "anomaly_score": with_(BASE, VALUES, LOOK)
    + f"SELECT selection_id, parameter, view, round(z, 6) AS z_score, {Z_LABEL} AS score_label, CASE WHEN z >= 0 THEN 'above' WHEN z < 0 THEN 'below' END AS direction, "
    "CASE WHEN z IS NOT NULL THEN year_min || '–' || year_max END AS baseline_period FROM scored",
    "anomaly_trend": with_(
        BASE,
        "vals AS (SELECT selection_id, parameter, 'time_series' AS view, strftime(time, '%Y-%m') AS last_month, avg(full_value) AS current_value FROM facts "
        "WHERE full_value IS NOT NULL GROUP BY ALL)",
        LOOK.replace("s.calendar_month, ", "", 1)
        .replace("t.view, c.*", "t.view, t.last_month, c.*")
        .replace("PARTITION BY selection_id, parameter, view", "PARTITION BY selection_id, parameter, last_month")
        .replace("AND b.view = tg.view", "AND b.last_month = tg.last_month"),
    )
    + f"SELECT selection_id, parameter, last_month AS month, round(z, 6) AS z_score, {Z_LABEL} AS label, round(current_value, 6) AS current_value, "
    "round(bmean, 6) AS baseline_mean FROM scored WHERE z IS NOT NULL",
    "evidence_grade": with_(BASE, VALUES, LOOK, GRADED)
    + "SELECT selection_id, parameter, view, grade AS evidence_grade, CASE grade WHEN 'Supported' THEN 'all_grade_conditions_met' WHEN 'Indicative' THEN "
    "concat_ws(',', CASE WHEN fl < 2 THEN 'distinct_floats_below_minimum' END, CASE WHEN rate < 0.3 THEN 'qc_pass_rate_below_minimum' END) ELSE "
    "concat_ws(',', CASE WHEN vp < 5 THEN 'valid_profiles_below_5' END, CASE WHEN s0 <= 0 THEN 'baseline_std_zero' END, CASE WHEN n0 < 10 THEN 'baseline_n_below_minimum' END) END AS reasons, "
    "grade <> 'Insufficient' AND bmean IS NOT NULL AND current_value IS NOT NULL AS score_allowed, vp < 5 OR rate < 0.3 AS quality_warning FROM gr",
    "evidence_checks": with_(BASE, VALUES, LOOK, GRADED)
    + " UNION ALL ".join(
        f"SELECT selection_id, parameter, view, '{key}' AS key, round(CAST({v} AS DOUBLE), 6) AS value, CAST({lim} AS DOUBLE) AS threshold, {v} {op} {lim} AS passed FROM gr"
        for key, v, op, lim in (
            ("valid_profile_count", "vp", ">=", 5),
            ("baseline_observation_count", "n0", ">=", 10),
            ("distinct_float_count", "fl", ">=", 2),
            ("qc_pass_rate", "rate", ">=", 0.3),
            ("baseline_variability", "s0", ">", 0),
        )
    ),
    "method_eval": with_(
        "raw AS (SELECT " + ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in _CASE.items()) + " FROM part)",
        "num AS (SELECT case_id, label, evidence_grade, eligible, "
        + ", ".join(_NUM.format(c=c) for c in _CASE if c.split("_")[-1] in ("value", "mean", "std", "current"))
        + " FROM raw WHERE lower(eligible) IN ('1','true','yes') AND label <> 'ambiguous_excluded')",
        "d AS (SELECT label, 'regional_average' AS method, " + _DEC.format(c="current_value", m="regional_mean", s="regional_std") + " AS d FROM num UNION ALL "
        "SELECT label, 'unfiltered_z_score', " + _DEC.format(c="current_value", m="unfiltered_mean", s="unfiltered_std") + " FROM num UNION ALL "
        "SELECT label, 'qc_filtered_evidence_graded', CASE WHEN evidence_grade <> 'Insufficient' THEN " + _DEC.format(c="qc_current", m="production_mean", s="production_std") + " END FROM num)",
        "c AS (SELECT method, count(*) AS eligible_cases, count(*) FILTER (label <> 'measurement_quality_problem' AND d IS NOT NULL) AS covered_binary_cases, "
        "count(*) FILTER (label IN ('upper_ocean_anomaly','normal_ocean_state')) AS nb, count(*) FILTER (d AND label = 'upper_ocean_anomaly') AS tp, "
        "count(*) FILTER (d AND label = 'normal_ocean_state') AS fp, count(*) FILTER (NOT d AND label = 'normal_ocean_state') AS tn, count(*) FILTER (NOT d AND label = 'upper_ocean_anomaly') AS fn, "
        "count(*) FILTER (NOT d AND label = 'measurement_quality_problem') AS measurement_rejected, count(*) FILTER (d AND label = 'measurement_quality_problem') AS measurement_falsely_alerted, "
        "count(*) FILTER (d IS NULL AND label = 'measurement_quality_problem') AS measurement_uncovered FROM d GROUP BY method)",
    )
    + "SELECT * EXCLUDE (nb, p, r), round(p, 6) AS precision, round(r, 6) AS recall, round(covered_binary_cases / nullif(nb, 0), 6) AS query_coverage, "
    "round(2 * p * r / nullif(p + r, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS false_alert_rate FROM (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c)",
    "run_report": "SELECT event_type AS mode, count(*) AS run_count, count(*) FILTER (event_id % 10 <> 0 AND event_id % 3 <> 0) AS correct_count, "
    "count(*) FILTER (event_id % 10 = 0) AS invalid_output_count, round(avg(value), 6) AS mean_latency_ms, round(quantile_disc(value, 0.95), 6) AS p95_latency_ms, "
    "round(count(*) FILTER (event_id % 10 <> 0 AND event_id % 3 <> 0) / count(*), 6) AS success_rate, round(count(*) FILTER (event_id % 10 = 0) / count(*), 6) AS invalid_output_rate "
    "FROM events GROUP BY event_type",
}
