"""Views, climatology, grades, scores and whole answers on hand-computed tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import by, obs_frame, obs_row, selection, selections
from isohaline.operators import anomaly, climatology, evidence, lineage, profiles, quality, selection as sel_ops, supplementary, views
from isohaline.plans import answer as plan
from isohaline.plans import report
from isohaline.schema import CLIMATOLOGY, ContractError
from isohaline.sources.observations import columns_for, guard_production, read_climatology, write_climatology, write_observations

K = ("parameter",)


def two_profiles(spark, parameter="temperature"):
    levels = {5.0: 30.0, 20.0: 28.0, 75.0: 25.0, 150.0: 20.0}
    rows = [obs_row("1", "1", pres=p, temp=t, row=i) for i, (p, t) in enumerate(levels.items())]
    rows += [obs_row("2", "1", pres=p, temp=t - 1, row=10 + i) for i, (p, t) in enumerate(levels.items())]
    judged = quality.judge(obs_frame(spark, rows), parameter)
    return judged, profiles.profile_facts(judged, K)


def four_casts(spark):
    rows = []
    for y in (2023, 2024):
        for m in (1, 7):
            for i, p in enumerate((0.0, 50.0, 150.0, 300.0)):
                rows.append(obs_row("1", f"{y}{m}", day=f"{y}-{m:02d}-05", pres=p, temp=28 - p / 50 + (y - 2023), psal=35.0, row=len(rows)))
    judged = quality.judge(obs_frame(spark, rows), "temperature")
    return judged, profiles.profile_facts(judged, K)


def test_depth_profile_and_full_column_value(spark):
    _, facts = two_profiles(spark)
    bins = by(views.depth_profile(facts, K).collect(), "depth_bin")
    assert len(bins) == 4 and bins["0–10"].value == 29.5 and bins["0–10"].profile_count == 2
    value = by(views.representative_values(facts, K).collect(), "view")
    assert value["profile"].current_value == 26.0 and value["profile"].represented == 4


def test_shallow_series_takes_the_top_row(spark):
    _, facts = two_profiles(spark, "shallow_sst_proxy")
    assert [r.value for r in views.monthly_means(facts, "time_series", K).collect()] == [29.5]


def test_mean_of_months_is_unweighted(spark):
    rows = [obs_row("1", str(i), day="2024-01-05", pres=5.0, temp=10.0) for i in range(3)] + [obs_row("1", "9", day="2024-02-05", pres=5.0, temp=20.0)]
    facts = profiles.profile_facts(quality.judge(obs_frame(spark, rows), "temperature"), K)
    got = views.regional_average(facts, K).first()
    assert (got.annual_mean, got.represented_months) == (15.0, 2)


def test_only_deep_rows_give_no_profile_view(spark):
    facts = profiles.profile_facts(quality.judge(obs_frame(spark, [obs_row(pres=800.0)]), "temperature"), K)
    assert "profile" not in by(views.representative_values(facts, K).collect(), "view")


def test_seasonal_years_and_band(spark):
    _, facts = four_casts(spark)
    season = by(supplementary.seasonal_cycle(facts, K).collect(), "calendar_month")
    assert sorted(season) == [1, 7] and season[1].n_profiles == 2
    assert {r.year for r in supplementary.year_over_year(facts, K).collect()} == {2023, 2024}
    band = report.baseline_band(supplementary.seasonal_cycle(facts, K)).first()
    assert band.band_low < band.mean < band.band_high
    one_year = facts.where("full_id.time < '2024-01-01'")
    assert supplementary.year_over_year(one_year, K).count() == 0
    assert [r["std"] for r in supplementary.seasonal_cycle(one_year, K).collect()] == [0.0, 0.0]


def test_heat_content_matches_the_trapezoid(spark):
    judged, _ = four_casts(spark)
    got = supplementary.heat_content(judged, K).first()
    # Linear in pressure: mean of the end values times the thickness, for both years.
    expected = ((28 + 22) / 2 + 0.5) * 300 * 1025 * 3850 / 1e6
    assert got.value_mj_per_m2 == pytest.approx(expected) and got.profile_count == 4
    salt = quality.judge(judged.select(*[c for c in judged.columns if c not in ("parameter", "value", "reject_reason", "kept")]), "salinity")
    assert supplementary.heat_content(salt, K).count() == 0


def test_density_and_month_grid(spark):
    judged, _ = four_casts(spark)
    rho = by(supplementary.density_profile(judged, K).collect(), "depth_bin")
    assert 1020 < rho["0–10"].density < rho["300–500"].density < 1030
    grid = supplementary.scale_cells(supplementary.month_depth_grid(judged, K), K).collect()
    assert min(r.scaled for r in grid) == 0.0 and max(r.scaled for r in grid) == 1.0 and len(grid) == 16


def test_ts_pairs_are_whole_and_their_sample_repeatable(spark):
    judged, _ = four_casts(spark)
    many = judged.withColumn("source_row", F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i * 1000 + F.col("source_row"))))
    assert supplementary.ts_pairs(many, K).count() == 640
    one, two = supplementary.ts_pairs(many, K, 500).collect(), supplementary.ts_pairs(many.repartition(7), K, 500).collect()
    assert len(one) == 500 and sorted(map(str, one)) == sorted(map(str, two))
    assert (one[0].profile_count, one[0].pair_count) == (4, 640)


def test_one_bad_salinity_flag_removes_one_pair(spark):
    judged, _ = four_casts(spark)
    worse = judged.withColumn("psal_adjusted_qc", F.when(F.col("source_row") == 0, "4").otherwise(F.col("psal_adjusted_qc")))
    assert quality.paired(judged).count() - quality.paired(worse).count() == 1


def test_parameters_of_a_series_keep_apart(spark):
    rows = [("s", "2024-07", "temperature", 10.0), ("s", "2024-07", "shallow_sst_proxy", 30.0), ("s", "2024-07", "salinity", 35.0)]
    got = views.merge_parameter_series(spark.createDataFrame(rows, "selection_id string, month string, parameter string, value double")).first()
    assert (got.temperature, got.shallow_sst_proxy, got.salinity) == (10.0, 30.0, 35.0)


def test_short_numbers_and_coordinates(spark):
    df = spark.createDataFrame([(1234.5678,), (300.12345,), (300.0,), (0.5,), (999.99996,), (25.0,)], "x double")
    assert [r[0] for r in df.select(report.short_number(F.col("x"))).collect()] == ["1234.57", "300.123", "300", "0.5", "1000", "25"]
    assert df.limit(1).select(report.coordinate(F.lit(12.345678), "N", "S", F.lit(9))).first()[0] == "12.3457°N"


def traced(spark, rows, view, parameter="temperature"):
    judged = quality.judge(obs_frame(spark, rows), "temperature").withColumns({"selection_id": F.lit("s"), "parameter": F.lit(parameter)})
    asked = selections(spark, selection("s", view=view, parameters=(parameter,)))
    return lineage.traced_rows(judged, profiles.profile_facts(judged, lineage.KEYS), asked)


def test_trace_follows_the_view(spark):
    rows = [obs_row("1", "1", pres=5.0, row=1), obs_row("1", "1", pres=60.0, row=2), obs_row("1", "1", pres=250.0, row=3), obs_row("2", "1", pres=700.0, row=4)]
    shown = lambda view, *p: sorted((r.source_row, r.month, r.bin_no) for r in traced(spark, rows, view, *p).collect())
    assert shown("regional_average") == [(1, "2024-07", None), (2, "2024-07", None)]
    assert [r[0] for r in shown("profile")] == [1, 2, 3, 4] and shown("profile")[3] == (4, None, None)
    assert all(r[1] is None and r[2] is not None for r in shown("profile")[:3])
    assert [r[:2] for r in shown("time_series")] == [(i, "2024-07") for i in (1, 2, 3, 4)]
    assert [r[1] for r in shown("time_series", "shallow_sst_proxy")] == ["2024-07"] * 3 + [None]
    deep = [obs_row("2", "1", pres=700.0, row=4)]
    assert traced(spark, deep, "profile").count() == 0 and traced(spark, deep, "time_series", "shallow_sst_proxy").count() == 0
    per = {r.bin_no: r.observation_count for r in lineage.trace_counts(traced(spark, rows, "profile"), "bin_no").collect()}
    assert sum(per.values()) == 3 and len(per) == 3


def test_trace_is_cut_and_sorted_by_row_number(spark):
    rows = [obs_row("1", f"{i:03d}", row=i) for i in range(30)]
    got = lineage.trace_sample(traced(spark, rows, "time_series"), 25).first()
    assert got.truncated and len(got.profile_ids) == 25 and got.source_records[:3] == ["a.csv:0", "a.csv:1", "a.csv:2"]
    assert got.source_records[10] == "a.csv:10" and got.float_ids == ["1"]


def test_a_profile_over_the_end_of_a_month_stays_in_the_month_of_its_first_row(spark):
    rows = [obs_row("1", "1", "2024-07-31", pres=5.0, row=1), obs_row("1", "1", "2024-08-01", pres=60.0, row=2)]
    for view in ("time_series", "regional_average"):
        assert {r.month for r in traced(spark, rows, view).collect()} == {"2024-07"}


@pytest.mark.parametrize(
    ("z", "label"),
    [(1.49, "normal"), (1.5, "mild_positive"), (2.49, "mild_positive"), (2.5, "strong_positive"), (-1.5, "mild_negative"), (-2.5, "strong_negative")],
)
def test_score_labels(spark, z, label):
    row = {"current_value": z, "baseline_mean": 0.0, "baseline_std": 1.0, "baseline_year_min": 2000, "baseline_year_max": 2010}
    assert anomaly.score(spark.createDataFrame([row])).first().score_label == label


def test_no_score_without_spread(spark):
    row = {"current_value": 1.0, "baseline_mean": 0.0, "baseline_std": 0.0, "baseline_year_min": 2000, "baseline_year_max": 2010}
    got = anomaly.score(spark.createDataFrame([row])).first()
    assert got.z_score is None and got.score_label is None


@pytest.mark.parametrize(
    ("vp", "n", "std", "floats", "rate", "reviewed", "grade", "reasons"),
    [
        (4, 20, 1.0, 3, 0.9, True, "Insufficient", ["valid_profiles_below_5"]),
        (5, 9, 1.0, 3, 0.9, True, "Insufficient", ["baseline_n_below_minimum"]),
        (5, 20, 0.0, 3, 0.9, True, "Insufficient", ["baseline_std_zero"]),
        (5, 20, 1.0, 1, 0.2, True, "Indicative", ["distinct_floats_below_minimum", "qc_pass_rate_below_minimum"]),
        (5, 20, 1.0, 2, 0.3, True, "Supported", ["all_grade_conditions_met"]),
        (5, 20, 1.0, 2, 0.3, False, "Insufficient", ["evidence_thresholds_pending_review"]),
        (4, None, None, 2, 0.3, False, "Insufficient", ["valid_profiles_below_5", "baseline_std_zero", "evidence_thresholds_pending_review"]),
    ],
)
def test_grades(spark, vp, n, std, floats, rate, reviewed, grade, reasons):
    ddl = "valid_profile_count bigint, baseline_n bigint, baseline_std double, distinct_float_count bigint, qc_pass_rate double"
    df = spark.createDataFrame([(vp, n, std, floats, rate)], ddl)
    limits = {**evidence.THRESHOLDS, "reviewed": reviewed}
    got = evidence.evidence_grade(df, limits).withColumn("checks", evidence.evidence_checks(limits)).first()
    assert (got.evidence_grade, got.evidence_reasons) == (grade, reasons)
    assert got.checks[1].passed is (None if not reviewed else (n or 0) >= 10)


def july(spark, **kw):
    return [obs_row(str(1 + i % 2), str(i), day=f"2024-07-{10 + i:02d}", pres=p, temp=28.0 + i / 10, row=2 * i + j, **kw) for i in range(6) for j, p in enumerate((5.0, 50.0))]


def base_rows(spark, kind="production"):
    row = (kind, "p", "", "temperature", "grid", "grid-18-72", 18.0, 72.0, 7, 27.0, 1.0, 40, 5, 2000, 2024)
    return spark.createDataFrame([row], CLIMATOLOGY)


def test_answer_end_to_end(spark):
    obs = obs_frame(spark, july(spark))
    sel = selections(
        spark, selection("ok"), selection("bad", radius=5000.0), selection("none", lat=-30.0),
        selection("far", lat=22.4, radius=300.0), selection("explicit", lat=22.4, radius=300.0, explicit=True),
    )
    prepared = plan.prepare(obs, sel)
    rows = plan.graded(prepared, base_rows(spark))
    got = by(plan.assemble(prepared, rows).collect(), "selection_id")
    ok = got["ok"]
    assert (ok.status, ok.raw_count, ok.valid_profile_count, ok.distinct_float_count, ok.evidence_grade) == ("ok", 12, 6, 2, "Supported")
    assert ok.z_score is not None and ok.baseline_month == 7 and ok.nearest_observation_km == pytest.approx(0.0, abs=1e-6)
    assert (got["bad"].status, got["bad"].violations) == ("rejected", ["radius_out_of_range"])
    assert got["none"].status == "no_data"
    assert got["far"].radius_expanded and got["far"].actual_radius_km == 500.0 and 300 < got["far"].nearest_observation_km < 500
    assert got["explicit"].status == "no_data" and got["explicit"].suggested_radius_km == 450.0
    other = {r.view for r in plan.views(prepared).where("selection_id = 'ok' and not is_primary").collect()}
    assert other == {"time_series", "regional_average"}
    panel = by(plan.evidence_panel(prepared, rows).collect(), "selection_id")["ok"].evidence_panel
    short = by(plan.evidence_panel(prepared, rows, trace_limit=1, position_limit=1).collect(), "selection_id")["ok"].evidence_panel
    assert len(short.source_record_sample) == len(short.float_positions) == 1 and short.valid_profile_count == panel.valid_profile_count
    assert panel.baseline_grid_cell.asDict() == {"south": 18.0, "west": 72.0, "north": 20.0, "east": 74.0}
    assert len(panel.evidence_checks) == 5 and len(panel.float_positions) == 2
    extra = plan.supplementary_views(prepared, base_rows(spark))
    assert set(extra) == {"ts_diagram", "density_profile", "heat_content", "hovmoller", "seasonal_cycle", "year_over_year", "anomaly_trend"}
    assert extra["anomaly_trend"].where("selection_id = 'ok'").count() == 1 and extra["year_over_year"].count() == 0
    text = by(report.narrate(rows.where("status = 'ok'")).collect(), "selection_id")
    assert text["ok"].title == "temperature; depth profile; ok; 2024"
    assert "widened from 300 km" in text["far"].summary


def test_evidence_panel_needs_no_judged_rows_and_shows_both_sources(spark):
    first = obs_frame(spark, july(spark) + [obs_row("9", "m", day=f"2024-07-{1 + k:02d}", lat=19.0 + k % 2, pres=30.0 + k, row=90 + k) for k in range(4)])
    second = obs_frame(spark, july(spark)).withColumns({"latitude": F.col("latitude") - 40, "_source_file": F.lit("live.csv")})
    both = ("temperature", "salinity")
    prepared = plan.prepare(first, selections(spark, selection("ok", parameters=both), selection("same", parameters=both), selection("south", lat=-21.0)), secondary=second)
    rows = plan.graded(prepared, base_rows(spark))
    keys = ("selection_id", "parameter")
    got = {k: r.evidence_panel for k, r in by(plan.evidence_panel(replace(prepared, judged=None), rows).collect(), *keys).items()}
    sample = by(lineage.trace_sample(lineage.traced_rows(prepared.judged, prepared.facts, prepared.selections), 25).collect(), *keys)
    places = {(r.selection_id, r.parameter, r.platform_number, r.latitude, r.longitude, r.profile_count) for r in lineage.float_positions(prepared.judged, prepared.facts).collect()}
    assert set(got) == set(sample) == {(s, p) for s in ("ok", "same") for p in both} | {("south", "temperature")}
    for k, r in sample.items():
        assert (got[k].contributing_profile_ids, got[k].contributing_float_ids, got[k].source_record_sample) == (r.profile_ids, r.float_ids, r.source_records)
        assert got[k].trace_sample_truncated == r.truncated and got[k].valid_profile_count == r.profile_count
    assert places == {(*k, e.float_id, e.latitude, e.longitude, e.profile_count) for k, p in got.items() for e in p.float_positions}


def test_result_does_not_depend_on_partitioning(spark):
    rows, sel = july(spark), selections(spark, selection("ok", view="time_series", parameters=("temperature", "salinity")))
    a, b = (
        sorted(map(str, views.representative_values(profiles.selected_facts(o, sel)).collect()))
        for o in (obs_frame(spark, rows), obs_frame(spark, rows[::-1]).repartition(5))
    )
    assert a == b and len(a) == 6


def test_lookup_falls_back_region_cell_global(spark):
    def row(kind, sid, month, mean, la=None, lo=None):
        return ("production", "p", "", "temperature", kind, sid, la, lo, month, mean, None, 1, 1, 2000, 2001)

    clim = spark.createDataFrame(
        [row("region", "arabian-sea", 1, 1.0), row("grid", "grid-16-64", 1, 2.0, 16.0, 64.0), row("global", "all-available", 1, 3.0),
         row("grid", "grid-16-64", 2, 4.0, 16.0, 64.0), row("global", "all-available", 3, 5.0)], CLIMATOLOGY)
    targets = spark.createDataFrame(
        [("a", "temperature", m, "arabian-sea", 16.5, 65.0) for m in (1, 2, 3, 4)],
        "id string, baseline_parameter string, baseline_month int, region_id string, latitude double, longitude double",
    )
    got = {r.baseline_month: (r.baseline_mean, r.baseline_std) for r in anomaly.lookup_climatology(targets, clim).collect()}
    assert got == {1: (1.0, 0.0), 2: (4.0, 0.0), 3: (5.0, 0.0), 4: (None, None)}


def test_climatology_tables_stay_apart(spark, tmp_path):
    table = climatology.build_climatology(climatology.climatology_sets(obs_frame(spark, july(spark))))
    write_climatology(table, str(tmp_path / "p"), str(tmp_path / "v"))
    assert read_climatology(spark, str(tmp_path / "p")).count() > 0
    assert spark.read.parquet(str(tmp_path / "v")).count() == 0
    with pytest.raises(ContractError):
        guard_production(base_rows(spark, "validation"))


def test_written_observations_prune_years(spark, tmp_path):
    rows = [obs_row(cycle=str(y), day=f"{y}-07-10") for y in (2020, 2021, 2022)]
    write_observations(obs_frame(spark, rows), str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    picked = sel_ops.select_observations(back, selections(spark, selection(d1="2021-01-01", d2="2021-12-31")))
    text = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in text and "PushedFilters: [IsNotNull(latitude)" in text
    assert [r.profile_id for r in picked.collect()] == ["1:2021"]


def test_columns_for_a_parameter():
    have = ["time", "temp", "temp_adjusted", "psal", "psal_adjusted", "pres"]
    assert columns_for("salinity", have) == ["time", "pres", "psal", "psal_adjusted", "temp_adjusted"]


def test_secondary_rows_fill_only_dated_points_without_rows(spark):
    local = spark.createDataFrame([("a", 1)], "selection_id string, v int")
    second = spark.createDataFrame([("a", 2), ("b", 3), ("r", 4)], "selection_id string, v int")
    sel = selections(spark, selection("a"), selection("b"), selection("r", region="arabian-sea", bounds=(8.0, 25.0, 55.0, 75.0)))
    got = {(r.selection_id, r.v, r.live_source_used) for r in sel_ops.fill_from_secondary(local, second, sel).collect()}
    assert got == {("a", 1, False), ("b", 3, True)}


def test_parameter_lists(spark):
    df = spark.createDataFrame([(["all"],), (["salinity", "salinity"],), (None,)], "p array<string>")
    got = [r[0] for r in df.select(sel_ops.normalise_parameters(F.col("p"))).collect()]
    assert got == [["temperature", "salinity"], ["salinity"], ["temperature"]]



def test_second_source_fills_what_the_first_leaves_empty(spark):
    first = obs_frame(spark, july(spark)).where("platform_number = '1'")
    second = obs_frame(spark, july(spark)).withColumns({"latitude": F.col("latitude") - 40, "_source_file": F.lit("live.csv")})
    sel = selections(spark, selection("ok"), selection("south", lat=-21.0), selection("nowhere", lat=-80.0), selection("bad", radius=5000.0))
    out = plan.answer(first, sel, base_rows(spark), secondary=second)
    got = by(out.collect(), "selection_id")
    assert (got["ok"].status, got["ok"].live_source_used, got["ok"].live_source_caveat) == ("ok", False, None)
    assert got["south"].status == "ok" and got["south"].live_source_used and got["south"].live_source_caveat and got["south"].valid_count == 12
    assert got["nowhere"].status == "no_data" and not got["nowhere"].live_source_used and got["bad"].status == "rejected"
    assert "live_source_used" not in plan.answer(first, sel, base_rows(spark)).columns


def test_the_climatology_is_read_once_by_its_audit_and_groups_by_numbers(spark, tmp_path):
    rows = [obs_row(cycle=f"{m}-{i}", day=f"2005-{m:02d}-10", lat=10.0 + i, temp=20.0 + i) for m in (1, 2) for i in range(4)]
    climatology.climatology_sets(obs_frame(spark, rows)).write.parquet(str(tmp_path / "sets"))
    table = climatology.build_climatology(spark.read.parquet(str(tmp_path / "sets")))
    audit = climatology.climatology_audit(table)
    assert audit._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    of = {r.baseline_type: r for r in audit.collect()}
    sizes = sorted(r.n for r in table.where("baseline_type = 'validation'").collect())
    found = of["validation"]
    assert (found.n_rows, found.n_min, found.n_max, found.n_median) == (len(sizes), sizes[0], sizes[-1], (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2)
    assert "selection_id" not in table._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)[1]  # no names on the rows
