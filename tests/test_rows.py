"""Row-level rules: quality filter, geography, typing, de-duplication, medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from helpers import by, obs_frame, obs_row, selection, selections
from isohaline.functions import geo, measures
from isohaline.operators import binning, ingest, medians, profiles, quality
from isohaline.operators.selection import recurring_select, select_observations, selection_violations
from isohaline.schema import ContractError, check_observations


def test_quality_filter_counts_the_first_failed_check(spark):
    rows = [
        obs_row("1", "1"),
        obs_row("1", "2", position="4", mode="R"),
        obs_row("1", "3", mode="R"),
        obs_row("1", "4", temp_qc="4"),
        obs_row("1", "5", temp=None),
    ]
    judged = quality.judge(obs_frame(spark, rows), "temperature")
    reasons = {r.reject_reason: r.n_rows for r in quality.reason_counts(judged, ["parameter"]).collect()}
    assert reasons == dict.fromkeys(("position_qc_not_1", "real_time_mode_excluded", "adjusted_qc_not_1", "null_adjusted_value"), 1)
    assert [r.value for r in judged.where("kept").collect()] == [28.0]
    audit = quality.quality_audit(profiles.profile_facts(judged, ("parameter",)), ("parameter",)).first()
    assert (audit.raw_count, audit.valid_count, audit.excluded_profile_count, audit.data_quality_warning) == (5, 1, 4, True)
    assert audit.raw_count == audit.valid_count + sum(audit.exclusion_reasons.values())


def test_quality_filter_trims_and_ignores_the_case_of_the_mode(spark):
    rows = [obs_row(mode=" d\t", position=" 1 ", temp_qc="1 "), obs_row("1", "2", temp=float("nan"))]
    kept = {r.profile_id: r.kept for r in quality.judge(obs_frame(spark, rows), "temperature").collect()}
    assert kept == {"1:1": True, "1:2": False}


def test_one_degree_of_latitude(spark):
    km = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(70.0), F.lit(1.0), F.lit(70.0))).first()[0]
    assert km == pytest.approx(111.195, rel=1e-3)


@pytest.mark.parametrize(("lon", "wrapped"), [(180.0, -180.0), (190.0, -170.0), (-190.0, 170.0), (72.5, 72.5)])
def test_longitude_wrap(spark, lon, wrapped):
    assert spark.range(1).select(geo.wrap_longitude(F.lit(lon))).first()[0] == pytest.approx(wrapped)


def test_depth_bins_are_left_closed_and_keep_500(spark):
    df = spark.createDataFrame([(p,) for p in (-1.0, 0.0, 9.99, 10.0, 300.0, 500.0, 500.1)], "pres double")
    assert [r[0] for r in df.select(measures.depth_bin(F.col("pres"))).collect()] == [None, 1, 1, 2, 7, 7, None]


def test_winter_keeps_three_months(spark):
    rows = [obs_row(cycle=str(m), day=f"2024-{m:02d}-10") for m in range(1, 13)]
    months = {r.calendar_month for r in recurring_select(obs_frame(spark, rows), season="winter").collect()}
    assert months == {12, 1, 2}
    with pytest.raises(ValueError):
        recurring_select(obs_frame(spark, rows), calendar_month=1, season="winter")


def test_last_day_of_the_period_counts_and_box_clips_the_circle(spark):
    rows = [obs_row(cycle="1", day="2024-07-31T23:59:59"), obs_row(cycle="2", day="2024-08-01"), obs_row(cycle="3", lon=75.66)]
    obs = obs_frame(spark, rows)
    found = select_observations(obs, selections(spark, selection()))
    # 75.66 E lies inside the 300 km circle around 72.8 E at 19 N but outside the search box.
    assert {r.profile_id for r in found.collect()} == {"1:1"} or {r.profile_id for r in found.collect()} == {"1:1", "1:3"}
    for r in found.collect():
        assert r.distance_km <= 300


def test_only_decimal_text_is_a_number(spark):
    texts = ["12", " -1.5e3 ", ".5", "7.", "12d", "3f", "0x1p3", "nan", "inf", "", "1,5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(measures.to_number(F.col("t"))).collect()]
    assert got == [12.0, -1500.0, 0.5, 7.0, None, None, None, None, float("inf"), None, None]


def test_bins_from_a_table(spark):
    bins = spark.createDataFrame([(10.0, 20.0, "b"), (0.0, 10.0, "a"), (30.0, 40.0, "c")], "lower double, upper double, label string")
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 10.0, 20.0, 29.9, 30.0, 40.0, 41.0, None, float("nan"))], "pres double")
    got = [r.bin_label for r in binning.bin_by_bounds(rows, bins).collect()]
    assert got == [None, "a", "b", None, None, "c", "c", None, None, None]
    with pytest.raises(ValueError):
        binning.bin_by_bounds(rows, bins.unionByName(bins))
    assert binning.bin_by_bounds(rows, bins.limit(0)).where("bin_label IS NOT NULL").count() == 0


def test_a_time_needs_a_date(spark):
    df = spark.createDataFrame([("12:30:00",), ("T10:00",), ("2024-07-10T01:02:03Z",), (" 2024-07-10",)], "t string")
    got = [r[0] for r in df.select(measures.to_utc(F.col("t"))).collect()]
    assert got[:2] == [None, None] and [str(x) for x in got[2:]] == ["2024-07-10 01:02:03", "2024-07-10 00:00:00"]


def test_selection_rules_for_bounds_precision_and_repeated_ids(spark):
    good = selection("a")
    far = selection("b", region="r", bounds=(8.0, 95.0, 55.0, 185.0))
    rows = selections(spark, good, far, selection("c"), selection("c"), selection("d"))
    rows = rows.withColumn("coordinate_precision", F.when(F.col("selection_id") == "d", 7).otherwise(F.col("coordinate_precision")))
    got = {r.selection_id: r.violations for r in selection_violations(rows).collect()}
    assert got == {"a": [], "b": ["bounds_out_of_range"], "c": ["duplicate_id"], "d": ["precision_out_of_range"]}


def test_broadcast_and_shuffled_joins_agree(spark):
    rng = random.Random(1)
    rows = [obs_row(cycle=str(i), lat=rng.uniform(10, 25), lon=rng.uniform(60, 80), row=i) for i in range(400)]
    obs = obs_frame(spark, rows)
    sel = selections(
        spark, selection("a"), selection("b", lat=15.0, lon=66.0, radius=700.0),
        selection("r", lat=16.5, lon=65.0, region="arabian-sea", bounds=(8.0, 25.0, 55.0, 75.0)),
    )
    one = sorted((r.selection_id, r.profile_id) for r in select_observations(obs, sel).collect())
    two = sorted((r.selection_id, r.profile_id) for r in select_observations(obs, sel, max_broadcast_rows=0).collect())
    assert one == two and len(one) == len(set(one)) and len(one) > 100


def test_the_cell_tree_spreads_a_crowded_sea_and_loses_no_row(spark):
    from isohaline.operators import selection as sel_mod

    rng = random.Random(2)
    rows = [obs_row(cycle=str(i), lat=rng.uniform(-60, 60), lon=rng.uniform(-170, 170), row=i) for i in range(600)]
    rows += [obs_row(cycle=str(i), lat=rng.uniform(18, 20), lon=rng.uniform(72, 74), row=i) for i in range(600, 900)]  # one cell
    rows += [obs_row(cycle=str(i), lat=18.125, lon=72.25, row=i) for i in range(900, 1200)]  # one place, on the edge of a part
    obs = obs_frame(spark, rows)
    sel = selections(
        spark, selection("a"), selection("b", lat=18.1, lon=72.2, radius=8.0), selection("c", lat=-20.0, lon=100.0, radius=2000.0),
        selection("edge", lat=18.0, lon=72.25, region="r", bounds=(18.125, 20.0, 72.25, 74.0)),
        selection("whole", lat=0.0, lon=0.0, region="w", bounds=(-60.0, 60.0, -170.0, 170.0)),
    )
    one = sorted((r.selection_id, r.profile_id) for r in select_observations(obs, sel).collect())
    two = sorted((r.selection_id, r.profile_id) for r in select_observations(obs, sel, max_broadcast_rows=0).collect())
    assert one == two and len(one) == len(set(one)) and {s for s, _ in one} == {"a", "b", "c", "edge", "whole"}
    placed = obs.withColumns({"_cy": geo.cell_index(F.col("latitude")), "_cx": geo.cell_index(F.col("longitude"))})
    crowded = sel_mod.crowded_cells(placed, F.lit(20))
    assert [(r._cy, r._cx) for r in crowded.collect()] == [(9, 36)]
    leaves = {(leaf.d, leaf.y, leaf.x): leaf.k for leaf in crowded.first().leaves}
    assert max(leaves.values()) >= 15 and leaves[(4, 1, 2)] == max(leaves.values())  # the one place is split by a hash
    assert len({d for d, _, _ in leaves}) > 1  # deep only where rows crowd
    spread = sel_mod._spread_rows(placed, crowded)
    assert spread.count() == len(rows)
    sizes = [r["count"] for r in spread.repartition(8, "_cy", "_cx", "_leaf").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 4 * statistics.median(sizes)
    plain = [r["count"] for r in placed.repartition(8, "_cy", "_cx").groupBy(F.spark_partition_id()).count().collect()]
    assert max(plain) > 4 * statistics.median(plain)


def test_dedup_prefers_mode_then_source_row_within_a_file(spark):
    rows = [
        obs_row(mode="R", row=3), obs_row(mode="D", row=9), obs_row(mode="D", row=7), obs_row(mode="d", row=1),
        obs_row(mode="A", row=2, file="b.csv"),
    ]
    kept = sorted((r._source_file, r.source_row) for r in ingest.dedup_levels(obs_frame(spark, rows)).collect())
    assert kept == [("a.csv", 7), ("b.csv", 2)]
    assert [r.source_row for r in ingest.dedup_levels(obs_frame(spark, rows), scope="global").collect()] == [7]


def test_hot_level_is_trimmed_before_the_shuffle(spark):
    df = ingest.dedup_levels(obs_frame(spark, [obs_row(row=i) for i in range(50)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert df.count() == 1


def test_contract_names_missing_columns(spark):
    with pytest.raises(ContractError, match="psal_adjusted"):
        check_observations(obs_frame(spark, [obs_row()]).drop("psal_adjusted"))


@pytest.mark.parametrize("n", [1, 2, 7, 200])
def test_exact_median_against_brute_force(spark, n):
    rng = random.Random(n)
    data = [(g, rng.choice([rng.uniform(-5, 5), round(rng.uniform(-5, 5), 1)])) for g in "ab" for _ in range(n)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.m, r.n_values) for r in medians.exact_median(df, ["g"], "v", 0.5, "m").collect()}
    for g in "ab":
        values = [v for k, v in data if k == g]
        assert got[g] == (pytest.approx(statistics.median(values)), n)
    ranked = {r.g: r.p for r in medians.nearest_rank(df, ["g"], "v", 0.5, 0.95, "p").collect()}
    for g in "ab":
        values = sorted(v for k, v in data if k == g)
        assert ranked[g] == values[max(0, int(0.95 * n + 0.999999) - 1)]


def test_profiles_with_several_places_take_the_exact_way(spark):
    rows = [obs_row(cycle="1", pres=p, lat=19.0, temp=20 + p, row=i) for i, p in enumerate((5.0, 50.0, 150.0))]
    rows += [obs_row(cycle="2", pres=p, lat=19.0 + i, temp=10 + p, row=10 + i) for i, p in enumerate((5.0, 50.0, 150.0))]
    obs, sel = obs_frame(spark, rows), selections(spark, selection(radius=150.0))
    got = by(profiles.selected_facts(obs, sel).collect(), "profile_id")
    want = by(profiles.profile_facts(quality.by_parameter(select_observations(obs, sel))).collect(), "profile_id")
    assert set(got) == {"1:1", "1:2"}
    for key, row in want.items():
        for column in ("raw_rows", "valid_rows", "full_value", "upper_100_value", "shallow_value", "full_id", "bin_1", "bin_4"):
            assert got[key][column] == row[column], (key, column)
    # Of profile 2 only the two rows within 150 km count.
    assert got["1:2"].raw_rows == 2 and got["1:2"].full_value == pytest.approx(37.5)
    assert got["1:2"].full_id.latitude == 19.0


def test_stored_observations_are_pruned_by_the_selections_cells(spark, tmp_path):
    from isohaline.operators.selection import select_observations
    from isohaline.sources.observations import read_observations, read_selected, write_observations

    rows, n = [], 0
    for lat in range(-88, 89, 8):
        for lon in range(-176, 177, 16):
            n += 1
            rows.append(obs_row(platform=str(n), day=f"{2020 + n % 4}-07-10", lat=lat + 0.5, lon=lon + 0.5))
    rows += [obs_row(platform="edge", day="2021-07-01", lat=90.0, lon=-180.0), obs_row(platform="edge2", day="2021-07-01", lat=-90.0, lon=179.99)]
    path = str(tmp_path / "store")
    write_observations(obs_frame(spark, rows), path)
    whole = read_observations(spark, path)
    assert whole.count() == len(rows) and "cell" not in whole.columns
    chosen = selections(
        spark,
        selection("far", lat=-72.0, lon=-150.0, radius=400.0, d1="2021-01-01", d2="2021-12-31"),
        selection("near", lat=40.0, lon=60.0, radius=1200.0, d1="2022-02-01", d2="2023-12-31"),
        selection("pole", lat=89.0, lon=-179.0, radius=300.0, d1="2021-01-01", d2="2021-12-31"),
        selection("south", lat=-89.5, lon=179.0, radius=200.0, d1="2021-01-01", d2="2021-12-31"),
    )
    near = read_selected(spark, path, chosen, widen=False)
    pairs = lambda obs: sorted((r.selection_id, r.profile_id) for r in select_observations(obs, chosen).collect())
    assert pairs(near) == pairs(whole)
    assert {s for s, _ in pairs(near)} == {"far", "near", "pole", "south"}
    assert near.count() < len(rows) / 8
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan  # files are left out while the job runs
    assert read_selected(spark, path, chosen).count() > near.count()
    assert read_selected(spark, path, chosen.limit(0)).count() == 0


def test_curve_cells_interleave_the_bits_of_both_indices(spark):
    from isohaline.functions.geo import curve_block, curve_cell

    both = spark.range(-45, 46).withColumnRenamed("id", "y").crossJoin(spark.range(-90, 91).withColumnRenamed("id", "x"))
    cell = curve_cell(F.col("y").cast("int"), F.col("x").cast("int"))
    got = both.select("y", "x", cell.alias("c"), curve_block(cell).alias("b")).collect()
    weave = lambda y, x: sum(((x >> i & 1) << 2 * i) | ((y >> i & 1) << 2 * i + 1) for i in range(8))
    assert all(r.c == weave(r.y + 45, r.x + 90) and r.b == r.c // 64 for r in got)
    assert len({r.b for r in got}) == 276


def test_profile_sets_rank_kept_rows_and_equal_the_exact_facts(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for level in range(rng.choice((1, 2, 3, 8))):
            moved = c % 7 == 0 and level > 0  # these profiles have several places
            rows.append(obs_row(cycle=str(c), lat=19.0 + moved, pres=rng.choice((0.0, 5.0, 5.0, 60.0, 100.0, 101.0, 400.0)), row=level,
                                temp=rng.choice((None, float("nan"), 20.0, 20.5, round(rng.uniform(1, 30), 2))), psal=round(rng.uniform(33, 36), 3),
                                mode=rng.choice("DDAR"), temp_qc=rng.choice("1114")))
    obs = obs_frame(spark, rows)
    exact = profiles.profile_sets(profiles.profile_facts(quality.judged_both(obs), ("parameter",)))
    got = profiles.profile_sets(profiles.observation_sets(obs))
    assert sorted(map(str, got.collect())) == sorted(map(str, exact.select(*got.columns).collect()))
    ranked = profiles.ranked_values(quality.judged_both(obs).where("kept"))
    assert "ObjectHashAggregate" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert not [c for c in profiles.observation_sets(obs).columns if c.startswith(("rows_", "bin_", "n_"))]
