"""Exports, manifests, documents, cases and run logs."""

import codecs
import gzip
import hashlib
import json
import os
import random

import pytest

from helpers import by
from pyspark.sql import functions as F

from isohaline.operators import evaluate, ingest
from isohaline.schema import RAW_EXPORT, ContractError
from isohaline.sources import cases, exports, manifest
from isohaline.sources.sha256 import Sha256
from isohaline.sources.documents import cap_documents, flatten_documents, read_documents
from isohaline.vocabulary import EXPORT_COLUMNS

UNITS = ",".join("UTC" if c == "time" else "1" for c in EXPORT_COLUMNS)


def test_quoted_fields_and_equal_names_in_two_folders(spark, tmp_path):
    for folder, n in (("x", 3), ("y", 5)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.csv").write_text(export_text([line(i) for i in range(n)]))
    rows = exports.read_exports(spark, f"{tmp_path}/*")
    assert sorted(r.source_row for r in rows.collect()) == [3, 3, 4, 4, 5, 5, 6, 7]
    odd = rows.limit(2).withColumn("platform_number", F.lit('19,"02"'))
    exports.write_exports(odd, f"{tmp_path}/out")
    back = exports.read_exports(spark, f"{tmp_path}/out").collect()
    assert [r.platform_number for r in back] == ['19,"02"'] * 2 and {r.source_row for r in back} == {3, 4}


def test_quoted_line_breaks_survive_file_splits(spark, tmp_path):
    import csv
    import io

    rng = random.Random(7)
    want = []
    for name, n in (("a.csv", 400), ("b.csv", 60), ("plain.csv", 30)):
        out = io.StringIO()
        out.write(",".join(EXPORT_COLUMNS) + "\n" + UNITS + "\n")
        for i in range(n):
            odd = "" if name == "plain.csv" else rng.choice(["", "", "\n", '\n"\n', 'x"y', "\n\n,1"])
            platform = f"p{i}{odd}z"
            csv.writer(out, lineterminator="\n").writerow([platform, *line(i).split(",")[1:]])
            want.append((name, platform, i + 3))
        (tmp_path / name).write_text(out.getvalue())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = exports.read_exports(spark, f"{tmp_path}/*.csv").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r._source_file, r.platform_number, r.source_row) for r in rows) == sorted(want)
    odd = exports.read_exports(spark, f"{tmp_path}/plain.csv").limit(3).withColumn("platform_number", F.lit('a\nb,"c"\n'))
    exports.write_exports(odd, f"{tmp_path}/out")
    assert [r.platform_number for r in exports.read_exports(spark, f"{tmp_path}/out").collect()] == ['a\nb,"c"\n'] * 3


def test_an_open_quote_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(export_text([line(1), '"never closed']))
    with pytest.raises(ContractError, match="a.csv"):
        exports.read_exports(spark, str(tmp_path / "a.csv"))


def test_bad_header_in_a_second_folder_is_seen(spark, tmp_path):
    for folder, text in (("x", export_text([line(1)])), ("y", export_text([line(1)]).replace("UTC", "local"))):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.csv").write_text(text)
    with pytest.raises(ContractError, match="y/a.csv"):
        exports.require_headers(spark, f"{tmp_path}/*")
    assert exports.check_header(spark, f"{tmp_path}/*").count() == 2


def export_text(rows):
    return "\n".join([",".join(EXPORT_COLUMNS), UNITS, *rows]) + "\n"


def line(i, platform="1900121", time="2010-01-05T00:00:00Z", pres=None, mode="D"):
    return f" {platform} ,{i // 10},{time},10.5,190.0,{pres if pres is not None else i % 10},20.1,1,20.2,1,35.0,1,NaN,1,{mode},1"


def test_row_numbers_survive_file_splits(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, n in (("a.csv", 1500), ("b.csv", 700)):
        (folder / name).write_text(export_text([line(i) for i in range(n)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw = exports.read_exports(spark, str(folder))
        blocks = spark.read.schema(RAW_EXPORT).csv(str(folder)).select("_metadata.file_name", "_metadata.file_block_start")
        assert blocks.distinct().count() > 4
        rows = raw.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = sorted((r._source_file, int(r.cycle_number) * 10 + int(r.pres), r.source_row) for r in rows)
    assert got == [(f, i, i + 3) for f, n in (("a.csv", 1500), ("b.csv", 700)) for i in range(n)]


def test_clean_rows(spark, tmp_path):
    rows = [line(1), ",".join(EXPORT_COLUMNS), line(2, time="soon"), line(3, pres="x"), line(4, mode="")]
    (tmp_path / "a.csv").write_text(export_text(rows))
    got = ingest.clean_rows(exports.read_exports(spark, str(tmp_path / "a.csv"))).collect()
    assert [(r.profile_id, r.source_row, r.longitude, r.psal_adjusted, r.year) for r in got] == [("1900121:0", 3, -170.0, None, 2010)]


def test_header_check(spark, tmp_path):
    (tmp_path / "good.csv").write_text(export_text([line(1)]))
    exports.require_headers(spark, str(tmp_path / "good.csv"))
    (tmp_path / "bad.csv").write_text(export_text([line(1)]).replace("UTC", "local"))
    with pytest.raises(ContractError, match="bad.csv"):
        exports.require_headers(spark, str(tmp_path / "*.csv"))


def test_audit_digests_and_origin(spark, tmp_path):
    text = export_text([line(i) for i in range(5)])
    (tmp_path / "ERDDAP_x.csv").write_text(text)
    glob = str(tmp_path / "*.csv")
    got = exports.source_audit(spark, glob, exports.read_exports(spark, glob), {"ERDDAP": "service"}, "by hand").first()
    assert (got.sha256, got.size_bytes, got.input_rows) == (hashlib.sha256(text.encode()).hexdigest(), len(text), 5)
    assert got.origin == "service"


def test_manifest_readiness(spark, tmp_path):
    (tmp_path / "p.parquet").write_bytes(b"abc")
    entry = {"path": "processed/p.parquet", "kind": "profiles", "sha256": hashlib.sha256(b"abc").hexdigest(), "size_bytes": 3, "row_count": 1}
    base = {**entry, "path": "b.parquet", "kind": "production_baseline"}
    doc = {"status": "ready", "evidence_grade_policy": {"reviewed": True, "baseline_min_n": 10}, "artifacts": [entry, base]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    m = manifest.read_manifest(spark, str(tmp_path / "m.json"))
    files = exports.file_digests(spark, str(tmp_path / "*.parquet"))
    checked = by(manifest.verify_artifacts(m, files).collect(), "kind")
    assert checked["profiles"].digest_ok and checked["profiles"].size_ok and not checked["production_baseline"].present
    assert manifest.readiness(m, files).first().detail == "declared files are missing"
    (tmp_path / "b.parquet").write_bytes(b"abc")
    assert manifest.readiness(m, exports.file_digests(spark, str(tmp_path / "*.parquet"))).first().ready
    with pytest.raises(ContractError):
        manifest.readiness(m.unionByName(m), files)
    limits = manifest.thresholds(m)
    assert (limits["min_valid_profiles"], limits["min_baseline_n"], limits["min_distinct_floats"], limits["reviewed"]) == (5, 10, None, True)


def test_every_table_file_is_audited(spark, tmp_path):
    from catalog import QUERIES

    (tmp_path / "lineitem.parquet").write_bytes(b"abc")
    for table in ("documents.parquet", "pages.parquet"):
        (tmp_path / table).mkdir()
        for k in range(3):
            (tmp_path / table / f"part-{k}.parquet").write_bytes(f"{table} {k}".encode())
    got = {(r.path, r.kind): (r.present, r.size_ok, r.digest_ok) for r in QUERIES["artifact_audit_tables"](spark, str(tmp_path)).collect()}
    says = {"right": (True, True, True), "wrong size": (True, False, True), "wrong digest": (True, True, False), "absent": (False, False, False)}
    assert got == {(t, k): v for t in ("lineitem.parquet", "documents.parquet", "pages.parquet") for k, v in says.items()}


def test_audit_of_all_tables_matches_sql(spark, tmp_path):
    """Every table of the driver's folder, and a folder that lacks one."""
    from catalog import ORACLES, QUERIES
    from check import difference, duck

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables are absent")
    query, sql = QUERIES["artifact_audit_tables"], ORACLES["artifact_audit_tables"]
    assert difference(spark, duck(sf), "artifact_audit_tables", query, sql, sf) is None
    for name in os.listdir(sf):
        if name != "events.parquet":
            (tmp_path / name).symlink_to(f"{sf}/{name}")
    assert difference(spark, duck(sf), "artifact_audit_tables", query, sql, str(tmp_path)) is not None


def document(t_mode="D", s_mode="D", doc_id="7901125_002", cycle=2):
    return {
        "_id": doc_id, "geolocation": {"type": "Point", "coordinates": [88.95, 14.1]}, "timestamp": "2023-01-16T04:00:00.000Z",
        "cycle_number": cycle, "geolocation_argoqc": 1,
        "data_info": [["pressure", "temperature", "temperature_argoqc", "salinity", "salinity_argoqc"], ["units", "data_keys_mode"],
                      [["dbar", None], ["C", t_mode], [None, None], ["psu", s_mode], [None, None]]],
        "data": [[4, 6, 8], [28.75, 28.76, None], [1, 1, 1], [33.007, 33.004, 33.003], [1, 1, 4]],
    }


def test_large_files_are_hashed_in_steps(spark, tmp_path):
    """No task reads a large file whole; any bytes, ends and names give the digest of the whole file."""
    rng = random.Random(6)
    bodies = {
        "a.parquet": rng.randbytes(90_000), "b c.csv": b"x,y\r\n1,2\r\n" * 9_000, "ends": b"\n" * 50_000, "no feed": b"z" * 60_000,
        "mark.csv": codecs.BOM_UTF8 + b"a\n" * 30_000, "cut.gz": gzip.compress(rng.randbytes(70_000)), "small": b"abc",
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = {r.name: (r.size_bytes, r.sha256) for r in exports.file_digests(spark, f"{tmp_path}/*", whole=40_000, step=30_000).collect()}
        assert got == {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_state_of_a_digest_goes_on():
    body = bytes(range(256)) * 5
    for cut in (0, 1, 55, 56, 63, 64, 65, 700):
        first = Sha256().update(body[:cut])
        assert Sha256(first.state).update(body[cut:]).hexdigest() == hashlib.sha256(body).hexdigest()
        assert first.hexdigest() == hashlib.sha256(body[:cut]).hexdigest()


def test_documents(spark, tmp_path):
    docs = [document(), document("R", "D", "7901125_003", 3), {"_id": "broken", "geolocation": {}}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, docs)) + "\n{cut\n")
    rows = flatten_documents(read_documents(spark, str(tmp_path / "d.json"))).orderBy("profile_id", "pres").collect()
    assert [r.profile_id for r in rows] == ["7901125:2"] * 3 + ["7901125:3"] * 3
    assert [r.temp_adjusted for r in rows] == [28.75, 28.76, None, None, None, None]
    assert [r.psal_adjusted_qc for r in rows[:3]] == ["1", "1", "4"] and {r.data_mode for r in rows} == {"D"}
    assert (rows[0].platform_number, rows[0].cycle_number, rows[0].latitude, rows[0].position_qc) == ("7901125", "2", 14.1, "1")
    many = spark.createDataFrame([("s", str(i)) for i in range(250)], "selection_id string, body string")
    assert cap_documents(many, 200).count() == 200


def test_methods(spark):
    cols = cases.CASE_COLUMNS
    rows = [
        ("1", "upper_ocean_anomaly", "30", "25", "2", "25", "2", "30", "25", "2", "Supported", "yes", "v", "r"),
        ("2", "normal_ocean_state", "30", "25", "2", "25", "nan", "25", "25", "2", "Supported", "TRUE", "v", "r"),
        ("3", "measurement_quality_problem", "40", "25", "2", "25", "2", "x", "25", "2", "Insufficient", "1", "v", "r"),
        ("4", "ambiguous_excluded", "40", "25", "2", "25", "2", "40", "25", "2", "Supported", "1", "v", "r"),
        ("5", "normal_ocean_state", "40", "25", "2", "25", "2", "40", "25", "2", "Supported", "no", "v", "r"),
    ]
    got = by(evaluate.evaluate_methods(cases.type_cases(spark.createDataFrame(rows, cols))).collect(), "method")
    regional, raw, graded = got["regional_average"], got["unfiltered_z_score"], got["qc_filtered_evidence_graded"]
    assert (regional.eligible_cases, regional.tp, regional.fp, regional.precision, regional.false_alert_rate) == (3, 1, 1, 0.5, 1.0)
    assert (raw.covered_binary_cases, raw.query_coverage, raw.measurement_falsely_alerted) == (1, 0.5, 1)
    assert (graded.tp, graded.tn, graded.measurement_uncovered, graded.f1) == (1, 1, 1, 1.0)
    with pytest.raises(ContractError):
        cases.type_cases(spark.createDataFrame([(1,)], ["case_id"]))


def test_run_report_and_expectations(spark):
    runs = spark.createDataFrame([("m", "correct" if i else "invalid", float(i)) for i in range(20)], "mode string, outcome string, latency_ms double")
    got = evaluate.run_report(runs).first()
    assert (got.run_count, got.success_rate, got.invalid_output_rate, got.p95_latency_ms) == (20, 0.95, 0.05, 18.0)
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None)], "x string, want string")
    assert [r.matches for r in evaluate.matches_expected(df, {"x": "want"}).collect()] == [True, False, True]


def test_generated_code_of_cleaning_is_small_enough_to_compile(spark):
    from catalog.cleaning import coverage, dedup_levels, obs_clean

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for query in (obs_clean, dedup_levels, coverage):
            parts = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
            assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000  # the JVM leaves larger ones to its interpreter
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_generated_code_of_tagging_is_small_enough_to_compile(spark):
    from datetime import date

    from isohaline.plans import questions

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = spark.createDataFrame([("salinity near Mumbai in July 2024",)], "text string")
        parts = questions.locate(questions.tag_texts(texts, "text", date(2026, 8, 22)), fuzzy=False)._jdf.queryExecution().debug().codegenToSeq()
        assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_document_is_parsed_once(spark):
    from isohaline.sources.documents import flatten_documents

    texts = spark.range(3).select(F.concat(F.lit('{"_id":"'), F.col("id").cast("string"), F.lit('_1"}')).alias("body"))
    plan = flatten_documents(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(_id") == 1
