import random
import re

import pytest
from sentencepiece import SentencePieceProcessor
from test_linededup import brute as brute_lines
from test_mixing import expected_mix
from test_neardup import brute as brute_near

import corpus_pipeline
from isohaline.llm.pieces import MODEL

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(21)
    passage = " ".join(f"shared{i}" for i in range(55))
    rows = []
    for i in range(70):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(20, 90))]
        text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        if i % 9 == 0:
            text = f"{text}\n{passage}"
        if i % 11 == 3:
            text = "### $$$ *** " * 30
        if i % 10 == 7:
            text = rows[i // 2][1]
        rows.append((i, text, "en", f"s{i % 5}" if i % 13 else None, len(text)))
    return rows + [(100, None, "en", "s1", None), (101, "", None, "s2", 0), (None, "no id here but some words", "en", "s3", 24)]


def first_of_groups(rows):
    """One row of each near-duplicate group, by comparing all rows: the smallest id, rows without id last."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    roots = brute_near([(k, rows[n][1]) for k, n in enumerate(order)], corpus_pipeline.SHINGLE, 80)
    return [rows[n] for k, n in enumerate(order) if roots[k] == k]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(fixture(), COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 11 != 3), 0) for i in range(70) if i % 10 != 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage_against_brute_force(spark, folder):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    good = stages["quality"](spark, docs, folder)
    got = rows_of(good)
    junk = {r[0] for r in fixture() if r[1] and r[1].startswith("###")}
    assert {r[0] for r in fixture() if r[0] is not None and r[0] < 70} - {r[0] for r in got} == junk

    held = sorted(got, key=lambda r: (r[0] is None, r[0] or 0))
    gone = brute_lines([r[1] for r in held], 50)
    want = []
    for r, g in zip(held, gone):
        text = "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in g) if g else r[1]
        if not g or words(text):
            want.append((r[0], text, r[2], r[3], len(text) if g else r[4]))
    lines = stages["lines"](spark, spark.createDataFrame(got, COLUMNS), folder)
    assert rows_of(lines) == sorted(want, key=str)

    want = first_of_groups(want)
    near = stages["near_duplicates"](spark, spark.createDataFrame(rows_of(lines), COLUMNS), folder)
    assert rows_of(near) == sorted(want, key=str)

    taken = expected_mix(want, words)
    mix = stages["mix"](spark, spark.createDataFrame(rows_of(near), COLUMNS), folder)
    want = [r for k, r in enumerate(want) for _ in range(taken[k])]
    assert rows_of(mix) == sorted(want, key=str)

    model = SentencePieceProcessor(model_file=MODEL)
    out = stages["pieces"](spark, spark.createDataFrame(rows_of(mix), COLUMNS), folder).collect()
    assert sorted(((r.doc_id, r.pieces) for r in out), key=str) == sorted(((r[0], model.encode(r[1])) for r in want), key=str)


def test_the_whole_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(docs)


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_go_by_rows_whatever_their_ids(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"word{i}" for i in range(40))
    rows = [(5, text), (5, text), (5, text + " more"), (None, text), (None, text), (None, "alone without id"), (9, text), (7, None), (7, None), (8, ""), (6, "another text of a few words"), (6, "nothing like it at all here")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], COLUMNS).withColumns({"number": F.lit(1), "row": F.lit("r"), "component_id": F.lit(2), "kept": F.lit(False)})
    out = corpus_pipeline.distinct_documents(spark, docs, None)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    left = [r for r in got if r[1] is None or not r[1].startswith("word0")]
    assert len(got) - len(left) == 1 and {r[0] for r in got if r not in left} == {5}
    assert left == sorted([(None, "alone without id"), (7, None), (7, None), (8, ""), (6, rows[10][1]), (6, rows[11][1])], key=str)
    assert corpus_pipeline.distinct_documents(spark, docs.limit(0), None).count() == 0
