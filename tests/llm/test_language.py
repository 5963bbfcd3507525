import numpy as np
import pytest
from pyspark.sql import functions as F

from isohaline.llm.common import fold
from isohaline.llm.language import HIDDEN, SPAN, Model, Reader, detect, fit, pooled, training_rows, windows_of


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    r = Reader(rng, 3)
    r.p = {k: v.astype(np.float32) for k, v in r.p.items()}
    x = rng.integers(97, 101, size=(6, 4))
    weights = rng.normal(size=(6, 4, 3)).astype(np.float32)
    loss = lambda: float((r.read(x).astype(np.float64) * weights).sum())
    d = r.gradients(x, r.read(x), weights)
    for key, at in (("erz", (98, 1)), ("erz", (99, 4)), ("en", (97, 2)), ("urz", (0, 1)), ("urz", (2, 5)), ("un", (1, 1))):
        old, eps = r.p[key][at], 1e-2
        r.p[key][at] = old + eps
        up = loss()
        r.p[key][at] = old - eps
        down = loss()
        r.p[key][at] = old
        assert d[key][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=0.01), (key, at)


def test_windows_hold_whole_texts():
    raws = [b"", b"a" * SPAN, b"b" * (2 * SPAN + 5), b"c"]
    data, used, owner = windows_of(raws)
    assert [b"".join(bytes(data[i][: used[i]]) for i in np.flatnonzero(owner == k)) for k in range(4)] == raws


def test_pooling_is_the_mean_over_every_byte():
    rng = np.random.default_rng(1)
    model = Model(["x", "y"], Reader(rng), Reader(rng), rng.normal(size=(2 * HIDDEN, 2)).astype(np.float32), np.zeros(2, np.float32))
    raw = bytes(rng.integers(0, 256, 300, dtype=np.uint8))
    parts = []
    for at in range(0, 300, SPAN):
        piece = np.zeros(SPAN, dtype=np.intp)
        piece[: len(raw[at : at + SPAN])] = list(raw[at : at + SPAN])
        parts.append(model.label(piece[:, None])[0][: len(raw[at : at + SPAN]), 0])
    assert np.allclose(pooled(model, [raw, b""])[0], np.concatenate(parts).mean(axis=0), atol=1e-5)
    assert pooled(model, [raw, b""])[1].tolist() == [0, 0]


def test_held_out_accuracy_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = detect(docs, fit(training_rows(docs))).join(docs.select("doc_id", "lang"), "doc_id").filter(fold(F.col("doc_id"), 3) == 1)
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.93


def test_odd_rows_and_tables(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "12 34 !?", None), (5, "", "de"), (None, "the " * 60_000, None), (1, "the cat and the dog", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "lang_pred": F.lit(0)})
    model = fit(docs, steps=30)
    got = detect(docs, model).collect()
    assert len(got) == 7 and {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5}
    assert all(0 <= r.score <= 1 for r in got)
    nothing = fit(docs.filter("lang is null"), steps=3)
    assert {r.lang_pred for r in detect(docs, nothing).collect()} == {"und"}
    assert detect(docs.limit(0), model).count() == 0


def test_one_text_repeated_counts_once(spark):
    rows = [(i, "immer derselbe Satz", "de") for i in range(3000)] + [(5000 + i, f"the {i} cats and dogs", "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs, steps=40)
    assert model.languages == ["de", "en"]
    assert {r.lang_pred for r in detect(docs.filter("lang = 'de'").limit(3), model).collect()} == {"de"}
