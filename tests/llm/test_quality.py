import numpy as np

from isohaline.llm.quality import WIDTH, Model, fit, isotonic, score_quality, statistics

GOOD = "The heron waited by the water while {} boats came in. Nobody saw it leave, and nobody minded much."
BAD = "BUY*** NOW!! {} $$$ ### WIN%%% ||| FREE!! BUY*** NOW!! {} $$$ ### WIN%%%"


def corpus(spark, n=160):
    rows = [(i, (GOOD if i % 2 else BAD).replace("{}", f"w{i}x")) for i in range(n)]
    labels = [(i, i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_isotonic_pools_violators():
    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.1, 0.6, 0.2, 0.9]), np.array([1.0, 1, 1, 1]))
    assert np.allclose(y, [0.1, 0.4, 0.9]) and np.allclose(x, [0, 1.5, 3])


def test_random_features_approximate_a_gaussian_kernel():
    from isohaline.llm.quality import lift

    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(3, 20000)), rng.uniform(0, 2 * np.pi, 20000)
    x = rng.normal(size=(2, 3))
    z = lift(x, np.zeros(3), np.ones(3), w, b)[:, :-1]
    assert abs(z[0] @ z[1] - np.exp(-((x[0] - x[1]) ** 2).sum() / 2)) < 0.03


def test_separates_and_is_unchanged_by_extra_columns(spark):
    docs, labels = corpus(spark)
    model = fit(docs, labels)
    got = {r.doc_id: r for r in score_quality(docs, model).collect()}
    assert all(got[i].predicted == i % 2 for i in got)
    from pyspark.sql import functions as F

    more = docs.withColumns({"score": F.lit("x"), "x": F.lit(1), "k": F.lit(2), "y": F.lit(3), "predicted": F.lit(None)})
    assert {r.doc_id: r.score for r in score_quality(more, fit(more, labels.withColumn("text", F.lit("t")))).collect()} == {i: got[i].score for i in got}


def test_null_empty_long_and_repeated_rows(spark):
    docs, labels = corpus(spark, 40)
    model = fit(docs, labels)
    odd = spark.createDataFrame([(None, "a"), (900, None), (901, ""), (902, "word " * 50_000), (903, GOOD), (903, GOOD)], docs.schema)
    got = score_quality(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id): r.score for r in got}
    assert by[900] == by[901]


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 10)
    assert score_quality(docs, fit(docs, labels.limit(0))).first().score == 0.5
    assert score_quality(docs, fit(docs, labels.filter("quality = 1"))).first().score == 1.0
    assert score_quality(docs.limit(0), fit(docs.limit(0), labels)).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 7)], labels.schema)
    assert score_quality(docs, fit(docs, nulls)).first().score == 0.5


def test_every_text_has_the_same_number_of_figures():
    assert {len(statistics(t)) for t in (None, "", " \n", "é", "a\n\nb" * 10)} == {WIDTH}
    assert np.isfinite(np.array([statistics(t) for t in (None, "", "\n", "x")])).all()
    assert isinstance(Model(*[np.zeros(1)] * 7), Model)
