import random

from pyspark.sql import functions as F

from isohaline.llm.linededup import dedup_lines


def brute(texts, min_words):
    """texts in order -> kept line numbers; every repeated run is tried."""
    seqs = [[(i, x) for i, x in enumerate((t or "").split("\n")) if x.split()] for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for d, seq in enumerate(seqs):
        for s in range(len(seq)):
            for e in range(s + 1, len(seq) + 1):
                run = tuple(x for _, x in seq[s:e])
                if run in seen and sum(len(x.split()) for x in run) >= min_words:
                    gone[d] |= {i for i, _ in seq[s:e]}
            for e in range(s + 1, len(seq) + 1):
                seen.add(tuple(x for _, x in seq[s:e]))
    return [sorted(g) for g in gone]


def test_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["a", "b b", "c c c", "d d d d", "e e e e e e e", ""]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts[30] = texts[10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (1, 5, 12):
        want = brute(texts, least)
        got = {r.doc_id: r for r in dedup_lines(docs, least).collect()}
        assert [got[i]["_gone"] for i in range(60)] == want
        for i, t in enumerate(texts):
            kept = [x for n, x in enumerate(t.split("\n")) if n not in want[i]]
            assert got[i].text == ("\n".join(kept) if want[i] else t)


def test_passages_and_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    split = "\n".join(" ".join(f"q{i}" for i in range(k, k + 10)) for k in range(0, 60, 10))
    rows = [(3, f"x\n{passage}\ny"), (1, f"one\n{passage}"), (2, f"{split}\nz"), (9, f"k\n{split}"), (4, None), (5, ""), (6, "All rights reserved."), (7, "All rights reserved."),
            (None, passage), (8, "w " * 60_000), (10, "w " * 60_000), (1, f"one\n{passage}"), (11, "\n".join(["same"] * 2000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"r": F.lit("x"), "at": F.lit(1), "gone": F.lit("g"), "k": F.lit(0)})
    got = dedup_lines(docs).collect()
    assert len(got) == len(rows) and all((x.r, x["at"], x.gone, x.k) == ("x", 1, "g", 0) for x in got)
    by = {r.doc_id: r for r in got}
    assert by[1].text == f"one\n{passage}" and by[3].text == "x\ny" and by[None].text == ""
    assert by[2].text == f"{split}\nz" and by[9].text == "k" and by[4].text is None and by[5].text == ""
    assert by[6]["_gone"] == by[7]["_gone"] == [] and by[8]["_gone"] == [] and by[10]["_gone"] == [0]
    assert by[11]["_gone"] == list(range(1, 2000))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(docs).count() == 0


def test_columns_of_any_name_pass_through(spark):
    run = "\n".join(" ".join(f"w{i}_{k}" for k in range(12)) for i in range(6))
    docs = spark.createDataFrame([(1, run), (2, run), (3, None)], "doc_id long, text string")
    names = ("_key", "_d", "_th", "gone", "ln", "row", "hash")
    out = dedup_lines(docs.withColumns({c: F.lit(c) for c in (*names, "_gone")})).orderBy("doc_id").collect()
    assert [r.text for r in out] == [run, "", None]
    assert all(r[c] == c for r in out for c in names)
    assert [len(r["_gone"]) for r in out] == [0, 6, 0]
