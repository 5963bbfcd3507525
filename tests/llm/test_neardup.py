import random
import re

import numpy as np
from pyspark.sql import functions as F

from isohaline.llm.neardup import Shingler, components, minima, near_duplicates, packed, similarity


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 5, 30, 80]))]
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows) * 3, edited(rng, base, rng.randrange(0, 1 + len(base) // 8))))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A B"), (1004, "a b"), (1005, "x y\x85z"), (None, "a b"), (3, rows[-1][1]), (1006, "long " * 60_000), (1007, "long " * 60_001)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit(1), "n": F.lit("x"), "key": F.lit(2), "kept": F.lit(0)})
    for k in (2, 5):
        want = brute(rows, k, 80)
        got = near_duplicates(docs, k).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
            assert r.kept == (r.doc_id == r.component_id)
        sizes = {(r.doc_id, r.n_shingles) for r in got}
        assert sizes == {(i, len(shingles(t, k))) for i, t in rows}


def test_every_text_of_a_repeated_id_is_linked(spark):
    rng = random.Random(11)
    rows = []
    for g in range(6):  # six texts of document 1, each with a near copy, and an exact one, under larger ids
        base = [f"g{g}w{i}" for i in range(60)]
        rows += [(1, " ".join(base)), (1, " ".join(base)), (10 + g, edited(rng, base, 1)), (20 + g, " ".join(base).upper())]
    rows += [(30, "nothing like the others"), (1, None)]
    rng.shuffle(rows)
    want = brute([(i, t) for i, t in rows], 2, 80)
    assert all(want[i] == 1 for i in want if i != 30)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == len(rows)
    assert all((r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id) for r in got)


def test_two_texts_of_an_id_in_one_bucket(spark):
    """a - b - c are linked in a row; a and c, both texts of document 1, are not alike enough for b's bucket to need a alone."""
    base = [f"w{i}" for i in range(100)]
    a, b, c = " ".join(base), " ".join(["x"] * 7 + base[7:]), " ".join(["x"] * 7 + base[7:86] + ["y"] * 14)
    rows = [(1, a), (1, c), (2, b), (3, " ".join(["x"] * 7 + base[7:80] + ["y"] * 20))]
    want = brute(rows, 2, 80)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_chains_longer_than_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100}


def test_estimates_follow_the_similarity(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    s = Shingler(2)
    texts = [" ".join(base)] + [edited(rng, base, n) for n in (5, 20, 60, 400)]
    sigs = packed(np.array([minima(s(t)) for t in texts])).tolist()
    df = spark.createDataFrame([(sigs[0], x) for x in sigs], "a array<long>, b array<long>")
    est = [r[0] for r in df.select(similarity(F.col("a"), F.col("b"))).collect()]
    for e, t in zip(est, texts):
        a, b = shingles(texts[0], 2), shingles(t, 2)
        assert abs(e - len(a & b) / len(a | b)) < 0.2


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
