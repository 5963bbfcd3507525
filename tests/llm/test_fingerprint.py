import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohaline.llm.fingerprint import CELLS, Sketch, difference, digests, fingerprint, fingerprints, paragraphs


def slow_likeness(a, b):
    x, y = Counter(paragraphs(a)), Counter(paragraphs(b))
    both = sum((x | y).values())
    return sum((x & y).values()) / both if both else 1.0


def test_differences_are_recovered_exactly():
    rng = np.random.default_rng(5)
    for n, extra in ((0, 0), (5, 3), (300, 10), (50, 400)):
        shared = rng.integers(0, 2**64, n, dtype=np.uint64)
        a, b = rng.integers(0, 2**64, (2, extra), dtype=np.uint64)
        x, y = difference(np.concatenate([shared, a]), np.concatenate([b, shared]))
        assert set(x) == set(a) and set(y) == set(b)


def test_a_small_sketch_gets_stuck_and_says_so():
    keys = np.arange(1, 500, dtype=np.uint64)
    assert Sketch.of(keys, CELLS).minus(Sketch.of(keys[:0], CELLS)).peel() is None


def test_repeats_count():
    assert len(set(digests("a\na\nb").tolist())) == 3
    assert fingerprint("a\na") != fingerprint("a") and fingerprint("x\ny") == fingerprint("x\ny")


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 4
        e = t[: len(t) - m] + nxt[:m]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e), slow_likeness(t, e), slow_likeness(t, nxt)))
    return out


def key(r):
    return str(r)


@pytest.mark.parametrize("nulls", [False, True])
def test_against_brute_force(spark, nulls):
    rng = random.Random(8)
    word = lambda: rng.choice(["oak", "élan", "\U0001f600", "river", "of"])
    rows = [(i * 7, "\n".join(" ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 9)))) for i in range(90)]
    rows += [(14, None), (14, "same"), (14, "same"), (5000, ""), (6000, "x " * 50_000)] + ([(None, "b"), (None, "a")] if nulls else [])
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"range": F.lit(1), "tail": F.lit("t"), "i": F.lit(0), "n": F.lit(0)})
    got = sorted((tuple(r) for r in fingerprints(docs).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


def test_small_tables(spark):
    one = spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")
    assert tuple(fingerprints(one).first())[:2] == (4, 8) and fingerprints(one).first().near_next == 1.0
    assert fingerprints(one.limit(0)).count() == 0
    only_null = spark.createDataFrame([(None, "abcd"), (None, None)], "doc_id long, text string")
    assert fingerprints(only_null).count() == 2
