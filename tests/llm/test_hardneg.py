import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohaline.llm import hardneg
from isohaline.llm.hardneg import Tree, build, hard_negatives

ROWS = "vec_id long, embedding array<double>, label int"
ANCHOR = "vec_id % 10 = 0"


def brute(rows, k=5):
    """By comparing everything with everything."""
    whole = {(i, label, tuple(math.floor(256 * x) for x in e)) for i, e, label in rows if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in (r for r in whole if r[0] % 10 == 0):
        scored = sorted((-dot(a[2], r[2]), r[0], r[1]) for r in whole if r != a)
        for s, p, _ in [x for x in scored if x[2] == a[1]][:k]:
            fits = [x for x in scored if x[2] != a[1] and -80 * s <= -100 * x[0] <= -100 * s][:k]
            out += [(a[0], p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)]
    return sorted(out)


def fixture(n=700, dims=6, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.1 if i % 3 else 1) for x in c], rng.randrange(5)))
    rows += [(2000 + i, rows[3][1], i % 4) for i in range(400)]  # one vector holds a third of the rows
    rows += [(20, rows[5][1], 1), (20, rows[5][1], 1), (20, rows[6][1], 2), (5000, [0.0] * dims, 1), (5010, [], 1)]
    odd = [(None, [1.0] * dims, 1), (30, None, 1), (40, [1.0] * dims, None), (50, [1.0, None] + [0.0] * (dims - 2), 1)]
    return rows + odd + [(60, [float("nan")] + [0.0] * (dims - 1), 1), (70, [float("inf")] + [0.0] * (dims - 1), 2), (80, [0.5, 0.25], 3)]


def mined(spark, rows):
    df = spark.createDataFrame(rows, ROWS).withColumns({"v": F.lit("x"), "part": F.lit(0), "rank": F.lit(0), "anchor": F.lit(1), "w": F.lit(2)})
    return sorted(map(tuple, hard_negatives(df, ANCHOR).collect()))


@pytest.mark.parametrize("part, block, pivots", [(2048, 2048, 128), (60, 30, 4)])
def test_equals_brute_force(spark, monkeypatch, part, block, pivots):
    monkeypatch.setattr(hardneg, "PART", part)
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "PIVOTS", pivots)
    rows = fixture()
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_trees_cover_and_bound():
    import pandas as pd

    rng = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate((rng.normal(size=(300, 5)), rng.normal(size=(300, 5)) * 0.05 + 3)))
    frame = pd.DataFrame({"part": 0, "vec_id": np.arange(600), "label": 1, "v": [v.tobytes() for v in x]})
    row = pd.DataFrame([build(frame, 5, 5)]).iloc[0]
    tree = Tree(row, 5)
    q = np.floor(256 * rng.normal(size=5))
    lo, hi = tree.bounds(np.arange(len(tree.leaf)), q, math.sqrt(q @ q))
    below = {}
    for n in reversed(range(len(tree.leaf))):
        kids = range(tree.first[n], tree.last[n])
        below[n] = list(kids) if tree.leaf[n] else [p for c in kids for p in below[c]]
        score = tree.x[below[n]] @ q
        assert lo[n] <= score.min() and score.max() <= hi[n]
        assert tree.leaf[n] or all(tree.radius[c] <= tree.radius[n] / 2 * (1 + 1e-9) for c in kids)
    assert sorted(below[0]) == list(range(600))


def test_skips_nodes_of_clustered_vectors(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = np.floor(256 * (np.repeat(centres, 50, axis=0) + 0.02 * rng.normal(size=(2000, 16))))
    frame = pd.DataFrame({"part": 0, "vec_id": np.arange(2000), "label": 1, "v": [v.tobytes() for v in x]})
    tree = Tree(pd.DataFrame([build(frame, 5, 16)]).iloc[0], 16)
    read = []
    plain = hardneg.products
    monkeypatch.setattr(hardneg, "products", lambda a, q, e: read.append(len(a)) or plain(a, q, e))
    q = x[777]
    got = tree.descend(q, lambda got: got == 1, np.array([-np.inf]), np.array([np.inf]), 5, 777)[0]
    want = sorted((-int(s), i) for i, s in enumerate(x @ q) if i != 777)[:5]
    assert got == want and sum(read) < 600


def test_long_products_are_exact_and_cut(spark):
    big = [(i, [2.0**32 + i, 2.0**33 * (i % 3), 3.0 * i], i % 2) for i in range(40)]
    assert all(r[4] == r[5] == 2**63 - 1 for r in mined(spark, big))
    some = [(i, [2.0**22 + i, 2.0**21 * (i % 3) + i / 256, 3.0 * i], i % 2) for i in range(40)]
    assert mined(spark, some) == brute(some)


def test_no_anchor_no_label_no_rows(spark):
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(10, [1.0], 1), (2, [1.0], 2)]) == []
    assert hard_negatives(spark.createDataFrame([], ROWS), ANCHOR).count() == 0
    assert mined(spark, [(10, [], 1), (11, [], 1), (12, [], 2)]) == [(10, 11, 1, 12, 0, 0)]
