"""Hard negatives by cover trees over norm-augmented candidates.

Every candidate vector gets one more component that brings all of a tree to one norm M; an anchor gets a zero there. So a
candidate's inner product with an anchor of norm |q| is |q| M cos(angle), and the candidates below a node whose covering
radius is r lie within the angle 2 asin(r / 2M) of its centre: both ends of their inner products follow from the centre's.

The upper level of the index are pivots from a bounded sample; each vector belongs to its nearest pivot, and a pivot's
vectors are dealt by hash into parts of about ``PART`` vectors, however many there are. Each part is one cover tree: balls
are cut into balls of half their radius, level by level, down to leaves. Trees are rows of a written table. Anchors are
cut into blocks, and a task gets one tree and one block. An anchor descends best-first: nodes whose bounds miss all its
windows, or cannot beat the k-th hit it has, are skipped, and leaves are verified by exact integer products. The best k
of all trees are then taken by a ranked window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohaline.llm.common import travels
from isohaline.session import written

PIVOTS = 128  # bounded sample of vectors that the upper level is made of
PART = 2048  # vectors of one tree, about
LEAF = 24  # vectors of a leaf
BLOCK = 2048  # anchors of one block
STEP = 96  # nodes that a descent opens at once
EXACT = 2.0**53  # products of norms up to here make float sums of integers exact
LONG = 2**63 - 1


def matrix(blobs, dims: int) -> np.ndarray:
    """Vectors of whole numbers, shorter ones padded with zeros."""
    out = np.zeros((len(blobs), dims))
    for i, b in enumerate(blobs):
        v = np.frombuffer(b)
        out[i, : len(v)] = v
    return out


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers. Beyond the exact range of floats they are taken one by one in long integers."""
    if exact:
        return x @ q
    long = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, long)), -LONG - 1), LONG) for row in x], dtype=object)


def whole_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (binary float64, floor(scale * x)) of the rows that take part, equal rows once."""
    some = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) <= 1e100))  # NaN is greater than any number
    some = some.filter(finite).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "v": [np.floor(scale * np.asarray(e, dtype=np.float64)).tobytes() for e in b["embedding"]]})

    return some.mapInPandas(run, "vec_id long, label long, v binary").distinct()


def cover_tree(d2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cover tree of points with squared distances ``d2``: (order, centre, radius, first, last, leaf).

    Node 0 is the root. A node's children are the nodes first to last, a leaf's points are order[first:last]. A ball of
    radius r is covered by balls of radius r / 2 whose centres lie more than r / 2 apart, its own centre among them.
    """
    balls = [(np.arange(len(d2)), 0)]
    centre, radius, first, last, leaf, order = [], [], [], [], [], []
    for members, c in balls:  # children are appended while the list is read
        near2 = d2[c, members]
        r2 = near2.max()
        centre.append(c)
        radius.append(math.sqrt(r2))
        leaf.append(len(members) <= LEAF or r2 == 0)
        if leaf[-1]:
            first.append(len(order))
            order.extend(members)
            last.append(len(order))
            continue
        first.append(len(balls))
        while len(members):
            inside = d2[c, members] <= r2 / 4
            balls.append((members[inside], c))
            members = members[~inside]
            c = members[0] if len(members) else c
        last.append(len(balls))
    return np.array(order), np.array(centre), np.array(radius), np.array(first), np.array(last), np.array(leaf)


def build(frame: pd.DataFrame, k: int, dims: int) -> dict:
    """One tree from rows part, vec_id, label, v. Of equal vectors the first k + 1 ids of each label are kept.

    No more can count: hits of one score are taken by id, and one of them may be the anchor itself.
    """
    frame = frame.sort_values(["v", "label", "vec_id"])
    frame = frame[frame.groupby(["v", "label"]).cumcount() <= k]
    firsts = (frame["v"] != frame["v"].shift()).to_numpy()
    x = matrix(frame["v"][firsts].tolist(), dims)
    n2 = (x * x).sum(axis=1)
    m2 = n2.max()
    lift = np.sqrt(m2 - n2)
    d2 = np.maximum(n2[:, None] + n2[None, :] - 2 * (x @ x.T), 0) + (lift[:, None] - lift[None, :]) ** 2
    np.fill_diagonal(d2, 0)
    order, centre, radius, first, last, leaf = cover_tree(d2)
    starts = np.append(np.flatnonzero(firsts), len(frame))
    place = np.empty(len(order), dtype=int)
    place[order] = np.arange(len(order))
    took = [np.arange(starts[p], starts[p + 1]) for p in order]
    rows = np.concatenate(took)
    return {
        "part": frame["part"].iloc[0], "norm": math.sqrt(m2), "v": x[order].tobytes(), "centre": place[centre], "radius": radius, "first": first, "last": last, "leaf": leaf,
        "start": np.concatenate(([0], np.cumsum([len(t) for t in took]))), "label": frame["label"].to_numpy()[rows], "vec_id": frame["vec_id"].to_numpy()[rows],
    }


TREE = (
    "part long, norm double, v binary, centre array<int>, radius array<double>, first array<int>, last array<int>, leaf array<boolean>, "
    "start array<int>, label array<long>, vec_id array<long>"
)


def cover_trees(vectors: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """The index as a written table of trees, the number of parts and the number of components.

    Every vector is indexed. Up to ``PIVOTS`` vectors, first by hash, form the upper level; the driver holds these, one
    count for each, and no others.
    """
    longest, n = vectors.agg(F.max(F.length("v")), F.count("*")).first()
    dims = max(1, longest // 8)
    wanted = min(PIVOTS, math.ceil(n / PART))
    sample = [bytes(r["v"]) for r in vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect()]
    pivots = matrix(sorted(set(sample)), dims)
    lengths = (pivots**2).sum(axis=1)

    def nearest(batches):
        for b in batches:
            x = matrix(b["v"].tolist(), dims)
            yield b.assign(pivot=np.argmin(lengths - 2 * (x @ pivots.T), axis=1).astype(np.int32))

    placed = written(vectors.mapInPandas(nearest, "vec_id long, label long, v binary, pivot int"), "placed")
    counts = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    split = [max(1, math.ceil(counts.get(p, 0) / PART)) for p in range(len(pivots))]
    start = np.concatenate(([0], np.cumsum(split))).tolist()
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("pivot") + 1)
    part = (of(start) + F.pmod(F.xxhash64("v", "vec_id"), of(split))).cast("long")

    def tree(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([build(frame, k, dims)])

    trees = placed.withColumn("part", part).groupBy("part").applyInPandas(tree, TREE)
    return written(trees, "trees"), start[-1], dims


class Tree:
    """A tree of the index, as one task reads it."""

    def __init__(self, row, dims: int):
        self.x = np.frombuffer(row["v"]).reshape(-1, dims)
        self.norm = row["norm"]
        self.centre, self.radius, self.first, self.last, self.start, self.label, self.vec_id = (np.asarray(row[c]) for c in ("centre", "radius", "first", "last", "start", "label", "vec_id"))
        self.leaf = np.asarray(row["leaf"], dtype=bool)
        self.opening = 2 * np.arcsin(np.minimum(1, self.radius * (1 + 1e-9) / (2 * self.norm))) if self.norm else np.zeros(len(self.radius))

    def bounds(self, nodes: np.ndarray, q: np.ndarray, qn: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that a vector below each node can have with q."""
        reach = self.norm * qn
        if not reach:
            return np.zeros(len(nodes)), np.zeros(len(nodes))
        angle = np.arccos(np.clip(self.x[self.centre[nodes]] @ q / reach, -1, 1))
        slack = 1e-7 * reach + 1e-6
        return reach * np.cos(np.minimum(np.pi, angle + self.opening[nodes])) - slack, reach * np.cos(np.maximum(0, angle - self.opening[nodes])) + slack

    def descend(self, q: np.ndarray, wanted, low: np.ndarray, high: np.ndarray, k: int, me: int) -> list[list[tuple]]:
        """The first k hits (-score, vec_id) in each window low <= score <= high, best-first.

        ``wanted`` tells from labels which candidates count; the anchor ``me`` itself does not.
        """
        qn = math.sqrt(q @ q)
        exact = qn * self.norm <= EXACT
        own = products(q[None, :], q, exact)[0]
        if exact:
            low, high = low.astype(float), high.astype(float)
        hits: list[list[tuple]] = [[] for _ in low]
        least = low.copy()  # of each window: no lower score can be a hit any more

        def open_(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return ((hi[:, None] >= least) & (lo[:, None] <= high)).any(axis=1)

        nodes = np.zeros(1, dtype=int)
        lo, hi = self.bounds(nodes, q, qn)
        while True:
            keep = open_(lo, hi)
            nodes, lo, hi = nodes[keep], lo[keep], hi[keep]
            if not len(nodes):
                return hits
            best = np.argsort(-hi, kind="stable")
            now, rest = best[:STEP], best[STEP:]
            took, nodes, lo, hi = nodes[now], nodes[rest], lo[rest], hi[rest]
            leaves, inner = took[self.leaf[took]], took[~self.leaf[took]]
            if len(leaves):
                at = ranges(self.first[leaves], self.last[leaves])
                score = products(self.x[at], q, exact)
                some = np.array(((score[:, None] >= least) & (score[:, None] <= high)).any(axis=1), dtype=bool)
                at, score = at[some], score[some]
                rows = ranges(self.start[at], self.start[at + 1])
                score = np.repeat(score, self.start[at + 1] - self.start[at])
                fits = wanted(self.label[rows])
                mine = fits & (self.vec_id[rows] == me) & np.array(score == own, dtype=bool)
                for i in np.flatnonzero(mine):  # the anchor's own id, with its own vector
                    p = np.searchsorted(self.start, rows[i], "right") - 1
                    fits[i] = not np.array_equal(self.x[p], q)
                rows, score = rows[fits], score[fits]
                for w in range(len(low)):
                    inside = np.flatnonzero(np.array((score >= least[w]) & (score <= high[w]), dtype=bool))
                    if len(inside):
                        hits[w] = sorted(hits[w] + [(-int(score[i]), int(self.vec_id[rows[i]])) for i in inside])[:k]
                        if len(hits[w]) == k:
                            least[w] = max(least[w], -hits[w][-1][0])
            if len(inner):
                below = ranges(self.first[inner], self.last[inner])
                more_lo, more_hi = self.bounds(below, q, qn)
                nodes, lo, hi = np.concatenate((nodes, below)), np.concatenate((lo, more_lo)), np.concatenate((hi, more_hi))


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges first to last, one range after the other."""
    n = last - first
    return np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())


def _searched(trees: DataFrame, parts: int, anchors: DataFrame, blocks: int, dims: int, k: int, floor: tuple[int, int] | None = None) -> DataFrame:
    """The first k hits of every window of every anchor: anchor, w, score, vec_id, rank.

    ``anchors`` has anchor (its number), vec_id, label, v. Without ``floor`` there is one window without ends, for rows of
    the anchor's label; with it there is one for each of the anchor's ``scores``, from floor[0] / floor[1] of the score up to
    it, for rows of other labels. ``w`` numbers the windows from 0.
    """
    same = floor is None
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).withColumn("part", upto(parts))
    t = trees.withColumn("block", upto(blocks))

    def run(tree: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(tree) and len(some):
            held = Tree(tree.iloc[0], dims)
            for r in some.itertuples():
                q = matrix([r.v], dims)[0]
                wanted = (lambda got: got == r.label) if same else (lambda got: got != r.label)  # noqa: B023
                high = [math.inf] if same else [int(s) for s in r.scores]
                low = [-math.inf] if same else [-(-s * floor[0] // floor[1]) for s in high]
                found = held.descend(q, wanted, np.array(low, dtype=object), np.array(high, dtype=object), k, r.vec_id)
                out += [(r.anchor, w, -s, i) for w, h in enumerate(found) for s, i in h]
        return pd.DataFrame(out, columns=["anchor", "w", "score", "vec_id"])

    found = t.groupBy("part", "block").cogroup(a.groupBy("part", "block")).applyInPandas(run, "anchor long, w int, score long, vec_id long")
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchor: Column | str, positives: int = 5, negatives: int = 5, floor: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``anchor``, over vec_id and label, holds. Their positives are the first ``positives`` other
    rows of their label by falling inner product of floor(256 * x), ties by smaller vec_id; for each of these, the first
    ``negatives`` rows of other labels with floor[0] * positive <= floor[1] * negative <= floor[1] * positive.

    Rows without vec_id or label, and rows whose vector is null or has a null or non-finite component (or one beyond
    1e100) take no part. Rows equal in id, label and vector count once; rows that share an id only are rows of their own,
    and an anchor's own row is never its positive. A vector shorter than others counts as padded with zeros, an empty one
    as zero. Products beyond the range of a long are cut to it. Anchors without positive, and positives without a
    negative, give no rows; neither does an empty table. Other columns are ignored.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vectors = written(whole_vectors(df), "vectors")
    anchors = written(vectors.filter(anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n = anchors.count()
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    blocks = math.ceil(n / BLOCK)
    trees, parts, dims = cover_trees(vectors, max(positives, negatives))
    own = _searched(trees, parts, anchors, blocks, dims, positives)
    own = written(own.select("anchor", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = own.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    found = _searched(trees, parts, anchors.join(windows, "anchor"), blocks, dims, negatives, floor)
    found = found.select("anchor", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = own.join(found, ["anchor", "w"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


travels(__name__)
