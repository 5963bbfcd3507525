"""Quality score of documents: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of a text are standardised and mapped to ``sqrt(2 / D) * cos(x W + b)``, whose inner products approximate
a Gaussian kernel. Ridge weights solve the normal equations, which every partition of the training rows sums for itself,
so that only ``PARTS`` matrices of fixed size reach the driver. A share of the training rows is left out of the fit and
calibrates the raw score by isotonic regression over equal bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohaline.llm.common import fold, travels
from isohaline.session import written

SAMPLE = 100_000  # labelled rows that the fit may use, chosen by a hash of the id
FEATURES = 160  # random Fourier features
PARTS = 16  # partial sums of the normal equations
RIDGE = 1e-3  # ridge penalty per training row
BINS = 400  # bins of the raw score for calibration
THRESHOLD = 0.3

_CLASS = np.zeros(256, dtype=np.uint8)  # byte -> 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 junk mark, 7 non-ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
for _c in b" \t\r\x0b\x0c":
    _CLASS[_c] = 4
for _c in b".,;:?'\"-()":
    _CLASS[_c] = 5
for _c in b"#*$%&|<>!{}[]\\/@^~=+_":
    _CLASS[_c] = 6


def statistics(text: str | None) -> list[float]:
    """Fixed number of figures of a whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(len(raw), 1)
    share = np.bincount(_CLASS, weights=counts, minlength=8) / n
    words = raw.split()
    n_words = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    distinct = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    line_set = set(lines)
    p = counts[counts > 0] / n
    tail = np.bincount(_CLASS[np.frombuffer(b"".join(w[-1:] for w in words), dtype=np.uint8)], minlength=8) / n_words
    alone = sum(1 for w in words if len(w) == 1 and _CLASS[w[0]] == 6)
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    return [
        *share, counts[ord("|")] / n, counts[ord("!")] / n, np.log1p(len(words)), distinct / n_words, pairs,
        lengths.mean(), lengths.std(), np.log1p(lengths.max()), tail[5], tail[6], alone / n_words,
        1 - len(line_set) / n_lines, sum(map(len, line_set)) / max(sum(map(len, lines)), 1), np.log1p(len(words) / n_lines),
        float(-(p * np.log2(p)).sum()),
    ]


WIDTH = len(statistics("a b"))


@dataclass
class Model:
    """What scoring needs; a few hundred kilobytes at most."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return lift(x, self.mean, self.scale, self.w, self.b) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def lift(x, mean, scale, w, b) -> np.ndarray:
    z = np.sqrt(2.0 / w.shape[1]) * np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b)
    return np.hstack([z, np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by ``x``; returns the pools' centres and levels."""
    pools: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        pools.append([xi * ni, yi * ni, ni])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + c for a, c in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _featured(rows: DataFrame) -> DataFrame:
    """Replaces ``text`` by its statistics ``x``; other columns stay."""
    keep = [f.name for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"), "x array<double>"])

    def run(batches):
        for b in batches:
            out = b[keep].copy()
            out["x"] = [statistics(t) for t in b["text"]]
            yield out

    return rows.mapInPandas(run, schema)


def _normal_equations(rows: DataFrame, mean, scale, w, b) -> tuple[np.ndarray, np.ndarray]:
    d = FEATURES + 1

    def sums(batches):
        a, r = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            z = lift(np.array(batch["x"].tolist()), mean, scale, w, b)
            a += z.T @ z
            r += z.T @ batch["y"].to_numpy(dtype=float)
        yield pd.DataFrame({"a": [a.tobytes()], "r": [r.tobytes()]})

    parts = rows.repartition(PARTS, "k").sortWithinPartitions("k").mapInPandas(sums, "a binary, r binary").collect()
    a = sum(np.frombuffer(bytes(p["a"])).reshape(d, d) for p in parts)
    r = sum(np.frombuffer(bytes(p["r"])) for p in parts)
    return a, r


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fits on documents whose id has a non-null 0/1 label; the caller leaves held-out rows out of ``labels``.

    At most about ``sample`` label rows are used: above that, ids are kept by a hash at the fitting rate. Several labels
    of one id all count. Without labels of both kinds the score is constant: the share of ones, 0.5 without any.
    """
    lab = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("k"), F.col("quality").cast("double").alias("y"))
    n = lab.count()
    if n > sample:
        lab = lab.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    texts = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("k")).select("k", "y", "text")
    rows = written(_featured(texts), "statistics").withColumn("part", F.pmod(F.xxhash64("k", F.lit("calibrate")), F.lit(4)))
    xs = [F.element_at("x", i + 1) for i in range(WIDTH)]
    facts = rows.agg(F.count("*"), F.sum("y"), *[F.avg(c) for c in xs], *[F.stddev_pop(c) for c in xs]).collect()[0]
    zero = np.zeros(WIDTH)
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=1.0 / np.sqrt(WIDTH), size=(WIDTH, FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    total, ones = facts[0], facts[1] or 0.0
    if total == 0 or ones in (0, total):
        level = ones / total if total else 0.5
        return Model(zero, zero + 1, w, b, np.zeros(FEATURES + 1), np.array([0.0]), np.array([level]))
    mean, scale = np.array(facts[2 : 2 + WIDTH], dtype=float), np.array(facts[2 + WIDTH :], dtype=float)
    scale[scale < 1e-9] = 1.0
    a, r = _normal_equations(rows.filter("part > 0"), mean, scale, w, b)
    beta = np.linalg.solve(a + RIDGE * max(a[-1, -1], 1.0) * np.eye(len(a)), r)
    raw = Model(mean, scale, w, b, beta, zero, zero).raw

    def scored(batches):
        for batch in batches:
            yield pd.DataFrame({"s": np.clip(raw(np.array(batch["x"].tolist())), -1, 2), "y": batch["y"], "part": batch["part"]})

    bins = rows.mapInPandas(scored, "s double, y double, part long").groupBy("part", F.floor(F.col("s") * BINS).alias("bin"))
    bins = bins.agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    held = [p for p in bins if p["part"] == 0] if any(p["part"] == 0 for p in bins) else bins
    knots, levels = isotonic(*(np.array([p[c] for p in held], dtype=float) for c in ("s", "y", "n")))
    return Model(mean, scale, w, b, beta, knots, levels)


def scorer(model: Model):
    """The score as a column function of text, for filters that keep all columns of a table."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), WIDTH)))

    return score


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row. Null and empty texts are scored like any text, from zero counts."""

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b["text"]]).reshape(len(b), WIDTH)
            s = model.score(x)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "predicted": (s >= THRESHOLD).astype("int32")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold (crc32 of the id modulo 5 is 0)."""
    return labels.filter(fold(F.col("doc_id"), 5) != 0)


travels(__name__)
