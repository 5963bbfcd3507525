"""Language of documents from a bidirectional gated recurrent network over bytes.

Texts are read whole, as UTF-8 windows of ``SPAN`` bytes that start from a zero state. In each window one network reads
forwards and one backwards; at every byte both states together give label probabilities, and the mean over all bytes of
a document is its probability per language. Gates use the softsign curve instead of the exponential one, which is a third
of the cost. Training is backpropagation through time in numpy on a bounded sample; scoring runs in tasks, thousands of
windows in lockstep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohaline.llm.common import fold, travels

SPAN = 128  # bytes of a window
HIDDEN = 12  # units per direction
BLOCK = 896  # windows scored in lockstep; products of this size stay in one thread of the linear algebra library
DOCS_PER_LANGUAGE = 400  # distinct texts that training uses per language, the first by hash, each with all its windows
BYTES_PER_LANGUAGE = 8_000_000  # and at most so many bytes of them
MAX_LANGUAGES = 10_000  # counts per language that are broadcast
STEPS, BATCH, RATE = 120, 192, 0.02
UNKNOWN = "und"


class Reader:
    """One direction of the network: tables of input terms per byte and recurrent matrices."""

    def __init__(self, rng, h=HIDDEN):
        self.p = {
            "erz": rng.normal(scale=0.3, size=(256, 2 * h)).astype(np.float32), "en": rng.normal(scale=0.3, size=(256, h)).astype(np.float32),
            "urz": rng.normal(scale=0.3, size=(h, 2 * h)).astype(np.float32), "un": rng.normal(scale=0.3, size=(h, h)).astype(np.float32),
        }

    def read(self, x: np.ndarray) -> np.ndarray:
        """States [T, B, H] after each of the bytes x [T, B]."""
        p, (t, b), h = self.p, x.shape, self.p["un"].shape[0]
        out = np.empty((t, b, h), np.float32)
        rz, a = np.empty((b, 2 * h), np.float32), np.empty((b, 2 * h), np.float32)
        n, c = np.empty((b, h), np.float32), np.empty((b, h), np.float32)
        r, z = np.empty_like(n), np.empty_like(n)
        state = np.zeros((b, h), np.float32)
        for i in range(t):
            np.take(p["erz"], x[i], axis=0, out=rz, mode="clip")
            np.matmul(state, p["urz"], out=a)
            rz += a
            np.abs(rz, out=a)
            a += 1
            rz /= a
            rz *= 0.5
            rz += 0.5
            np.copyto(r, rz[:, :h])
            np.copyto(z, rz[:, h:])
            np.take(p["en"], x[i], axis=0, out=n, mode="clip")
            np.matmul(state, p["un"], out=c)
            c *= r
            n += c
            np.abs(n, out=c)
            c += 1
            n /= c
            np.subtract(state, n, out=c)
            c *= z
            state = np.add(n, c, out=out[i])
        return out

    def gradients(self, x: np.ndarray, out: np.ndarray, d_out: np.ndarray) -> dict:
        """Backpropagation through time: gradients of the parameters from those of the states."""
        p, (t, b), h = self.p, x.shape, self.p["un"].shape[0]
        d = {k: np.zeros_like(v) for k, v in p.items()}
        d_rz, d_n = np.empty((t, b, 2 * h), np.float32), np.empty((t, b, h), np.float32)
        back = np.zeros((b, h), np.float32)
        for i in range(t - 1, -1, -1):
            before = out[i - 1] if i else np.zeros((b, h), np.float32)
            u = p["erz"][x[i]] + before @ p["urz"]
            curve = u / (1 + np.abs(u))
            r, z = 0.5 + 0.5 * curve[:, :h], 0.5 + 0.5 * curve[:, h:]
            m = before @ p["un"]
            v = p["en"][x[i]] + r * m
            n = v / (1 + np.abs(v))
            dh = d_out[i] + back
            dv = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dm = dv * r
            du = np.hstack([dv * m, dh * (before - n)]) * 0.5 * (1 - np.abs(curve)) ** 2
            d["un"] += before.T @ dm
            d["urz"] += before.T @ du
            back = dh * z + dm @ p["un"].T + du @ p["urz"].T
            d_rz[i], d_n[i] = du, dv
        flat = x.ravel()
        for key, g in (("erz", d_rz.reshape(-1, 2 * h)), ("en", d_n.reshape(-1, h))):
            d[key] = np.stack([np.bincount(flat, weights=g[:, j], minlength=256) for j in range(g.shape[1])], axis=1).astype(np.float32)
        return d


@dataclass
class Model:
    """Trained network; a few tens of kilobytes. Without languages it answers ``und``."""

    languages: list[str]
    ahead: Reader
    behind: Reader
    w: np.ndarray
    b: np.ndarray

    def label(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities [T, B, L] at every byte of x [T, B], and the states of both directions."""
        f, g = self.ahead.read(x), self.behind.read(x[::-1])[::-1]
        h = f.shape[2]
        logits = np.matmul(f, self.w[:h]) + np.matmul(g, self.w[h:]) + self.b
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, f, g


def windows_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows [N, SPAN] of all texts, zero-padded; bytes used in each; the text that each belongs to."""
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    n = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(raws)), n)
    first = np.cumsum(n) - n
    data = np.zeros(int(n.sum()) * SPAN, dtype=np.uint8)
    for i, r in enumerate(raws):
        at = int(first[i]) * SPAN
        data[at : at + len(r)] = np.frombuffer(r, dtype=np.uint8)
    number = np.arange(len(owner)) - first[owner] if len(owner) else owner
    used = np.minimum(sizes[owner] - number * SPAN, SPAN) if len(owner) else owner
    return data.reshape(-1, SPAN), used, owner


def pooled(model: Model, raws: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all bytes of each text; zeros for an empty one."""
    data, used, owner = windows_of(raws)
    sums = np.zeros((len(raws), len(model.languages)))
    for at in range(0, len(data), BLOCK):
        x = np.ascontiguousarray(data[at : at + BLOCK].T).astype(np.intp)
        prob, _, _ = model.label(x)
        prob *= (np.arange(SPAN)[:, None] < used[at : at + BLOCK])[:, :, None]
        np.add.at(sums, owner[at : at + BLOCK], prob.sum(axis=0))
    total = np.bincount(owner, weights=used, minlength=len(raws)) if len(raws) else np.zeros(0)
    return sums / np.maximum(total, 1)[:, None]


def train(windows: np.ndarray, used: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 11) -> Model:
    """Adam on the mean log loss over all bytes of batches in which every language has an equal share."""
    rng = np.random.default_rng(seed)
    model = Model(languages, Reader(rng), Reader(rng), (rng.normal(size=(2 * HIDDEN, len(languages))) * 0.3).astype(np.float32), np.zeros(len(languages), np.float32))
    by = [np.flatnonzero(labels == k) for k in range(len(languages))]
    names = [("f", k) for k in model.ahead.p] + [("g", k) for k in model.behind.p] + [("o", "w"), ("o", "b")]
    hold = lambda part, key: getattr(model, key) if part == "o" else (model.ahead if part == "f" else model.behind).p[key]
    m1, m2 = ({n: np.zeros_like(hold(*n)) for n in names} for _ in range(2))
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(ix, max(1, BATCH // len(by))) for ix in by])
        x, y = windows[rows].T.astype(np.intp), labels[rows]
        mask = np.arange(SPAN)[:, None] < used[rows]
        prob, f, g = model.label(x)
        d = prob.copy()
        d[:, np.arange(len(rows)), y] -= 1
        d *= (mask / mask.sum())[:, :, None].astype(np.float32)
        flat = d.reshape(-1, d.shape[2])
        grads = {("o", "w"): np.vstack([f.reshape(-1, HIDDEN).T @ flat, g.reshape(-1, HIDDEN).T @ flat]), ("o", "b"): flat.sum(axis=0)}
        grads |= {("f", k): v for k, v in model.ahead.gradients(x, f, d @ model.w[:HIDDEN].T).items()}
        back = model.behind.gradients(x[::-1], g[::-1], (d @ model.w[HIDDEN:].T)[::-1])
        grads |= {("g", k): v for k, v in back.items()}
        norm = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
        rate = RATE * min(1.0, 1.5 * (1 - (step - 1) / steps))
        for n in names:
            v = grads[n] * min(1.0, 1.0 / max(norm, 1e-9))
            m1[n] = 0.9 * m1[n] + 0.1 * v
            m2[n] = 0.99 * m2[n] + 0.01 * v * v
            hold(*n)[...] -= rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-6)
    return model


def fit(docs: DataFrame, steps: int = STEPS) -> Model:
    """Learns from rows with text and lang; the caller leaves held-out rows out of ``docs``.

    The sample is drawn from distinct texts, so copies of a text, however many, count once. A language of which no text fits
    the bounds is not learned.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != "")).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = known.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    rate = F.least(F.lit(1.0), F.lit(2.0 * DOCS_PER_LANGUAGE) / F.col("n"))  # twice as many, of which the first are used
    drawn = known.join(F.broadcast(counts), "lang") if counts.limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES else known.join(counts, "lang")
    drawn = drawn.filter(F.pmod("h", F.lit(1_000_000)) < rate * 1_000_000).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h")
    first = drawn.withColumns({"at": F.row_number().over(order), "upto": F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    first = first.filter((F.col("at") <= DOCS_PER_LANGUAGE) & (F.col("upto") <= BYTES_PER_LANGUAGE))
    rows = sorted((r["lang"], r["text"]) for r in first.select("lang", "text").collect())
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        rng = np.random.default_rng(0)
        return Model([], Reader(rng), Reader(rng), np.zeros((2 * HIDDEN, 0), np.float32), np.zeros(0, np.float32))
    data, used, owner = windows_of([text.encode("utf-8", "replace") for _, text in rows])
    return train(data, used, np.array([languages.index(lang) for lang, _ in rows])[owner], languages, steps)


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row.

    ``und`` with score 0 where the text is null, has no letter (Unicode category L), or nothing was learned. Whole texts
    are read whatever their length; repeated rows and null ids give a row each, an empty table none.
    """

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b["text"]]
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model.languages and any(c.isalpha() for c in t)]
            if rows:
                p = pooled(model, [texts[i].encode("utf-8", "replace") for i in rows])
                lang[rows] = np.array(model.languages, dtype=object)[p.argmax(axis=1)]
                score[rows] = np.clip(p.max(axis=1), 0, 1)
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": lang, "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents outside the held-out fold (crc32 of the id modulo 3 is 1)."""
    return docs.filter(fold(F.col("doc_id"), 3) != 1)


travels(__name__)
