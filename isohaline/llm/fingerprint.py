"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, and a long line counts as several of ``PIECE`` words; its digest also covers how often it occurred
before, so that repeats count. Every digest is added to one cell in each of three parts of a sketch: a count, a sum of
digests and a sum of checks. Subtracting two sketches leaves the digests that only one text has, and peeling cells that
hold a single digest recovers them. Where a sketch is too small for the difference, peeling gets stuck and a sketch
``GROW`` times as large is made from the texts and tried.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohaline.llm.common import partitions_of, travels

CELLS = 24  # cells of a fingerprint
GROW = 2
PIECE = 8  # words of the longest piece
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)[:, None]
_ZERO = np.uint64(0)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        words = line.split(" ")
        if len(words) <= PIECE:
            if line:
                out.append(line)
        else:
            out += [p for p in (" ".join(words[i : i + PIECE]) for i in range(0, len(words), PIECE)) if p]
    return out


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs, the n-th occurrence of one being different from the others."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        n = seen.get(p, 0)
        seen[p] = n + 1
        out.append(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), n))
    return np.array(out, dtype=np.uint64)


def _places(keys: np.ndarray, part: int) -> np.ndarray:
    return (_mix(keys + _SALT) % np.uint64(part)).astype(np.intp) + np.arange(3)[:, None] * part


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(0xFFFFFFFF)


class Sketch:
    def __init__(self, count: np.ndarray, key: np.ndarray, check: np.ndarray):
        self.count, self.key, self.check = count, key, check

    @classmethod
    def of(cls, keys: np.ndarray, cells: int) -> Sketch:
        at = _places(keys, cells // 3).ravel()
        count, key, check = np.bincount(at, minlength=cells).astype(np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        np.add.at(key, at, np.tile(keys, 3))
        np.add.at(check, at, np.tile(_check(keys), 3))
        return cls(count, key, check)

    def minus(self, other: Sketch) -> Sketch:
        return Sketch(self.count - other.count, self.key - other.key, self.check - other.check)

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests with count 1 and with count -1, or None if the sketch is too small for them. Empties the sketch."""
        part = len(self.count) // 3
        plus, minus = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _ in range(3 * len(self.count)):
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            key, check = self.key[at], self.check[at]
            below = sign < 0
            key[below], check[below] = _ZERO - key[below], _ZERO - check[below]
            good = _check(key) == check
            key, sign = key[good], sign[good]
            if not len(key):
                break
            key, first = np.unique(key, return_index=True)
            sign = sign[first]
            plus.append(key[sign > 0])
            minus.append(key[sign < 0])
            places, n = _places(key, part).ravel(), np.tile(sign, 3)
            np.subtract.at(self.count, places, n)
            flip = sign < 0
            check = _check(key)
            key[flip], check[flip] = _ZERO - key[flip], _ZERO - check[flip]
            np.subtract.at(self.key, places, np.tile(key, 3))
            np.subtract.at(self.check, places, np.tile(check, 3))
        if self.count.any() or self.key.any() or self.check.any():
            return None
        return np.concatenate(plus), np.concatenate(minus)

    def text(self) -> str:
        return base64.b64encode(self.count.astype("<i4").tobytes() + self.key.astype("<u8").tobytes() + self.check.astype("<u4").tobytes()).decode()


def difference(a: np.ndarray, b: np.ndarray, expected: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in a, only in b. Starts at the size for ``expected`` differences and grows until peeling ends."""
    cells = CELLS
    while cells < 1.5 * max(expected, abs(len(a) - len(b))):
        cells *= GROW
    while True:
        found = Sketch.of(a, cells).minus(Sketch.of(b, cells)).peel()
        if found is not None and len(a) - len(found[0]) == len(b) - len(found[1]):
            return found
        cells *= GROW


def likeness(a: np.ndarray, b: np.ndarray, expected: int = 0) -> float:
    """Shared paragraphs over all paragraphs of both; 1 if neither has any."""
    only_a, only_b = difference(a, b, expected)
    shared = len(a) - len(only_a)
    total = shared + len(only_a) + len(only_b)
    return shared / total if total else 1.0


def fingerprint(text: str) -> str:
    return Sketch.of(digests(text), CELLS).text()


def compare(text: str, keys: np.ndarray, following: str, following_keys: np.ndarray) -> tuple:
    n = len(text)
    m = n // 4
    edited = text[: n - m] + following[:m]
    keys_e = digests(edited)
    return (
        n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), Sketch.of(keys, CELLS).text(), Sketch.of(keys_e, CELLS).text(),
        likeness(keys, keys_e, (len(keys) + len(keys_e)) // 3), likeness(keys, following_keys, len(keys) + len(following_keys)),
    )


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text of all rows in ranges of doc_id, sorted, each range followed by the first row of the next one.

    ``tail`` is true for that extra row (after the last range: the first row of all). Rows with one doc_id stand by
    text; null ids come last. Ranges come from the ids alone; texts are shuffled once.
    """
    n = partitions_of(docs)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = own.filter("doc_id IS NOT NULL")
    parts = known.select("doc_id").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("lo"))
    starts = sorted(r["lo"] for r in parts.collect())
    bounds = np.array(starts[1:])
    kind = docs.schema["doc_id"].dataType

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        out = np.full(len(ids), len(starts), dtype=np.int32)
        there = ids.notna().to_numpy()
        out[there] = np.searchsorted(bounds, ids[there].to_numpy(dtype=bounds.dtype if len(bounds) else None), side="right")
        return pd.Series(out)

    rows = own.select(range_of("doc_id").alias("range"), F.lit(False).alias("tail"), "doc_id", "text")
    spark = docs.sparkSession
    last = len(starts)  # range of the rows without id
    firsts = known.join(F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(starts)], f"s {kind.simpleString()}, i int")), F.col("doc_id") == F.col("s"))
    firsts = firsts.groupBy("i").agg(F.min("text").alias("text"))
    nulls = own.filter("doc_id IS NULL").agg(F.min("text").alias("text"), F.count("*").alias("n")).filter("n > 0").select(F.lit(last).alias("i"), "text")
    has_null = not nulls.isEmpty()
    total = last + has_null
    firsts = firsts.unionByName(nulls) if has_null else firsts
    before = F.pmod(F.col("i") - 1, F.lit(max(total, 1))).cast("int")
    tails = firsts.select(before.alias("range"), F.lit(True).alias("tail"), F.lit(None).cast(kind).alias("doc_id"), "text")
    dealt = rows.unionByName(tails).repartitionById(max(total, 1), "range")
    return dealt.sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_last(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``COLUMNS`` for every row of ``docs``; see ``compare``.

    The next document is the next row by doc_id, then text; a single row is its own next. Null text counts as empty;
    empty texts have no paragraphs and are alike (1.0). Equal texts have equal fingerprints. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held = None
        for b in batches:
            out = []
            for doc_id, text, tail in zip(b["doc_id"], b["text"], b["tail"]):
                keys = digests(text)
                if held is not None:
                    out.append((held[0], *compare(held[1], held[2], text, keys)))
                held = None if tail else (doc_id, text, keys)
            frame = pd.DataFrame(out, columns=["doc_id", *COLUMNS])
            frame["doc_id"] = frame["doc_id"].astype("Int64") if kind in ("bigint", "int") else frame["doc_id"]
            yield frame

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).select("doc_id", "text", "tail").mapInPandas(run, schema)


travels(__name__)
