"""Alignment of two tokenizers by products of sparse incidence matrices.

Both tokenizers cut the same bytes (a space and the text). A tokenizer's incidence matrix has a row for each token and a
column for each byte, stored as compressed rows: row starts, columns, values. The rows of A times the transposed B, by
Gustavson's method (for every entry of a row, add that row of the other matrix), give the overlap links: which tokens share
bytes, and how many. Offsets at which tokens of both end cut the bytes into groups; the product of the two token-group
matrices gives the links of tokens that share a group.

Documents are aligned together, about ``CHUNK`` bytes at a time, and products are taken in blocks of rows, so a task's memory
is bounded by the tokens of its longest text. Counts of id pairs over the corpus are sums of counts per document; pairs are at
most as many as the two vocabularies allow and usually few, so they are broadcast if a bounded count proves them small
and shuffled otherwise.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohaline.llm.common import travels
from isohaline.session import broadcast_if_small, written

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 400_000  # bytes that are aligned together
ROWS_OUT = 2_000_000  # bytes of a batch of links
B_SPAN = 1 << 24  # ids of B stay below this; a pair is a_id * B_SPAN + b_id
# Fixed value: the pattern by which the byte-level vocabulary cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENDLESS = re.compile(r"\s{65536}|\S{65536}")  # runs on which the faster tokenizer may run out of stack


@dataclass
class Csr:
    """Sparse matrix in compressed rows: row i holds entries start[i] to start[i + 1]."""

    start: np.ndarray
    col: np.ndarray
    val: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    @property
    def transposed(self) -> Csr:
        order = np.argsort(self.col, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(self.col, minlength=self.width))))
        return Csr(start, self.rows[order], self.val[order], len(self.start) - 1)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    n = last - first
    return np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())


def spans(first: np.ndarray, last: np.ndarray, width: int) -> Csr:
    """Row i has ones in the columns first[i] to last[i] - 1."""
    return Csr(np.concatenate(([0], np.cumsum(last - first))), _ranges(first, last), np.ones((last - first).sum(), dtype=np.int64), width)


def product(a: Csr, b: Csr) -> Csr:
    """a times b, row by row: every entry (i, k) of a adds val * row k of b to row i."""
    lo, hi = b.start[a.col], b.start[a.col + 1]
    take = _ranges(lo, hi)
    row, col = np.repeat(a.rows, hi - lo), b.col[take]
    val = np.repeat(a.val, hi - lo) * b.val[take]
    key = row * b.width + col
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, val = key[order], val[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.intp)
    val = np.add.reduceat(val, first) if len(first) else val
    row, col = np.divmod(key[first], b.width) if len(first) else (key, key)
    start = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(a.start) - 1))))
    return Csr(start, col, val, b.width)


def overlaps(a_end: np.ndarray, b_end: np.ndarray, block: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlap links (A's token, B's token, shared bytes) of two cuttings of the same bytes, given by where tokens end."""
    a_first, b_first = np.concatenate(([0], a_end[:-1])), np.concatenate(([0], b_end[:-1]))
    out = []
    at = 0
    while at < len(a_end):
        to = max(at + 1, int(np.searchsorted(a_end, a_first[at] + block, "right")))
        lo, hi = a_first[at], a_end[to - 1]
        j, k = int(np.searchsorted(b_end, lo, "right")), int(np.searchsorted(b_first, hi, "left"))
        ours = spans(a_first[at:to] - lo, a_end[at:to] - lo, hi - lo)
        theirs = spans(np.maximum(b_first[j:k], lo) - lo, np.minimum(b_end[j:k], hi) - lo, hi - lo)
        found = product(ours, theirs.transposed)
        out.append((found.rows + at, found.col + j, found.val))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3


def group_matrices(a_end: np.ndarray, b_end: np.ndarray, ends: np.ndarray) -> tuple[Csr, Csr]:
    """Token-group incidence of both tokenizers; a group runs up to one of ``ends``, where tokens of both end."""
    a, b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
    return spans(a, a + 1, len(ends)), spans(b, b + 1, len(ends))


@lru_cache(2)
def byte_vocabulary(text: str) -> tuple[dict[bytes, int], tuple[bytes, ...]]:
    """Byte strings with ids, and the byte string of each id, from the JSON of a byte-level merging tokenizer."""
    model = json.loads(text)["model"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    special = {t["content"] for t in json.loads(text)["added_tokens"]}
    ids = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merges != sorted(merges) or len(merges) + 256 != len(ids):
        raise ValueError("ids of merged tokens have to follow the order of the merges")
    raw = [b""] * (max(model["vocab"].values()) + 1)
    for token, i in ids.items():
        raw[i] = token
    return ids, tuple(raw)


class ByteTokenizer:
    """The byte-level tokenizer: ids of a text, special tokens being plain text."""

    def __init__(self, text: str):
        import tiktoken

        ids, self.raw = byte_vocabulary(text)
        self.fast, self.text, self.slow = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={}), text, None

    def encode(self, texts: list[str]) -> list:
        return [self._endless(t) if _ENDLESS.search(t) else self.fast.encode_ordinary(t) for t in texts]

    def _endless(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        if self.slow is None:
            self.slow = Tokenizer.from_str(self.text)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """The piece tokenizer: ids of a text, before which it puts a space itself."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_proto=proto)
        piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        self.raw = tuple(b"" if m.is_control(i) or m.is_unknown(i) else piece(i) for i in range(m.get_piece_size()))

    def encode(self, texts: list[str]) -> list:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Aligns texts inside a task."""

    def __init__(self, byte_text: str, piece_proto: bytes):
        self.a, self.b = ByteTokenizer(byte_text), PieceTokenizer(piece_proto)
        self.a_len, self.b_len = (np.array([len(x) for x in t.raw], dtype=np.int64) for t in (self.a, self.b))
        n, m = len(self.a.raw), len(self.b.raw)
        self.words = np.array([f"{i}{s}" for k, s in ((n, ","), (n, "|"), (m, ","), (m, ";")) for i in range(k)], dtype=object)

    def chunk(self, texts: list[str]) -> tuple:
        """Ids and ends of both, with how many of them each text has; ends count over all texts. Texts without tokens have 0."""
        some = [i for i, t in enumerate(texts) if t]
        a_all, b_all = self.a.encode([" " + texts[i] for i in some]), self.b.encode([texts[i] for i in some])
        n_a, n_b = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        a_ids, b_ids = [], []
        for i, a, b in zip(some, a_all, b_all):
            whole = b" " + texts[i].encode("utf-8", "surrogatepass")
            if b"".join([self.a.raw[x] for x in a]) == whole == b"".join([self.b.raw[x] for x in b]):
                n_a[i], n_b[i] = len(a), len(b)
                a_ids.append(a)
                b_ids.append(b)
        a_ids, b_ids = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (a_ids, b_ids))
        return a_ids, b_ids, np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids]), n_a, n_b

    def aligned(self, texts: list[str]) -> pd.DataFrame:
        """n_a, n_b, n_groups, n_links, groups, pairs, counts of every text."""
        a_ids, b_ids, a_end, b_end, n_a, n_b = self.chunk(texts)
        i, j, _ = overlaps(a_end, b_end)
        together = a_end[i] == b_end[j]
        i, j = i[together], j[together]
        ends = a_end[i]
        ours, theirs = group_matrices(a_end, b_end, ends)
        a_of, b_of = ours.col, theirs.col
        a_to, b_to = ours.transposed.start, theirs.transposed.start  # tokens of the groups before each group
        # `1,2|3;4|5,6;`: every token stands after its group's earlier tokens and before a mark
        n, m = len(self.a.raw), len(self.b.raw)
        codes = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
        codes[np.arange(len(a_ids)) + b_to[a_of]] = a_ids + n * (np.arange(len(a_ids)) + 1 == a_to[a_of + 1])
        codes[np.arange(len(b_ids)) + a_to[b_of + 1]] = b_ids + 2 * n + m * (np.arange(len(b_ids)) + 1 == b_to[b_of + 1])
        upto = np.cumsum(n_a + n_b)
        groups = ["".join(self.words[codes[lo:hi]].tolist())[:-1] for lo, hi in zip(upto - n_a - n_b, upto)]
        text_of = np.searchsorted(np.cumsum(n_a), i, "right")
        per_text = np.bincount(text_of, minlength=len(texts))
        pair = a_ids[i] * B_SPAN + b_ids[j]
        known, code = np.unique(pair, return_inverse=True)
        both, counts = np.unique(text_of * max(1, len(known)) + code, return_counts=True)
        cut = np.searchsorted(both, np.arange(1, len(texts)) * max(1, len(known)))
        pairs = known[both % max(1, len(known))] if len(known) else both
        return pd.DataFrame({
            "n_a": n_a, "n_b": n_b, "n_groups": per_text, "n_links": per_text, "groups": groups,
            "pairs": np.split(pairs, cut), "counts": np.split(counts, cut),
        })

    def links(self, texts: list[str], grouped: bool) -> pd.DataFrame:
        """text, a_at, b_at, a_id, b_id and shared: the bytes two tokens share, or 1 for tokens of one group."""
        a_ids, b_ids, a_end, b_end, n_a, n_b = self.chunk(texts)
        if grouped:
            ours, theirs = group_matrices(a_end, b_end, np.intersect1d(a_end, b_end))
            found = product(ours, theirs.transposed)
            i, j, shared = found.rows, found.col, found.val
        else:
            i, j, shared = overlaps(a_end, b_end)
        text = np.searchsorted(np.cumsum(n_a), i, "right")
        return pd.DataFrame({"text": text, "a_at": i - (np.cumsum(n_a) - n_a)[text], "b_at": j - (np.cumsum(n_b) - n_b)[text], "a_id": a_ids[i], "b_id": b_ids[j], "shared": shared})


def _chunks(texts: list[str]):
    """(first, last) of runs of about CHUNK characters; a longer text stands alone."""
    at = size = 0
    for n, t in enumerate(texts):
        if n > at and size + len(t) > CHUNK:
            yield at, n
            at, size = n, 0
        size += len(t)
    if len(texts) > at:
        yield at, len(texts)


def _models(spark, byte_path: str, piece_path: str):
    """Both model files, read on the driver and sent along; they do not grow with the corpus."""
    with open(byte_path, encoding="utf-8") as a, open(piece_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def align(docs: DataFrame, byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs, counts for every row of ``docs``.

    A is the byte-level tokenizer over a space and the text, B the piece tokenizer over the text; both take the strings of
    special tokens as plain text. ``groups`` is the alignment as text, ids of A and B group by group: ``a1,a2|b1;a3|b2,b3``.
    Links are pairs of tokens that end at the same byte; ``pairs`` holds the id pairs of a text (a_id * 2^24 + b_id) and
    ``counts`` how many of its links hold each. Null and empty texts, and texts whose joined tokens of A or B are not the
    space and the text (those with U+2581, which B reads as a space) have no tokens: zeros and empty values. Repeated rows
    and rows without id give a row each, other columns are ignored, an empty table gives no rows. A text is encoded whole.
    """
    models = _models(docs.sparkSession, byte_path, piece_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        aligner = Aligner(*models.value)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for lo, hi in _chunks(texts):
                out = aligner.aligned(texts[lo:hi])
                out.insert(0, "doc_id", b["doc_id"].iloc[lo:hi].to_numpy())
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, counts array<long>")


def token_links(docs: DataFrame, grouped: bool = False, byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> DataFrame:
    """All overlap links of every row, or with ``grouped`` all links of tokens in one group, as a long table.

    doc_id, a_at, b_at (places of the tokens in the text, from 0), a_id, b_id, shared (bytes; 1 for a group). Rows and texts
    are taken as by ``align``.
    """
    models = _models(docs.sparkSession, byte_path, piece_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        aligner = Aligner(*models.value)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for lo, hi in _chunks(texts):
                out = aligner.links(texts[lo:hi], grouped)
                out.insert(0, "doc_id", b["doc_id"].iloc[lo:hi].to_numpy()[out.pop("text")])
                for at in range(0, len(out), ROWS_OUT // 40):
                    yield out.iloc[at : at + ROWS_OUT // 40]

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, a_at long, b_at long, a_id long, b_id long, shared long")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links that hold it, over the whole corpus), best (no pair of its B id has a higher count)."""
    per = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    per = written(per, "pairs").withColumn("b", F.pmod("pair", F.lit(B_SPAN)))
    top = per.groupBy("b").agg(F.max("count").alias("top"))
    return written(per.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "counts")


def with_counts(aligned: DataFrame, max_broadcast_rows: int | None = None) -> DataFrame:
    """Adds n_best and count_sum to aligned rows: links with a best pair, and the sum of the counts of all links.

    The rows are written first, with a number each, so texts are encoded once.
    """
    rows = written(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts, _ = broadcast_if_small(pair_counts(rows), *([] if max_broadcast_rows is None else [max_broadcast_rows]))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return rows.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).drop("row")


travels(__name__)
