"""Near-duplicate documents by b-bit MinHash: band candidates, bit-count estimates, confirmation on full shingle sets.

Texts with equal shingle sets collapse first, by a digest of the set, into the smallest id. That digest, not the id, is
the node of buckets, pairs, texts and signatures, as one id may stand for several texts; only edges are in ids. The
representatives are cut into ``BANDS`` bands of ``ROWS`` minima; a pair at similarity 0.8 shares no band with probability 3e-6. The low ``BITS``
bits of ``HASHES`` minima are packed into longs; counting differing fields of two signatures estimates the similarity
corrected for chance agreement, and pairs more than six standard deviations under the threshold are not read in full.

Pairs inside a bucket are never listed. First every member is compared with the smallest id of its bucket. What is then
one component needs no more comparisons; only members outside the largest component of a bucket are held against the
others, block by block, and only links leave a block. So every pair of different texts that shares a bucket is either
confirmed, refuted on full sets, or inside one component already.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohaline.llm.common import travels
from isohaline.session import written

BANDS, ROWS, HASHES, BITS = 24, 4, 128, 2
BLOCK_DOCS, BLOCK_BYTES = 1024, 2_000_000
FIELDS = 64 // BITS  # fields of one packed long
LONGS = HASHES // FIELDS
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(2024)
_A = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes; word hashes are remembered up to a bound."""

    def __init__(self, k: int, remember: int = 300_000):
        self.k, self.remember, self.known = k, remember, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        w = np.array(out, dtype=np.uint64)
        k = min(self.k, len(w))
        n = len(w) - k + 1
        h = w[:n].copy()
        for j in range(1, k):
            h = h * _MULTIPLIER + w[j : j + n]
        return np.unique(_mix(h + np.uint64(k)))


def minima(shingles: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        best = np.minimum(best, (shingles[at : at + 4096, None] * _A + _B).min(axis=0))
    return best


def packed(m: np.ndarray) -> np.ndarray:
    """Low bits of minima [N, HASHES] as longs [N, LONGS]."""
    low = (m & np.uint64(2**BITS - 1)).reshape(len(m), LONGS, FIELDS)
    return (low << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m[:, : BANDS * ROWS].reshape(len(m), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), BANDS)).copy()
    for j in range(ROWS):
        h = _mix(h * _MULTIPLIER + rows[:, :, j])
    return h.view(np.int64)


def similarity(a: Column, b: Column) -> Column:
    """Estimate of two packed signatures' similarity: agreeing fields, less those that agree by chance."""
    field = sum(1 << (BITS * i) for i in range(FIELDS))
    differing = F.lit(0)
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        for j in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(a[i].bitwiseXOR(b[i]), j))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(field)))
    chance = 1 / 2**BITS
    return (1 - differing / F.lit(float(HASHES)) - chance) / (1 - chance)


def floor_for(percent: int) -> float:
    """Estimate below which a pair at the threshold falls with probability 1e-9."""
    s, chance = percent / 100, 1 / 2**BITS
    agree = s + (1 - s) * chance
    return s - 6 * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text hash, n_shingles, set digest, packed signature, band keys of every row."""

    def run(batches):
        shingler = Shingler(k)
        for b in batches:
            sets = [shingler(t) for t in b["text"]]
            m = np.array([minima(s) for s in sets]).reshape(len(sets), HASHES)
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "h": b["h"], "n": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "sig": list(packed(m)), "bands": list(band_keys(m)),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return hashed.mapInPandas(run, f"doc_id {kind}, h long, n long, digest binary, sig array<long>, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (u, v): root is the smallest node that can be reached.

    Large-star and small-star steps, each written, until the edges are stars; groups are only ever reduced to minima.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.filter("u <> v"), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "small")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the texts (da, db) whose full shingle sets reach the threshold, as edges (u, v)."""
    left = pairs.join(texts.select(F.col("digest").alias("da"), F.col("text").alias("ta")), "da")
    both = left.join(texts.select(F.col("digest").alias("db"), F.col("text").alias("tb")), "db")

    def run(batches):
        shingler, last, held = Shingler(k), None, None
        for batch in batches:
            out = []
            for a, b, db, ta, tb in zip(batch["a"], batch["b"], batch["db"], batch["ta"], batch["tb"]):
                if db != last:
                    last, held = db, shingler(tb)
                own = shingler(ta)
                inter = len(np.intersect1d(own, held, assume_unique=True))
                if 100 * inter >= percent * (len(own) + len(held) - inter):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["u", "v"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "db", "ta", "tb").mapInPandas(run, f"u {kind}, v {kind}")


def _across(open_: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members of different components of a bucket, as edges (u, v).

    ``apart`` marks the members outside the largest component; each is held against all members. Both sides are cut
    into blocks of at most ``BLOCK_DOCS`` texts and about ``BLOCK_BYTES``, and a task gets one block of either side, counts
    common shingles there through an inverted list and returns links only, never pairs.
    """
    rows = written(open_.join(texts, "digest"), "open")
    size = lambda c: F.ceil(F.greatest(F.sum(F.when(c, F.octet_length("text"))) / BLOCK_BYTES, F.count_if(c) / BLOCK_DOCS))
    per = written(rows.groupBy("key").agg(size(F.lit(True)).alias("ny"), size(F.col("apart")).alias("nx")), "blocks")
    every = rows.join(per, "key")
    of = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "digest"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    xs = every.filter("apart").select("key", "rep", "root", "text", F.lit(True).alias("x"), of("nx", 1).alias("xb"), upto("ny").alias("yb"))
    ys = every.select("key", "rep", "root", "text", F.lit(False).alias("x"), of("ny", 2).alias("yb"), upto("nx").alias("xb"))
    kind = open_.schema["rep"].dataType.simpleString()

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        shingler = Shingler(k)
        sets = [shingler(t) for t in frame["text"]]
        is_x = frame["x"].to_numpy(dtype=bool)
        rep, root = frame["rep"].to_numpy(), frame["root"].to_numpy()
        x_at, y_at = np.flatnonzero(is_x), np.flatnonzero(~is_x)
        if not len(x_at) or not len(y_at):
            return pd.DataFrame({"u": rep[:0], "v": rep[:0]})
        sizes = np.array([len(s) for s in sets])
        values = np.concatenate([sets[i] for i in y_at])
        owner = np.repeat(np.arange(len(y_at)), sizes[y_at])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        out = []
        for i in x_at:
            lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            hits = owner[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum())]
            common = np.bincount(hits, minlength=len(y_at))
            linked = (100 * common >= percent * (sizes[i] + sizes[y_at] - common)) & (root[y_at] != root[i])
            out += [(rep[i], rep[j]) for j in y_at[linked]]
        return pd.DataFrame(out, columns=["u", "v"]) if out else pd.DataFrame({"u": rep[:0], "v": rep[:0]})

    found = xs.unionByName(ys).groupBy("key", "xb", "yb").applyInPandas(links, f"u {kind}, v {kind}")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Words are runs of non-white-space characters with A-Z lowered, shingles are ``k`` successive words; a text with fewer
    words has its whole sequence as its one shingle. Documents with 100 * intersection >= percent * union are linked and
    ``component_id`` is the smallest doc_id that can be reached. Null, empty and blank texts have no shingles and link
    with nothing. A doc_id that occurs in several rows is one document, linked through each of its texts. Rows without
    doc_id are linked with nothing, have no component and are kept. An empty table gives no rows.
    """
    sigs = written(signatures(docs, k), "signatures")
    some = sigs.filter("n > 0 AND doc_id IS NOT NULL")
    groups = written(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sig", "bands", "h"), "doc_id").alias("x")), "groups")
    members = some.select("doc_id", "digest").join(groups.select("digest", "rep"), "digest").select("doc_id", "rep")
    own = members.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    own = written(own, "members")
    several = own.filter("rep <> other").select("doc_id")
    twice = members.join(several, "doc_id").join(own.select("doc_id", F.col("rep").alias("first")), "doc_id").select(F.col("rep").alias("u"), F.col("first").alias("v"))

    banded = groups.select("rep", "digest", F.explode("x.bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min(F.struct("rep", "digest")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    hubs = written(hubs, "hubs")  # written minima leave the joins with an exchange of their own, whose hot partitions split
    buckets = written(banded.join(hubs.select("key", "hub"), "key"), "buckets")
    wanted = groups.join(buckets.select("digest").distinct(), "digest", "left_semi").select("rep", "digest", F.col("x.h").alias("h"))
    texts = _texts_of(docs, wanted, k)

    least = floor_for(percent)
    sig = groups.select("digest", F.col("x.sig").alias("sig"))
    pairs = buckets.filter("rep <> hub.rep").select(F.col("rep").alias("a"), F.col("digest").alias("da"), F.col("hub.rep").alias("b"), F.col("hub.digest").alias("db")).distinct()
    p, sa, sb = pairs.alias("p"), sig.alias("sa"), sig.alias("sb")
    pairs = p.join(sa, F.col("da") == F.col("sa.digest")).join(sb, F.col("db") == F.col("sb.digest"))
    pairs = pairs.filter(similarity(F.col("sa.sig"), F.col("sb.sig")) >= least).select("a", "da", "b", "db")
    links = written(_confirmed(pairs, texts, k, percent).unionByName(twice), "links")

    rooted = components(links)
    b, c = buckets.alias("b"), rooted.alias("c")
    placed = written(b.join(c, F.col("b.rep") == F.col("c.node"), "left").select("key", "rep", "digest", F.coalesce("root", "rep").alias("root")), "placed")
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("m"), F.count("*").alias("parts")).filter("parts > 1").select("key", F.col("m.root").alias("main"))
    main = written(main, "main")
    open_ = placed.join(main, "key").select("key", "rep", "digest", "root", (F.col("root") != F.col("main")).alias("apart"))
    more = written(_across(open_, texts, k, percent), "more")
    if not more.isEmpty():
        rooted = components(links.unionByName(more))

    r, o, s = rooted.alias("r"), own.alias("o"), sigs.alias("s")
    place = o.join(r, F.col("o.rep") == F.col("r.node"), "left").select("o.doc_id", F.coalesce("root", "rep").alias("component_id")).alias("f")
    out = s.join(place, F.col("s.doc_id") == F.col("f.doc_id"), "left")
    root = F.coalesce(F.col("f.component_id"), F.col("s.doc_id"))
    return out.select("s.doc_id", F.col("s.n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("s.doc_id"), F.lit(True)).alias("kept"))


def _texts_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """digest, text of the wanted texts: one row with that id, that text hash and that shingle set each."""
    w = wanted.withColumnRenamed("digest", "want").alias("w")
    d = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").alias("d")
    found = d.join(w, (F.col("d.doc_id") == F.col("w.rep")) & (F.col("d.h") == F.col("w.h"))).select("want", "text")

    def run(batches):
        shingler = Shingler(k)
        for b in batches:
            same = [hashlib.blake2b(shingler(t).tobytes(), digest_size=16).digest() == bytes(w) for t, w in zip(b["text"], b["want"])]
            yield b.loc[same].rename(columns={"want": "digest"})

    several = written(found.mapInPandas(run, "digest binary, text string"), "texts")
    if several.groupBy("digest").count().filter("count > 1").isEmpty():
        return several
    return written(several.dropDuplicates(["digest"]), "texts")


travels(__name__)
