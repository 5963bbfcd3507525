"""Weighted fair queueing against one global sort, on the rows where ids and texts repeat or are missing."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from isohaline.llm import mixing
from isohaline.llm.queries import MIX_SQL

DOCS = "doc_id long, text string, source string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected_mix(rows, words):
    """How often each row is taken, by one global sort. Rows are (doc_id, text, lang, source, ...)."""
    size = lambda t: len(words(t))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    totals = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(totals.values())
    target, open_ = {}, set(names)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * totals[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * totals[s] for s in over}
        open_ -= over
    text = lambda r: hashlib.md5((r[1] or "").encode()).hexdigest()[:16]
    key = lambda r: hashlib.md5(f"mix:{'null:' + text(r) if r[0] is None else r[0]}".encode()).hexdigest()
    copies = []
    for s in names:
        queue = sorted((key(r), r[0] or 0, size(r[1]), text(r), k) for k, r in enumerate(rows) if r[3] == s)
        sent = 0
        for _ in range(3):
            for *_, k in queue:
                sent += size(rows[k][1])
                if size(rows[k][1]):
                    copies.append((sent / target[s], names.index(s), sent, k))
    taken, used = Counter(), 0
    for _, _, _, k in sorted(copies):
        used += size(rows[k][1])
        if used > total:
            break
        taken[k] += 1
    return taken


def messy(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 30)))
        rows.append((i, text, rng.choice(["a", "b", "b", "b", "c", None])))
    rows += [(None, f"no id {i % 7}" + " x" * (i % 5), "b") for i in range(120)]  # copies without id
    rows += [(3, "one id " + "y " * (i % 11), "c") for i in range(90)]  # one id, several texts, several rows each
    rows += [(900 + i, None, "a") for i in range(5)] + [(910 + i, "", "wordless") for i in range(4)]
    return rows


def taken_of(spark, rows):
    out = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    return sorted(((r.doc_id, r.source, r.size, r.text_hash, r.copies) for r in out), key=str), out


def test_against_one_global_sort(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 20)
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = messy()
    taken = expected_mix([(r[0], r[1], None, r[2]) for r in rows], words_of)
    text = lambda r: hashlib.md5((r[1] or "").encode()).hexdigest()[:16]
    want = sorted(((r[0], r[2], len(words_of(r[1])), text(r), taken[k]) for k, r in enumerate(rows)), key=str)
    got, _ = taken_of(spark, rows)
    assert got == want


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = messy(150, 8)
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, taken, round(target, 6) FROM ({MIX_SQL})").fetchall()
    got = [tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "taken", F.round("target", 6)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text", ["ten words of one text " * 2, None])
def test_targets_are_met_where_ids_are_missing(spark, text):
    """All rows of a source have one size and no id; with ``text`` they are copies of each other as well."""
    rows = [(None, text or " ".join(f"t{i}_{k}" for k in range(10)), "a") for i in range(100)]
    rows += [(i, " ".join(["z"] * 10), "b") for i in range(100)]
    _, out = taken_of(spark, rows)
    for source in "ab":
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10
        assert max(r.copies for r in mine) - min(r.copies for r in mine) <= 1


def test_rows_taken_pass_all_columns_and_clashing_names(spark):
    rows = messy(120, 9)
    docs = spark.createDataFrame(rows, DOCS).withColumn("_key", F.monotonically_increasing_id())
    for name in ("_copy", "copies", "size", "row", "hash", "_size", "least", "times"):
        docs = docs.withColumn(name, F.lit(name))
    out = mixing.taken_rows(docs)
    assert out.columns == docs.columns
    taken = expected_mix([(r[0], r[1], None, r[2]) for r in rows], words_of)
    want = Counter()
    for k, r in enumerate(rows):
        want[r] += taken[k]
    rows_out = out.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows_out) == +want
    assert max(Counter(r._key for r in rows_out).values()) <= 3
    assert {r.times for r in rows_out} == {"times"}


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.taken_rows(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], DOCS)).collect()] == [0, 0]
