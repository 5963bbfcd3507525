import random
import zlib

import pytest
from pyspark.sql import functions as F

from isohaline.llm.queries import QUERIES
from isohaline.llm.sharding import base_map, load_map, publish, rebalance, shard_documents, slot_bytes

DOCS = "doc_id long, text string"


def near_equal(rows, shards, slack):
    load = [sum(r.size for r in rows if r.shard == s) for s in range(shards)]
    return max(load) - min(load) <= slack


def places_are_gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    return all(sorted(v) == list(range(len(v))) for v in by.values())


def fixture():
    rng = random.Random(5)
    rows = [(i, "ab é" * rng.randint(0, 300)) for i in range(2500)]
    rows += [(10_000 + i, "the same text") for i in range(1200)]  # a third share one text
    rows += [(7, f"one id, text {i}") for i in range(300)] + [(None, f"no id {i}") for i in range(300)]
    return rows + [(1, None), (2, ""), (2, ""), (2, ""), (None, None), (3, "x" * 40_000)]


def test_documents_are_spread_by_bytes(spark):
    given = fixture()
    docs = spark.createDataFrame(given, DOCS).withColumns({"h": F.lit("x"), "vslot": F.lit(-1), "shard": F.lit(99), "n": F.lit(0)})
    rows = shard_documents(docs).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    assert {r.shard for r in rows} <= set(range(16)) and places_are_gapless(rows)
    assert near_equal(rows, 16, 200)
    for text in ("the same text", None):
        assert text is None or len({r.shard for r in rows if r.text_crc32 == zlib.crc32(text.encode())}) == 16
    again = shard_documents(docs.repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_a_huge_text_does_not_disturb_the_others(spark):
    rows = shard_documents(spark.createDataFrame([(0, "x" * 100_000)] + [(i, "y" * 99) for i in range(1, 1501)], DOCS), shards=4).collect()
    alone = next(r.shard for r in rows if r.doc_id == 0)
    load = [sum(r.size for r in rows if r.shard == s) for s in range(4) if s != alone]
    assert max(load) - min(load) <= 400 and max(load) < 100_000 and places_are_gapless(rows)


def brute_rebalance(shard, size, shards):
    total, out, load, loose = sum(size), list(shard), [0] * shards, []
    for s in set(shard):
        run = 0
        for v in sorted((v for v in range(len(size)) if shard[v] == s), key=lambda v: (-size[v], v)):
            run += size[v]
            if size[v] == 0 or run <= total / shards:
                load[s] += size[v]
            else:
                loose.append(v)
    for v in sorted(loose, key=lambda v: (-size[v], v)):
        out[v] = load.index(min(load))
        load[out[v]] += size[v]
    return out


@pytest.mark.parametrize("shards", [4, 5])
def test_an_edit_equals_its_definition_and_keeps_versions(spark, tmp_path, shards):
    rng = random.Random(8)
    size = [rng.choice([0, 1, 5, 5, 9, 40, 300]) for _ in range(64)]
    sums = spark.createDataFrame([(v, s, 1) for v, s in enumerate(size)], "vslot int, bytes long, n long")
    path = str(tmp_path / "map")
    publish(base_map(spark, 4, 64), path)
    publish(rebalance(load_map(spark, path), sums, shards), path)
    first = {r.vslot: r.shard for r in load_map(spark, path, 1).collect()}
    assert first == {v: v % 4 for v in range(64)}
    newest = load_map(spark, path).collect()
    want = brute_rebalance([v % 4 for v in range(64)], size, shards)
    assert {r.vslot: r.shard for r in newest} == dict(enumerate(want)) and {r.version for r in newest} == {2}
    assert {r.vslot for r in newest if r.moved} == {v for v in range(64) if want[v] != v % 4}
    assert sum(r.moved for r in newest) < 50  # an edit, not a new deal


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert shard_documents(empty).count() == 0
    zero = slot_bytes(empty.select(F.lit(0).alias("vslot"), F.lit(0).cast("long").alias("size")), 8).collect()
    assert len(zero) == 8 and not any(r.bytes for r in zero)


def test_the_query(spark, tmp_path):
    spark.createDataFrame(fixture(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_sharding"](spark, str(tmp_path))
    assert out.dtypes[:7] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows = out.collect()
    assert len(rows) == len(fixture()) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert near_equal(rows, 16, 200) and places_are_gapless(rows)
