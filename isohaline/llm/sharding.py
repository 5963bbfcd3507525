"""Sharding over fixed virtual slots.

A record's hash puts it into one of ``SLOTS`` virtual slots for good. What may change is the map from slots to shards: a
small table with a version. Version 1 deals the slots out in turn. Rebalancing sums the bytes of every slot and edits the
map: a slot stays where it is while its shard has room up to an equal share, larger slots first, and the slots beyond go,
largest first, to the shard with the fewest bytes. Growing by a shard edits it as well. Every edit is a new version; old
ones stay readable. Records follow the map by one lookup, so no record is ever sorted against all the others.

Inside its shard a record has a gapless place: the slots of a shard stand one after another, and records are numbered
inside their slot only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohaline.session import checkpoint_dir, written

SLOTS = 4096
MAP = "version int, vslot int, shard int, moved boolean"


def record_hash(*values: Column) -> Column:
    """Hash of a record's identity; nulls count as values of their own."""
    return F.xxhash64(*[F.struct(v.isNull(), v) for v in values])


def slot_of(h: Column, slots: int = SLOTS) -> Column:
    return F.pmod(h, F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, bytes, n of all ``slots`` slots, empty ones included, from records with ``vslot`` and ``size``."""
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    sums = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return every.join(sums, "vslot", "left").fillna(0, ["bytes", "n"])


def base_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt to the shards in turn."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("vslot"), F.pmod(slot, F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("moved"))


def rebalance(current: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version of one version of a map, edited until the bytes of all ``shards`` are near equal.

    Also grows a map: shards that it does not know yet have no bytes and are filled from the slots beyond the equal share.
    Work is on ``SLOTS`` rows. Slots without bytes stay. Equal sums are taken by slot number, so reruns agree.
    """
    here = current.join(sums, "vslot")
    share = F.sum("bytes").over(Window.partitionBy()) / shards
    filled = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    here = here.withColumn("stays", (F.col("bytes") == 0) | (filled <= share))
    held = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(
        F.filter("rows", lambda r: r["stays"] & (r["shard"] == s)), F.lit(0).cast("long"), lambda a, r: a + r["bytes"],
    ))
    one = here.groupBy().agg(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes", "shard", "stays")).alias("rows"))
    one = one.select(F.transform(F.filter(F.array_sort("rows"), lambda r: ~r["stays"]), lambda r: r).alias("loose"), held.alias("load"))

    def place(state: Column, r: Column) -> Column:
        at = F.array_position(state["load"], F.array_min(state["load"])).cast("int") - 1
        load = F.transform(state["load"], lambda v, i: F.when(i == at, v + r["bytes"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(state["to"], F.array(F.struct(r["vslot"].alias("vslot"), at.alias("at")))).alias("to"))

    start = F.struct(F.col("load").alias("load"), F.array().cast("array<struct<vslot:int,at:int>>").alias("to"))
    placed = one.select(F.explode(F.aggregate("loose", start, place)["to"]).alias("p")).select("p.*")
    out = here.join(placed, "vslot", "left").withColumn("next", F.coalesce("at", "shard"))
    return out.select((F.col("version") + 1).alias("version"), "vslot", F.col("next").alias("shard"), (F.col("next") != F.col("shard")).alias("moved"))


def publish(version: DataFrame, path: str) -> None:
    """Append one version to the stored map."""
    version.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in MAP.split(", ")]).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the newest by default."""
    stored = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def assign(records: DataFrame, current: DataFrame) -> DataFrame:
    """Adds ``shard`` and ``slot``, the gapless place in the shard, to records with ``vslot``, ``h``, and what they return.

    Places follow slot, hash and the other columns. The map has ``SLOTS`` rows and is broadcast.
    """
    counts = records.groupBy("vslot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = current.select("vslot", "shard").join(counts, "vslot").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("vslot", "shard", "start")
    rows = Window.partitionBy("vslot").orderBy("h", *[c for c in records.columns if c not in ("h", "vslot")])
    numbered = records.withColumn("at", F.row_number().over(rows))
    return numbered.join(F.broadcast(starts), "vslot").withColumn("slot", (F.col("start") + F.col("at") - 1).cast("long")).drop("start", "at")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot, moved for every row of ``docs``; the map's versions go to ``store``.

    ``size`` is the text's bytes in UTF-8 plus 1, ``text_crc32`` its unsigned checksum; null text counts as empty. The hash
    covers id and text, so neither an id nor a text that holds many rows lands in one slot by itself; rows that repeat both
    share a slot, and rows without id are spread by their text. A single slot heavier than an equal share stays whole. An
    empty table gives no rows; other columns are ignored. ``store`` is a folder that all executors share and has to be
    new; by default one in the session's checkpoint folder.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    h = record_hash(F.col("doc_id"), F.col("text"))
    records = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), h.alias("h"))
    records = written(records.withColumn("vslot", slot_of(F.col("h"), slots)), "records")
    store = store or f"{checkpoint_dir(spark).rstrip('/')}/shard-map-{uuid.uuid4().hex}"
    publish(base_map(spark, shards, slots), store)
    publish(rebalance(load_map(spark, store), written(slot_bytes(records, slots), "slot-bytes"), shards), store)
    current = load_map(spark, store)
    out = assign(records, current).join(F.broadcast(current.select("vslot", "moved")), "vslot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", F.col("vslot").alias("virtual_slot"), "moved")
