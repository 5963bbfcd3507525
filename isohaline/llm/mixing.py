"""Mixing of sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to ``EPOCHS`` times. A copy's virtual finish
time is the number of words that its queue has sent up to and including it, divided by the target of its source. All
copies are range-sorted by finish time over all sources and the order is cut where the total budget is reached.

Both the running sum of a queue and the global order are spread: the shuffled order is dealt into slices by the leading
digits of the hash, slices are summed first, and only rows of one slice are ever sorted together. Rows equal in id,
source and text are counted before they are shuffled and stand in the queue one after the other, each with a place of its
own. The global cut is found by narrowing ranges of finish times, so no task sorts more than one narrow range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohaline.llm.common import word_count
from isohaline.session import written

WEIGHTS = (1, 2, 3)  # given to the sources in code-point order, repeating
EPOCHS = 3  # how often a document may be used
SLICE_ROWS = 2000  # rows of one slice of a queue
RANGES = 1024  # finish-time ranges per step of narrowing
BLOCK = 4096  # equal rows that one task writes out together
ORDER = ("_finish", "_rank", "_epoch", "_key", "doc_id", "_size", "_th", "_nth")  # the global order of copies


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: rank, source_size, n_groups, total, target.

    Shares of the total by weight; a share above ``EPOCHS`` times its source stops there and the excess goes to the
    others by weight. With sources in order of cap / weight, the stopped ones are a prefix of that order, so running
    sums settle it at once. Null is a source of its own, ranked last.
    """
    every = Window.partitionBy()
    per = sized.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"), F.count("*").alias("n_groups"))
    per = per.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumns({"_cap": F.col("source_size") * EPOCHS, "total": F.sum("source_size").over(every)})
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "_caps": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_left": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    per = per.withColumn("_full", F.col("_cap") * F.col("_left") < (F.col("total") - F.col("_caps")) * F.col("_w"))
    per = per.withColumns({
        "_taken": F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0)),
        "_open": F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every),
    })
    share = ((F.col("total") - F.col("_taken")) * F.col("_w")).cast("double") / F.col("_open")
    return per.select("_source", "_rank", "source_size", "n_groups", "total", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def _queued(sized: DataFrame, digits: int) -> DataFrame:
    """Adds ``_before``: words of the queue before the first of a group's equal rows."""
    high = digits // 2
    sized = sized.withColumns({"_p1": F.substring("_key", 1, high), "_p2": F.substring("_key", high + 1, digits - high)})
    slices = sized.groupBy("_source", "_p1", "_p2").agg(F.sum(F.col("_size") * F.col("_n")).alias("_s"))
    inner = Window.partitionBy("_source", "_p1").orderBy("_p2").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_off2", F.coalesce(F.sum("_s").over(inner), F.lit(0)))
    outer = Window.partitionBy("_source").orderBy("_p1").rowsBetween(Window.unboundedPreceding, -1)
    coarse = slices.groupBy("_source", "_p1").agg(F.sum("_s").alias("_s1")).withColumn("_off1", F.coalesce(F.sum("_s1").over(outer), F.lit(0)))
    c, s = coarse.alias("c"), slices.alias("s")
    same = F.col("c._source").eqNullSafe(F.col("s._source")) & (F.col("c._p1") == F.col("s._p1"))
    offsets = s.join(c, same).select("s._source", "s._p1", "s._p2", (F.col("_off1") + F.col("_off2")).alias("_off"))
    rows = Window.partitionBy("_source", "_p1", "_p2").orderBy("_key", "doc_id", "_size", "_th").rowsBetween(Window.unboundedPreceding, -1)
    words = F.coalesce(F.sum(F.col("_size") * F.col("_n")).over(rows), F.lit(0))
    d, o = sized.withColumn("_run", words).alias("d"), offsets.alias("o")
    here = F.col("d._source").eqNullSafe(F.col("o._source")) & (F.col("d._p1") == F.col("o._p1")) & (F.col("d._p2") == F.col("o._p2"))
    return d.join(o, here).select("d.*", (F.col("_run") + F.col("_off")).alias("_before"))


def _rows(groups: DataFrame) -> DataFrame:
    """One row per row of a group: ``_nth`` from 1, and ``_cum``, the words of the queue up to and including it.

    Groups of more than ``BLOCK`` rows are cut into blocks that are spread before they are written out.
    """
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK)))
    large = groups.filter(F.col("_n") > BLOCK).withColumn("_block", blocks).repartition("_key", "_th", "_block")
    cut = groups.filter(F.col("_n") <= BLOCK).withColumn("_block", F.lit(0).cast("long")).unionByName(large)
    first, last = F.col("_block") * BLOCK + 1, F.least(F.col("_n"), (F.col("_block") + 1) * BLOCK)
    rows = cut.withColumn("_nth", F.explode(F.sequence(first, last)))
    return rows.withColumn("_cum", F.col("_before") + F.col("_nth") * F.col("_size")).drop("_block", "_before", "_n")


def _first_beyond(copies: DataFrame, budget: int):
    """The first copy, in the global order, with which the words taken exceed the budget; None if none does.

    Two rounds of narrowing by finish time, each on at most ``4 * RANGES`` sums, then an exact order inside one range.
    """
    before, scale = 0, 1
    for _ in range(2):
        scale *= RANGES
        width = F.floor(F.least(F.col("_finish"), F.lit(4.0)) * scale)
        sums = copies.groupBy(width.alias("_range")).agg(F.sum("_size").alias("_s"))
        sums = sums.withColumn("_to", F.sum("_s").over(Window.orderBy("_range")))
        hit = sums.filter(F.col("_to") > budget - before).orderBy("_range").limit(1).collect()
        if not hit:
            return None
        before += hit[0]["_to"] - hit[0]["_s"]
        copies = copies.filter(width == hit[0]["_range"])
    order = Window.orderBy(*ORDER)
    last = copies.withColumn("_to", F.sum("_size").over(order)).filter(F.col("_to") > budget - before)
    hit = last.orderBy(*ORDER).limit(1).collect()
    return hit[0] if hit else None


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, text_hash.

    ``copies`` (0 to 3) is how often the mix uses the document, ``taken`` = copies * size. The order of a queue follows
    the MD5 of seed and doc_id, then doc_id, size and the hash of the text, so reruns agree. A row without doc_id follows
    the MD5 of seed and text hash. Rows equal in all of these have places one after the other, so a cut may fall between
    them: copies of equal rows differ by one at most. Null text has size 0; documents without words are not needed to
    reach a target and get no copies. An empty table gives no rows. Other columns of ``docs`` play no part. Different
    texts that share one doc_id stand in one slice, so an id of very many texts makes one long (spilling) sort.
    """
    digest = F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16)
    place = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), digest))
    sized = docs.select(
        "doc_id", F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), digest.alias("_th"),
        F.md5(F.concat(F.lit(seed + ":"), place)).alias("_key"),
    )
    sized = written(sized.groupBy(*sized.columns).agg(F.count("*").alias("_n")), "sizes")
    targets = written(source_targets(sized), "targets")
    top = targets.agg(F.max("n_groups"), F.max("total")).collect()[0]
    digits = max(0, math.ceil(math.log((top[0] or 1) / SLICE_ROWS, 16))) if top[0] else 0
    queued = _queued(sized, digits).alias("q")
    t = targets.alias("t")
    queued = queued.join(t, F.col("q._source").eqNullSafe(F.col("t._source"))).select("q.*", "t._rank", "t.source_size", "t.target")
    queued = written(_rows(written(queued.drop("_p1", "_p2", "_run"), "groups")), "queues")
    finish = lambda e: (e * F.col("source_size") + F.col("_cum")).cast("double") / F.col("target")
    copies = queued.filter("_size > 0").withColumn("_epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])))
    copies = copies.withColumn("_finish", finish(F.col("_epoch")))
    cut = _first_beyond(copies, top[1] or 0)
    place = lambda e: F.struct(finish(F.lit(e)).alias("_finish"), "_rank", F.lit(e).alias("_epoch"), *ORDER[3:])
    if cut is None:
        used = F.lit(EPOCHS)
    else:
        types = dict(copies.select(*ORDER).dtypes)
        end = F.struct(*[F.lit(cut[c]).cast(types[c]).alias(c) for c in ORDER])
        used = sum(((place(e) < end).cast("int") for e in range(EPOCHS)), F.lit(0))
    used = F.when((F.col("target") > 0) & (F.col("_size") > 0), used).otherwise(0)
    return queued.select(
        "doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target",
        used.alias("copies"), (used * F.col("_size")).alias("taken"), F.col("_th").alias("text_hash"),
    )


def taken_rows(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, none to three times each; columns as in ``docs``, whatever
    their names.

    Of rows equal in id, source and text all are taken alike but where the cut falls between them: there (in one group
    a source at most) the first in the order of their other columns are taken once more.
    """
    used = mix(docs, seed).groupBy("doc_id", "source", "text_hash").agg(
        F.min("copies").alias("least"), F.sum(F.col("copies")).alias("all"), F.count("*").alias("n")
    ).filter(F.col("all") > 0)
    used = written(used, "taken").alias("m")
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = nested.withColumn("hash", F.substring(F.md5(F.coalesce("row.text", F.lit(""))), 1, 16)).alias("d")
    same = F.col("d.row.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.row.source").eqNullSafe(F.col("m.source")) & (F.col("d.hash") == F.col("m.text_hash"))
    found = d.join(used, same).select("row", "hash", "least", (F.col("all") - F.col("least") * F.col("n")).alias("more"))
    even = found.filter("more = 0").select("row", F.col("least").alias("times"))
    place = F.row_number().over(Window.partitionBy("row.doc_id", "row.source", "hash").orderBy(F.to_json("row")))
    split = found.filter("more > 0").withColumn("nth", place)
    split = split.select("row", (F.col("least") + (F.col("nth") <= F.col("more")).cast("int")).alias("times")).filter("times > 0")
    return even.unionByName(split).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
