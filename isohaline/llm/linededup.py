"""Line dedup: repeated runs of lines, from suffix ranks over line-ID sequences by distributed prefix doubling.

A run is a sequence of consecutive lines with words (blank lines are left out and never deleted). A run of at least
``min_words`` words that already occurred, earlier in the order of (doc_id, text hash, line), is a later copy and its lines
go; the first occurrence of every run stays.

Round k ranks all suffixes by their first 2^k lines: the pair of ranks at a line and 2^(k-1) lines further on is grouped
and range-sorted. Lines whose line occurs once end every repeated run and leave at once, and suffixes that are alone with
their first 2^k lines leave round by round. Suffixes of equal rank are one interval of common prefix length >= 2^k, and two
overlapping ranks name the interval of any length in between. A maximal repeated run is the union of its shortest parts
of ``min_words`` words, taken forwards from every line and backwards from every line, and equal parts have equal lengths,
so one grouping of parts by interval finds exactly the lines that any maximal run covers, and rounds stop at the longest
part, however long the runs are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohaline.llm.common import word_count
from isohaline.session import written

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with words: document (_d, _th), line number ``at``, 128 bits of hash, words."""
    parts = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_th"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = parts.withColumn("nw", word_count(F.col("line"))).filter("nw > 0")
    return lines.select("_d", "_th", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "nw")


def _ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rank of each pair (a, b) that occurs twice or more, in sorted order; alone pairs are left out."""
    groups = pairs.groupBy(a, b).agg(F.count("*").alias("_n")).filter("_n > 1").select(a, b)
    return written(groups.orderBy(a, b).withColumn("r", F.monotonically_increasing_id()), "ranks")


def _repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines that occur twice or more, in order: pos, document (o, _d, _th), ``ln`` among lines with words, at, nw, r."""
    lines = written(_lines(docs), "lines")
    ranks = _ranked(lines, "h1", "h2")
    found = lines.join(ranks, ["h1", "h2"]).select("_d", "_th", "at", "nw", "r").dropDuplicates(["_d", "_th", "at"])
    # Consecutive numbers among lines with words need the other lines of the same documents too.
    every = lines.select("_d", "_th", "at", "nw").dropDuplicates(["_d", "_th", "at"])
    number = every.withColumn("ln", F.row_number().over(Window.partitionBy("_d", "_th").orderBy("at"))).drop("nw").alias("n")
    f = found.alias("f")
    same = F.col("f._d").eqNullSafe(F.col("n._d")) & (F.col("f._th") == F.col("n._th")) & (F.col("f.at") == F.col("n.at"))
    rows = f.join(number, same).select("f.*", "n.ln")
    rows = rows.orderBy(F.col("_d").asc_nulls_last(), "_th", "at").withColumn("pos", F.monotonically_increasing_id())
    rows = written(rows, "repeated")
    return written(rows.withColumn("o", F.min("pos").over(Window.partitionBy("_d", "_th"))), "positions")


def _levels(base: DataFrame, longest: int) -> DataFrame:
    """(k, o, ln, r) of all suffixes that share their first 2^k lines with another one, for 2^k <= longest."""
    level = base.select("o", "ln", "r")
    levels, k = level.withColumn("k", F.lit(0)), 0
    while 2 ** (k + 1) <= longest:
        ahead = level.select("o", (F.col("ln") - 2**k).alias("ln"), F.col("r").alias("r2"))
        pairs = written(level.withColumnRenamed("r", "r1").join(ahead, ["o", "ln"]), "pairs")
        level = written(pairs.join(_ranked(pairs, "r1", "r2"), ["r1", "r2"]).select("o", "ln", "r"), "level")
        k += 1
        if level.isEmpty():
            break
        levels = levels.unionByName(level.withColumn("k", F.lit(k)))
    return levels


def _parts(base: DataFrame, min_words: int) -> DataFrame:
    """Shortest parts of ``min_words`` words from each line forwards and from each line backwards: o, ln, n lines."""
    stretch = Window.partitionBy("o", "seg").orderBy("ln")
    rows = base.withColumn("seg", F.col("ln") - F.row_number().over(Window.partitionBy("o").orderBy("ln")))
    rows = rows.withColumn("upto", F.sum("nw").over(stretch.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("nw"))
    reach = min_words - 1
    rows = rows.withColumns({
        "_next": F.collect_list("upto").over(stretch.rowsBetween(0, reach)),
        "_last": F.collect_list("before").over(stretch.rowsBetween(-reach, 0)),
    })
    ahead = F.size(F.filter("_next", lambda c: c < F.col("before") + min_words)) + 1
    back = F.size(F.filter("_last", lambda c: c > F.col("upto") - min_words)) + 1
    both = rows.select("o", "ln", F.explode(F.array(
        F.when(ahead <= F.size("_next"), F.struct(F.col("ln").alias("s"), ahead.alias("n"))),
        F.when(back <= F.size("_last"), F.struct((F.col("ln") - back + 1).alias("s"), back.alias("n"))),
    )).alias("x"))
    return both.filter("x is not null").select("o", F.col("x.s").alias("ln"), F.col("x.n").alias("n")).distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: _d, _th (doc_id and text hash) and ``gone``, the sorted 0-based line numbers."""
    base = _repeated_lines(docs)
    parts = written(_parts(base, min_words), "parts")
    longest = parts.agg(F.max("n")).collect()[0][0] or 0
    levels = written(_levels(base, longest), "levels")
    k = F.floor(F.log2("n") + 1e-9).cast("int")
    named = parts.withColumn("k", k).withColumn("end", F.col("ln") + F.col("n") - F.pow(F.lit(2.0), F.col("k")).cast("int"))
    named = named.join(levels.withColumnRenamed("r", "ra"), ["k", "o", "ln"])
    named = named.join(levels.select("k", "o", F.col("ln").alias("end"), F.col("r").alias("rb")), ["k", "o", "end"])
    named = written(named.join(base.select("o", "ln", "pos"), ["o", "ln"]).select("o", "ln", "n", "ra", "rb", "pos"), "named")
    first = named.groupBy("n", "ra", "rb").agg(F.min("pos").alias("first"))
    copies = named.join(first, ["n", "ra", "rb"]).filter("pos > first")
    ends = copies.groupBy("o", "ln").agg(F.max(F.col("ln") + F.col("n")).alias("end"))
    marked = base.select("o", "ln", "at", "_d", "_th").join(ends, ["o", "ln"], "left")
    reach = F.max("end").over(Window.partitionBy("o").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0))
    gone = marked.withColumn("reach", reach).filter("reach > ln")
    return gone.groupBy("_d", "_th").agg(F.sort_array(F.collect_list("at")).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs cut out of ``text``; adds _n_lines and _gone (line numbers removed).

    Null and empty texts stay as they are. Rows equal in doc_id and text are one document to the search and keep the
    same lines; null ids sort last. An empty table stays empty. All other columns pass through, whatever their names, but
    input columns named _n_lines or _gone give way to those of the result.
    """
    gone = later_copies(docs, min_words).alias("g")
    names = [c for c in docs.columns if c not in ("_n_lines", "_gone")]
    key = "_" + "".join(docs.columns)  # longer than any name of the input
    d = docs.withColumn(key, F.xxhash64("text")).alias("d")
    both = d.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g._d")) & (F.col(f"d.`{key}`") == F.col("g._th")), "left")
    lines = F.split(F.col("d.text"), "\n", -1)
    last = F.when(F.col("g.gone").isNotNull(), F.size(lines) - 1)
    kept = F.array_except(F.sequence(F.lit(0), last), F.col("g.gone"))
    cut = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(cut)
    columns = [text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in names]
    return both.select(*columns, F.size(lines).alias("_n_lines"), F.coalesce(F.col("g.gone"), F.array().cast("array<int>")).alias("_gone"))
