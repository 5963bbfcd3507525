"""Raw CSV exports: header row, units row, sixteen text columns."""

from __future__ import annotations

import codecs
import itertools
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohaline.schema import RAW_EXPORT, ContractError
from isohaline.session import broadcast_if_small, checkpoint_dir, written
from isohaline.sources.sha256 import Sha256
from isohaline.vocabulary import EXPORT_COLUMNS

WHOLE = 512 * 1024**2  # largest file that one task reads whole, in bytes
STEP = 256 * 1024**2  # bytes of a larger file that one task hashes
CODECS = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd")

# ---- Fixed values: words that count as a missing value in an export -------------------------------
MISSING_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_exports(spark: SparkSession, glob: str) -> DataFrame:
    """All matching exports as text, without units rows, with file name and record number (the header is 1).

    Files are split freely and no row is shuffled: ids are consecutive within a split, so a row's place is its id
    less the first id of the split, plus the rows of the splits before it. Files are told apart by their whole path.
    Only files in which a line leaves a quote open, as a quoted line break does, go through ``read_broken_lines``.
    """
    lines = _lines(spark, glob)
    broken = written(lines.where(_quotes(F.col("value")) % 2 == 1).select("_path").distinct(), "open-quotes")
    raw = (
        spark.read.schema(RAW_EXPORT)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .csv(glob)
        .withColumns(
            {
                "_source_file": F.col("_metadata.file_name"),
                "_path": F.col("_metadata.file_path"),
                "_block": F.col("_metadata.file_block_start"),
                "_pos": F.monotonically_increasing_id(),
            }
        )
    )
    some = not broken.isEmpty()
    if some:
        broken, _ = broadcast_if_small(broken)
    rows = with_row_numbers(raw.join(broken, "_path", "left_anti") if some else raw)
    if some:
        rows = rows.unionByName(read_broken_lines(lines.join(broken, "_path", "left_semi")))
    missing = {c: F.when(~F.col(c).isin(*MISSING_WORDS), F.col(c)) for c in EXPORT_COLUMNS}
    # Row 2 of a file is its units row.
    return rows.where(F.col("source_row") > 2).withColumns(missing)


def _lines(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.text(glob).select(
        "value",
        F.col("_metadata.file_name").alias("_source_file"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )


def _quotes(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit('"'), F.lit("")))


def read_broken_lines(lines: DataFrame) -> DataFrame:
    """Records of files whose quoted fields hold line breaks, with their number.

    A line starts a record if the quotes before it are even in number. That parity runs over the splits of a file by one small
    row per split, and inside a split over its own lines, so files stay splittable. A file that ends inside a quote is
    refused.
    """
    lines = lines.withColumn("_odd", _quotes(F.col("value")) % 2)
    split = ["_path", "_block"]
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parity = lines.groupBy(*split).agg((F.sum("_odd") % 2).alias("_parity"))
    parity = written(parity.withColumn("_before", F.coalesce(F.sum("_parity").over(before), F.lit(0)) % 2), "parity")
    unclosed = parity.groupBy("_path").agg((F.sum("_parity") % 2).alias("open")).where("open = 1").limit(1).collect()
    if unclosed:
        raise ContractError(f"{unclosed[0]['_path']}: a quote is not closed")
    inside = Window.partitionBy(*split).orderBy("_pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.join(parity.select(*split, "_before"), split)
    marked = marked.withColumn("_start", (F.coalesce(F.sum("_odd").over(upto), F.lit(0)) + F.col("_before")) % 2 == 0)
    marked = marked.where(~F.col("_start") | (F.col("value") != ""))  # blank lines between records are none
    marked = marked.withColumn("_nth", F.sum(F.col("_start").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    marked = written(marked, "marked")
    starts = marked.groupBy(*split).agg(F.count_if("_start").alias("_n"))
    starts = starts.select(*split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = marked.join(starts, split).withColumn("source_row", F.col("_offset") + F.col("_nth"))
    whole = placed.groupBy("_path", "_source_file", "source_row").agg(F.array_sort(F.collect_list(F.struct("_block", "_pos", "value"))).alias("l"))
    record = F.array_join(F.transform("l", lambda x: x["value"]), "\n")
    ddl = ", ".join(f"{c} string" for c in EXPORT_COLUMNS)
    parsed = whole.where(F.col("source_row") > 1).select("_source_file", "source_row", F.from_csv(record, ddl, {"escape": '"', "mode": "PERMISSIVE"}).alias("f"))
    return parsed.select(*[F.col(f"f.{c}") for c in EXPORT_COLUMNS], "_source_file", F.col("source_row").cast("bigint"))


def with_row_numbers(lines: DataFrame) -> DataFrame:
    """``source_row``: 1-based physical row; the header is row 1 and not part of ``lines``."""
    sizes = lines.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets, _ = broadcast_if_small(written(offsets, "splits"))
    return (
        lines.join(offsets, ["_path", "_block"])
        .withColumn("source_row", (F.col("_offset") + F.col("_pos") - F.col("_first") + 2).cast("bigint"))
        .select(*EXPORT_COLUMNS, "_source_file", "source_row")
    )


def check_header(spark: SparkSession, glob: str) -> DataFrame:
    """One row per export, told apart by its whole path: does it start with the sixteen columns and a units row with UTC third?

    Reads the files as text lines; only the line at the start of a file can be its header, so each file
    contributes two candidate lines.
    """
    first = Window.partitionBy("_path").orderBy("_pos")
    head = (
        _lines(spark, glob)
        .where(F.col("_block") == 0)
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= 2)
        .groupBy("_path", "_source_file")
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.col("value"))).alias("header"),
            F.max(F.when(F.col("_rank") == 2, F.col("value"))).alias("units"),
        )
    )
    units = F.split("units", ",", -1)
    return head.select(
        "_source_file",
        F.col("_path").alias("path"),
        (F.col("header") == ",".join(EXPORT_COLUMNS)).alias("header_ok"),
        F.coalesce((F.size(units) == len(EXPORT_COLUMNS)) & (F.get(units, F.lit(2)) == "UTC"), F.lit(False)).alias("units_ok"),
    )


def require_headers(spark: SparkSession, glob: str) -> None:
    bad = check_header(spark, glob).where(~(F.col("header_ok") & F.col("units_ok"))).limit(1).collect()
    if bad:
        raise ContractError(f"{bad[0]['path']}: header or units row does not match the frozen schema")


def file_digests(spark: SparkSession, glob: str, whole: int = WHOLE, step: int = STEP) -> DataFrame:
    """path, name, size and SHA-256 of files, hashed by the tasks that read them.

    A file above ``whole`` bytes is hashed in steps of about ``step`` bytes (``_in_steps``), so no task reads it whole. Those that
    Spark's text source would decompress, by their names, are read whole (up to 2 GB).
    """
    read = spark.read.format("binaryFile")
    shape = [F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes")]
    files = read.load(glob)
    out = files.where(F.col("length") <= whole).select(*shape, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select(*shape, F.col("_metadata.file_path").alias("_file")).collect()
    packed = [f for f in large if f.name.endswith(CODECS)]
    if packed:
        out = out.unionByName(read.load([f.path for f in packed]).select(*shape, F.sha2("content", 256).alias("sha256")))
    large = [f for f in large if f not in packed]
    if large:
        digests = _in_steps(spark, {f._file: (f.path, f.size_bytes) for f in large}, step)
        rows = [(f.path, f.name, f.size_bytes, digests[f._file]) for f in large]
        out = out.unionByName(spark.createDataFrame(rows, "path string, name string, size_bytes bigint, sha256 string"))
    return out


def _hashing(states: dict[str, bytes], first: bool):
    """Takes lines in order of their files and place; gives the state of each file after them, and their bytes."""

    def run(batches):
        chains, counts = {}, {}
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for file, group in itertools.groupby(rows, lambda r: r[0]):
                lines = b"\n".join(line for _, line in group)
                follows = file in chains or not first
                chains.setdefault(file, Sha256(states[file])).update(b"\n" + lines if follows else lines)
                counts[file] = counts.get(file, 0) + len(lines) + 1
        after = [pa.array(list(chains), pa.string()), pa.array([c.state for c in chains.values()], pa.binary()), pa.array([counts[f] for f in chains], pa.int64())]
        yield pa.RecordBatch.from_arrays(after, ["file", "state", "bytes"])

    return run


def _in_steps(spark: SparkSession, files: dict[str, tuple[str, int]], step: int) -> dict[str, str]:
    """SHA-256 of files given as URI -> (path, size), which is one chain over their bytes.

    The files are cut at line feeds by the splits of the text source and dealt to steps by their place. One job per step hashes
    the next part of every file, each in one task, from the state that the step before left: of each file, some hundred bytes
    pass through the driver. The parts are written under the checkpoint folder, so each byte is read from its file once.
    """
    lines = spark.read.option("lineSep", "\n").text([path for path, _ in files.values()])
    place = F.col("_metadata.file_block_start")
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), place.alias("start"), F.floor(place / step).alias("step"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line"),
    )
    path = f"{checkpoint_dir(spark).rstrip('/')}/parts-{uuid.uuid4().hex}"
    lines.write.partitionBy("step").parquet(path)
    parts = spark.read.parquet(path)
    steps = sorted(r.step for r in parts.select("step").distinct().collect())

    def run(mark: bytes) -> dict[str, tuple[bytes, int]]:
        states = {file: Sha256().update(mark).state for file in files}
        read = dict.fromkeys(files, -1)  # bytes of lines and of the line feeds between them
        for k in steps:
            part = parts.where(F.col("step") == k).repartition(max(8, 2 * len(files)), "file").sortWithinPartitions("file", "start", "row")
            for r in part.select("file", "line").mapInArrow(_hashing(dict(states), k == steps[0]), "file string, state binary, bytes bigint").collect():
                states[r.file], read[r.file] = bytes(r.state), read[r.file] + r.bytes
        return {file: (states[file], read[file] + len(mark)) for file in files}

    out, left = {}, dict(files)
    for mark in (b"", codecs.BOM_UTF8):  # the text source leaves out a byte order mark
        if left:
            for file, (state, n) in run(mark).items():
                if file in left and left[file][1] - n in (0, 1):
                    out[file] = Sha256(state).update(b"\n" * (left.pop(file)[1] - n)).hexdigest()
    if left:
        raise ContractError(f"{next(iter(left))}: the bytes read are not those of the file")
    return out


def source_audit(spark: SparkSession, glob: str, rows: DataFrame, origins: dict[str, str], otherwise: str) -> DataFrame:
    """Per export: size, digest, input rows and the label of its origin.

    ``origins`` maps a part of a file name to a label; the first that fits counts, ``otherwise`` if none does.
    """
    counts = rows.groupBy(F.col("_source_file").alias("name")).agg(F.count("*").alias("input_rows"))
    origin = F.lit(otherwise)
    for part, label in reversed(origins.items()):
        origin = F.when(F.col("name").contains(part), label).otherwise(origin)
    return file_digests(spark, glob).join(counts, "name", "left").select(
        "name", origin.alias("origin"), "sha256", "size_bytes", F.coalesce("input_rows", F.lit(0)).alias("input_rows")
    )


def quoted(text: Column) -> Column:
    """A field as the readers expect it: quoted where it holds a comma, a quote or a line break."""
    inside = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), inside).otherwise(text)


def write_exports(obs: DataFrame, path: str) -> None:
    """Write observation rows as export files (header, units row, sixteen columns).

    The first row of every task carries the two head lines of its file, so nothing is gathered.
    """
    head = "\n".join([",".join(EXPORT_COLUMNS), ",".join("UTC" if c == "time" else "1" for c in EXPORT_COLUMNS), ""])
    text = F.concat_ws(",", *[quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in EXPORT_COLUMNS])
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = F.when(row_in_task == 0, F.concat(F.lit(head), text)).otherwise(text)
    obs.select(line.alias("value")).write.text(path)
