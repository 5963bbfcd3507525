"""From raw documents to training pieces, in stages that are each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of ``documents``, but for
the last, which returns the encoded documents. The classifier and the tokenizer cannot be stated in SQL, so there is no
checking SQL; the tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohaline.llm import pieces, quality
from isohaline.llm.linededup import dedup_lines
from isohaline.llm.mixing import taken_rows
from isohaline.llm.neardup import near_duplicates
from isohaline.session import checkpoint_dir, written

ORACLE_SQL = None
SHINGLE = 2  # words of a shingle in near-duplicate detection


def good_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject.

    Every row is scored by its text, null and empty ones too; rows without id are never labelled. Extra columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality.scorer(quality.fit(docs, quality.training_labels(labels)))
    return docs.filter(score("text") >= quality.THRESHOLD)


def distinct_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; a document goes if no word of it is left.

    Null and blank texts have no lines to cut and stay; rows equal in id and text lose the same lines. An empty table
    stays empty. Extra columns pass through, whatever their names.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    cut = dedup_lines(docs.select("doc_id", "text", rest))
    kept = cut.filter((F.size("_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.size("_gone") > 0, F.char_length("text")).otherwise(F.col("rest.n_chars"))
    changed = {"text": F.col("text"), "n_chars": length.alias("n_chars")}
    return kept.select(*[changed[c] if c in changed else F.col(f"rest.`{c}`") for c in docs.columns])


def distinct_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, by rows: the one with the smallest id, a missing id coming last.

    Groups are those of the operator at the two-word shingles of its own query. Rows that share an id, or have none, are
    documents of their own here, so copies among them go as well. Null and blank texts are in no group and stay; an empty
    table stays empty. Extra columns pass through.
    """
    numbered = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("number", F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), k=SHINGLE)
    ids = numbered.select("number", F.col("row.doc_id").alias("doc_id"))
    member = groups.select(F.col("doc_id").alias("number"), "component_id").join(ids, "number")
    first = member.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "number"))["number"].alias("number"))
    return numbered.join(written(first.select("number"), "first"), "number", "left_semi").select("row.*")


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none to three rows each.

    Rows without words are never taken, so null and empty texts go; an empty table stays empty. Every row has a place of
    its own in the mix, rows equal in id, source and text too. Extra columns pass through, whatever their names.
    """
    return taken_rows(docs)


def encoded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces, round_trip of every row; null and empty texts have no pieces."""
    return pieces.encode(docs)


STAGES = [
    ("quality", good_quality),
    ("lines", distinct_lines),
    ("near_duplicates", distinct_documents),
    ("mix", mixed),
    ("pieces", encoded),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages, applied to the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
