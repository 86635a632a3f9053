"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns a DataFrame that
is written as Parquet and read again for the next stage, whose end deletes it. All stages but the last
return the columns of documents, whatever other columns there are. Whole texts are read, however long.
An empty table gives no rows, with the same columns. A row with a null doc_id is judged by its text
alone: line dedup and near-dedup leave it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode_decode
from tessera.llm.common import read_table, remove, remove_at_exit, shared_dir
from tessera.llm.decontaminate import without_leaks
from tessera.llm.line_dedup import line_dedup
from tessera.llm.near_dup import near_duplicates
from tessera.llm.quality_rules import quality_rules, trusted_documents

#: SQL can't express the hashed buckets of the first stage nor the tokenizer of the last one.
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trusted: those that labels mark good. Null, empty and blank texts go; repeated rows are judged alike."""
    judged = quality_rules(docs.select(*COLUMNS), trusted_documents(read_table(spark, sf_dir, "labels")), carry=True)
    return judged.where("kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines, n_chars of the text that is left; one that loses all its words goes, as its lines stand in other documents.

    A line stays in the document with the smallest doc_id, in all rows of it. Null and empty texts stay.
    """
    parsed = line_dedup(docs.select(*COLUMNS), carry=True)
    left = parsed.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.char_length("text").cast("bigint"))
    return left.select("row.doc_id", "text", "row.lang", "row.source", n_chars.alias("n_chars"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 80 percent: the one with the smallest id, once.

    Of several rows with its id the first by text stays, by its other columns where texts are equal, and
    a null text only where there is no other. Null and blank texts are linked with nothing and stay.
    """
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    rest = [c for c in COLUMNS if c != "doc_id"]
    again = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNull().alias("no_text"), *rest)).alias("row"))
    return left.join(repeated, "doc_id", "left_anti").select(*COLUMNS).union(again.select("doc_id", *[f"row.{c}" for c in rest]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts stay; repeated rows are judged alike."""
    return without_leaks(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every row; none and the empty text for null and empty texts."""
    return bpe_encode_decode(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("BPE", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder and read again; it goes when the next stage is written, and the last one's when the process ends."""
    docs = read_table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, place)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            remove(spark, f"{place}/{k - 1}")
    return docs
