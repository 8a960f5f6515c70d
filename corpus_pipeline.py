"""Corpus preparation: toxicity, near-duplicates, benchmark leaks, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import default_tokenizer, encoding_digests
from tessella.llm.common import DOCUMENT_COLUMNS, table, written
from tessella.llm.decontaminate import without_leaks
from tessella.llm.neardup import BROADCAST_ROWS, near_duplicates
from tessella.llm.secrets import redact_documents
from tessella.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the classifier takes for toxic."""
    return keep_clean(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: one with the smallest doc_id, null being the greatest.

    Rows are told apart by numbers of their own: rows that repeat a doc_id go or stay by their own texts, and of equal rows one stays.
    Null and empty texts are near to nothing and stay.
    """
    docs = written(docs.select(*DOCUMENT_COLUMNS, F.monotonically_increasing_id().alias("row")), "near-rows")
    found = near_duplicates(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    found = written(found, "near-found")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    best = found.join(docs.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(rank)["row"].alias("first"), F.count("*").alias("n"))
    best = _sent(written(best.where("n > 1").select("component_id", "first"), "near-best"))
    # a list of rows is sent everywhere up to a size, and texts are shuffled beyond
    gone = _sent(written(found.join(best, "component_id").where("row != first").select("row"), "near-gone"))
    return docs.join(gone, "row", "left_anti").select(*DOCUMENT_COLUMNS)


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    return without_leaks(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced by the names of their kinds, and n_chars following the text."""
    out = redact_documents(docs.select(*DOCUMENT_COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return encoding_digests(docs, default_tokenizer())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]
#: SQL can't express the trained classifiers; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
