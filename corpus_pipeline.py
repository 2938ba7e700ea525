"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens.

Each stage gets what the one before kept, is written as Parquet in the folder that the cluster shares and
read again. Only the last one's columns differ from those of documents.

Null and empty texts score 0 and go with the first stage. Rows without doc_id pass line dedup and near-duplicates
untouched. Repeated rows are judged one by one and share their fate; of a group of near-duplicates the smallest
doc_id stays, with all its rows. Very long texts are read whole in every stage. Extra columns go along, also ones
named as an operator's results, up to the last stage. Empty documents give no rows, and with no labels every
document scores 0 and goes.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.llm import bpe, decontaminate, line_templates, minhash, quality_knn
from seedsift.llm.common import Scratch, table, without


def _beside(docs: DataFrame, results: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the columns of docs; those named as its results are out of its way meanwhile."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in results}
    return stage(docs.withColumnsRenamed(aside)).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labelled rows of the table documents."""
    model = quality_knn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _beside(docs, ["score", "predicted"], lambda d: quality_knn.score_documents(d, model).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; documents that lose all their words with them go too."""

    def stage(d: DataFrame) -> DataFrame:
        kept = line_templates.drop_recurring_lines(d).where(r"n_dropped = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
        if "n_chars" in d.columns:
            kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return kept

    return _beside(docs, ["n_lines", "n_dropped"], stage)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles and a similarity of 0.8, stays."""
    groups = minhash.near_duplicates(docs, words=5, percent=80)
    return without(docs, groups.where("not kept").select("doc_id"), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    items = table(spark, sf_dir, "benchmark")
    return _beside(docs, decontaminate.RESULTS, lambda d: decontaminate.scan_documents(d, items).where("not contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and hashes of ids and decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("bpe tokens", tokens),
]

#: SQL expresses neither the classifier nor the template tree.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
