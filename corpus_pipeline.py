"""Corpus pipeline: from raw documents to packed training sequences.

Every stage reads what its predecessor kept.  All but the last return the columns of
``documents``; the last returns the pieces with their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodic.llm.common import written
from episodic.llm.exact_dedup import exact_dedup
from episodic.llm.minhash_dedup import without_near_duplicates
from episodic.llm.packing import packed_documents
from episodic.llm.suffix_dedup import without_repeats
from episodic.llm.toxicity import scored

#: Documents with a toxicity score from here on are rejected.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is below ``TOXIC``.

    Null and empty texts are scored like any other; repeated rows alike.  No documents give none."""
    return scored(spark, docs, sf_dir, carry=True).where(F.col("score") < TOXIC).drop("score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text, the one with the largest id.

    Null and empty texts are one text; of repeated rows one stays; a null id is the smallest."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id.

    Texts without words (null, empty) and rows with a null id are in no group and stay.  Rows of
    one id with different texts are documents of their own."""
    return without_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 100-byte strings that also start earlier out of the texts; all documents stay.

    A null text stays null; rows that share id and text are one document; a null id is the
    smallest.  ``n_chars``, if there, is counted anew."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences.

    A null or empty text is its end id alone; repeated rows are packed one by one."""
    return packed_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("minhash_dedup", near), ("suffix_array_dedup", substrings), ("best_fit_packing", packing)]

#: SQL cannot express the classifier and the signatures; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
