"""A training-corpus pipeline in five stages, each on all that the one before has kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it
again for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatrace.llm.common import written
from seatrace.llm.decontamination import decontaminate
from seatrace.llm.jaccard import without_near_duplicates
from seatrace.llm.packing import pack_documents
from seatrace.llm.repeats import cut_repeats
from seatrace.llm.toxicity import fit, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those at or above their language's toxicity threshold. The fit learns from all labels there are.

    Null and empty texts are scored as one padding token; a null language has the threshold of all; without labels of both
    kinds the score is the share of label 1. Rows with equal or null ids are each judged by their own text.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, keep=COLUMNS[1:]).where("not flagged").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest id. Shingles of five words, similarity 0.8.

    Texts that are null or have no words are in no class and stay; of rows with equal ids, each is a document of its own.
    """
    return without_near_duplicates(docs.select(*COLUMNS), shingle=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that also stand elsewhere; documents stay, if need be with empty texts.

    Null texts stay null; rows with equal or null ids are documents of their own.
    """
    cut = cut_repeats(docs.withColumn("was_null", F.isnull("text")), threshold=50, unit="word", keep=["lang", "source", "was_null"])
    text = F.when(~F.col("was_null"), F.decode("kept", "UTF-8"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents of which half or more is benchmark text go.

    Null and empty texts are hit by nothing and stay as they are; an empty benchmark changes nothing.
    """
    clean = decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins; null and empty texts have no tokens and no piece; ties go by id."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate), ("suffix_dedup", repeated_passages), ("decontamination", benchmark), ("packing", packing)]

#: The first stage is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
