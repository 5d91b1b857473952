"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it
as Parquet into the shared folder and gives what it reads back to the next stage.
All stages but the last return the columns of the documents as they are.
"""
import uuid

from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import exact_dedup, language_id, ngram_join, packing, toxicity
from kgloom.llm.common import held_out, shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity network rejects."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    model = language_id.train(docs.filter(~held_out("doc_id", 4, 2)))
    return language_id.keep_identified(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ngram_join.drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("language_id", language_stage), ("exact_dedup", exact_stage), ("ngram_join", near_stage), ("packing", packing_stage)]

# networks, similarity joins and packing can't be written in SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")
