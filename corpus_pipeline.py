"""The training-data pipeline: toxic documents go, boilerplate lines go, one of each group of near
duplicates stays, documents with benchmark passages go, and what is left is encoded.

STAGES are (name, function) in order. Each function takes (spark, docs, sf_dir), works on all that the
stage before it kept, and returns the columns of documents; the last returns tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from echoloom.llm.common import drop_folder, table
from echoloom.llm.queries import tokenizer_path, toxicity_model
from echoloom.session import ensure_checkpoint_dir, tune


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches 0.7; the lexicon is learned from `docs` and labels."""
    return toxicity.drop_toxic(docs, toxicity_model(tune(spark), docs, sf_dir))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts, site by site, long ones from few pages on; n_chars follows the text."""
    tune(spark)
    out = line_dedup.drop_boilerplate(docs, "source", "text", steps=line_dedup.STEPS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates."""
    tune(spark)
    return jaccard.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.drop_leaked(docs, table(tune(spark), sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document left."""
    tune(spark)
    return bpe.round_trip(docs, bpe.read_spec(tokenizer_path()))


STAGES = [("toxicity", without_toxic), ("line_dedup", without_boilerplate), ("near_duplicates", without_copies), ("decontamination", without_leaks), ("bpe", encoded)]

#: Tokenizing and learned weights cannot be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet in the shared checkpoint folder and reread.

    A stage's folder is deleted once the next stage has been written; only the last one stays.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            drop_folder(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
