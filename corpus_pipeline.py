"""From raw documents to token ids: the stages, each on all rows that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return
the columns of ``docs``; the last returns token ids. :func:`run` writes every stage's
result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekloom.llm import bpe, decontaminate, neardup, privacy, toxicity
from seekloom.llm._shared import remove, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go. The model learns from the labelled ones."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxicity.held_out_rows())
    scored = toxicity.score(docs, model)
    return scored.where(~F.col(scored.columns[-1])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id."""
    return neardup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut out of the others."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and words that disclose it are replaced."""
    return privacy.sanitise(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; a text that its ids don't decode to is an error."""
    encoded = bpe.encode(docs, checked=True)
    ids = encoded.columns[-1]
    return encoded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("token_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("privacy", sanitise),
    ("tokens", tokenise),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:  # what the stage read is no longer needed
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
