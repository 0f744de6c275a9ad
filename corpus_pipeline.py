"""The corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns of documents,
and works on all that the stage before it kept.  Stages with Python bound the session's Arrow batches, as an executor has
to hold those of all its tasks besides what the stages before have left in its memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, jaccard, mixing, token_output, toxicity
from sparkloom.llm.shared import Scratch, new_path, small_batches, written
from sparkloom.llm.tokenize import vocabulary

TOKENIZER, END_ID = "word_bpe_49k.json", 1


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels of these documents, does not reject."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order."""
    return mixing.training_order(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; what they hold, read back."""
    small_batches(spark)
    path = new_path(spark, "tokens")
    token_output.write_tokens(docs, path, vocabulary(TOKENIZER), END_ID, ("lang", "source"))
    return token_output.digest(spark, path)


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", no_benchmark),
    ("source_mixing", mix),
    ("token_output", tokens),
]

#: The toxicity model and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again before the next, and go when the last is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    out = written(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
    scratch.drop()
    return out
