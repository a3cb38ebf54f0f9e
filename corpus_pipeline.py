"""Toxicity, near copies, repeated passages, benchmark leaks, tokens: one corpus through five stages.

Each stage takes the documents that its predecessor kept and returns documents, the last one token digests.
run() holds every stage's table in the shared folder, so a lost executor costs one stage at most.

Defined results, of every stage as of its operator: null and empty texts are kept (one row of them, since
they are copies of each other); rows that share a doc_id or have none are judged each by its own text;
rows alike in id and text become one; very long texts are read whole; an empty table stays empty; further
columns pass through all stages but the last, whatever their names but for such that begin with __skyledger_.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import bpe, decontaminate, simhash, substring, toxicity
from skyledger.llm.queries import vocabulary
from skyledger.llm.scratch import store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the PU-trained scorer rejects go; labels come from the folder's labels table."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that of least doc_id; null ids come last."""
    return simhash.representatives(docs, shingle=4, reach=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller doc_id has too are cut out; every document stays."""
    return substring.remove_repeats(docs, window=13).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark_leaks", drop_leaks),
    ("tokens", tokenise),
]

#: SQL can't train the scorer or hash with XXH64; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
