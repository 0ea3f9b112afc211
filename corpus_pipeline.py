"""A training corpus from raw documents: quality, line dedup, near-duplicate documents, source mixture, tokens."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanquarry.llm import bpe, line_dedup, mixing, ngram_join, quality
from spanquarry.llm.shared import folder

#: The classifier, the mixture's bisection and the tokenizer are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier gives 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.train(docs, labels), out="__score").where("__score >= 0.3").drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words or more that stand earlier in the corpus go; so do documents of which nothing is left."""
    cleaned = line_dedup.drop_repeats(docs)
    return cleaned.where("n_deleted = 0 or n_deleted < n_words").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard likeness of 0.8 or more the one with the least id."""
    groups = ngram_join.jaccard_components(docs, width=5, share=80, whole=100)
    gone = groups.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are read up to twice, every document once at least."""
    return mixing.mix(docs, mixing.words(), repeats=2.0, prefix="__mix_").select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that the mixture reads, and digests of the ids and of what they decode to."""
    return bpe.digests(docs.select("doc_id", "source", "text")).drop("text")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("bpe tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        path = folder(spark, f"stage-{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
