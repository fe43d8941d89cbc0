"""The corpus pipeline: language, near duplicates, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
Stages work on all that their predecessor kept. A null or empty text has no language and goes in the first stage; later stages
keep such rows should they meet them. Columns that documents may have beyond its five are kept by all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, jaccard, langid, mixing, pii
from palimpsest.llm.common import fresh_path

MIN_CONFIDENCE = 0.5


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns of these names, in any case, under other names; and what those are."""
    held = {c: f"_pl_held_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(held), held


def back(df: DataFrame, docs: DataFrame, held: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells with a confidence of MIN_CONFIDENCE or more; lang becomes that language."""
    d, held = aside(docs, "language", "confidence", "probabilities", "positions")
    kept = langid.identify(d, langid.train(docs)).where(F.col("confidence") >= MIN_CONFIDENCE)
    return back(kept.withColumn("lang", F.col("language")), docs, held)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least doc_id."""
    return jaccard.one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers in text replaced by their kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their source's target: each as often as the mix takes it."""
    d, held = aside(docs, "copies")
    return back(mixing.repeated(mixing.mix(d)), docs, held)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, tokens, n_tokens and round_trip of every document."""
    return bpe.tokenize(docs).select("doc_id", "lang", "source", "tokens", "n_tokens", "round_trip")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: A network, hashes and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
