"""A training corpus from documents: toxicity, boilerplate lines, near copies, source mix, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.llm import line_dedup, mixing, simhash, toxicity, unigram
from auditlake.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, learned from the labelled documents that reached this stage."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that more than 2 % of their source's different documents carry.

    Copies count as one document here: the next stage keeps one of them, which must come whole."""
    return line_dedup.drop_boilerplate(docs, site="source", copies_once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies."""
    return simhash.drop_near_copies(docs, shingle=3, max_bits=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per document and round, at most three, partly taken ones with the taken words alone."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, n_tokens, and whether the tokens decode to the text."""
    out = unigram.encode(docs.select("doc_id", "source", "text"), decodes="decodes")
    return out.select("doc_id", "source", "tokens", F.size("tokens").cast("long").alias("n_tokens"), "decodes")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", tokenise),
]
#: The toxicity model, XXH64 shingles and the piece search have no SQL form; tests run the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
