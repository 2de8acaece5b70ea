"""Documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes and returns a DataFrame with the columns of `documents`; the last one
returns the encoded documents. A stage works on all that the one before it kept.

Defined results: null and empty texts have too few words for the rules and go in the first
stage; rows with one doc_id are judged each by its own text, but stay or go together in near-dedup;
rows without doc_id stay in near-dedup; a null source is a source of its own; nulls in the other columns pass through;
further columns of the input stay up to the encoding; an empty table gives an empty one at
each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.llm import bpe, line_dedup, minhash, mixing, quality_rules
from predio.llm.common import checkpointed, small_batches


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.apply_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    small_batches(spark)
    kept = line_dedup.dedup_texts(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    small_batches(spark)
    return minhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and text, ids."""
    small_batches(spark)
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), texts=True).drop("decoded")


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixture), ("bpe", encoded)]
#: SQL can't express the near-dedup's, the mixing's and the encoding's methods.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
