"""A corpus pipeline: toxicity filter, exact and near deduplication, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of documents;
the last returns the tokens. Stages work on all rows that the one before kept. What
an operator defines for nulls, empty texts and repeated rows holds for its stage; in
particular rows without an id are never dropped as copies. An empty table gives an
empty result. Stages with Python workers set the size of Arrow batches for the session.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import bpe, exact_dedup, mixing, near_dup, toxicity
from cellweave.llm.common import materialise, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model scores under one half."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(COLUMNS), model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs.select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near duplicates the row with the least id."""
    small_batches(spark)
    return near_dup.drop_near_duplicates(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated to the target weights, in global random order."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    small_batches(spark)
    tokens = bpe.encode(docs, public_tokenizers.path(bpe.VOCABULARY), decode=False)
    return tokens.select(F.col("id").alias("doc_id"), "n_tokens", "ids")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies), ("source mixing", mix), ("byte-level BPE", encode)]

#: Fitted models and merge replay can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
