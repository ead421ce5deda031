"""Exact deduplication by progressive refinement.

Length groups come first, then groups of (length, prefix hash); only rows of such
groups with two or more rows are compared by the hash of the full content. All
tables after the first scan are narrow (ids, lengths, hashes): texts never shuffle.

Defined results: a null text equals the empty text. A null id ranks below every
other id. Rows that repeat both id and text are all in one group and each of them
with the largest id is marked as kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import ASCII_LOWER, ASCII_UPPER, BROADCAST_ROWS, ascii_lower, fresh, materialise, table, text_of

PREFIX = 128


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, prefix: int = PREFIX) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest.

    digest is the SHA-256 of the text with A-Z lower-cased; unless digest_all, it is
    null for rows whose length or prefix already proves them unique.
    """
    norm = ascii_lower(text_of(text_col))
    scanned = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    keys = [F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head")]
    full = F.sha2(F.col("norm").cast("binary"), 256)
    narrow = materialise(scanned.select("id", *keys, (full if digest_all else F.lit(None).cast("string")).alias("digest")))

    # written, so that its size is known when the join is planned: broadcast if small, else splittable by adaptive execution
    lengths = materialise(narrow.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"))
    heads = materialise(narrow.join(lengths, "len", "left_semi").groupBy("len", "head").agg(F.count("*").alias("n")).where("n > 1").select("len", "head"))
    if digest_all:
        rivals = narrow.join(heads, ["len", "head"], "left_semi").select("id", "digest")
    else:
        again = scanned.select("id", *keys, "norm")
        if heads.count() <= BROADCAST_ROWS:  # full content is hashed for the surviving groups only
            rivals = again.join(F.broadcast(heads), ["len", "head"], "left_semi").select("id", full.alias("digest"))
        else:  # too many groups to send out: hash in the scan, so that no text shuffles
            rivals = again.select("id", "len", "head", full.alias("digest")).join(heads, ["len", "head"], "left_semi").select("id", "digest")
        rivals = materialise(rivals)
    groups = materialise(rivals.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1"))

    rows = narrow.select("id", "digest") if digest_all else rivals
    # broadcast if few, as a hot digest's rows would meet in one task; beyond that adaptive execution splits them
    found = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "digest", "left").select("id", "digest", "keep", "n")
    if not digest_all:
        found = found.unionByName(narrow.join(heads, ["len", "head"], "left_anti").select("id", "digest", F.lit(None).cast(narrow.schema["id"].dataType).alias("keep"), F.lit(None).cast("long").alias("n")))
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return found.select("id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "digest").withColumnRenamed("id", id_col)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay; rows without an id always do. An id's other texts aren't touched."""
    gone_id, gone_digest = fresh(docs, "copy_id", "copy_digest")
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(gone_id), F.col("digest").alias(gone_digest)).distinct()
    # only rows whose id is found are hashed again: the condition names both sides, so it isn't a join key
    digest = F.when(F.col(gone_id).isNotNull(), F.sha2(ascii_lower(text_of(text_col)).cast("binary"), 256))
    return docs.join(gone, (F.col(id_col) == F.col(gone_id)) & (digest == F.col(gone_digest)), "left_anti")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.withColumnRenamed("digest", "text_sha256")


SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS norm FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
