"""Line deduplication over the corpus.

Line keys are hashed to 128 bits where the texts are read. The hashes are
range-partitioned with document and position as further sort keys, so a line that a
third of all documents hold spreads over as many partitions as it fills; the ranges'
bounds come from the lines of one document in SAMPLE, which balances tasks and changes no
result. Each partition is streamed in order and every line that does not stand in its key's first
document is reported. A run that a partition shares with the one before is reported
whole and settled by one summary row per partition. Texts do not move: the result is
a compressed keep bitmap for each document.

Defined results: a null or empty text is one empty line. Rows that repeat id and
text keep and lose the same lines; ids are otherwise taken as unique. A null id ranks
before all others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import ASCII_LOWER, ASCII_UPPER, BLANKS, ascii_lower, discard, materialise, partitions, place_among, table, text_of

LEAST = 10
#: One document of so many, by a hash of the id, and about so many of its lines for each range, tell the ranges' bounds.
SAMPLE, LINES = 16, 50
#: Stands for a null id while ids are compared.
NO_ID = -(1 << 63)

_STREAMED = "kind int, part int, h1 long, h2 long, id long, pos int"
DROPPED, IN_HEAD, FIRST, LAST = range(4)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    lines = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.posexplode(F.split(text_of(text_col), "\n")).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    return lines.select("id", "pos", key.alias("key")).where(F.char_length("key") >= least).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "id", "pos")


def in_ranges(lines: DataFrame, sampled: DataFrame, ranges: int) -> DataFrame:
    """lines dealt to that many partitions by (h1, h2, id, pos), of about as many rows each by what is sampled."""
    order = ["h1", "h2", "id", "pos"]
    n = sampled.count()
    share = min(1.0, LINES * ranges / max(n, 1))
    drawn = sampled.where(F.pmod(F.xxhash64(F.lit("bound"), *order), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sorted(map(tuple, drawn.select(*order).collect()))  # LINES for each range
    bounds = sorted({rows[len(rows) * i // ranges] for i in range(1, ranges)}) if rows else []
    listed = F.from_json(F.lit(json.dumps([dict(zip(order, b, strict=True)) for b in bounds])), "array<struct<h1: bigint, h2: bigint, id: bigint, pos: int>>")
    return place_among(lines, F.struct(*order), listed, len(bounds), "range").repartitionById(ranges, "range").select(*order).sortWithinPartitions(*order)


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (h1, h2, id, pos)."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("pos", pa.int32())])

    def rows(kind, h1, h2, ids, pos):
        n = len(h1)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, "i4")), pa.array(np.full(n, part, "i4")), pa.array(h1), pa.array(h2), pa.array(ids), pa.array(pos)], schema=schema)

    head = carry = None  # (h1, h2, first id) of the partition's first run and of the current one
    one = lambda kind, run: rows(kind, *(np.array([x], "i8") for x in run), np.zeros(1, "i4"))
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, ids, pos = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("h1", "h2", "id", "pos"))
        new = np.empty(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = carry is None or (h1[0], h2[0]) != carry[:2]
        at = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        first = np.where(at >= 0, ids[np.maximum(at, 0)], 0 if carry is None else carry[2])
        if head is None:
            head = (h1[0], h2[0], ids[0])
            yield one(FIRST, head)
        in_head = (h1 == head[0]) & (h2 == head[1])
        drop = (ids != first) & ~in_head
        if in_head.any():
            yield rows(IN_HEAD, h1[in_head], h2[in_head], ids[in_head], pos[in_head])
        if drop.any():
            yield rows(DROPPED, h1[drop], h2[drop], ids[drop], pos[drop])
        carry = (h1[-1], h2[-1], first[-1])
    if carry is not None:
        yield one(LAST, carry)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, pos (from 0) of each line that an earlier document holds."""
    spark = docs.sparkSession
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0)
    sampled = materialise(line_hashes(sample, id_col, text_col, least))
    lines = in_ranges(line_hashes(docs, id_col, text_col, least), sampled, partitions(spark))
    streamed = materialise(lines.mapInArrow(_first_occurrences, _STREAMED))
    discard(sampled)
    # one or two rows for each partition, whatever the input
    ends = sorted(streamed.where(F.col("kind") >= FIRST).collect(), key=lambda r: (r["part"], r["kind"]))
    firsts, carry = [], None
    for begin, end in zip(ends[::2], ends[1::2], strict=True):
        run = lambda r: (r["h1"], r["h2"])
        goes_on = carry is not None and run(begin) == carry[0]
        first = carry[1] if goes_on else begin["id"]
        firsts.append((begin["part"], first))
        carry = (run(end), first if run(end) == run(begin) else end["id"])
    known = F.broadcast(spark.createDataFrame(firsts, "part int, first long"))
    heads = streamed.where(F.col("kind") == IN_HEAD).join(known, "part").where("id != first")
    return streamed.where(F.col("kind") == DROPPED).select("id", "pos").unionByName(heads.select("id", "pos")).distinct()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for gone in b.column(b.schema.get_field_index("gone")):
            pos = np.asarray(gone.values.to_numpy(zero_copy_only=False), "i8")
            keep = np.ones(int(pos.max()) // 8 * 8 + 8, "u1")  # whole bytes, filled up with kept lines
            keep[pos] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), b.column(b.schema.get_field_index("n_dropped")), pa.array(maps, pa.binary())], names=["id", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_dropped, keep_bitmap for each document that loses a line.

    keep_bitmap is a zlib stream of bits, most significant first: 1 keeps the line;
    lines after the last bit of a position that was dropped stay.
    """
    gone = dropped_lines(docs, id_col, text_col, least).groupBy("id").agg(F.collect_list("pos").alias("gone"), F.count("*").alias("n_dropped"))
    return gone.select("id", "n_dropped", "gone").mapInArrow(_bitmaps, "id long, n_dropped long, keep_bitmap binary")


def kept_text(text: str, bitmap: bytes | None) -> str:
    """Applies a keep bitmap."""
    if bitmap is None:
        return text
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), "u1"))
    lines = text.split("\n")
    return "\n".join(x for i, x in enumerate(lines) if i >= len(keep) or keep[i])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, maps, gone = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("id", "text", "keep_bitmap", "n_dropped"))
        n = [t.count("\n") + 1 for t in texts]
        sha = [hashlib.sha256(kept_text(t, m).encode()).hexdigest() for t, m in zip(texts, maps, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    maps = materialise(keep_bitmaps(docs)).select(F.col("id").alias("gone_id"), "n_dropped", "keep_bitmap")
    sides = docs.select(F.col("doc_id").alias("id"), text_of("text").alias("text"))
    # always shuffled: the bitmaps grow with the corpus, and one plan at every size keeps its cost in proportion
    joined = sides.hint("merge").join(maps, F.coalesce("id", F.lit(NO_ID)) == F.col("gone_id"), "left")
    return joined.select("id", "text", "keep_bitmap", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped")).mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_TRIM}), '{ASCII_UPPER}', '{ASCII_LOWER}') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= {LEAST} GROUP BY k
), marked AS (
  SELECT doc_id, pos, line, first_doc IS NOT NULL AND first_doc <> doc_id AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
