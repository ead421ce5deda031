"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits are cut into just two segments, so that of two fingerprints
with at most three differing bits one segment differs in at most one. Each segment is
indexed under 32 variants, each with another bit left out; equal variants meet and
the whole fingerprints are compared. A pair is taken from one variant only.

A variant that more than RUN distinct fingerprints share gives no pairs. Its members
go another, exact way to the same links: fingerprints within two bits of each other
lie in a ball of radius one around some 64-bit value, and all members of such a ball
are within two bits of each other. So each member is listed under itself and its 64
one-bit changes, and neighbours in the sorted members of a ball, of which there are 65
at most, are linked. Chains give the same components as all pairs would.

Defined results: a null text is an empty one; a text without words has fingerprint
zero, which is linked like any other. A null id takes part like any other row, but
names a component only if no other id is in it (then the component is null). Rows that
repeat an id each get their own fingerprint's component. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import materialise, partitions, pieces, table, text_of
from cellweave.llm.components import connected_components

SEED = 42
#: Distinct fingerprints of one variant up to which pairs are formed.
RUN = 32

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def words(text: str) -> list[bytes]:
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))


def _bit_sums(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """How much of the weight has each of the 64 bits, from the lowest."""
    if weights is None:
        total = np.zeros(64, "i8")
        for i in range(0, len(hashes), 8192):
            bits = np.unpackbits(hashes[i : i + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype="i4")
        return total
    bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
    return weights @ bits.astype("f4")


def _packed(majority: np.ndarray) -> int:
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def shingle_hashes(ws: list[bytes], n: int, seed: int = SEED) -> list[int]:
    if not ws:
        return []
    digest = xxhash.xxh64_intdigest
    if len(ws) <= n:
        return [digest(b" ".join(ws), seed)]
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), "i8", len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(ws) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]


def fingerprint(text: str, n: int = 3, seed: int = SEED) -> int:
    """Signed 64 bits; a bit is 1 if more than half of the shingles' hashes have it."""
    hashes = shingle_hashes(words(text), n, seed)
    if not hashes:
        return 0
    return _packed(_bit_sums(np.array(hashes, "<u8")) * 2 > len(hashes))


def weighted_fingerprint(hashes: np.ndarray, counts: np.ndarray) -> int:
    """Signed 64 bits over distinct hashes, each with the root of its count as weight."""
    if not len(hashes):
        return 0
    weights = np.sqrt(counts.astype("f4"))
    return _packed(_bit_sums(hashes, weights) * 2 > weights.sum())


def _fingerprinted(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            fps = [fingerprint(t, n) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp."""
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(_fingerprinted(n), "id long, fp long")


def _meet(bits: int, run: int):
    """Over rows (key, fp) sorted by both: pairs (a, b) of a run's fingerprints, or (a, null) for each member of a long run."""

    def pairs_of(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        segment, wild = np.divmod(key >> 32, 32)
        for lag in range(1, run):
            if lag >= len(key):
                return
            same = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(same):
                return
            a, b = fp[same], fp[same + lag]
            x = (a ^ b).view("u8")
            low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
            s, w = segment[same], wild[same].astype("u8")
            own = np.where(s == 0, low, high)
            # only from the variant that leaves the differing bit out, or from the first; from the second segment only if the first can't show it
            once = (own == np.uint64(1) << w) | ((own == 0) & (w == 0))
            once &= (s == 0) | (np.bitwise_count(low) > 1)
            once &= (np.bitwise_count(x) <= bits) & (x != 0)
            if once.any():
                yield a[once], b[once]

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], names=["a", "b"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, "i8"), np.zeros(0, "i8"))  # the last, perhaps unfinished run: at most run + 1 rows of it
        long_key = None  # of a run that is already known as long

        def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            lengths = np.diff(np.concatenate((begins, [len(key)])))
            is_long = np.repeat((lengths > run) | (key[begins] == (long_key if long_key is not None else -1)), lengths)
            if is_long.any():
                yield out(np.unique(fp[is_long]), None)
            several = ~is_long & np.repeat(lengths > 1, lengths)
            for a, b in pairs_of(key[several], fp[several]):
                yield out(a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate((held[0], batch.column(0).to_numpy()))
            fp = np.concatenate((held[1], batch.column(1).to_numpy()))
            tail = int(np.searchsorted(key, key[-1]))
            yield from settle(key[:tail], fp[:tail]) if tail else ()
            key, fp = key[tail:], fp[tail:]
            if long_key is not None and long_key != key[0]:
                long_key = None
            if long_key is not None or len(key) > run:
                long_key = int(key[0])
                yield out(fp, None)
                key, fp = key[:0], fp[:0]
            held = (key, fp)
        if len(held[0]):
            yield from settle(*held)

    return stream


def links(fps: DataFrame, bits: int = 2, run: int = RUN) -> DataFrame:
    """a, b: links between distinct fingerprints that have the same components as all links of at most that many bits."""
    if bits not in (1, 2):
        raise ValueError("links of one or two bits are supported")
    spark = fps.sparkSession
    n = partitions(spark)
    shift = "cast(v div 32 * 32 as int)"
    key = f"shiftleft(cast(v as bigint), 32) | (shiftright(fp, {shift}) & 4294967295 & ~shiftleft(1L, v % 32))"
    # dealt out anew, as few tasks hold the distinct fingerprints and each makes 64 rows
    index = fps.select("fp").distinct().repartition(n).select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(F.expr(key).alias("key"), "fp")
    met = materialise(index.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_meet(bits, run), "a long, b long"))
    pairs = met.where("b is not null")
    crowded = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    return pairs.unionByName(ball_links(crowded, bits))


def ball_links(fps: DataFrame, bits: int) -> DataFrame:
    """Links through balls of radius one; for one bit, through values that lack that bit."""
    if bits == 1:
        centres = fps.select("fp", F.posexplode(F.expr("transform(sequence(0, 63), i -> fp & ~shiftleft(1L, i))")).alias("i", "x"))
    else:
        centres = fps.select("fp", F.lit(0).alias("i"), F.explode(F.expr("array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp)")).alias("x"))
    before = F.lag("fp").over(Window.partitionBy("i", "x").orderBy("fp"))
    return centres.select(F.col("fp").alias("a"), before.alias("b")).where("b is not null").distinct()


def near_dup_components(docs: DataFrame, n: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """id, fp, component_id: the smallest id reachable over links of at most that many bits."""
    rows = materialise(fingerprints(docs, n, id_col, text_col))
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(links(nodes, bits, run))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    by_root = materialise(labelled.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = materialise(labelled.select("fp", "root").join(by_root, "root").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("id", "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
