"""Near-duplicate removal by SimHash, verified on five-word shingles.

Two texts are alike if the Jaccard similarity of their sets of five-word shingles is 0.8
or more; a group is what is reachable over such pairs. One pass over the texts gives each
its set's digest, a SimHash fingerprint of its words, parities and a prefix of the set.

1. Equal sets become one node, by a pre-aggregated minimum.
2. Deletion variants of the fingerprints (simhash.links) give candidates within two bits,
   and equal fingerprints a star; they are verified and their groups become roots.
3. Fingerprints miss pairs, most of all if an edit is one contiguous piece. So all nodes
   are joined by prefix filtering, which misses none: of two sets that are 0.8 alike, in
   whatever order that is the same for all, the first ninth of one meets the first fifth
   of the other. The order is by how often a shingle recurs in a sample of the
   documents, then by hash (the sample only saves work). Nodes of one root aren't paired.
   A shingle in at most MEMBERS prefixes pairs them all. In a longer run all members
   meet its centre only, the one with the fewest rarer shingles: a large group of copies
   falls into one root that way, at a cost in proportion to its size.
4. Runs that still have several roots are finished exactly: the members outside the run's
   largest root are compared with all its members, in blocks, within the tasks.

Candidates of 2 to 4 are excluded by set sizes, by the places of the shingle in both
prefixes and by parities (of the shingles in BUCKETS buckets, which can't differ in more
bits than the sets may in shingles); what is left is verified on the sets themselves. A
shingle that the sample shows in very many documents is dealt to several tasks; its run
is then finished by step 4.

Defined results: a null text is an empty one; empty texts are alike. Of a group the row
with the least id stays, of several texts with that id the one with the least hash. Rows
are told apart by id and text: an id's texts have their own fates, and rows that repeat
both share one. Rows with a null id stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import BROADCAST_ROWS, discard, fresh, materialise, partitions, pieces, release_memory, text_of
from cellweave.llm.components import connected_components
from cellweave.llm.simhash import SEED, links, weighted_fingerprint, words

SHINGLE = 5
LIKE = 0.8
#: Buckets of a text's parity sketch.
BUCKETS = 8 * 64
#: Nodes with a shingle in their prefix up to which all of them are paired.
MEMBERS = 64
#: One document of so many, by a hash of the id, tells which shingles recur: those in OFTEN of them, MOST_OFTEN at most. All three only order the shingles.
SAMPLE, OFTEN, MOST_OFTEN = 16, 4, 1 << 20
#: Rows of a recurring shingle that one task gets, as far as the sample shows; shingles up to which this is done.
SHARE, SALTED = 4096, 50_000
#: Members of a run outside of its largest root, and members in all, that are compared at once.
PROBES, AGAINST = 512, 2048

_FACTOR, _LENGTH = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Hashes of words, kept up to a bound."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found

    def of(self, text: str) -> np.ndarray:
        ws = words(text)
        return np.fromiter(map(self.__getitem__, ws), "u8", len(ws))

    def release(self) -> None:
        self.clear()
        release_memory()


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending, from its words' hashes; of fewer words, of the whole text."""
    count = min(SHINGLE, len(hashes))
    if not count:
        return hashes
    x = hashes[: len(hashes) - count + 1] + np.uint64(count * _LENGTH & 0xFFFFFFFFFFFFFFFF)  # texts of fewer words apart from longer ones
    for k in range(1, count):
        x = x * _FACTOR + hashes[k : len(hashes) - count + 1 + k]
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return np.unique(x ^ (x >> np.uint64(31)))


def _parity(shingles: np.ndarray) -> np.ndarray:
    """Of each bucket whether an odd number of shingles falls into it, in longs.

    Two sets differ in at least as many shingles as their parities differ in bits.
    """
    odd = np.bincount((shingles >> np.uint64(40)).astype("i8") % BUCKETS, minlength=BUCKETS) % 2
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def _least_common(n: np.ndarray) -> np.ndarray:
    """So many shingles two alike sets of n together share at least."""
    return (4 * n + 8) // 9


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype("i4")
    flat = np.concatenate(arrays).astype("u8").view("i8") if arrays else np.zeros(0, "i8")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _distinct_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for b in pieces(batches, "text", 1 << 20):
        for text in b.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(known.of(text.as_py())).view("i8"))], names=["h"])
    known.release()


def recurring(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that recur in the sample, ascending, and in how many of its documents. texts: id, text."""
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text")
    often = sample.mapInArrow(_distinct_shingles, "h long").groupBy("h").agg(F.count("*").alias("df")).where(f"df >= {OFTEN}")
    found = often.orderBy(F.desc("df"), "h").limit(MOST_OFTEN).toArrow()  # bounded
    h, df = found.column("h").to_numpy().astype("i8").view("u8"), found.column("df").to_numpy().astype("i8")
    order = np.argsort(h)
    return h[order], df[order]


_FEATURES = "id long, t1 long, t2 long, sig1 long, sig2 long, n int, fp long, s array<long>, prefix array<long>"


def _featured(often: np.ndarray, counts: np.ndarray):
    """Rows id, t1, t2, text to those of _FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in pieces(batches, "text", 1 << 20):
            sigs, sizes, fps, parities, prefixes = [], [], [], [], []
            for text in b.column(3):
                hashes = known.of(text.as_py())
                s = shingle_set(hashes)
                n = len(s)
                sigs.append(np.frombuffer(xxhash.xxh128_digest(s.tobytes()), "<i8"))
                sizes.append(n)
                fps.append(weighted_fingerprint(*np.unique(hashes, return_counts=True)))
                parities.append(_parity(s))
                if n and len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    seen = np.where(often[at] == s, counts[at], 0)
                    s = s[np.argsort(seen, kind="stable")]
                prefixes.append(s[: n - (4 * n + 4) // 5 + 1])
            sig = np.array(sigs, "i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), _lists(parities), _lists(prefixes)],
                names=["id", "t1", "t2", "sig1", "sig2", "n", "fp", "s", "prefix"],
            )
        known.release()

    return run


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text to node, shingles."""
    known = WordHashes()
    for b in pieces(batches, "text", 1 << 20):
        yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingle_set(known.of(t.as_py())) for t in b.column(1)])], names=["node", "shingles"])
    known.release()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, sa, sb to the a, b that are alike."""
    try:
        for b in batches:
            (xs, x), (ys, y) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in b.columns[2:4])
            both = np.fromiter((len(np.intersect1d(x[i:j], y[k:m], assume_unique=True)) for i, j, k, m in zip(xs[:-1].tolist(), xs[1:].tolist(), ys[:-1].tolist(), ys[1:].tolist(), strict=True)), "i8", b.num_rows)
            like = pa.array(both >= LIKE * (np.diff(xs) + np.diff(ys) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(like), b.column(1).filter(like)], names=["a", "b"])
    finally:
        release_memory()


def text_keys(text: Column) -> list[Column]:
    """What tells an id's texts apart."""
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sizes and parities let them be alike."""
    ends = [nodes.select(F.col("node").alias(e), F.col("n").alias(f"n{e}"), F.col("s").alias(f"s{e}")) for e in "ab"]
    differ = " + ".join(f"bit_count(sa[{i}] ^ sb[{i}])" for i in range(BUCKETS // 64))
    near = f"5 * least(na, nb) >= 4 * greatest(na, nb) and {differ} <= na + nb - 2 * ((4 * (na + nb) + 8) div 9)"
    return pairs.join(ends[0], "a").join(ends[1], "b").where(near).select("a", "b").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are alike, in a table. nodes: node, id, t1, t2; texts: id, text."""
    near = materialise(pairs)
    wanted = materialise(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", F.col("id").alias("of"), "t1", "t2"), "node"))
    # an id finds its rows, their text the right one of them; rows that repeat both give one
    t1, t2 = text_keys(F.col("text"))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = texts.join(few, (F.col("id") == F.col("of")) & (t1 == F.col("t1")) & (t2 == F.col("t2"))).groupBy("node").agg(F.first("text").alias("text"))
    sets = materialise(found.mapInArrow(_as_sets, "node long, shingles array<long>"))
    joined = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    out = materialise(joined.select("a", "b", "sa", "sb").mapInArrow(_similar, "a long, b long"))
    discard(near, wanted, sets)
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


_MET = "a long, b long, h long, at int, n int"


def _met(pairs: pa.RecordBatch | None = None, members: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows of _MET: pairs (a, b), or members a, h, at, n of runs."""
    if pairs is not None:
        rest = [pa.nulls(pairs.num_rows, kind) for kind in (pa.int64(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([*pairs.columns, *rest], names=["a", "b", "h", "at", "n"])
    node, h, at, n = members  # type: ignore[misc]
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.nulls(len(node), pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["a", "b", "h", "at", "n"])


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether sets x and y, given by their rows, can be alike if this is the first shingle that they share."""
    small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    return (5 * small >= 4 * large) & (np.minimum(n[x] - at[x], n[y] - at[y]) >= _least_common(small + large))


def _prefixes_meet(most: int):
    """Over rows (h, salt, at, n, node, root) sorted by the first four: pairs that may be alike, and the members of runs that aren't finished by them."""

    def settle(h, salt, at, n, node, root) -> Iterator[pa.RecordBatch]:
        new = np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))
        begins = np.flatnonzero(new)
        lengths = np.diff(np.append(begins, len(h)))
        several = np.minimum.reduceat(root, begins) != np.maximum.reduceat(root, begins)
        long = several & (lengths > most)
        run = np.cumsum(new) - 1
        if (unfinished := (long | (salt[begins] > 0))[run]).any():
            yield _met(members=[x[unfinished] for x in (node, h, at, n)])
        if long.any():
            y = np.flatnonzero(long[run])
            x = begins[run[y]]
            take = (root[x] != root[y]) & _fit(x, y, n, at)
            if take.any():
                yield _met(_pairs(np.minimum(node[x], node[y])[take], np.maximum(node[x], node[y])[take]))
        rows = np.flatnonzero((several & ~long)[run])
        for lag in range(1, len(rows)):
            x, y = rows[:-lag], rows[lag:]
            same = run[x] == run[y]
            if not same.any():
                return
            x, y = x[same], y[same]
            take = (root[x] != root[y]) & _fit(x, y, n, at)
            if take.any():
                yield _met(_pairs(np.minimum(node[x], node[y])[take], np.maximum(node[x], node[y])[take]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last, perhaps unfinished run
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                new = [c.to_numpy().astype("i8") for c in batch.columns]
                columns = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
                own = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
                if tail := len(own) - int(own.sum()):
                    yield from settle(*(c[:tail] for c in columns))
                held = [c[tail:].copy() for c in columns]
            if held is not None:
                yield from settle(*held)
        finally:
            release_memory()

    return stream


_LONGS = BUCKETS // 64


def _blocks_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (h, block, chunk, probe, at, n, node, root, s) sorted by the first four, the probes of a block last: pairs of probes and members that may be alike."""

    def settle(key, probe, at, n, node, root, s) -> Iterator[pa.RecordBatch]:
        begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        for i, j in zip(begins.tolist(), np.append(begins[1:], len(key)).tolist(), strict=True):
            split = i + int(np.searchsorted(probe[i:j], 1))
            members = np.arange(i, split)
            for p in range(split, j):
                y = members[root[i:split] != root[p]]
                x = np.full(len(y), p)
                y = y[_fit(x, y, n, at)]
                differ = np.bitwise_count(s[y] ^ s[p]).sum(axis=1, dtype="i8")
                total = n[y] + n[p]
                if len(y := y[differ <= total - 2 * _least_common(total)]):
                    yield _pairs(np.minimum(node[y], node[p]), np.maximum(node[y], node[p]))

    held: list[np.ndarray] | None = None
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.columns
            new = [np.column_stack([x.to_numpy().astype("i8") for x in c[:3]]), *(x.to_numpy().astype("i8") for x in c[3:8]), c[8].flatten().to_numpy().astype("i8").view("u8").reshape(-1, _LONGS)]
            columns = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            tail = len(columns[0]) - int((columns[0] == columns[0][-1]).all(axis=1).sum())
            if tail:
                yield from settle(*(x[:tail] for x in columns))
            held = [x[tail:].copy() for x in columns]
        if held is not None:
            yield from settle(*held)
    finally:
        release_memory()


def rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with the root of each."""
    known = roots.select(F.col("node").alias("of"), "root")
    return nodes.join(known, nodes["node"] == known["of"], "left").withColumn("root", F.coalesce("root", "node")).drop("of")


def prefix_pairs(nodes: DataFrame, roots: DataFrame, salts: DataFrame, most: int = MEMBERS) -> DataFrame:
    """A table of pairs (a, b) that may be alike and whose roots differ, and of the members (a, h, at, n) of runs that aren't finished by them. nodes: node, n, prefix; salts: h, salts."""
    n = partitions(nodes.sparkSession)
    rows = rooted(nodes.select("node", "n", "prefix"), roots).select("node", "root", "n", F.posexplode("prefix").alias("at", "h"))
    rows = rows.join(F.broadcast(salts), "h", "left")  # SALTED rows at most
    # a shingle with shares has salts from 1, any other one 0
    salt = F.coalesce(F.pmod(F.xxhash64("node"), "salts") + 1, F.lit(0).cast("long"))
    rows = rows.select("h", salt.alias("salt"), "at", "n", "node", "root").repartition(n, "h", "salt").sortWithinPartitions("h", "salt", "at", "n", "node")
    return materialise(rows.mapInArrow(_prefixes_meet(most), _MET))


def block_pairs(members: DataFrame, nodes: DataFrame, roots: DataFrame, probes: int = PROBES, against: int = AGAINST) -> DataFrame:
    """Pairs (a, b) that may be alike, of all pairs of nodes with different roots in one run. members: node, h, at, n."""
    n = partitions(nodes.sparkSession)
    rows = materialise(rooted(members, roots).select("node", "root", "n", "at", "h"))
    sizes = rows.groupBy("h", "root").agg(F.count("*").alias("size"))
    runs = sizes.groupBy("h").agg(F.sum("size").alias("all"), F.max("size").alias("most"), F.max_by("root", F.struct("size", "root")).alias("main")).where("all > most")
    runs = materialise(runs.select("h", "main", F.expr(f"(all - most + {probes - 1}) div {probes}").alias("blocks"), F.expr(f"(all + {against - 1}) div {against}").alias("chunks")))
    rows = materialise(rows.join(runs, "h").join(nodes.select("node", "s"), "node"))
    block, chunk = F.pmod(F.xxhash64("node"), "blocks"), F.pmod(F.xxhash64(F.lit(1), "node"), "chunks")
    data = ["at", "n", "node", "root", "s"]
    members = rows.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), F.lit(0).alias("probe"), *data)
    outside = rows.where("root <> main").select("h", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("probe"), *data)
    both = members.unionByName(outside).repartition(n, "h", "block", "chunk").sortWithinPartitions("h", "block", "chunk", "probe")
    return both.mapInArrow(_blocks_meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: int = MEMBERS) -> DataFrame:
    """node, root, t1, t2: id of each row to drop and of the one of its group that stays, and the keys of the dropped row's text."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    often, counts = recurring(texts)
    t1, t2 = text_keys(F.col("text"))
    features = texts.select("id", t1.alias("t1"), t2.alias("t2"), "text").mapInArrow(_featured(often, counts), _FEATURES)
    features = materialise(features.withColumn("node", F.monotonically_increasing_id()))
    # equal sets: all but the first are linked to it and take no further part
    first = materialise(features.groupBy("sig1", "sig2").agg(F.min("node").alias("root"), F.count("*").alias("size")).where("size > 1"))
    equal = materialise(features.select("node", "sig1", "sig2").join(first, ["sig1", "sig2"]).where("node <> root").select("node", "root"))
    nodes = features if equal.isEmpty() else materialise(features.join(equal, "node", "left_anti"))

    by_fp = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    stars = nodes.join(by_fp, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = links(by_fp)
    ends = [by_fp.select(F.col("fp").alias(e), F.col("least").alias(f"l{e}")) for e in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    roots = connected_components(verified(possible(stars.unionByName(near), nodes), nodes, texts))

    hot = np.flatnonzero(counts * SAMPLE > SHARE)
    hot = hot[np.argsort(-counts[hot], kind="stable")[:SALTED]]
    salts = spark.createDataFrame([(int(h), int(-(-c * SAMPLE // SHARE))) for h, c in zip(often[hot].view("i8").tolist(), counts[hot].tolist(), strict=True)], "h long, salts long")
    met = prefix_pairs(nodes, roots, salts, members)
    roots = merged(roots, verified(possible(met.where("b is not null").distinct(), nodes), nodes, texts))
    unfinished = met.where("h is not null").select(F.col("a").alias("node"), "h", "at", "n")
    if not unfinished.isEmpty():
        roots = merged(roots, verified(block_pairs(unfinished, nodes, roots), nodes, texts))

    roots = merged(roots, equal.select(F.col("root").alias("a"), F.col("node").alias("b")))
    ends = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    grouped = materialise(features.select("node", "id", "t1", "t2").join(ends, "node").drop("node"))
    # the least id of a group stays, with one text
    stays = materialise(grouped.groupBy("root").agg(F.min(F.struct("id", "t1", "t2")).alias("stays")))
    gone = grouped.join(stays, "root").where(F.struct("id", "t1", "t2") != F.col("stays"))
    gone = materialise(gone.select(F.col("id").alias("node"), F.col("stays.id").alias("root"), "t1", "t2").distinct())
    discard(features, first, equal, by_fp, met, grouped, stays, roots)
    return gone


def merged(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """The roots after further pairs."""
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(pairs))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that are near-duplicate of one that stays."""
    gone_id, gone_t1, gone_t2 = fresh(docs, "near_dup_id", "near_dup_t1", "near_dup_t2")
    gone = near_duplicates(docs, id_col, text_col).select(F.col("node").alias(gone_id), F.col("t1").alias(gone_t1), F.col("t2").alias(gone_t2))
    t1, t2 = text_keys(text_of(text_col))
    return docs.join(gone, (F.col(id_col) == F.col(gone_id)) & (t1 == F.col(gone_t1)) & (t2 == F.col(gone_t2)), "left_anti")
