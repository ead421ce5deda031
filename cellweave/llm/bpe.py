"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The distinct words (matches of the splitting pattern) of a block of documents are
laid out as one chain of symbols. An inverted index from token pair to the positions
where the pair stands is kept in rank order; each merge is applied to all its
positions at once, and only the pairs of touched neighbours are looked up anew. A
word keeps its ids for later blocks of the same task. Blocks have a bound
in bytes, so the work is a narrow pass over the corpus: texts are not shuffled.

A merge whose new token can't be part of a pair of lower rank is applied to all
positions of a word at once, from the left; any other merge is applied to a word's
leftmost position only, before the index is consulted again. Both give what merging
the lowest-ranked, leftmost pair one at a time gives.

Ranks are read where the driver runs and travel with the job.

Defined results: a null text is an empty one; an empty text has no ids. Rows that
repeat an id are each encoded. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import pieces, release_memory, table, text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words that a task keeps.
KEPT_WORDS = 120_000
NEVER = np.int64(1 << 40)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in rank order."""
    with open(path, "rb") as file:
        ranked = [line.split() for line in file if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in ranked) + 1)
    for token, rank in ranked:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Merges:
    """Replays the merges of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        ranks = {t: i for i, t in enumerate(tokens) if t}
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], "i8")
        keys, merged = [], []
        for rank, t in enumerate(tokens):
            for cut in range(1, len(t)):
                if (a := ranks.get(t[:cut])) is not None and (b := ranks.get(t[cut:])) is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, "i8"))
        self.keys, self.merged = np.array(keys, "i8")[order], np.array(merged, "i8")[order]
        #: Of each token whether all pairs with it rank after it.
        self.quiet = np.ones(len(tokens), bool)
        for half in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            self.quiet[half[self.merged < half]] = False
        #: Ids by word, as little-endian unsigned 32-bit integers.
        self.known: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NEVER)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids."""
        lengths = np.fromiter(map(len, words), "i8", len(words))
        symbol = self.byte_rank[np.frombuffer(b"".join(words), "u1")]
        size = len(symbol)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, size + 2), np.arange(-1, size)  # place size stands for none; its own values are never used
        last, first = ends - 1, ends - lengths
        after[last], before[first] = size, size
        after[size] = size
        before = np.append(before[:size], size)
        symbol = np.append(symbol, 0)
        word = np.append(np.repeat(np.arange(len(words)), lengths), -1)
        pair = np.full(size + 1, NEVER)  # rank of the pair that begins at each place
        inner = np.flatnonzero(after[:size] != size)
        pair[inner] = self.rank_of(symbol[inner], symbol[after[inner]])

        index: dict[int, list[np.ndarray]] = {}

        def listed(places: np.ndarray) -> list[int]:
            """Puts places into the index; ranks that it did not hold."""
            ranks = pair[places]
            some = ranks != NEVER
            places, ranks = places[some], ranks[some]
            if not len(places):
                return []
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            new = []
            for part, rank in zip(np.split(places, cuts), ranks[np.concatenate(([0], cuts))].tolist(), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    new.append(rank)
            return new

        queue = listed(inner)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            places = index.pop(rank)
            at = places[0] if len(places) == 1 else np.concatenate(places)
            at = at[pair[at] == rank]
            if len(at) > 1:
                at = np.unique(at)
                if self.quiet[rank]:
                    # of pairs that overlap in a row, every other one from the left
                    joined = np.append(False, after[at[:-1]] == at[1:])
                    begins = np.flatnonzero(~joined)
                    nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
                    at = at[nth % 2 == 0]
                else:
                    owner = word[at]
                    leftmost = np.append(True, owner[1:] != owner[:-1])
                    if not leftmost.all():
                        index[rank] = [at[~leftmost]]
                        heappush(queue, rank)
                    at = at[leftmost]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = rank
            pair[gone] = NEVER
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at
            before[size] = size
            left = before[at]
            touched = np.concatenate((at, left[left != size]))
            right = after[touched]
            ranks = self.rank_of(symbol[touched], symbol[right])
            pair[touched] = np.where(right == size, NEVER, ranks)
            pair[size] = NEVER
            for r in listed(touched):
                heappush(queue, r)

        alive = np.ones(size, bool)
        # a place is merged away if its predecessor's successor lies beyond it
        reach = after[:size]
        alive[:] = False
        alive[first[lengths > 0]] = True
        follow = reach[np.flatnonzero(alive)]
        follow = follow[follow != size]
        while len(follow):
            alive[follow] = True
            follow = reach[follow]
            follow = follow[follow != size]
        ids = symbol[:size][alive].astype("<u4").tobytes()
        per_word = np.bincount(word[:size][alive], minlength=len(words)) * 4
        stops = np.cumsum(per_word).tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def encode(self, texts: list[str], pattern: regex.Pattern) -> Iterator[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        split = [pattern.findall(t) for t in texts]
        if new := list({w for words in split for w in words if w not in known}):
            known.update(zip(new, self.replay([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        for words in split:
            yield b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def _merges(tokens: tuple[bytes, ...]) -> Merges:
    return Merges(list(tokens))


def _shipped(tokens: list[bytes]) -> bytes:
    return b"\n".join(base64.b64encode(t) for t in tokens)


@cache
def _unshipped(data: bytes) -> Merges:
    return _merges(tuple(base64.b64decode(t) for t in data.split(b"\n")))


def _encoded(spark: SparkSession, path: str, pattern: str, digests: bool, decode: bool = True):
    shipped = spark.sparkContext.broadcast(_shipped(read_ranks(path)))  # a vocabulary file: under a megabyte, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, split = _unshipped(shipped.value), regex.compile(pattern)
        try:
            for b in pieces(batches, "text", 1 << 20):
                n, ids, decoded = [], [], []
                for own in merges.encode(b.column(1).to_pylist(), split):
                    n.append(len(own) // 4)
                    back = merges.decode(own) if decode else b""
                    ids.append(hashlib.sha256(own).hexdigest() if digests else np.frombuffer(own, "<i4"))
                    decoded.append(hashlib.sha256(back).hexdigest() if digests else back.decode("utf-8", "replace") if decode else None)
                kind = pa.string() if digests else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids", "decoded"])
        finally:
            merges.known.clear()  # the worker outlives the task
            release_memory()

    return run


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """id, n_tokens, ids (array<int>), decoded (text; null unless decode)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_encoded(docs.sparkSession, path, pattern, False, decode), f"id {kind}, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, of the same ids and decoded bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(_encoded(docs.sparkSession, path, pattern, True), f"id {kind}, n_tokens long, ids string, decoded string")
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_digests(docs, public_tokenizers.path(VOCABULARY)).withColumnRenamed("id", "doc_id")
