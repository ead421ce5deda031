"""Document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs (lines) are cut into cells of words: a cell ends after a word whose
hash is a multiple of EVERY, and with the paragraph, so that an inserted word changes its
own cell only. Each cell's digest, with its number among equal ones, is a key of the text;
so is each paragraph's digest, for a second sketch. A sketch adds every key to one slot of
each of three rows: a count, the sum of keys and the sum of their check values. Two
sketches subtract slot by slot, whereby shared keys vanish; peeling slots that hold a
single key recovers what differs.

The fingerprint is both sketches as base64. Their sizes are powers of two that grow with
the text: the one of paragraphs has room for all of them to differ, the one of cells for
about a half. A sketch folds to any smaller size, so `differing` and `likeness_of` begin
with the smallest, retry twice as large on failure, up to what is stored, and compare
texts of any two lengths. Beyond that the texts decide: `likeness` sketches them GROWTH
times larger and with other hashes until they peel. The likeness of two texts is the
share of common cells among all of theirs.

For the next document, rows are dealt to ranges of the id, whose bounds are approximate
quantiles, and each range is streamed in order; the first row of a range is also sent
to the end of the one before. Nothing but that is written before the result.

Defined results: a null text is an empty one, which has one empty cell. The document
after the last is the first; a single document is its own next. A null id ranks
first; rows that repeat an id are in order of their text. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import partitions, pieces, table, text_of, with_range

#: One word in so many ends a cell; longer runs without a space are cut into pieces.
EVERY, LONGEST, PIECE = 4, 32, 16
#: Slots in each of the three rows of the smallest sketch; how much larger the next one is; how often to retry.
SLOTS, GROWTH, RETRIES = 4, 4, 14
#: Keys for each slot that a stored sketch's row has at most, of paragraphs and of cells, and its least slots.
PARAGRAPHS_A_SLOT, CELLS_A_SLOT, LEAST_STORED = 1, 3, 8
NO_ID = -(1 << 63)

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_LOW64 = (1 << 64) - 1


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """SplitMix64's finaliser of salted values."""
    x = x + np.uint64(_STEP * (2 * salt + 1) & _LOW64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class TokenHashes(dict):
    """Hashes of words, kept up to a bound."""

    MOST = 200_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[token] = found = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return found


_known = TokenHashes()
_END = xxhash.xxh3_64_intdigest(b"\n")


def tokens(text: str) -> list[str]:
    """Words between single spaces, empty ones included; the end of a paragraph is one of its own."""
    out = text.replace("\n", " \n ").split(" ")
    if max(map(len, out)) > LONGEST:
        out = [x for t in out for x in ([t] if len(t) <= LONGEST else [t[i : i + PIECE] for i in range(0, len(t), PIECE)])]
    return out


def _numbered(hashes: np.ndarray, begins: np.ndarray, ends_cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of stretches of tokens that end where ends_cell is true and with their text, and where each text's keys begin."""
    first = np.append(True, ends_cell[:-1])
    first[begins[:-1]] = True
    starts = np.flatnonzero(first)
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    key = np.add.reduceat(_mix(hashes + place.astype("u8") * _M2, 3), starts)
    at = np.searchsorted(starts, begins)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(at))
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
    runs = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(runs, np.diff(np.append(runs, len(key))))
    return _mix(key + nth.astype("u8") * _M1, 99), at


Keys = tuple[np.ndarray, np.ndarray]


def keys_of(texts: list[str]) -> tuple[Keys, Keys]:
    """Of the cells and of the paragraphs of all texts in a row: keys, and where each text's begin (one more entry than texts)."""
    if not texts:
        nothing = np.zeros(0, "u8"), np.zeros(1, "i8")
        return nothing, nothing
    split = [tokens(t) for t in texts]
    hashes = np.concatenate([np.fromiter(map(_known.__getitem__, ts), "u8", len(ts)) for ts in split])
    begins = np.concatenate(([0], np.cumsum([len(ts) for ts in split])))
    line = hashes == np.uint64(_END)
    return _numbered(hashes, begins, line | (hashes % np.uint64(EVERY) == 0)), _numbered(hashes, begins, line)


class Sketches:
    """Of several texts or pairs: 3 * slots[i] cells each, one after the other."""

    def __init__(self, slots: np.ndarray, level: int):
        self.level, self.slots = level, slots
        self.offset = np.concatenate(([0], np.cumsum(3 * slots)))
        n = int(self.offset[-1])
        self.count, self.keys, self.checks = np.zeros(n, "i8"), np.zeros(n, "u8"), np.zeros(n, "u8")

    def cells(self, key: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Each key's slots, shape (3, keys)."""
        slots = self.slots[owner]
        return np.stack([self.offset[owner] + row * slots + (_mix(key, 10 + 3 * self.level + row) % slots.astype("u8")).astype("i8") for row in range(3)])

    def add(self, key: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        at = self.cells(key, owner)
        sign = np.broadcast_to(np.asarray(sign, "i8"), key.shape)
        factor = sign.astype("u8")  # -1 wraps
        signed_key, signed_check = key * factor, _mix(key, 5) * factor
        for row in at:
            np.add.at(self.count, row, sign)
            np.add.at(self.keys, row, signed_key)
            np.add.at(self.checks, row, signed_check)
        return at

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair whether it was peeled whole, and how many keys only the first and only the second has."""
        n = len(self.slots)
        only_first, only_second = np.zeros(n, "i8"), np.zeros(n, "i8")
        look = np.arange(len(self.count))
        while len(look):
            look = look[np.abs(self.count[look]) == 1]
            factor = self.count[look].astype("u8")
            key = self.keys[look] * factor
            pure = _mix(key, 5) * factor == self.checks[look]
            look, key = look[pure], key[pure]
            if not len(look):
                break
            owner = np.searchsorted(self.offset, look, "right") - 1
            order = np.lexsort((key, owner))
            look, key, owner = look[order], key[order], owner[order]
            first = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
            look, key, owner = look[first], key[first], owner[first]
            sign = self.count[look]
            np.add.at(only_first, owner[sign > 0], 1)
            np.add.at(only_second, owner[sign < 0], 1)
            look = np.unique(self.add(key, owner, -sign))
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        whole = ~np.logical_or.reduceat(left, self.offset[:-1]) if n else np.zeros(0, bool)
        return whole, only_first, only_second


def _taken(key: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of some of the texts, and the place in `which` that each belongs to."""
    sizes = at[which + 1] - at[which]
    index = np.repeat(at[which] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    return key[index], np.repeat(np.arange(len(which)), sizes)


def likeness(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs (text a[i] of first, text b[i] of second), by subtraction, peeling and larger retries."""
    out = np.ones(len(a))
    todo = np.arange(len(a))
    n_a, n_b = (at[w + 1] - at[w] for (_, at), w in ((first, a), (second, b)))
    for level in range(RETRIES):
        if not len(todo):
            return out
        # a sketch more than four times as large as both sets won't help; other hashes will
        slots = np.minimum(SLOTS * GROWTH**level, np.maximum(SLOTS, 4 * (n_a[todo] + n_b[todo]) // 3 + 8))
        pair = Sketches(slots, level)
        pair.add(*_taken(*first, a[todo]), 1)
        pair.add(*_taken(*second, b[todo]), -1)
        whole, only_a, only_b = pair.peel()
        done = todo[whole]
        out[done] = (n_a[done] - only_a[whole]) / np.maximum(n_a[done] + only_b[whole], 1)
        todo = todo[~whole]
    for i in todo:  # never seen: exact sets
        x, y = (set(k[at[w] : at[w + 1]].tolist()) for (k, at), w in ((first, a[i]), (second, b[i])))
        out[i] = len(x & y) / max(1, len(x | y))
    return out


#: What is stored of a slot, of paragraphs and of cells, whose keys are shortened.
_PARAGRAPH_SLOT = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
_CELL_SLOT = np.dtype([("count", "<i2"), ("key", "<u4"), ("check", "<u2")])


def _mask(kind: np.dtype, field: str) -> int:
    return (1 << 8 * kind[field].itemsize) - 1


def _stored(keys: Keys, per_slot: int, kind: np.dtype) -> tuple[np.ndarray, list[bytes]]:
    """Each text's sketch: the logarithm of its slots, and its slots. Sums are kept modulo the size of their fields."""
    key, at = keys
    key = key & np.uint64(_mask(kind, "key"))
    n = np.diff(at)
    power = np.ceil(np.log2(np.maximum(n / per_slot, LEAST_STORED))).astype("i8")
    s = Sketches(1 << power, 0)
    s.add(key, np.repeat(np.arange(len(n)), n), 1)
    packed = np.zeros(len(s.count), kind)
    for field, sums in (("count", s.count), ("key", s.keys), ("check", s.checks)):
        packed[field] = sums.astype(kind[field])
    return power, [packed[i:j].tobytes() for i, j in zip(s.offset[:-1].tolist(), s.offset[1:].tolist(), strict=True)]


def fingerprints_of(cells: Keys, paragraphs: Keys) -> list[bytes]:
    """The logarithms of both sizes, the paragraphs' sketch and the cells'."""
    if len(cells[1]) < 2:
        return []
    (p, of_paragraphs), (c, of_cells) = _stored(paragraphs, PARAGRAPHS_A_SLOT, _PARAGRAPH_SLOT), _stored(cells, CELLS_A_SLOT, _CELL_SLOT)
    return [bytes((i, j)) + x + y for i, j, x, y in zip(p.tolist(), c.tolist(), of_paragraphs, of_cells, strict=True)]


def _parts(fingerprint: str | bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of paragraphs and of cells, three rows each."""
    data = base64.b64decode(fingerprint) if isinstance(fingerprint, str) else fingerprint
    size = (3 << data[0]) * _PARAGRAPH_SLOT.itemsize
    return np.frombuffer(data[2 : 2 + size], _PARAGRAPH_SLOT).reshape(3, -1), np.frombuffer(data[2 + size :], _CELL_SLOT).reshape(3, -1)


def _folded(sketch: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums of keys and of checks of the same sketch with fewer slots."""
    return tuple(sketch[field].astype(wide).reshape(3, -1, slots).sum(axis=1, dtype=wide).ravel() for field, wide in (("count", "i8"), ("key", "u8"), ("check", "u8")))  # type: ignore[return-value]


def _peeled(first: np.ndarray, second: np.ndarray, slots: int) -> tuple[list[int], list[int]] | None:
    """Keys of the first sketch only and of the second only; None if they are too many for that many slots."""
    low, short = (_mask(first.dtype, field) for field in ("key", "check"))
    (count, keys, checks), (c, k, x) = _folded(first, slots), _folded(second, slots)
    count, keys, checks = (count - c).tolist(), ((keys - k) & np.uint64(low)).tolist(), ((checks - x) & np.uint64(short)).tolist()
    sketch, found = Sketches(np.array([slots]), 0), ([], [])
    look = list(range(3 * slots))
    while look:
        i = look.pop()
        sign = count[i]
        if abs(sign) != 1:
            continue
        key = np.array([keys[i] * sign & low], "u8")
        check = int(_mix(key, 5)[0])
        if check * sign & short != checks[i]:
            continue
        found[sign < 0].append(int(key[0]))
        for at in sketch.cells(key, np.zeros(1, "i8"))[:, 0].tolist():
            count[at] -= sign
            keys[at] = keys[at] - sign * int(key[0]) & low
            checks[at] = checks[at] - sign * check & short
            look.append(at)
    return None if any(count) or any(keys) or any(checks) else found


def _difference(first: np.ndarray, second: np.ndarray) -> tuple[list[int], list[int]] | None:
    """By the smallest folded sketches that peel."""
    slots, most = SLOTS, min(first.shape[1], second.shape[1])
    while slots <= most:
        if (found := _peeled(first, second, slots)) is not None:
            return found
        slots *= 2
    return None


def differing(first: str | bytes, second: str | bytes) -> tuple[list[int], list[int]] | None:
    """Digests of the paragraphs that only the first fingerprint's text has, and only the second's; None if they are more than is stored can tell."""
    return _difference(_parts(first)[0], _parts(second)[0])


def likeness_of(first: str | bytes, second: str | bytes) -> float | None:
    """The share of common cells by two fingerprints alone; None if too many differ."""
    a, b = _parts(first)[1], _parts(second)[1]
    if (found := _difference(a, b)) is None:
        return None
    common = int(a["count"].sum(dtype="i8")) // 3 - len(found[0])
    return common / max(1, common + len(found[0]) + len(found[1]))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(ids: list, texts: list[str], n: int) -> pa.RecordBatch:
    """The results of the first n texts, each with the one after it."""
    (own, paragraphs) = keys_of(texts)
    changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
    new, new_paragraphs = keys_of(changed)
    each = np.arange(n)
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    near = likeness(own, new, each, each), likeness(own, own, each, each + 1)
    cut = lambda keys: (keys[0][: keys[1][n]], keys[1][: n + 1])
    spelled = [[base64.b64encode(f).decode() for f in fingerprints_of(*k)] for k in ((cut(own), cut(paragraphs)), (new, new_paragraphs))]
    columns = [ids[:n], [len(t) for t in texts[:n]], sha, *spelled, *near]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows id, text in order: results of all but the last row, which is a copy of the next range's first."""
    held: tuple | None = None
    for b in pieces(batches, "text", 2 << 20):
        if not b.num_rows:
            continue
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        if held is not None:
            ids.insert(0, held[0])
            texts.insert(0, held[1])
        held = ids[-1], texts[-1]
        if len(ids) > 1:
            yield _compared(ids, texts, len(ids) - 1)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("rank", F.coalesce("id", F.lit(NO_ID).cast("long")))
    rows = with_range(rows, "rank", n, "part")
    # a row for each range, whatever the input
    firsts = sorted(map(tuple, rows.groupBy("part").agg(F.min("rank")).collect()))
    before = [(part, first, firsts[i - 1][0]) for i, (part, first) in enumerate(firsts)]
    known = F.broadcast(spark.createDataFrame(before, "head int, first long, part_before int"))
    heads = rows.join(known, (F.col("part") == F.col("head")) & (F.col("rank") == F.col("first"))).groupBy("part_before").agg(F.min("text").alias("text"))
    copies = heads.select(F.col("part_before").alias("part"), F.lit(1).alias("copy"), F.lit(None).cast("long").alias("id"), F.lit(NO_ID).cast("long").alias("rank"), "text")
    both = rows.select("part", F.lit(0).alias("copy"), "id", "rank", "text").unionByName(copies)
    in_order = both.repartitionById(n, "part").sortWithinPartitions("copy", "rank", "text")
    return in_order.select("id", "text").mapInArrow(_streamed, _RESULT)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
