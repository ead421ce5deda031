"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams of one to three code points, hashed
to BUCKETS, with logarithmic term counts and unit length. Weights are trained with
follow-the-regularised-leader (proximal) under L1 and L2 penalties; a temperature
fitted on rows that did not train them calibrates the probabilities.

Every `lang` value of a training row is learned. Where there are so many that BUCKETS
weights of each would pass MODEL_CELLS, the n-grams are hashed to fewer buckets instead.
Fitting uses about SAMPLE_ROWS rows, dealt evenly to the languages and taken by a hash of
their id, at least one of each; fewer if they have more than SAMPLE_FEATURES features in
all. Every row's whole text is predicted.

Defined results: a null text, an empty one and one without a letter are `und` with
score 0. Without any training row all texts are `und`. A row with a null id has
held_out false and never trains. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import discard, held_out, materialise, pieces, table, text_of

FOLD = (5, 0)
SAMPLE_ROWS, SAMPLE_FEATURES = 3000, 20_000_000
BUCKETS, MODEL_CELLS = 1 << 15, 1 << 24
ORDERS = (1, 2, 3)
#: Code points worked on at once.
STRETCH = 1 << 20
#: Learning rate's numerator and offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
EPOCHS = 3
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Of each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def buckets_for(languages: int) -> int:
    """A power of two."""
    return 1 << max(8, min(BUCKETS.bit_length(), (MODEL_CELLS // max(languages, 1)).bit_length()) - 1)


def counts(text: str, buckets: int = BUCKETS, stretch: int = STRETCH) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None without a letter. All that is no letter counts as a space, runs of it as one; a space stands before and after the text."""
    known, total, any_letter = _letters(), np.zeros(buckets, "i8"), False
    text = text.lower()
    carry, space = np.zeros(0, "u8"), True  # the code points that n-grams of the next stretch begin in, and whether the last code point was no letter
    shift = np.uint64(65 - buckets.bit_length())
    for at in range(0, len(text) or 1, stretch):
        c = np.frombuffer(text[at : at + stretch].encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = known[c]
        any_letter = any_letter or bool(is_letter.any())
        keep = is_letter | ~np.append(space, ~is_letter[:-1]) if len(c) else is_letter
        new = np.where(is_letter, c, 32).astype("u8")[keep]
        if len(c):
            space = not is_letter[-1]
        if not at:
            new = np.append(np.uint64(32), new)
        if at + stretch >= len(text) and not space:
            new = np.append(new, np.uint64(32))
        code = np.concatenate((carry, new))
        first = len(carry)  # n-grams that end before it are counted already
        for n in ORDERS:
            begin = max(0, first - n + 1)
            x = code[begin : len(code) - n + 1] if len(code) - n + 1 > begin else code[:0]
            for k in range(1, n):
                x = x * np.uint64(1_000_003) + code[begin + k : begin + k + len(x)]
            total += np.bincount(((x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> shift).astype("i8"), minlength=buckets)
        carry = code[len(code) - min(len(code), max(ORDERS) - 1) :]
    return total if any_letter else None


def vector(total: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF weights, of unit length."""
    at = np.flatnonzero(total)
    value = np.log1p(total[at]) * idf[at]
    return at, value / (np.sqrt(value @ value) or 1.0)


def _featured(buckets: int):
    """lang, part, draw, text to lang, part, draw, at, n: buckets and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            langs, parts, draws, texts = (b.column(i).to_pylist() for i in range(4))
            rows = [(lang, part, draw, at, c[at]) for lang, part, draw, t in zip(langs, parts, draws, texts, strict=True) if (c := counts(t, buckets)) is not None for at in [np.flatnonzero(c)]]
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["lang", "part", "draw", "at", "n"])

    return run


class _Vectors(Sequence):
    """Rows buckets, values, class, whose values are computed each time: the driver holds the counts only."""

    def __init__(self, ats: list[np.ndarray], ns: list[np.ndarray], classes: list[int], idf: np.ndarray):
        self.ats, self.ns, self.classes, self.idf = ats, ns, classes, idf

    def __len__(self) -> int:
        return len(self.ats)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        at = self.ats[i].astype("i8")
        value = np.log1p(self.ns[i]) * self.idf[at]
        return at, value / np.sqrt(value @ value), self.classes[i]


def follow_the_regularised_leader(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (buckets + 1, classes) of rows (buckets, values, class); the last is the constant's."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    random = np.random.default_rng(7)

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, value, y = rows[i]
            at, value = np.append(at, buckets), np.append(value, 1.0)
            w = weights(at)
            logits = value @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(value, p)
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = n_new
    return weights(np.arange(buckets + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """That of the least log loss, by a search over a logarithmic grid."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    grid = np.geomspace(0.05, 20, 121)
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def train(docs: DataFrame, fold: tuple[int, int] = FOLD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict:
    """languages, idf, weights, temperature."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text_of(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id", *fold))
    drawn = F.pmod(F.xxhash64(F.lit("lang"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    usable = usable.withColumn("drawn", drawn)
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("drawn").alias("least")).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return {"languages": [], "idf": None, "weights": None, "temperature": 1.0}
    buckets = buckets_for(len(languages))
    each = max(8, sample_rows // len(languages))
    shares = docs.sparkSession.createDataFrame([(r["lang"], max(r["least"], min(1.0, each / r["n"]))) for r in sizes], "lang string, share double")
    picked = usable.join(F.broadcast(shares), "lang").where("drawn <= share")  # shares: a row for each language
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(5)).cast("int")
    draw = F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = materialise(picked.select("lang", part.alias("part"), draw.alias("draw"), "text").mapInArrow(_featured(buckets), "lang string, part int, draw double, at array<int>, n array<int>"))
    features = found.agg(F.sum(F.size("at"))).first()[0] or 0
    rows = found.where(F.col("draw") < SAMPLE_FEATURES / max(features, 1)).drop("draw").toArrow()
    discard(found)
    langs, parts = (rows.column(c).to_pylist() for c in ("lang", "part"))
    ats, ns = ([x.values.to_numpy() for x in rows.column(c)] for c in ("at", "n"))
    if not langs:
        return {"languages": [], "idf": None, "weights": None, "temperature": 1.0}
    order = np.lexsort(([int(n.sum()) for n in ns], [int((a.astype("i8") * n).sum()) for a, n in zip(ats, ns, strict=True)], langs))  # whatever order tasks end in
    seen = np.zeros(buckets, "i8")
    for at in ats:  # a row's buckets are distinct
        seen[at] += 1
    idf = np.log((1 + len(langs)) / (1 + seen)) + 1
    number = {lang: i for i, lang in enumerate(languages)}

    def vectors(picked: list[int]) -> _Vectors:
        return _Vectors([ats[i] for i in picked], [ns[i] for i in picked], [number[langs[i]] for i in picked], idf)

    weights = follow_the_regularised_leader(vectors([i for i in order if parts[i]] or list(order)), len(languages), buckets)
    rest = vectors([i for i in order if not parts[i]])
    logits = np.array([value @ weights[at] + weights[buckets] for at, value, _ in rest]).reshape(len(rest), len(languages))
    return {"languages": languages, "idf": idf, "weights": weights.astype("f4"), "temperature": temperature(logits, np.array([y for *_, y in rest], int))}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    languages, idf, weights, heat = model["languages"], model["idf"], model["weights"], model["temperature"]

    def one(text: str) -> tuple[str, float]:
        total = counts(text, len(weights) - 1) if languages else None
        if total is None:
            return UNKNOWN, 0.0
        at, value = vector(total, idf)
        logits = (value @ weights[at] + weights[-1]) / heat
        p = np.exp(logits - logits.max())
        k = int(np.argmax(p))
        return languages[k], float(p[k] / p.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = [one(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select(F.col("id").alias("doc_id"), held_out("id", *FOLD).alias("held_out"), "lang_pred", "score")
