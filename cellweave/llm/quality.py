"""Quality classifier by compression against two zstandard dictionaries.

One dictionary is built from pieces of good labelled text, one from bad. A text is
compressed in blocks of BLOCK bytes with each of them; the normalised difference of
the two sizes, with the ratio of the smaller one to the text's own size and its
length, goes through a logistic calibration fitted on labelled rows that gave no
piece to a dictionary.

Fitting uses at most SAMPLE_ROWS training rows a class and PIECES pieces a class;
every row's whole text is scored.

Defined results: a null text is scored as an empty one. Without rows of both classes
every score is the rate of label 1 (0.5 without any label). A row with a null id has
held_out false. Rows that repeat an id are each scored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import fit
from cellweave.llm.common import pieces, table, text_of

FOLD = (3, 1)
SAMPLE_ROWS = 4000
PIECES = 3000
PIECE = 1024
DICTIONARY = 1 << 16
BLOCK = 8192
LEVEL = 3
FEATURES = 6


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, text -> the text's pieces."""
    for b in pieces(batches, "text"):
        ids, labels, texts = (b.column(i).to_pylist() for i in range(3))
        rows = [(i, label, k, data[k : k + PIECE]) for i, label, t in zip(ids, labels, texts, strict=True) for data in [t.encode("utf-8", "surrogatepass")] for k in range(0, len(data), PIECE)]
        rows = [r for r in rows if len(r[3]) >= 32]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["id", "label", "at", "piece"])


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of samples too few to train on, their own content."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO
    made = zstandard.ZstdCompressionDict(data, dict_type=kind)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False)


def _size(compressor: zstandard.ZstdCompressor, data: bytes) -> int:
    return sum(len(compressor.compress(data[i : i + BLOCK])) for i in range(0, len(data) or 1, BLOCK))


def features(sizes: np.ndarray) -> np.ndarray:
    """Of rows good size, bad size, own size."""
    good, bad, own = sizes.T.astype("f8")
    difference = (bad - good) / np.maximum(np.maximum(good, bad), 1)
    ratio = np.log((np.minimum(good, bad) + 20) / (own + 20))
    length = np.log1p(own)
    return np.column_stack([difference, ratio, ratio**2, length, difference * length, ratio * length])


def _measured(good: bytes, bad: bytes):
    """Rows id, text to rows id, good, bad, own (sizes in bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = [_compressor(good), _compressor(bad)]
        for b in pieces(batches, "text"):
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            sizes = [pa.array([_size(c, t) for t in texts], pa.int64()) for c in pair]
            yield pa.RecordBatch.from_arrays([b.column(0), *sizes, pa.array(map(len, texts), pa.int64())], names=["id", "good", "bad", "own"])

    return run


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict:
    """good, bad: dictionaries (None if a class has no text); calibration."""
    sample, totals = fit.labelled_texts(docs, labels, label, *fold, sample_rows, id_col, text_col)
    kind = sample.schema["id"].dataType.simpleString()
    cut = sample.where("half = 0").select("id", "label", "text").mapInArrow(_cut, f"id {kind}, label int, at long, piece binary")
    order = [F.xxhash64("id", "at"), "id", "at"]
    kept = [[bytes(r["piece"]) for r in cut.where(F.col("label") == k).orderBy(*order).limit(PIECES).select("piece").collect()] for k in (1, 0)]
    if not all(kept):
        everything = sum(totals.values())
        return {"good": None, "bad": None, "calibration": fit.constant(totals.get(1, 0) / everything if everything else 0.5, FEATURES)}
    good, bad = map(_dictionary, kept)
    rest = sample.where("half = 1").select(F.col("label").cast("long").alias("id"), "text").mapInArrow(_measured(good, bad), "id long, good long, bad long, own long").toPandas()
    x, y = features(rest[["good", "bad", "own"]].to_numpy()), rest["id"].to_numpy()
    return {"good": good, "bad": bad, "calibration": fit.calibrate(x, y, totals)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, good_size, bad_size, n_bytes of every row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    calibration = model["calibration"]
    measure = _measured(model["good"] or b"", model["bad"] or b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in measure(batches):
            sizes = np.column_stack([b.column(i).to_numpy() for i in (1, 2, 3)])
            p = fit.probability(calibration, features(sizes)) if len(sizes) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), *b.columns[1:]], names=["id", "score", "good_size", "bad_size", "n_bytes"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, good_size long, bad_size long, n_bytes long")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit.scored(score(docs, train(docs, labels)), *FOLD)
