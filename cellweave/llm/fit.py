"""What the trained operators share: bounded samples of labelled rows and logistic calibration.

Only labels are sampled, and only to fit; a fitted model is applied to all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import held_out, text_of


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, by: int, remainder: int, rows_per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """id, label, half, text of at most rows_per_class training rows of each class, and how many each class has in all.

    Rows are taken in the order of a hash of their id, so the sample is the same on every run.
    Those whose hash is far above what the sample needs are left out in the scan, so that
    no more than a few times its size is ever sorted. Rows whose crc32 leaves the
    remainder, and rows without an id or label, are never taken.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id", by, remainder))
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 53))
    picked = None
    for k in (0, 1):
        part = usable.where(F.col("label") == k).withColumn("place", place)
        share = 2 * rows_per_class / max(1, totals.get(k, 0))
        if share < 1:
            part = part.where(F.col("place") < int(share * (1 << 53)))
        part = part.orderBy("place", "id").limit(rows_per_class).drop("place")
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int"))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # the sample's size has a bound: 2 * rows_per_class rows of three numbers
    return texts.join(F.broadcast(picked), "id").select("id", "label", "half", "text"), totals


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> dict:
    """Ridge logistic regression by Newton's method over standardised columns; x has no constant column."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, keep = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + keep
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "beta": beta}


def constant(rate: float, columns: int) -> dict:
    """The model of a label that can't be learned: always its rate."""
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    return {"mean": np.zeros(columns), "scale": np.ones(columns), "beta": np.array([np.log(rate / (1 - rate)), *[0.0] * columns])}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    z = (x - model["mean"]) / model["scale"]
    return 1 / (1 + np.exp(-np.clip(model["beta"][0] + z @ model["beta"][1:], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, totals: dict[int, int]) -> dict:
    """Logistic calibration in which each class has the weight of all its rows, not of those sampled."""
    seen = {k: int((y == k).sum()) for k in (0, 1)}
    if not seen[0] or not seen[1]:
        everything = sum(totals.values())
        return constant(totals.get(1, 0) / everything if everything else 0.5, x.shape[1])
    each = {k: totals[k] / seen[k] for k in (0, 1)}
    weight = np.where(y == 1, each[1], each[0])
    return logistic(x, y, weight * (len(y) / weight.sum()))


def scored(df: DataFrame, by: int, remainder: int) -> DataFrame:
    """The contract's columns of rows id, score."""
    prediction: Column = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return df.select(F.col("id").alias("doc_id"), held_out("id", by, remainder).alias("held_out"), "score", prediction.cast("int").alias("predicted"))
