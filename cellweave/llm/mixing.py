"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the output over its share of the
input, in code points. Each document draws its number of copies by inverting the
Poisson distribution of that mean at a uniform number that a hash of (seed, id)
gives, so the draw needs no state, is the same on every retry and is spread alike
over a hot source. Copies are exploded and dealt out by a hash of (seed, id, copy):
a global shuffle without a sampling pass.

Rates above DIRECT_RATE, where exp(-rate) nears the smallest double, are inverted too: the
distribution function then begins WIDE standard deviations below the rate, at a term
taken from logarithms. A source may have any rate; only an output_share above DIRECT_RATE,
which asks for the whole corpus that often, is refused.

Defined results: a null source is a source of its own. A source without any code
point has rate 1. A null id hashes as an empty string. Rows that repeat an id draw
the same number. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import fresh, materialise, partitions, table, text_of

SEED = 42
#: Default target weights grow as a source's size to this power.
POWER = 0.5
#: Above this mean exp(-rate) is close to the smallest double.
DIRECT_RATE = 500.0
#: Standard deviations on either side of a large mean beyond which there is less than a uniform number of 48 bits can tell.
WIDE = 12
#: Sources, and terms of their distribution functions, up to which these are broadcast.
BROADCAST_SOURCES, BROADCAST_TERMS = 2_000, 1_000_000


def _bits(text: Column, hex_digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, hex_digits), 16, 10).cast("long")


def distribution(rate: float) -> tuple[int, np.ndarray]:
    """The first k that counts and the distribution function from there on, for a large mean."""
    spread = WIDE * math.sqrt(rate) + 40
    low = max(1, int(rate - spread))
    k = np.arange(low + 1, int(rate + spread) + 1)
    # the logarithm of rate^low exp(-rate) / low!, with Stirling's series
    first = low * math.log1p((rate - low) / low) - (rate - low) - 0.5 * math.log(2 * math.pi * low) - 1 / (12 * low) + 1 / (360 * low**3)
    cdf = np.cumsum(np.exp(first + np.concatenate(([0.0], np.cumsum(np.log(rate / k))))))
    return low, cdf / cdf[-1]


def _distributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, rate to src, rate, low, cdf."""
    for b in batches:
        for i, rate in enumerate(b.column(1).to_pylist()):
            low, cdf = distribution(rate)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([low], pa.int32()), pa.array([cdf], pa.list_(pa.float64()))], names=["src", "rate", "low", "cdf"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, output_share: float = 1.0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """src, rate, low, cdf: the terms of the distribution function from low on, until it no longer grows."""
    if output_share > DIRECT_RATE:
        raise ValueError(f"the corpus would be repeated {output_share:.0f} times; output shares above {DIRECT_RATE:.0f} are not supported")
    sizes = materialise(docs.groupBy(F.col(source_col).alias("src")).agg(F.sum(F.char_length(text_of(text_col))).alias("chars")))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(POWER))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("src").eqNullSafe(F.lit(name).cast("string")), F.lit(float(w))).otherwise(weight)
    total = sizes.agg(F.sum(weight).alias("w"), F.sum("chars").alias("c")).first()
    w, c = total["w"] or 1.0, float(total["c"] or 0)
    rated = materialise(sizes.select("src", F.when(F.col("chars") > 0, weight / F.lit(w) * F.lit(c * output_share) / F.col("chars")).otherwise(F.lit(1.0)).alias("rate")))
    tops = rated.groupBy((F.col("rate") > DIRECT_RATE).alias("large")).agg(F.max("rate").alias("top")).collect()
    top = max((r["top"] for r in tops if not r["large"]), default=0.0)
    terms = int(top + 12 * top**0.5 + 40)
    # p(k) = p(k-1) * rate / k; the distribution function is the running sum
    start = F.struct(F.exp(-F.col("rate")).alias("p"), F.array(F.exp(-F.col("rate"))).alias("cdf"))
    step = lambda a, k: F.struct((a["p"] * F.col("rate") / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("rate") / k)).alias("cdf"))
    direct = rated.where(F.col("rate") <= DIRECT_RATE).withColumn("low", F.lit(0)).withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda a: a["cdf"]))
    if not any(r["large"] for r in tops):
        return direct
    kind = rated.schema["src"].dataType.simpleString()
    return direct.unionByName(rated.where(F.col("rate") > DIRECT_RATE).mapInArrow(_distributions, f"src {kind}, rate double, low int, cdf array<double>"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, output_share: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of docs, once for each copy, and mix_copy (from 1), mix_rate, mix_key (with underscores appended if docs has such a column); globally shuffled by mix_key."""
    spark = docs.sparkSession
    src, low, cdf, n, copy, rate, key = fresh(docs, "mix_src", "mix_low", "mix_cdf", "mix_n", "mix_copy", "mix_rate", "mix_key")
    by_source = materialise(rates(docs, weights, output_share, text_col, source_col))
    size = by_source.agg(F.count("*").alias("sources"), F.sum(F.size("cdf")).alias("terms")).first()
    if size["sources"] <= BROADCAST_SOURCES and (size["terms"] or 0) <= BROADCAST_TERMS:  # beyond that Spark chooses the join
        by_source = F.broadcast(by_source)
    by_source = by_source.withColumnsRenamed({"src": src, "rate": rate, "low": low, "cdf": cdf})
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = _bits(F.concat(F.lit(f"{seed}:"), ident), 12) / F.lit(float(1 << 48))
    return (
        docs.join(by_source, F.col(source_col).eqNullSafe(F.col(src)))
        .withColumn(n, F.col(low) + F.size(F.filter(cdf, lambda c: c <= drawn)))
        .where(F.col(n) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
        .withColumn(key, _bits(F.concat(F.lit(f"{seed}:"), ident, F.lit(":"), F.col(copy).cast("string")), 15))
        .drop(src, low, cdf, n)
        .repartition(partitions(spark), key)
        .sortWithinPartitions(key)
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("mix_copy").alias("copy"), F.round("mix_rate", 6).alias("rate"), F.col("mix_key").alias("shuffle_key"), "text")


#: For rates of up to 700, at which exp(-rate) is still a number of full precision.
SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source AS src, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY source
), totals AS (
  SELECT sum(pow(chars::DOUBLE, {POWER})) AS w, sum(chars)::DOUBLE AS c FROM sizes
), rated AS (
  SELECT src, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, {POWER}) / w * c / chars ELSE 1.0 END AS rate FROM sizes, totals
), dist AS (
  SELECT src, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rated
  UNION ALL
  SELECT src, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM dist WHERE k < rate + 12 * sqrt(rate) + 40
), drawn AS (
  SELECT row_number() OVER () AS place, doc_id, source, text, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 AS u FROM documents
), counted AS (
  SELECT doc_id, source, text, max(rate) AS rate, count(*) FILTER (WHERE cdf <= u) AS n
  FROM drawn JOIN dist ON source IS NOT DISTINCT FROM src GROUP BY place, doc_id, source, text
), copies AS (
  SELECT doc_id, source, text, rate, unnest(generate_series(1, n))::INTEGER AS copy FROM counted WHERE n > 0
)
SELECT doc_id, source, copy, round(rate, 6) AS rate,
       ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key, text
FROM copies
"""
