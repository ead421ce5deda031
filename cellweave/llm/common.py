"""Helpers that the training-data operators share.

Every operator takes a DataFrame and column names, selects only the columns it
needs at once (so extra columns with clashing names cannot interfere), and works
on null texts as on empty ones.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.tables import shared_folder

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: White space of the text contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"

#: Rows up to which a key table may be broadcast; larger ones take the shuffled way.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def _path(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder, which outlives lost executors.

    A join with the reread table also has a plain exchange on that side, so that
    adaptive execution can split its hot keys, which it can't beneath an aggregate.
    The table goes by `discard` or, as results are read lazily, when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cellweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found, files = _path(spark, path)
    files.deleteOnExit(found)
    out = spark.read.schema(df.schema).parquet(path)
    out._cellweave_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `materialise` returned and nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "_cellweave_path", None)) is not None:
            found, files = _path(df.sparkSession, path)
            files.delete(found, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores appended as keep it from clashing with the columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def place_among(df: DataFrame, rank: Column, bounds: Column, count: int, out: str) -> DataFrame:
    """df with how many of `count` rising bounds, a literal array, are below its rank: found by halving, a projection for each halving."""
    df = df.withColumn(out, F.lit(0))
    half = (1 << count.bit_length()) >> 1
    while half:
        at = F.col(out) + half
        df = df.withColumn(out, F.col(out) + F.when((at <= count) & (rank > F.element_at(bounds, F.least(at, F.lit(count)))), F.lit(half)).otherwise(F.lit(0)))
        half >>= 1
    return df


def with_range(df: DataFrame, column: str, ranges: int, out: str) -> DataFrame:
    """df with the number of the range, below `ranges`, that a long column falls into; ranges have about as many rows each.

    Their bounds are approximate quantiles, which travel to the driver.
    """
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 20 * ranges))).first()[0] if shares else None
    bounds = sorted(set(found or []))
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded into one literal
    return place_among(df, F.col(column), listed, len(bounds), out)


def small_batches(spark: SparkSession) -> None:
    """From now on in this session batches sent to Python hold about a megabyte; with whole texts or sets in them, those of 10,000 rows take tens, in the JVM and again in the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def release_memory() -> None:
    """Gives memory that was freed back to the system; Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that many bytes of text (one row at least)."""
    try:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                rows = batch.num_rows - start
                size = batch.column(batch.schema.get_field_index(column)).slice(start, rows).nbytes
                step = rows if size <= most else max(1, min(rows, int(rows * most / size)))
                yield batch.slice(start, step)
                start += step
    finally:
        release_memory()


def held_out(id_column: str, by: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % by == remainder, F.lit(False))
