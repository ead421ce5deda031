"""Raster operators over streams of pixels or tiles.

Pointwise operators need no state: they are applied to a stream as to a table.
Operators that need a whole raster run over each micro-batch, of which a file source
with one raster per file makes complete rasters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_pixels(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_pointwise(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream to a Parquet folder, exactly once; with `once` it stops when what there is has been read."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def write_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies an operator to each micro-batch; a batch that is run again replaces its own output."""

    def one(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def changed_tiles(stream: DataFrame, time: str, size: int = 256, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """tile_row, tile_col, window, pixels: which tiles got new pixels in each window; pixels later than `late` are left out."""
    tile = [F.expr(f"cast({a} div {size} as int)").alias(f"tile_{a}") for a in ("row", "col")]
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *tile).agg(F.count("*").alias("pixels"))
