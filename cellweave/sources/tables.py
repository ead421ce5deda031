"""Rasters as bucketed tables: aligned rasters of the same buckets join without a shuffle. The shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a session in one process, as in tests, gets one of its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    own = tempfile.mkdtemp(prefix="cellweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextlib.contextmanager
def stored(df: DataFrame, records: int = 0) -> Iterator[DataFrame]:
    """The rows that all tasks have written at once to a table in the shared folder, for a driver that then takes them one by one. The table goes at the end."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/cellweave-{uuid.uuid4().hex}"
    try:
        df.write.option("maxRecordsPerFile", records).option("compression", "none").parquet(place)
        yield spark.read.schema(df.schema).parquet(place)
    finally:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def save_raster(pixels: DataFrame, name: str, buckets: int, keys: Sequence[str] = ("row", "col"), mode: str = "errorifexists") -> None:
    """A table bucketed and sorted by the keys that aligned rasters are joined on."""
    pixels.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def load_raster(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
