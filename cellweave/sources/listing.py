"""What Spark's own file sources leave out of a listing."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import SparkSession


def empty_files(spark: SparkSession, path: str) -> list[tuple[str, str, datetime]]:
    """Path, name and time of the files without a byte, which Spark's sources skip, of a file, a folder or a pattern."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for found in files.globStatus(pattern) or []:
        for one in files.listStatus(found.getPath()) if found.isDirectory() else [found]:
            name = one.getPath().getName()
            if one.isFile() and not one.getLen() and name[0] not in "._":
                out.append((one.getPath().toString(), name, datetime.fromtimestamp(one.getModificationTime() / 1000, timezone.utc)))
    return out
