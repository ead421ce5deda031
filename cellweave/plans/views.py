"""Raster views of the star-schema tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.geometric import Grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, v: one raster row per embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v")).withColumn("v", F.col("v").cast("double"))


PX = "px AS (SELECT vec_id::INTEGER AS row, (generate_subscripts(embedding, 1) - 1)::INTEGER AS col, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px with integer layers: code, m (mask), a1..a3 and c1..c3 (bands), and elev, precip, slope in doubles."""
    x = px(spark, sf_dir)
    byte = lambda scale, shift: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v") + shift) * scale).cast("int")))
    return x.withColumns(
        {
            "code": F.floor((F.col("v") + 1.0) * 40.0).cast("int"),
            "m": byte(512.0, 0.25),
            "a1": byte(256.0, 0.5),
            "a2": byte(200.0, 0.6),
            "a3": byte(300.0, 0.4),
            "c1": byte(-180.0, -0.7),
            "c2": byte(150.0, 0.8),
            "c3": byte(90.0, 0.9),
            "elev": (F.col("v") + 1.0) * 2000.0,
            "precip": (F.col("v") + 0.5) * 1200.0,
            "slope": F.abs(F.col("v")) * 150.0,
        }
    )


def _byte(scale: float, shift: float) -> str:
    return f"greatest(0, least(255, floor((v + ({shift})) * ({scale}))::INTEGER))"


LAYERS = f"""{PX}, layers AS (
  SELECT row, col, v, floor((v + 1.0) * 40.0)::INTEGER AS code, {_byte(512.0, 0.25)} AS m,
         {_byte(256.0, 0.5)} AS a1, {_byte(200.0, 0.6)} AS a2, {_byte(300.0, 0.4)} AS a3,
         {_byte(-180.0, -0.7)} AS c1, {_byte(150.0, 0.8)} AS c2, {_byte(90.0, 0.9)} AS c3,
         (v + 1.0) * 2000.0 AS elev, (v + 0.5) * 1200.0 AS precip, abs(v) * 150.0 AS slope
  FROM px)"""


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of lineitem: key columns, r, g, b, hill, and m."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"),
        (F.col("l_partkey") % 256).cast("int").alias("r"),
        (F.col("l_suppkey") % 256).cast("int").alias("g"),
        (F.col("l_orderkey") % 256).cast("int").alias("b"),
        (F.col("l_quantity") * 5.0).cast("int").alias("hill"),
        F.floor(F.col("l_discount") * 2500.0).cast("int").alias("m"),
    )


RGB = """rgb AS (
  SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 256)::INTEGER AS r, (l_suppkey % 256)::INTEGER AS g,
         (l_orderkey % 256)::INTEGER AS b, (l_quantity * 5.0)::INTEGER AS hill, floor(l_discount * 2500.0)::INTEGER AS m
  FROM lineitem)"""

#: The px raster's place: 64 columns of 10 m.
WIDTH = 64
GRID = Grid(x=1000.0, y=9000.0, dx=10.0, dy=-10.0, width=WIDTH, height=0, crs="EPSG:3857")


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    height = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return Grid(GRID.x, GRID.y, GRID.dx, GRID.dy, WIDTH, int(height if height is not None else -1) + 1, GRID.crs)
