"""Every raster query against its SQL twin in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from cellweave.plans import file_queries, queries  # noqa: F401  the first registers its own
from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return round(float(v), 9) if isinstance(v, float) else str(v)

    return sorted((tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, db, name):
    ours, theirs = queries.QUERIES[name](spark, SMALL).toPandas(), db.sql(queries.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) and plain(ours) == plain(theirs)


def test_noise_is_reproducible(spark):
    rows = [queries.QUERIES["vignette_noise"](spark, SMALL).orderBy("row", "col").collect() for _ in range(2)]
    assert rows[0] == rows[1] and all(0 <= r["alpha"] <= 255 for r in rows[0])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def largest_method(df) -> int:
    """Bytes of the largest method that the plan's generated code has; the JVM compiles none over 8,000."""
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    return max((stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())), default=0)


POINTWISE = ("reclass_alpha", "hillshade_shade", "hillshade_tonemap", "masked_blend_columns", "tree_line", "hsv_adjust", "hsv_values", "color_relief", "biome_layer", "pipeline_mix_init_lerp_multiply")


@pytest.mark.parametrize("name", POINTWISE)
def test_plans_stay_in_the_jvm(spark, name):
    """Pointwise queries have no shuffle, no Python and no method that is too large to be compiled."""
    df = queries.QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Python" not in plan and "SortMergeJoin" not in plan
    assert 0 < largest_method(df) < 8000


def test_many_stops_stay_compiled(spark):
    from cellweave.operators import ramp
    from cellweave.plans.views import layers

    text = "\n".join(f"{i * 20} {i % 256} {255 - i % 256} {i * 7 % 256}" for i in range(200))
    df = ramp.color_relief(layers(spark, SMALL), ramp.parse_ramp(ramp.lines_frame(spark, text)))
    assert largest_method(df.select("r", "g", "b")) < 8000


def test_dictionaries_are_broadcast(spark):
    plan = queries.QUERIES["reclass_palette"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "Exchange hash" not in plan


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["presence_west_of_x"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan or "ReadSchema" in plan and "label" not in plan.split("ReadSchema")[1].splitlines()[0]
    assert os.path.isdir(SMALL)


def test_bucketed_rasters_join_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    from cellweave.operators import blend
    from cellweave.plans.views import layers
    from cellweave.sources import tables

    x = layers(spark, SMALL).select("row", "col", "a1", "c1", "m")
    for name, column in (("t_a", "a1"), ("t_b", "c1"), ("t_m", "m")):
        tables.save_raster(x.select("row", "col", F.col(column).alias("v")), name, 4, mode="overwrite")
    a, b, m = (tables.load_raster(spark, n) for n in ("t_a", "t_b", "t_m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = blend.masked_blend(a, b, m, ["v"], "v")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        want = x.select("row", "col", blend.blend_value("a1", "c1", "m").alias("v"))
        assert out.exceptAll(want).count() == 0 and out.count() == want.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("t_a", "t_b", "t_m"):
            spark.sql(f"DROP TABLE IF EXISTS {n}")
