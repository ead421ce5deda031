import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import blend as B


def raster(spark, a, names):
    rows, cols = a.shape[:2]
    return spark.createDataFrame([(r, c, *(int(v) for v in np.atleast_1d(a[r, c]))) for r in range(rows) for c in range(cols)], "row int, col int, " + ", ".join(f"{n} int" for n in names))


def test_masked_blend_closed_form(spark):
    rng = np.random.default_rng(1)
    a, mask = rng.integers(0, 255, (10, 10, 3)), np.arange(100).reshape(10, 10)
    bands = ["b1", "b2", "b3"]
    out = B.masked_blend(raster(spark, a, bands), raster(spark, a * 0, bands), raster(spark, mask, ["m"])).orderBy("row", "col").toPandas()
    assert (out[bands].to_numpy().reshape(10, 10, 3) == np.round(a * (mask / 255.0)[..., None])).all()


def test_masked_blend_ends(spark):
    df = spark.createDataFrame([(7, 200, 255), (7, 200, 0), (7, 200, None)], "a int, b int, m int")
    assert [r[0] for r in df.select(B.blend_value("a", "b", "m")).collect()] == [7, 200, None]


def test_dimensions(spark):
    a, b = raster(spark, np.zeros((2, 3)), ["v"]), raster(spark, np.zeros((2, 2)), ["v"])
    assert B.dimensions(a) == (3, 2)
    B.check_aligned({"a": a, "b": a})
    with pytest.raises(ValueError, match="dimensions"):
        B.masked_blend(a, b, a, ["v"], "v", check=True)


def brute_shade(h, rgb, o, den=255.0):
    h = np.clip(h / den, 0, 1)
    if o.hill_floor > 0 or o.hill_gamma != 1 or o.hill_ceil < 1:
        h = np.clip(np.minimum(o.hill_floor + (1 - o.hill_floor) * h**o.hill_gamma, o.hill_ceil), 0, 1)

    def smooth(e0, e1):
        t = np.clip((h - e0 / 255) / ((e1 - e0) / 255), 0, 1) if e1 > e0 else 0 * h
        return t * t * (3 - 2 * t)

    w = np.maximum((1 - smooth(*o.shadow_range)) * o.protect_shadows, smooth(*o.highlight_range) * o.protect_highlights)
    m = np.clip(1 - o.shade_strength + o.shade_strength * np.clip(h + w * (1 - h), 0, 1), 0, 1)
    return np.clip(np.round(m[..., None] * rgb), 0, 255)


@pytest.mark.parametrize("options", [B.Shading(), B.Shading(hill_floor=0.1, hill_gamma=1.5, hill_ceil=0.8, shade_strength=1.0), B.Shading(shadow_range=(60, 60), protect_shadows=1.0)])
def test_hillshade(spark, options):
    rng = np.random.default_rng(2)
    hill, rgb = rng.integers(0, 256, (12, 9)), rng.integers(0, 256, (12, 9, 3))
    out = B.hillshade_blend(raster(spark, hill, ["hill"]), raster(spark, rgb, "rgb"), options=options).orderBy("row", "col").toPandas()
    assert (out[["r", "g", "b"]].to_numpy().reshape(12, 9, 3) == brute_shade(hill, rgb, options)).all()


def test_hillshade_identity_alpha_and_nodata(spark):
    df = spark.createDataFrame([(0, 0, 10, 1, 2, 3, 9), (0, 1, 0, 50, 60, 70, 8), (0, 2, None, 50, 60, 70, 7)], "row int, col int, hill int, r int, g int, b int, a int")
    same = B.shade(df, options=B.Shading(shade_strength=0.0)).orderBy("col").collect()
    assert [(r["r"], r["g"], r["b"]) for r in same] == [(1, 2, 3), (50, 60, 70), (50, 60, 70)]
    masked = B.hillshade_blend(df.select("row", "col", "hill"), df.drop("hill"), alpha="a", nodata=0).orderBy("col").collect()
    assert masked[1]["r"] == 50 and [r["a"] for r in masked] == [9, 8, 7]


@pytest.mark.parametrize("wrong", [{"protect_shadows": -0.1}, {"hill_gamma": 0}, {"shadow_range": (9, 3)}, {"highlight_range": (0, 300)}, {"hill_floor": 0.9, "hill_ceil": 0.5}, {"shade_strength": 2}])
def test_wrong_shading(wrong):
    with pytest.raises(ValueError):
        B.Shading(**wrong)


def test_denominator(spark):
    f = lambda *v: spark.createDataFrame([(x,) for x in v], "hill double")
    assert B.hill_denominator(f(0.1, 1.5)) == 1.0
    assert B.hill_denominator(f(0.1, 1.6, float("nan"))) == 255.0
    assert B.hill_denominator(f(float("nan"), None, float("inf"))) == 1.0
    assert B.hill_denominator(f(9.0), dtype="uint16") == 65535.0


def layers(spark):
    df = spark.createDataFrame([(100.0, 200.0, 0.5)], "a double, b double, f double")
    return df, {"HUMID_VEGETATION": [F.col("a")] * 3, "X": [F.col("b")] * 3}


def test_pipeline_contract(spark):
    df, p = layers(spark)
    run = lambda steps, factors={"f": F.col("f"), "none": None}: [tuple(r) for r in df.select(*(c.alias(f"b{i}") for i, c in enumerate(B.run_pipeline(p, factors, steps)))).collect()][0]  # noqa: B006, E731
    begin = B.Step("init", "f", palette_a="HUMID_VEGETATION", target="X")
    assert run([begin]) == (150, 150, 150)
    assert run([begin, B.Step("lerp", "f", target="X")]) == (175, 175, 175)
    assert run([begin, B.Step("lerp", "f", target="UNKNOWN"), B.Step("lerp", "absent", target="X"), B.Step("multiply", "none")]) == (150, 150, 150)
    assert run([begin, B.Step("multiply", "f")]) == (75, 75, 75)
    assert run([B.Step("mix_palettes", "none", palette_a="X", palette_b="HUMID_VEGETATION", output="M"), B.Step("init", "f", palette_a="M", target="X")]) == (200, 200, 200)
    for steps in ([], [begin, begin], [B.Step("swirl", "f")], [B.Step("multiply", "f")], [B.Step("init", "f", palette_a="UNKNOWN", target="X")], [B.Step("lerp", "absent", target="X")]):
        with pytest.raises(ValueError):
            run(steps)
    with pytest.raises(ValueError):
        B.run_pipeline({"X": p["X"]}, {}, [begin])


def test_alpha_is_not_multiplied(spark):
    df = spark.createDataFrame([(100.0, 0.5)], "a double, f double")
    four = {"HUMID_VEGETATION": [F.col("a")] * 4, "X": [F.col("a")] * 4}
    out = B.run_pipeline(four, {"f": F.col("f")}, [B.Step("init", "f", palette_a="HUMID_VEGETATION", target="X"), B.Step("multiply", "f")])
    assert tuple(df.select(*(c.alias(f"b{i}") for i, c in enumerate(out))).first()) == (50, 50, 50, 100)
