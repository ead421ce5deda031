import colorsys

import pytest

from cellweave.functions.expr import adjust_hsv, hsv_to_rgb, rgb_to_hsv
from cellweave.operators import ramp as R
from pyspark.sql import functions as F

#: h in degrees, s, v; saturation, shadows, mids, highlights; hue range and target; expected h, s, v.
CASES = {
    "no_change": ((120, 0.8, 0.7), (1, 0, 0, 0), (0, 0, 0), (120, 0.8, 0.7)),
    "boost_midtones": ((240, 0.9, 0.5), (1, 0, 0.2, 0), (0, 0, 0), (240, 0.9, 0.7)),
    "crush_shadows": ((20, 0.7, 0.1), (1, -0.1, 0, 0), (0, 0, 0), (20, 0.7, 0.02)),
    "increase_saturation": ((300, 0.5, 0.5), (1.5, 0, 0, 0), (0, 0, 0), (300, 0.75, 0.5)),
    "no_saturation_on_grey": ((0, 0, 0.5), (2, 0, 0, 0), (0, 0, 0), (0, 0, 0.5)),
    "hue_shift_falls_off": ((100, 0.8, 0.5), (1, 0, 0, 0), (90, 150, 120), (110, 0.8, 0.5)),
    "no_hue_shift_outside": ((30, 0.8, 0.5), (1, 0, 0, 0), (90, 150, 120), (30, 0.8, 0.5)),
    "saturation_is_clamped": ((120, 0.8, 1), (2, 0, 0, 0), (90, 150, 120), (120, 1.0, 1)),
    "value_is_clamped": ((50, 0.5, 0.9), (1, 0, 0, 0.3), (0, 0, 0), (50, 0.5, 1)),
    "range_wraps_around": ((350, 0.9, 0.5), (1, 0, 0, 0), (330, 30, 10), (7.3205, 0.9, 0.5)),
}


@pytest.mark.parametrize("name", CASES)
def test_adjust_hsv(spark, name):
    (h, s, v), factors, hues, want = CASES[name]
    df = spark.createDataFrame([(h / 360, float(s), float(v))], "h double, s double, v double")
    got = df.select(*(c.alias(n) for c, n in zip(adjust_hsv(F.col("h"), F.col("s"), F.col("v"), *factors, *hues), "hsv", strict=True))).first()
    assert (got["h"] * 360, got["s"], got["v"]) == pytest.approx(want, abs=1e-3)


def test_color_conversions(spark):
    levels = (0, 1, 60, 127, 200, 254, 255)
    colors = [(r, g, b) for r in levels for g in levels for b in levels]
    df = spark.createDataFrame(colors, "r int, g int, b int")
    hsv = df.select("*", *(c.alias(n) for c, n in zip(rgb_to_hsv(*(F.col(c) / 255.0 for c in "rgb")), "hsv", strict=True)))
    both = hsv.select("*", *(c.alias(f"{n}2") for c, n in zip(hsv_to_rgb(F.col("h"), F.col("s"), F.col("v")), "rgb", strict=True))).collect()
    for x in both:
        assert (x["h"], x["s"], x["v"]) == pytest.approx(colorsys.rgb_to_hsv(x["r"] / 255, x["g"] / 255, x["b"] / 255))
        assert [x["r2"] * 255, x["g2"] * 255, x["b2"] * 255] == pytest.approx([x["r"], x["g"], x["b"]])


TEXT = "# top\n300 1 2 3\n\n100.5,4,5,6,7\nnv 0 0 0"


def parsed(spark, text=TEXT, **kw):
    return R.parse_ramp(R.lines_frame(spark, text), **kw)


def test_parse_and_write(spark, tmp_path):
    rows = parsed(spark).orderBy("line_no").collect()
    assert [(r["line_no"], r["is_data"], r["elev"], r["a"], r["raw"]) for r in rows] == [(1, False, None, None, "# top"), (2, True, 300.0, None, None), (4, True, 100.5, 7, None), (5, False, None, None, "nv 0 0 0")]
    R.write_ramp(parsed(spark), str(tmp_path / "out.txt"))
    assert (tmp_path / "out.txt").read_text() == "# top\n300 1 2 3\n100.5 4 5 6 7\nnv 0 0 0"
    (tmp_path / "in.txt").write_text(TEXT)
    again = R.parse_ramp(R.read_lines(spark, str(tmp_path / "in.txt"))).orderBy("line_no").collect()
    assert again == rows


def test_strict(spark):
    rows = R.sort_ramp(parsed(spark, "9 1 2 3 # x\n5 4 5 6\n# y\n5 7 8 9", strict=True)).collect()
    assert [(r["elev"], r["r"]) for r in rows] == [(5.0, 4), (5.0, 7), (9.0, 1)]
    down = R.sort_ramp(parsed(spark, "9 1 2 3\n5 4 5 6"), descending=True).collect()
    assert [r["elev"] for r in down] == [9.0, 5.0]


@pytest.mark.parametrize("line", ["1 2 3", "1 2 3 4 5 6", "x 1 2 3", "1 2 3 256", "1 2 3 -4", "1 2.5 3 4", "1 a 3 4"])
def test_broken_lines(spark, line):
    with pytest.raises(Exception, match="line 2"):
        parsed(spark, f"5 1 2 3\n{line}").collect()


def test_neutral_factors_change_nothing(spark):
    before = parsed(spark).orderBy("line_no").collect()
    assert R.adjust_color_file(parsed(spark)).orderBy("line_no").collect() == before
    scaled = R.line_text(R.scale_elevation(parsed(spark), 2.0)).orderBy("line_no").collect()
    assert [r["text"] for r in scaled][1:3] == ["600.0 1 2 3", "201.0 4 5 6 7"]


def test_interpolate(spark):
    three = parsed(spark, "300 100 100 100 10\n200 51 50 50 20\n100 0 0 0 40")
    pick = lambda df: tuple(df.first())
    assert pick(R.interpolate(three, 1)) == (1, 250.0, 76, 75, 75, 15)
    assert pick(R.interpolate(three, 0)) == (0, 400.0, 149, 150, 150, 0)
    assert pick(R.interpolate(parsed(spark, "5 1 2 3"), 0)) == (0, 5.0, 1, 2, 3, None)
    new = R.update_line(three, 2, 50.0, (9, 9, 9, 9)).orderBy("ix").collect()
    assert tuple(new[2]) == (2, 50.0, 9, 9, 9, 9) and new[0]["elev"] == 300.0


def test_relief(spark):
    df = spark.createDataFrame([(-5.0,), (100.0,), (150.0,), (999.0,), (None,)], "elev double")
    rows = R.color_relief(df, parsed(spark, "200 100 0 0\n100 0 0 51")).collect()
    assert [(r["r"], r["b"]) for r in rows[:4]] == [(0, 51), (0, 51), (50, 26), (100, 0)]


def test_configured_ramps(spark, tmp_path):
    config = {"RAMPS": {"c": {"mode": "color", "color": "#EF3E15"}, "h": {"mode": "hsv", "elev-adjust": 2}, "f": {"mode": "file", "file": "x.txt"}, "d": {"mode": "dynamic"}, "bad": {"mode": "odd"}, "empty": {"mode": "color"}, "list": [1]}}
    (tmp_path / "x.txt").write_text("1 2 3 4")
    get = lambda n, **kw: R.ramp_from_config(spark, config, n, folder=str(tmp_path), **kw)
    assert get("d") == ("dynamic", None)
    assert [tuple(r)[2:7] for r in get("c")[1].collect()] == [(-100.0, True, 239, 62, 21), (10000.0, True, 239, 62, 21)]
    assert get("f")[1].first()["elev"] == 1.0
    assert get("h", base=parsed(spark))[1].where("line_no = 2").first()["elev"] == 600.0
    for wrong in ("bad", "empty", "list", "none"):
        with pytest.raises(ValueError):
            get(wrong)
    with pytest.raises(FileNotFoundError):
        get("h")
    with pytest.raises(ValueError):
        R.ramp_settings({}, "x")
    with pytest.raises(Exception, match="RRGGBB"):
        R.rgb_ramp(spark, "zzz").collect()
