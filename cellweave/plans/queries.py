"""Registered raster queries and their SQL twins.

Each query applies one operator to whole tables. Transcendental results are rounded or
quantised, as the two engines' math libraries differ in the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.expr import adjust_hsv, rgb_to_hsv, shorten
from cellweave.operators import blend, catalog, focal, geometric, ramp, reclassify
from cellweave.plans.views import LAYERS, PX, RGB, grid, layers, px, rgb, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- reclassify

CONFIG = reclassify.parse_config(
    {
        "classes": [
            {"name": "dark_rock", "rgb": "4d4339", "ids": [21, 22, 23, 24, 25, 26, 27]},
            {"name": "playa", "rgb": "e3dbca", "ids": [30, 31, 32, 33, 34]},
            {"name": "water", "rgb": "7d95ab", "ids": [38, 39, 40, 41], "value": 10},
            {"name": "grass", "ids": [45, 46, 47]},
        ],
        "options": {"default_value": 0, "input_nodata": [33]},
    }
)
_RULES = "rules(rule_ix, name, value, id, rgb) AS (VALUES " + ", ".join(f"({i}, '{r.name}', {r.value}, {c}, {'NULL' if r.rgb is None else repr(r.rgb)})" for i, r in enumerate(CONFIG.rules) for c in r.ids) + ")"
_CLASSED = f"""{LAYERS}, {_RULES}, classed AS (
  SELECT row, col, code, CASE WHEN code IN (33, -9999) THEN 0 ELSE coalesce(value, 0) END AS class
  FROM layers LEFT JOIN rules ON code = id)"""


@query(f'WITH {_CLASSED} SELECT class, CASE WHEN class <> 0 THEN 255 ELSE 0 END AS alpha, count(*) AS pixels FROM classed GROUP BY class')
def reclass_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reclassify.reclassify(layers(spark, sf_dir), CONFIG).groupBy("class", "alpha").agg(F.count("*").alias("pixels"))


@query(f"WITH {_CLASSED} SELECT row, col, class, CASE WHEN class <> 0 THEN 255 ELSE 0 END AS alpha FROM classed")
def reclass_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = layers(spark, sf_dir).select("row", "col", reclassify.lookup(CONFIG, "code").alias("class"))
    return p.withColumn("alpha", reclassify.alpha_of(F.col("class"), CONFIG.options))


@query(f"WITH {LAYERS}, {_RULES} SELECT code, count(*) AS pixels FROM layers WHERE code NOT IN (33, -9999) AND code NOT IN (SELECT id FROM rules) GROUP BY code")
def reclass_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reclassify.unmapped(layers(spark, sf_dir), CONFIG)


_PART_RULES = "SELECT p_brand AS name, p_size AS id FROM part"


@query(f"WITH t AS ({_PART_RULES}) SELECT id, count(*) AS times, array_to_string(list_sort(list_distinct(list(name))), ',') AS names FROM t GROUP BY id HAVING count(*) > 1")
def reclass_dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reclassify.duplicate_ids(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("id")))


@query(
    f"""WITH {_CLASSED}, pal(value, r, g, b) AS (VALUES (0, 0, 0, 0), (1, 77, 67, 57), (2, 227, 219, 202), (10, 125, 149, 171), (4, 0, 0, 0))
SELECT row, col, class, r, g, b FROM classed JOIN pal ON class = value"""
)
def reclass_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reclassify.reclassify(layers(spark, sf_dir).select("row", "col", "code"), CONFIG, alpha=None)
    return reclassify.colorize(p, reclassify.palette(spark, CONFIG)).drop("code")


@query(
    f"""WITH {LAYERS} SELECT first_rule, count(*) AS pixels FROM (
  SELECT CASE WHEN code IN (30, 31, 32, 33) THEN 0 WHEN code IN (33, 34, 35) THEN 1 WHEN code IN (30, 40, 41) THEN 2 ELSE -1 END AS first_rule FROM layers) GROUP BY first_rule"""
)
def reclass_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [reclassify.Rule("a", 1, (30, 31, 32, 33)), reclassify.Rule("b", 2, (33, 34, 35)), reclassify.Rule("c", 3, (30, 40, 41))]
    return layers(spark, sf_dir).select(F.coalesce(reclassify.first_match("code", rules), F.lit(-1)).alias("first_rule")).groupBy("first_rule").agg(F.count("*").alias("pixels"))


# ---------------------------------------------------------------- blends


def _blend_sql(a: str, b: str, m: str) -> str:
    return f"greatest(0, least(255, round_even({a} * ({m} / 255.0::DOUBLE) + {b} * (1.0::DOUBLE - {m} / 255.0::DOUBLE), 0)::INTEGER))"


@query(f"WITH {LAYERS} SELECT row, col, {', '.join(f'{_blend_sql(f'a{i}', f'c{i}', 'm')} AS b{i}' for i in (1, 2, 3))} FROM layers")
def masked_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = layers(spark, sf_dir)
    a = x.select("row", "col", *(F.col(f"a{i}").alias(f"b{i}") for i in (1, 2, 3)))
    b = x.select("row", "col", *(F.col(f"c{i}").alias(f"b{i}") for i in (1, 2, 3)))
    return blend.masked_blend(a, b, x.select("row", "col", "m"))


@query(f"WITH {RGB} SELECT k, n, {_blend_sql('r', 'b', 'm')} AS r, {_blend_sql('g', 'hill', 'm')} AS g FROM rgb")
def masked_blend_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that are columns of one table: no join."""
    return rgb(spark, sf_dir).select("k", "n", blend.blend_value("r", "b", "m").alias("r"), blend.blend_value("g", "hill", "m").alias("g"))


_SHADING = blend.Shading()


def _smooth_sql(low: float, high: float, x: str) -> str:
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE)))"
    return f"({t} * {t} * (3.0::DOUBLE - {t} * 2.0::DOUBLE))"


def _shade_sql(source: str, h: str, keep: str = "k, n", bands: str = "rgb") -> str:
    s = [x / 255.0 for x in (*_SHADING.shadow_range, *_SHADING.highlight_range)]
    return f"""toned AS (SELECT *, {h} AS h FROM {source}),
weighed AS (SELECT *, greatest((1.0::DOUBLE - {_smooth_sql(s[0], s[1], 'h')}) * 0.2::DOUBLE, {_smooth_sql(s[2], s[3], 'h')} * 0.1::DOUBLE) AS w FROM toned),
lifted AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, h + w * (1.0::DOUBLE - h))) AS m0 FROM weighed),
factored AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {1.0 - 0.8!r}::DOUBLE + 0.8::DOUBLE * m0)) AS fm FROM lifted)
SELECT {keep}, {', '.join(f'greatest(0, least(255, round_even(fm * {b}, 0)::INTEGER)) AS {b}' for b in bands)} FROM factored"""


@query(f"WITH {RGB}, {_shade_sql('rgb', 'greatest(0.0::DOUBLE, least(1.0::DOUBLE, hill::DOUBLE / 255.0::DOUBLE))')}")
def hillshade_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blend.shade(rgb(spark, sf_dir), "hill").select("k", "n", "r", "g", "b")


@query(f"WITH {LAYERS}, {_shade_sql('layers', 'greatest(0.0::DOUBLE, least(1.0::DOUBLE, m::DOUBLE / 255.0::DOUBLE))', 'row, col, c3', ('a1', 'a2', 'a3'))}")
def hillshade_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rasters, joined; c3 passes through as alpha."""
    x = layers(spark, sf_dir)
    return blend.hillshade_blend(x.select("row", "col", F.col("m").alias("hill")), x.select("row", "col", "a1", "a2", "a3", "c3"), bands=("a1", "a2", "a3"), alpha="c3")


@query(
    f"""WITH {RGB}, t AS (SELECT k, n, greatest(0.0::DOUBLE, least(1.0::DOUBLE, hill::DOUBLE / 255.0::DOUBLE)) AS h FROM rgb)
SELECT k, n, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(0.05::DOUBLE + 0.95::DOUBLE * pow(h, 1.4::DOUBLE), 0.9::DOUBLE))), 9) AS tone FROM t"""
)
def hillshade_tonemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = blend.Shading(hill_floor=0.05, hill_gamma=1.4, hill_ceil=0.9)
    return rgb(spark, sf_dir).select("k", "n", F.round(blend.tone("hill", o), 9).alias("tone"))


@query(f"WITH {PX} SELECT CASE WHEN max(v) IS NULL OR max(v) <= 1.5 THEN 1.0::DOUBLE ELSE 255.0::DOUBLE END AS denominator, count(*) AS pixels FROM px")
def hillshade_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = px(spark, sf_dir)
    return x.agg(F.lit(blend.hill_denominator(x, "v")).alias("denominator"), F.count("*").alias("pixels"))


@query(
    f"""WITH {LAYERS}, f AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (precip - 300.0) / 600.0)) AS w, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (elev - 1500.0) / 800.0)) AS t FROM layers),
mixed AS (SELECT row, col, w, t, m, {', '.join(f'a{i} + (c{i} - a{i}) * w AS x{i}, a{i}, c{i}' for i in (1, 2, 3))} FROM f),
begun AS (SELECT row, col, t, m, {', '.join(f'x{i} + (c{i} - x{i}) * t AS y{i}, x{i}' for i in (1, 2, 3))} FROM mixed),
done AS (SELECT row, col, {', '.join(f'(y{i} + (200.0 - y{i}) * (m / 255.0::DOUBLE)) * (0.5 + 0.5 * t) AS z{i}' for i in (1, 2, 3))} FROM begun)
SELECT row, col, {', '.join(f'greatest(0, least(255, round_even(z{i}, 0)::INTEGER)) AS b{i}' for i in (1, 2, 3))} FROM done"""
)
def pipeline_mix_init_lerp_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = layers(spark, sf_dir)
    t = blend.tree_line("elev", 1500.0, 800.0)
    palettes = {"HUMID_VEGETATION": [F.col(f"a{i}") for i in (1, 2, 3)], "ARID": [F.col(f"c{i}") for i in (1, 2, 3)], "SNOW": [F.lit(200.0)] * 3}
    factors = {"precip": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("precip") - 300.0) / 600.0)), "trees": t, "mask": F.col("m") / 255.0, "shade": 0.5 + 0.5 * t, "none": None}
    steps = [
        blend.Step("mix_palettes", "precip", palette_a="HUMID_VEGETATION", palette_b="ARID", output="GROUND"),
        blend.Step("lerp", "absent", target="SNOW"),
        blend.Step("init", "trees", palette_a="GROUND", target="ARID"),
        blend.Step("lerp", "mask", target="SNOW"),
        blend.Step("lerp", "none", target="SNOW"),
        blend.Step("multiply", "shade"),
    ]
    return x.select("row", "col", *(c.alias(f"b{i}") for i, c in enumerate(blend.run_pipeline(palettes, factors, steps), 1)))


@query(f"WITH {LAYERS} SELECT row, col, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (elev - 1800.0) / 400.0)) AS weight FROM layers")
def tree_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(spark, sf_dir).select("row", "col", blend.tree_line("elev", 1800.0, 400.0).alias("weight"))


@query(
    f"""WITH {LAYERS}, f AS (SELECT *, 1.0::DOUBLE - {_smooth_sql(300.0, 900.0, 'precip')} AS d, {_smooth_sql(25.0, 45.0, 'slope')} AS s FROM layers)
SELECT row, col, {', '.join(f'greatest(0, least(255, round_even((a{i} + (c{i} - a{i}) * d) + (m - (a{i} + (c{i} - a{i}) * d)) * s, 0)::INTEGER)) AS {b}' for i, b in ((1, 'r'), (2, 'g'), (3, 'b')))} FROM f"""
)
def biome_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blend.biome_layer(layers(spark, sf_dir), ("a1", "a2", "a3"), ("c1", "c2", "c3"), ("m", "m", "m")).select("row", "col", "r", "g", "b")


@query(
    f"""WITH {LAYERS}, f AS (SELECT *, 1.0::DOUBLE - {_smooth_sql(300.0, 900.0, '(precip + v * 120.0::DOUBLE)')} AS d FROM layers)
SELECT row, col, {', '.join(f'greatest(0, least(255, round_even(a{i} + (c{i} - a{i}) * d, 0)::INTEGER)) AS {b}' for i, b in ((1, 'r'), (2, 'g'), (3, 'b')))} FROM f"""
)
def biome_layer_tpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position index shifts precipitation; no slope."""
    return blend.biome_layer(layers(spark, sf_dir), ("a1", "a2", "a3"), ("c1", "c2", "c3"), ("m", "m", "m"), slope=None, tpi="v", tpi_bias=120.0).select("row", "col", "r", "g", "b")


@query(
    """WITH over(v, g) AS (VALUES (3, 'Water'), (7, 'Snow')), macro(mg, g) AS (VALUES ('AFRICA', 'Desert'), ('ASIA', 'Steppe'), ('EUROPE', 'Forest')),
pal(g, rl, gl, bl, ra, ga, ba) AS (VALUES ('Water', 10, 60, 200, 20, 70, 180), ('Snow', 250, 250, 255, 240, 240, 240), ('Desert', 210, 180, 120, 230, 200, 140), ('Steppe', 120, 160, 70, 170, 160, 90), ('Forest', 20, 90, 30, 90, 110, 50), ('Other', 128, 128, 128, 128, 128, 128))
SELECT n_nationkey AS "VALUE", coalesce(o.g, m.g, 'Other') AS "ColorGroup", round_even(ra + (rl - ra) * 0.35::DOUBLE, 0)::INTEGER AS r, round_even(ga + (gl - ga) * 0.35::DOUBLE, 0)::INTEGER AS g, round_even(ba + (bl - ba) * 0.35::DOUBLE, 0)::INTEGER AS b
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN over o ON n_nationkey = o.v LEFT JOIN macro m ON r_name = m.mg LEFT JOIN pal p ON p.g = coalesce(o.g, m.g, 'Other')"""
)
def render_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("VALUE"), F.col("r_name").alias("MACROGROUP"))
    over = spark.sql("SELECT * FROM VALUES (3, 'Water', 'x'), (7, 'Snow', 'y') AS t(VALUE, ColorGroup, Note)")
    macro = spark.sql("SELECT * FROM VALUES ('AFRICA', 'Desert'), ('ASIA', 'Steppe'), ('EUROPE', 'Forest') AS t(MACROGROUP, ColorGroup)")
    pal = spark.sql("SELECT * FROM VALUES ('Water', 10, 60, 200, 20, 70, 180), ('Snow', 250, 250, 255, 240, 240, 240), ('Desert', 210, 180, 120, 230, 200, 140), ('Steppe', 120, 160, 70, 170, 160, 90), ('Forest', 20, 90, 30, 90, 110, 50), ('Other', 128, 128, 128, 128, 128, 128) AS t(ColorGroup, R_lush, G_lush, B_lush, R_arid, G_arid, B_arid)")
    return blend.render_table(values, over, macro, pal, 0.35)


# ---------------------------------------------------------------- geometry


@query(f"WITH {PX}, h AS (SELECT max(row) + 1 AS h FROM px) SELECT (row - ((h - 40) * 0.5::DOUBLE)::INTEGER)::INTEGER AS row, col - 12 AS col, v FROM px, h WHERE row BETWEEN floor((h - 40) * 0.5) AND floor((h - 40) * 0.5) + 39 AND col BETWEEN 12 AND 51".replace("((h - 40) * 0.5::DOUBLE)::INTEGER", "floor((h - 40) * 0.5::DOUBLE)::INTEGER"))
def subset_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return geometric.create_subset(px(spark, sf_dir), g.width, g.height, 40)


@query(f"WITH {PX}, h AS (SELECT max(row) + 1 AS h FROM px) SELECT (row - floor((h - 30) * 0.9::DOUBLE)::INTEGER)::INTEGER AS row, col - 3 AS col, v FROM px, h WHERE row BETWEEN floor((h - 30) * 0.9::DOUBLE) AND floor((h - 30) * 0.9::DOUBLE) + 29 AND col BETWEEN 3 AND 32")
def subset_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return geometric.create_subset(px(spark, sf_dir), g.width, g.height, 30, 0.1, 0.9)


#: A template of 16 m cells that begins between the source's cells.
def _template(spark: SparkSession, sf_dir: str) -> geometric.Grid:
    g = grid(spark, sf_dir)
    return geometric.Grid(g.x + 3.0, g.y - 5.0, 16.0, -16.0, 38, g.height * 10 // 16 - 2, g.crs)


_TEMPLATE = f"""{PX}, size AS (SELECT max(row) + 1 AS h FROM px),
target AS (SELECT r.r::INTEGER AS row, c.c::INTEGER AS col, ((((c.c + 0.5::DOUBLE) * 16.0::DOUBLE + 1003.0::DOUBLE) - 1000.0::DOUBLE) / 10.0::DOUBLE) AS fc, ((((r.r + 0.5::DOUBLE) * -16.0::DOUBLE + 8995.0::DOUBLE) - 9000.0::DOUBLE) / -10.0::DOUBLE) AS fr
  FROM size, generate_series(0, 37) c(c), LATERAL (SELECT unnest(generate_series(0, h * 10 // 16 - 3)) AS r) r)"""


@query(f"WITH {_TEMPLATE} SELECT t.row, t.col, v FROM target t JOIN px p ON p.row = floor(fr)::INTEGER AND p.col = floor(fc)::INTEGER")
def align_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric.align(px(spark, sf_dir), grid(spark, sf_dir), _template(spark, sf_dir), method="nearest")


_BILINEAR = f"""WITH {_TEMPLATE}, k AS (SELECT row, col, floor(fr - 0.5) AS r0, floor(fc - 0.5) AS c0, fr - 0.5 - floor(fr - 0.5) AS tr, fc - 0.5 - floor(fc - 0.5) AS tc FROM target),
cells AS (SELECT row, col, (r0 + i)::INTEGER AS sr, (c0 + j)::INTEGER AS sc, CASE i WHEN 0 THEN 1 - tr ELSE tr END * CASE j WHEN 0 THEN 1 - tc ELSE tc END AS w FROM k, generate_series(0, 1) a(i), generate_series(0, 1) b(j))
SELECT c.row, c.col, round(sum(w * v) / sum(w), 6) AS v FROM cells c JOIN px p ON p.row = sr AND p.col = sc WHERE w <> 0 GROUP BY c.row, c.col"""


@query(_BILINEAR)
def align_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometric.align(px(spark, sf_dir), grid(spark, sf_dir), _template(spark, sf_dir), method="bilinear")
    return out.withColumn("v", F.round("v", 6))


_W = "CASE {i} WHEN -1 THEN -0.5 * {t} + {t} * {t} - 0.5 * {t} * {t} * {t} WHEN 0 THEN 1 - 2.5 * {t} * {t} + 1.5 * {t} * {t} * {t} WHEN 1 THEN 0.5 * {t} + 2 * {t} * {t} - 1.5 * {t} * {t} * {t} ELSE -0.5 * {t} * {t} + 0.5 * {t} * {t} * {t} END"


@query(
    f"""WITH {_TEMPLATE}, k AS (SELECT row, col, floor(fr - 0.5) AS r0, floor(fc - 0.5) AS c0, fr - 0.5 - floor(fr - 0.5) AS tr, fc - 0.5 - floor(fc - 0.5) AS tc FROM target),
cells AS (SELECT row, col, (r0 + i)::INTEGER AS sr, (c0 + j)::INTEGER AS sc, ({_W.format(i='i', t='tr')}) * ({_W.format(i='j', t='tc')}) AS w FROM k, generate_series(-1, 2) a(i), generate_series(-1, 2) b(j))
SELECT c.row, c.col, round(sum(w * v) / sum(w), 6) AS v FROM cells c JOIN px p ON p.row = sr AND p.col = sc WHERE w <> 0 GROUP BY c.row, c.col"""
)
def align_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometric.align(px(spark, sf_dir), grid(spark, sf_dir), _template(spark, sf_dir), method="cubic")
    return out.withColumn("v", F.round("v", 6))


@query(f"WITH {PX} SELECT row // 2 AS row, col // 2 AS col, round(avg(v), 9) AS v FROM px GROUP BY ALL")
def overview_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric.overview(px(spark, sf_dir), 2).withColumn("v", F.round("v", 9))


@query(f"WITH {PX} SELECT row // 4 AS row, col // 4 AS col, round(avg(v), 9) AS v FROM px GROUP BY ALL")
def overview_l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric.overview(px(spark, sf_dir), 4).withColumn("v", F.round("v", 9))


@query(f"WITH {PX}, l(level) AS (VALUES (2), (4), (8), (16), (32), (64), (128)) SELECT level, row // level AS row, col // level AS col, round(avg(v), 6) AS v FROM px, l GROUP BY ALL")
def overview_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric.pyramid(px(spark, sf_dir)).withColumn("v", F.round("v", 6))


@query(f"WITH {LAYERS} SELECT row // 16 AS tile_row, col // 16 AS tile_col, (max(row % 16) + 1)::INTEGER AS h, (max(col % 16) + 1)::INTEGER AS w, array_to_string(list(m ORDER BY row, col), ',') AS m FROM layers GROUP BY ALL HAVING max(m) > 0")
def tile_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric.to_tiles(layers(spark, sf_dir), 16, ("m",)).withColumn("m", F.array_join("m", ","))


@query(f"WITH {LAYERS} SELECT row, col, m FROM layers")
def tile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric.from_tiles(geometric.to_tiles(layers(spark, sf_dir), 16, ("m",), sparse=None), 16, ("m",))


_HALF = 20037508.342789244
#: Means of what falls into a pixel for the zooms that are coarser than the raster, and its pixel under the centre for the finer ones.
TILED = f"""{LAYERS}, size AS (SELECT max(row) + 1 AS h FROM layers),
coarse AS (SELECT zoom, 2 * {_HALF}::DOUBLE / (256 << zoom) AS res FROM (VALUES (12), (13)) z(zoom)), fine AS (SELECT zoom, 2 * {_HALF}::DOUBLE / (256 << zoom) AS res FROM (VALUES (14), (15)) z(zoom)),
mean AS (SELECT zoom, floor((((col + 0.5::DOUBLE) * 10.0::DOUBLE + 1000.0::DOUBLE) + {_HALF}::DOUBLE) / res)::BIGINT AS gx, floor(({_HALF}::DOUBLE - ((row + 0.5::DOUBLE) * -10.0::DOUBLE + 9000.0::DOUBLE)) / res)::BIGINT AS gy, round_even(avg(a1), 0)::INTEGER AS a1 FROM layers, coarse GROUP BY ALL),
across AS (SELECT zoom, res, unnest(generate_series(floor((1000.0::DOUBLE + {_HALF}::DOUBLE) / res)::BIGINT, floor((1640.0::DOUBLE + {_HALF}::DOUBLE) / res)::BIGINT)) AS gx FROM fine),
down AS (SELECT zoom, unnest(generate_series(floor(({_HALF}::DOUBLE - 9000.0::DOUBLE) / res)::BIGINT, floor(({_HALF}::DOUBLE - (9000.0::DOUBLE - 10.0::DOUBLE * h)) / res)::BIGINT)) AS gy FROM fine, size),
target AS (SELECT zoom, gx, gy, floor(((gx + 0.5::DOUBLE) * res - {_HALF}::DOUBLE - 1000.0::DOUBLE) / 10.0::DOUBLE)::BIGINT AS col, floor(({_HALF}::DOUBLE - (gy + 0.5::DOUBLE) * res - 9000.0::DOUBLE) / -10.0::DOUBLE)::BIGINT AS row FROM across JOIN down USING (zoom)),
under AS (SELECT zoom, gx, gy, a1 FROM target JOIN layers USING (row, col)),
tiled AS (SELECT zoom, (gx // 256)::INTEGER AS tile_column, (gy // 256)::INTEGER AS tile_row, (gy % 256)::INTEGER AS row, (gx % 256)::INTEGER AS col, a1 FROM (SELECT * FROM mean UNION ALL SELECT * FROM under))"""


@query(f"WITH {TILED} SELECT * FROM tiled")
def tile_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two zooms coarser and two finer than the raster."""
    return geometric.tile_pyramid(layers(spark, sf_dir), grid(spark, sf_dir), ("a1",), 12, 15)


#: A template in degrees over a part of the raster, whose metres are those of web Mercator.
_DEGREES = geometric.Grid(0.0095, 0.079, 0.0001, -0.00015, 45, 250, "EPSG:4326")
_IN_DEGREES = f"""{PX}, target AS (SELECT r::INTEGER AS row, c::INTEGER AS col, ((c + 0.5::DOUBLE) * 0.0001::DOUBLE + 0.0095::DOUBLE) * {_HALF / 180.0!r}::DOUBLE AS x,
  ln(tan(radians((r + 0.5::DOUBLE) * -0.00015::DOUBLE + 0.079::DOUBLE) / 2 + pi() / 4)) * {_HALF}::DOUBLE / pi() AS y FROM generate_series(0, 249) a(r), generate_series(0, 44) b(c))"""


@query(f"WITH {_IN_DEGREES} SELECT t.row, t.col, v FROM target t JOIN px p ON p.row = floor((y - 9000.0) / -10.0)::INTEGER AND p.col = floor((x - 1000.0) / 10.0)::INTEGER")
def align_reprojected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source in metres on a template in degrees."""
    return geometric.align(px(spark, sf_dir), grid(spark, sf_dir), _DEGREES, method="nearest")


@query(f"WITH {_TEMPLATE}, placed AS (SELECT floor(((row + 0.5::DOUBLE) * -10.0::DOUBLE + 9000.0::DOUBLE - 8995.0::DOUBLE) / -16.0::DOUBLE)::INTEGER AS row, floor(((col + 0.5::DOUBLE) * 10.0::DOUBLE + 1000.0::DOUBLE - 1003.0::DOUBLE) / 16.0::DOUBLE)::INTEGER AS col, v FROM px) SELECT row, col, round(quantile_cont(v, 0.5), 9) AS v FROM placed, size WHERE row BETWEEN 0 AND h * 10 // 16 - 3 AND col BETWEEN 0 AND 37 GROUP BY row, col")
def align_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometric.align(px(spark, sf_dir), grid(spark, sf_dir), _template(spark, sf_dir), method="med").withColumn("v", F.round("v", 9))


# ---------------------------------------------------------------- neighbourhood


def _distance_sql(feature: str, source: str = "layers") -> str:
    """px rows with d2; exact, by columns and then by rows."""
    return f"""f AS (SELECT row, col, {feature} AS f FROM {source}),
g AS (SELECT row, col, least(coalesce(row - max(CASE WHEN f THEN row END) OVER (PARTITION BY col ORDER BY row ROWS UNBOUNDED PRECEDING), 1000000), coalesce(min(CASE WHEN f THEN row END) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - row, 1000000))::BIGINT AS g FROM f),
d AS (SELECT a.row, a.col, min((a.col - b.col)::BIGINT * (a.col - b.col) + b.g * b.g) AS d2 FROM g a JOIN g b ON a.row = b.row GROUP BY a.row, a.col)"""


TARGETS = (22, 23, 58, 59)


@query(f"WITH {LAYERS}, {_distance_sql(f'code IN {TARGETS}')} SELECT row, col, sqrt(d2::DOUBLE) AS distance FROM d")
def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.proximity(layers(spark, sf_dir), TARGETS)


@query(f"WITH {LAYERS}, {_distance_sql(f'code IN {TARGETS}')} SELECT row, col, least(sqrt(d2::DOUBLE), 7.5) AS distance FROM d")
def proximity_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.proximity(layers(spark, sf_dir), TARGETS, maxdist=7.5)


def _feather_sql(sigma: float) -> str:
    return f"CASE WHEN d2 > {focal.feather_radius(sigma) ** 2} THEN 0 ELSE floor(255.0::DOUBLE * exp(-(d2::DOUBLE / {2.0 * sigma * sigma}::DOUBLE)))::INTEGER END"


@query(f"WITH {LAYERS}, {_distance_sql('m <> 0 AND m < 60')} SELECT row, col, {_feather_sql(2.0)} AS alpha FROM d")
def edge_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = layers(spark, sf_dir).withColumn("m", F.when(F.col("m") < 60, F.col("m")).otherwise(0))
    return focal.edge_feather(mask, sigma=2.0)


@query(
    f"""WITH {LAYERS}, tiles AS (SELECT row, col, m <> 0 AND m < 60 AS f, tr.tr, tc.tc FROM layers, LATERAL (SELECT unnest(generate_series(greatest(0, floor((row - 5) / 16)::INTEGER), floor((row + 5) / 16)::INTEGER)) AS tr) tr, LATERAL (SELECT unnest(generate_series(greatest(0, floor((col - 5) / 16)::INTEGER), floor((col + 5) / 16)::INTEGER)) AS tc) tc),
near AS (SELECT a.row, a.col, min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) AS d2 FROM tiles a LEFT JOIN tiles b ON a.tr = b.tr AND a.tc = b.tc AND b.f AND abs(a.row - b.row) <= 7 AND abs(a.col - b.col) <= 7 WHERE a.row // 16 = a.tr AND a.col // 16 = a.tc GROUP BY a.row, a.col)
SELECT row, col, coalesce({_feather_sql(2.0)}, 0) AS alpha FROM near"""
)
def edge_feather_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = layers(spark, sf_dir).withColumn("m", F.when(F.col("m") < 60, F.col("m")).otherwise(0))
    return focal.edge_feather(mask, sigma=2.0, truncate=2.5, tile_size=16)


@query(
    f"""WITH {LAYERS}, h AS (SELECT max(row) + 1 AS h FROM layers), e AS (SELECT row, col, least(row, col, h - 1 - row, 63 - col) AS d FROM layers, h),
a AS (SELECT row, col, round_even(least(d, 12) / 12.0::DOUBLE * 255.0::DOUBLE, 0) / 255.0::DOUBLE AS t FROM e)
SELECT row, col, round_even(t * t * (3.0::DOUBLE - t * 2.0::DOUBLE) * 255.0::DOUBLE, 0)::INTEGER AS alpha FROM a"""
)
def vignette_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return focal.vignette(px(spark, sf_dir).select("row", "col"), g.height, g.width, border=20.0)


@query(
    f"""WITH {LAYERS}, h AS (SELECT max(row) + 1 AS h FROM layers), {_distance_sql('row = 0 OR col = 0 OR col = 63 OR row = h - 1 OR m <= 0', 'layers, h')},
a AS (SELECT d.row, d.col, m, round_even(least(sqrt(d2::DOUBLE), 12.0::DOUBLE) / 12.0::DOUBLE * 255.0::DOUBLE, 0) / 255.0::DOUBLE AS t FROM d JOIN layers USING (row, col))
SELECT row, col, round_even(m * round_even(t * t * (3.0::DOUBLE - t * 2.0::DOUBLE) * 255.0::DOUBLE, 0) / 255.0::DOUBLE, 0)::INTEGER AS m FROM a"""
)
def vignette_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alpha band multiplied with the vignette of what it shows."""
    g = grid(spark, sf_dir)
    return focal.vignette(layers(spark, sf_dir).select("row", "col", "m"), g.height, g.width, alpha="m", border=20.0, out="m")


@query()
def vignette_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With warp and grain from NumPy's generator, which SQL can't express."""
    g = grid(spark, sf_dir)
    return focal.vignette(px(spark, sf_dir).select("row", "col"), g.height, g.width, border=20.0, noise=20.0, warp=60.0, seed=7)


def _kernel_sql(sigma: float) -> str:
    w = focal.gaussian_kernel(sigma)
    return "kernel(o, w) AS (VALUES " + ", ".join(f"({i - len(w) // 2}, {x!r}::DOUBLE)" for i, x in enumerate(w)) + ")"


@query(
    f"""WITH {PX}, {_kernel_sql(1.5)}, down AS (SELECT p.row + k.o AS row, p.col, sum(p.v * k.w) AS v FROM px p, kernel k GROUP BY ALL),
across AS (SELECT d.row, d.col + k.o AS col, sum(d.v * k.w) AS v FROM down d, kernel k GROUP BY ALL)
SELECT p.row, p.col, round(a.v, 6) + 0.0 AS v FROM px p JOIN across a ON a.row = p.row AND a.col = p.col"""
)
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.gaussian_blur(px(spark, sf_dir), sigma=1.5).withColumn("v", F.round("v", 6) + 0.0)


@query(
    f"""WITH {LAYERS}, votes AS (SELECT h.row, h.col, n.code AS v, count(*) AS c FROM layers h JOIN layers n ON n.row BETWEEN h.row - 1 AND h.row + 1 AND n.col BETWEEN h.col - 1 AND h.col + 1
  WHERE h.code IN (40, 41) AND n.code NOT IN (40, 41) GROUP BY ALL),
best AS (SELECT row, col, v FROM votes QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY c DESC, v) = 1)
SELECT row, col, coalesce(b.v, l.code) AS code FROM layers l LEFT JOIN best b USING (row, col)"""
)
def inpaint_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.inpaint_mode(layers(spark, sf_dir).select("row", "col", "code"), [40, 41])


@query(
    f"""WITH {LAYERS}, near AS (SELECT h.row, h.col, sum(n.a1 / sqrt(((h.row - n.row) * (h.row - n.row) + (h.col - n.col) * (h.col - n.col))::DOUBLE)) / sum(1.0::DOUBLE / sqrt(((h.row - n.row) * (h.row - n.row) + (h.col - n.col) * (h.col - n.col))::DOUBLE)) AS f
  FROM layers h JOIN layers n ON n.row BETWEEN h.row - 3 AND h.row + 3 AND n.col BETWEEN h.col - 3 AND h.col + 3 WHERE h.a1 = 128 AND n.a1 <> 128 AND (h.row - n.row) * (h.row - n.row) + (h.col - n.col) * (h.col - n.col) <= 9 GROUP BY ALL)
SELECT row, col, round(coalesce(f, l.a1), 6) AS v FROM layers l LEFT JOIN near USING (row, col)"""
)
def fill_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = layers(spark, sf_dir).select("row", "col", F.col("a1").cast("double").alias("v"))
    return focal.fill_nodata(x, 128.0, radius=3).withColumn("v", F.round("v", 6))


# ---------------------------------------------------------------- color ramps

RAMP_TEXT = """# elevation ramp
3000 250 250 250 255
2200.5, 180, 160, 140
1500\t120 150 90
900 60 120 50 200

nv 0 0 0 0
100 30 90 160"""
_RAMP = "ramp(line_no, elev, elev_is_int, r, g, b, a) AS (VALUES (2, 3000.0::DOUBLE, true, 250, 250, 250, 255), (3, 2200.5::DOUBLE, false, 180, 160, 140, NULL), (4, 1500.0::DOUBLE, true, 120, 150, 90, NULL), (5, 900.0::DOUBLE, true, 60, 120, 50, 200), (8, 100.0::DOUBLE, true, 30, 90, 160, NULL))"


def _ramp(spark: SparkSession) -> DataFrame:
    return ramp.parse_ramp(ramp.lines_frame(spark, RAMP_TEXT))


def _shown(df: DataFrame) -> DataFrame:
    """Nulls as -1, false and empty, so that both engines give the same column types."""
    return df.fillna(-1).fillna(False).fillna("")


@query(f"WITH {_RAMP} SELECT line_no, true AS is_data, elev, elev_is_int, r, g, b, coalesce(a, -1) AS a, '' AS raw FROM ramp UNION ALL SELECT * FROM (VALUES (1, false, -1, false, -1, -1, -1, -1, '# elevation ramp'), (7, false, -1, false, -1, -1, -1, -1, 'nv 0 0 0 0'))")
def ramp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_ramp(spark))


_HSV = """h0 AS (SELECT *, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z FROM {source}),
h1 AS (SELECT *, greatest(x, y, z) AS hi, greatest(x, y, z) - least(x, y, z) AS span FROM h0),
hsv AS (SELECT *, hi AS v, CASE WHEN span = 0 THEN 0.0::DOUBLE ELSE span / hi END AS s,
  CASE WHEN span = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN x = hi THEN (y - z) / span WHEN y = hi THEN 2.0 + (z - x) / span ELSE 4.0 + (x - y) / span END) / 6.0 END AS hh FROM h1),
hsv1 AS (SELECT *, hh - floor(hh) AS h FROM hsv),
adj AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, v + (greatest(0.0::DOUBLE, 1.0 - v * 2.0) * {sh} + (1.0 - greatest(0.0::DOUBLE, 1.0 - v * 2.0) - greatest(0.0::DOUBLE, (v - 0.5) * 2.0)) * {mid} + greatest(0.0::DOUBLE, (v - 0.5) * 2.0) * {hig}))) AS v2,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, s * {sat}::DOUBLE)) AS s2, (1.0 - abs((v - 0.5) * 2.0)) * least(1.0::DOUBLE, s * 4.0) AS fade,
  CASE WHEN {t} / 360.0::DOUBLE - h > 0.5 THEN {t} / 360.0::DOUBLE - h - 1.0 WHEN {t} / 360.0::DOUBLE - h < -0.5 THEN {t} / 360.0::DOUBLE - h + 1.0 ELSE {t} / 360.0::DOUBLE - h END AS turn,
  abs(h - {c}::DOUBLE) AS away0 FROM hsv1),
adj1 AS (SELECT *, CASE WHEN {inside} THEN h + turn * fade * cos((CASE WHEN away0 > 0.5 THEN 1.0 - away0 ELSE away0 END) / ({w}::DOUBLE / 2.0) * (pi() / 2)) ELSE h END AS h9 FROM adj),
out0 AS (SELECT *, (h9 - floor(h9)) * 6.0 AS h6 FROM adj1)"""


def _hsv_sql(source: str, sat: float, sh: float, mid: float, hig: float, low: float, high: float, t: float) -> str:
    plain = low <= high
    inside = f"h >= {low}/360.0::DOUBLE {'AND' if plain else 'OR'} h <= {high}/360.0::DOUBLE"
    width = high / 360.0 - low / 360.0 if plain else (1.0 - low / 360.0) + high / 360.0
    centre = low / 360.0 + width / 2 if plain else (low / 360.0 + width / 2) % 1.0
    return _HSV.format(source=source, sat=sat, sh=sh, mid=mid, hig=hig, t=f"{t}::DOUBLE", c=repr(centre), w=repr(width), inside=inside if low != high else "false")


def _channel_sql(n: int) -> str:
    k = f"(({n} + h6) - 6.0 * floor(({n} + h6) / 6.0))"
    return f"greatest(0, least(255, round_even((v2 - v2 * s2 * greatest(0.0::DOUBLE, least({k}, 4.0 - {k}, 1.0::DOUBLE))) * 255.0, 0)::INTEGER))"


@query(f"WITH {RGB}, {_hsv_sql('rgb', 1.3, -0.05, 0.1, 0.02, 330.0, 60.0, 20.0)} SELECT k, n, {_channel_sql(5)} AS r, {_channel_sql(3)} AS g, {_channel_sql(1)} AS b FROM out0")
def hsv_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rgb(spark, sf_dir).withColumn("is_data", F.lit(True))
    return ramp.shift_colors(x, saturation=1.3, shadows=-0.05, mids=0.1, highlights=0.02, min_hue=330.0, max_hue=60.0, target_hue=20.0).select("k", "n", "r", "g", "b")


@query(
    f"""WITH {RGB}, {_hsv_sql('rgb', 0.8, 0.1, 0.0, -0.1, 90.0, 150.0, 120.0)} SELECT k, n, round(h9 - floor(h9), 6) AS h, round(s2, 6) AS s, round(v2, 6) AS v FROM out0"""
)
def hsv_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rgb(spark, sf_dir)
    x = x.select("k", "n", *(c.alias(a) for c, a in zip(rgb_to_hsv(*(F.col(c) / 255.0 for c in "rgb")), "hsv", strict=True)))
    new = adjust_hsv(F.col("h"), F.col("s"), F.col("v"), 0.8, 0.1, 0.0, -0.1, 90.0, 150.0, 120.0)
    return x.select("k", "n", *(F.round(c, 6).alias(a) for c, a in zip(new, "hsv", strict=True)))


@query(f"WITH {_RAMP}, {_hsv_sql('ramp', 1.5, 0.0, 0.1, 0.0, 60.0, 180.0, 150.0)} SELECT line_no, elev * 0.5 AS elev, {_channel_sql(5)} AS r, {_channel_sql(3)} AS g, {_channel_sql(1)} AS b, coalesce(a, -1) AS a FROM out0 UNION ALL SELECT * FROM (VALUES (1, -1, -1, -1, -1, -1), (7, -1, -1, -1, -1, -1))")
def adjust_color_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ramp.adjust_color_file(_ramp(spark), saturation=1.5, mid_adjust=0.1, min_hue=60.0, max_hue=180.0, target_hue=150.0, elev_adjust=0.5)
    return _shown(out.select("line_no", "elev", "r", "g", "b", "a"))


@query("SELECT * FROM (VALUES (1, '# elevation ramp'), (2, '4500.0 250 250 250 255'), (3, '3300.75 180 160 140'), (4, '2250.0 120 150 90'), (5, '1350.0 60 120 50 200'), (7, 'nv 0 0 0 0'), (8, '150.0 30 90 160')) t(line_no, text)")
def ramp_elev_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ramp.line_text(ramp.scale_elevation(_ramp(spark), 1.5))


@query(f"WITH {_RAMP}, o AS (SELECT *, row_number() OVER (ORDER BY elev DESC, line_no) - 1 AS ix FROM ramp) SELECT c.ix::INTEGER AS ix, round_even((c.elev + p.elev) / 2, 0) AS elev, round_even((c.r + p.r) / 2.0::DOUBLE, 0)::INTEGER AS r, round_even((c.g + p.g) / 2.0::DOUBLE, 0)::INTEGER AS g, round_even((c.b + p.b) / 2.0::DOUBLE, 0)::INTEGER AS b, coalesce(round_even((c.a + p.a) / 2.0::DOUBLE, 0)::INTEGER, -1) AS a FROM o c JOIN o p ON p.ix = c.ix - 1 WHERE c.ix = 2")
def ramp_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ramp.interpolate(_ramp(spark), 2))


@query(f"WITH {_RAMP}, o AS (SELECT *, (row_number() OVER (ORDER BY elev DESC, line_no) - 1)::INTEGER AS ix FROM ramp) SELECT ix, CASE WHEN ix = 1 THEN 2000.0 ELSE elev END AS elev, CASE WHEN ix = 1 THEN 9 ELSE r END AS r, CASE WHEN ix = 1 THEN 8 ELSE g END AS g, CASE WHEN ix = 1 THEN 7 ELSE b END AS b, coalesce(a, -1) AS a FROM o")
def ramp_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ramp.update_line(_ramp(spark), 1, 2000.0, (9, 8, 7)))


@query("SELECT * FROM (VALUES (1, '-100 239 62 21'), (2, '10000 239 62 21')) t(line_no, text)")
def ramp_of_one_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ramp.line_text(ramp.rgb_ramp(spark, "EF3E15"))


@query(
    f"""WITH {LAYERS}, {_RAMP}, stops AS (SELECT *, lead(elev) OVER w AS e1, lead(r) OVER w AS r1, lead(g) OVER w AS g1, lead(b) OVER w AS b1 FROM ramp WINDOW w AS (ORDER BY elev))
SELECT row, col, {', '.join(f'round_even(CASE WHEN l.elev <= 100 THEN {lo} WHEN l.elev >= 3000 THEN {hi} ELSE s.{c} + (s.{c}1 - s.{c}) * ((l.elev - s.elev) / (s.e1 - s.elev)) END, 0)::INTEGER AS {c}' for c, lo, hi in (('r', 30, 250), ('g', 90, 250), ('b', 160, 250)))}
FROM layers l LEFT JOIN stops s ON l.elev >= s.elev AND l.elev < s.e1"""
)
def color_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ramp.color_relief(layers(spark, sf_dir), _ramp(spark)).select("row", "col", "r", "g", "b")


_QML = '<qgis><pipe><rasterrenderer><colorPalette>' + "".join(f'<paletteEntry value="{v}" color="{c}" alpha="{a}" label="x"/>' for v, c, a in ((0, "#000000", 0), (1, "#574d42", 255), (2, "#625e5a", 255), (3, "#e3dbca", 255), (4, "#3a404a", 255))) + "</colorPalette></rasterrenderer></pipe></qgis>"


@query("WITH p(value, r, g, b, a) AS (VALUES (1, 87, 77, 66, 255), (2, 98, 94, 90, 255), (3, 227, 219, 202, 255), (4, 58, 64, 74, 255)) SELECT i::INTEGER AS value, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM generate_series(0, 255) t(i) LEFT JOIN p ON i = value")
def qml_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ramp.qml_lut(spark, _QML)


# ---------------------------------------------------------------- catalog


@query("SELECT 'doc' || doc_id || '.tif' AS name, octet_length(encode(coalesce(text, ''))) AS size_bytes, sha256(coalesce(text, '')) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'https://example.org/' || doc_id ELSE 'Unknown' END AS url FROM documents")
def manifest_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files; every third has a source."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".tif"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    files = docs.select(name.alias("name"), F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(content, 256).alias("sha256"))
    sources = docs.where("doc_id % 3 = 0").select(name.alias("name"), F.create_map(F.lit("url"), F.concat(F.lit("https://example.org/"), F.col("doc_id"))).alias("source"))
    return catalog.with_sources(files, sources).select("name", "size_bytes", "sha256", F.col("source")["url"].alias("url"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) IS NULL THEN 'file is missing' WHEN octet_length(encode(text)) < 1000 THEN octet_length(encode(text)) || ' bytes, fewer than 1000' WHEN doc_id % 7 = 0 THEN 'not a raster' WHEN (doc_id % 50) * (doc_id % 90) < 1000 THEN (doc_id % 50) * (doc_id % 90) || ' pixels, fewer than 1000' END AS error FROM documents")
def validate_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rasters = docs.select("doc_id", F.octet_length(F.col("text").cast("binary")).cast("long").alias("size_bytes"), F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 50).cast("int")).alias("width"), (F.col("doc_id") % 90).cast("int").alias("height"))
    return catalog.validate_rasters(rasters).select("doc_id", "error")


@query(f"WITH {LAYERS} SELECT DISTINCT code FROM layers WHERE code IN (20, 25, 30, 35, 58, 70) AND (col + 0.5) * 10.0 + 1000.0 <= 1150.0")
def presence_west_of_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = layers(spark, sf_dir)
    return catalog.presence(x, [20, 25, 30, 35, 58, 70], 1150.0, grid(spark, sf_dir).centre()[0])


@query(f"WITH {LAYERS} SELECT DISTINCT code FROM layers WHERE code IN (20, 25, 30, 35, 58, 70) AND (floor(col / 16) * 16 + 8.0) * 10.0 + 1000.0 <= 1150.0")
def presence_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.presence(layers(spark, sf_dir), [20, 25, 30, 35, 58, 70], 1150.0, F.lit(0.0), block=16, dx=10.0, x0=1000.0, width=64)


_SCHEMA_SQL = "opts(driver, name, type, lo, hi, vals) AS (VALUES " + ", ".join(f"('{d}', '{n}', '{t}', {lo if lo is not None else 'NULL'}::DOUBLE, {hi if hi is not None else 'NULL'}::DOUBLE, {[v.upper() for v in vals]}::VARCHAR[])" for d, o in catalog.OPTION_SCHEMAS.items() for n, (t, lo, hi, vals) in o.items()) + ")"


@query(
    f"""WITH {_SCHEMA_SQL}, f AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'GTiff' WHEN 1 THEN 'MBTiles' ELSE 'PNG' END AS driver,
  CASE event_id % 7 WHEN 0 THEN 'COMPRESS=FAKE' WHEN 1 THEN 'JPEG_QUALITY=' || (user_id % 150) WHEN 2 THEN 'interleave=' || event_type WHEN 3 THEN 'INTERLEAVE=pixel' WHEN 4 THEN 'TILED' WHEN 5 THEN 'QUALITY=' || (user_id % 130) ELSE 'BLOKSIZE=256' END AS flag FROM events),
p AS (SELECT *, upper(split_part(flag, '=', 1)) AS key, substr(flag, instr(flag, '=') + 1) AS value, contains(flag, '=') AS has FROM f)
SELECT p.id, p.driver, p.flag, p.key, p.value, CASE WHEN NOT has OR upper(p.driver) NOT IN ('GTIFF', 'MBTILES') OR p.key IN ('COPY_SRC_OVERVIEWS', 'COMPRESS', 'NUM_THREADS', 'BIGTIFF') THEN NULL
  WHEN o.name IS NULL THEN 'unknown option' WHEN o.type = 'int' AND try_cast(value AS DOUBLE) < lo THEN 'below the minimum' WHEN o.type = 'int' AND try_cast(value AS DOUBLE) > hi THEN 'above the maximum'
  WHEN len(vals) > 0 AND NOT list_contains(vals, upper(value)) THEN 'not an allowed value' END AS error
FROM p LEFT JOIN opts o ON o.driver = upper(p.driver) AND o.name = p.key"""
)
def option_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as command-line flags."""
    e = table(spark, sf_dir, "events")
    driver = F.when(F.col("event_id") % 3 == 0, "GTiff").when(F.col("event_id") % 3 == 1, "MBTiles").otherwise("PNG")
    number = lambda n: (F.col("user_id") % n).cast("string")
    kinds = [F.lit("COMPRESS=FAKE"), F.concat(F.lit("JPEG_QUALITY="), number(150)), F.concat(F.lit("interleave="), F.col("event_type")), F.lit("INTERLEAVE=pixel"), F.lit("TILED"), F.concat(F.lit("QUALITY="), number(130)), F.lit("BLOKSIZE=256")]
    flag = F.element_at(F.array(*kinds), (F.col("event_id") % 7 + 1).cast("int"))
    flags = e.select(F.col("event_id").alias("id"), driver.alias("driver"), flag.alias("flag"))
    return catalog.check_options(flags, catalog.option_schema(spark))


@query("WITH m AS (SELECT o_orderkey AS path, 'VERSION' AS key, o_orderstatus AS value FROM orders), c AS (SELECT DISTINCT l_orderkey AS path, 'VERSION' AS key, 'new' AS value FROM lineitem WHERE l_quantity > 49) SELECT path, key, value FROM c UNION ALL SELECT path, key, value FROM m WHERE path NOT IN (SELECT path FROM c)")
def version_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.lit("VERSION").alias("key"), F.col("o_orderstatus").alias("value"))
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("path"), F.lit("VERSION").alias("key"), F.lit("new").alias("value")).distinct()
    return catalog.set_tags(tags, new)


@query("SELECT c_custkey AS path, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS value FROM customer")
def version_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), "c_name")
    return catalog.get_tag(c.where("path % 4 <> 0").select("path", F.lit("VERSION").alias("key"), F.col("c_name").alias("value")), c)


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 160) || ' ... ' || right(text, 160) END AS text FROM documents")
def shorten_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", shorten(F.col("text")).alias("text"))


flagship = reclass_classes
