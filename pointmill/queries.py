"""The registered queries of the point-cloud operators on the scene made from ``lineitem``, and their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .operators import components as C
from .operators import crowns, ground, measure, noise, objects, quality, raster, tables, terrain, tilestore
from .operators.quality import Frame
from .scene import points, scene_cte
from .storage import removed_at_exit, settled, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Grid of the scene: row and col of a point, as in :func:`quality.with_cells`.
FR = "fr AS (SELECT min(x) AS x0, min(z) AS z0, CAST(floor(max(x) - min(x)) AS INTEGER) + 1 AS cols, CAST(floor(max(z) - min(z)) AS INTEGER) + 1 AS rws FROM pts)"
CELLED = "pc AS (SELECT pts.*, CAST(greatest(0, least(rws - 1, floor(z - z0))) AS INTEGER) AS row, CAST(greatest(0, least(cols - 1, floor(x - x0))) AS INTEGER) AS col FROM pts CROSS JOIN fr)"
BASE = f"{scene_cte()}, {FR}, {CELLED}"
NOISE = "classification IN (7, 18)"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query of (spark, sf_dir) and its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def hag_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene with exact heights above its terrain."""
    return points(spark, sf_dir).withColumn("height_above_ground", F.col("y") - F.col("terrain"))


def low_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Frame]:
    p = points(spark, sf_dir)
    frame = Frame.of(p)
    return raster.minimum_surface(p, frame), frame


LOW = f"{BASE}, lo AS (SELECT row, col, min(y) AS value FROM pc WHERE NOT {NOISE} GROUP BY row, col)"


# ------------------------------------------------------------ projections, filters, histograms


@query(scene_cte() + """
SELECT count(*) AS n, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z,
  (min(x) + max(x)) / 2e0 AS center_x, (min(y) + max(y)) / 2e0 AS center_y, (min(z) + max(z)) / 2e0 AS center_z,
  max(x) - min(x) AS size_x, max(y) - min(y) AS size_y, max(z) - min(z) AS size_z,
  round(sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y)) + (max(z) - min(z)) * (max(z) - min(z))), 6) AS diagonal FROM pts""")
def bounds(spark, sf_dir):
    return tables.bounds(points(spark, sf_dir)).withColumn("diagonal", F.round("diagonal", 6))


@query(scene_cte() + """
SELECT floor((min(x) + max(x) + 1086000e0) / 2e0 / 1000e0 + 0.5e0) * 1000e0 AS origin_x, floor((min(y) + max(y)) / 2e0 / 1000e0 + 0.5e0) * 1000e0 AS origin_y,
  floor((min(z) + max(z) - 8358000e0) / 2e0 / 1000e0 + 0.5e0) * 1000e0 AS origin_z FROM pts""")
def choose_origin(spark, sf_dir):
    # The scene moved to map coordinates of a survey.
    return tables.choose_origin(points(spark, sf_dir).withColumns({"x": F.col("x") + 543000.0, "z": F.col("z") - 4179000.0}))


@query(scene_cte() + "SELECT pid, 543000e0 + x AS east, -(-4179000e0 + z) + 0e0 AS north, 0e0 + y AS elevation FROM pts")
def map_coordinates(spark, sf_dir):
    return points(spark, sf_dir).select("pid", *G.map_coordinates(F.col("x"), F.col("y"), F.col("z"), (543000.0, 0.0, -4179000.0)))


_DENSE = scene_cte() + ", nu AS (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS i, count(*) OVER () AS m FROM pts) "


def _dense(spark, sf_dir):
    """The scene with each point's place i in the order of pid, from 0."""
    return C.numbered(points(spark, sf_dir), ["pid"], "i").withColumn("i", F.col("i") - 1)


@query(_DENSE + "SELECT pid, x, y, z FROM nu WHERE i % 7 = 0")
def thin_every_n(spark, sf_dir):
    return tables.thin_every(_dense(spark, sf_dir), 7, "i").select("pid", "x", "y", "z")


@query(_DENSE + "SELECT pid, x, y, z FROM nu WHERE floor((i + 1) * (m // 3) * 1e0 / m) <> floor(i * (m // 3) * 1e0 / m)")
def trim_to_target(spark, sf_dir):
    """A third of the points, evenly."""
    p = points(spark, sf_dir)
    n = p.count()
    return tables.trim_to(_dense(spark, sf_dir), n // 3, n, "i").select("pid", "x", "y", "z")


@query(scene_cte() + "SELECT classification, count(*) AS n FROM pts GROUP BY classification")
def class_histogram(spark, sf_dir):
    return tables.class_histogram(points(spark, sf_dir))


_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in G.CLASS_NAMES.items())


@query(scene_cte() + f"""
SELECT classification, CASE classification {_NAMES} ELSE 'Class ' || classification END AS name, count(*) AS n,
  floor(count(*) * 100e0 / any_value(t.total) * 1000e0 + 0.5e0) / 1000e0 + 0e0 AS share FROM pts CROSS JOIN (SELECT count(*) AS total FROM pts) t GROUP BY classification""")
def class_summary(spark, sf_dir):
    return tables.class_summary(points(spark, sf_dir))


@query(scene_cte() + "SELECT point_source_id, count(*) AS n FROM pts GROUP BY point_source_id")
def flight_line_histogram(spark, sf_dir):
    return tables.flight_line_histogram(points(spark, sf_dir))


@query(scene_cte() + f"SELECT pid, classification FROM pts WHERE NOT {NOISE}")
def without_noise(spark, sf_dir):
    return tables.without_noise(points(spark, sf_dir)).select("pid", "classification")


@query(scene_cte() + "SELECT pid, return_number FROM pts WHERE return_number <= 1")
def first_returns(spark, sf_dir):
    return tables.first_returns(points(spark, sf_dir)).select("pid", "return_number")


@query(scene_cte() + "SELECT round(sum(CASE WHEN number_of_returns <= 1 THEN 1 ELSE 0 END) * 1e0 / count(*), 6) AS single_share, max(number_of_returns) AS max_returns FROM pts")
def returns_summary(spark, sf_dir):
    return tables.returns_summary(points(spark, sf_dir))


@query(scene_cte() + f"SELECT CAST(sum(CASE WHEN {NOISE} THEN 1 ELSE 0 END) AS BIGINT) AS noise, count(*) AS n, round(sum(CASE WHEN {NOISE} THEN 1 ELSE 0 END) * 1e0 / count(*), 6) AS share FROM pts")
def noise_share(spark, sf_dir):
    return tables.noise_share(points(spark, sf_dir))


@query(scene_cte() + f"SELECT pid, x + 543000e0 AS east, 4179000e0 - z + 0e0 AS north, y + 0e0 AS elevation, CASE classification {_NAMES} END AS class_name, return_number, number_of_returns, point_source_id FROM pts WHERE pid = (SELECT min(pid) FROM pts)")
def describe_point(spark, sf_dir):
    p = points(spark, sf_dir)
    return tables.describe_point(p, p.agg(F.min("pid")).first()[0], (543000.0, 0.0, -4179000.0))


@query(scene_cte() + """
, b AS (SELECT min(x) AS bx, min(y) AS b_y, min(z) AS bz FROM pts)
SELECT pid, round(sqrt((x - bx) * (x - bx) + (y - b_y) * (y - b_y) + (z - bz) * (z - bz)), 6) AS distance, round(sqrt((x - bx) * (x - bx) + (z - bz) * (z - bz)), 6) AS horizontal,
  round(y - b_y, 6) AS vertical, round(CASE WHEN y = b_y AND x = bx AND z = bz THEN 0e0 ELSE degrees(atan2(abs(y - b_y), sqrt((x - bx) * (x - bx) + (z - bz) * (z - bz)))) END, 6) AS slope FROM pts CROSS JOIN b""")
def ruler_measure(spark, sf_dir):
    p = points(spark, sf_dir)
    b = p.agg(F.min("x"), F.min("y"), F.min("z")).first()
    m = G.measure_between(*(F.col(c) - F.lit(v) for c, v in zip("xyz", b, strict=True)))
    out = p.select("pid", *m)
    return out.select("pid", *(F.round(c, 6).alias(c) for c in ("distance", "horizontal", "vertical", "slope")))


@query(scene_cte() + """
SELECT pid, round(point_source_id * 0.6180339887e0 - floor(point_source_id * 0.6180339887e0), 6) AS hue,
  CASE WHEN y - terrain < -0.25e0 THEN 'below' WHEN y - terrain <= 0.25e0 THEN 'ground' ELSE 'above' END AS band,
  round(sqrt(least(1e0, greatest(0e0, y - terrain) / 30e0)), 6) AS ramp, round(pow(intensity / 4095e0, 0.8e0), 6) AS brightness FROM pts""")
def colour_modes(spark, sf_dir):
    h = F.col("height_above_ground")
    return hag_points(spark, sf_dir).select(
        "pid", F.round(G.flight_line_hue(F.col("point_source_id").cast("double")), 6).alias("hue"), F.when(h < -0.25, "below").when(h <= 0.25, "ground").otherwise("above").alias("band"),
        F.round(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h) / 30.0)), 6).alias("ramp"), F.round(F.pow(F.col("intensity") / 4095.0, F.lit(0.8)), 6).alias("brightness"),
    )


def _mix_sql(a, b, t: str) -> str:
    return "[" + ", ".join(f"{x}e0 + ({y}e0 - {x}e0) * ({t})" for x, y in zip(a, b, strict=True)) + "]"


def _hsl_sql(hue: str, saturation: float, lightness: str) -> str:
    part = lambda k: f"({lightness}) + {saturation}e0 * (greatest(0e0, least(1e0, abs((({hue}) * 6 + {k}e0) - floor((({hue}) * 6 + {k}e0) / 6) * 6 - 3) - 1)) - 0.5e0) * (1 - abs(2 * ({lightness}) - 1))"
    return f"[{part(0)}, {part(4)}, {part(2)}]"


_CLASS_HEX = " ".join(f"WHEN {k} THEN '{v}'" for k, v in G.CLASS_COLOURS.items())
_ABOVE = " ".join(f"WHEN t < {t1}e0 OR {t1} = 1 THEN {_mix_sql(a, b, f'(t - {t0}e0) / {t1 - t0!r}e0')}" for (t0, a), (t1, b) in zip(G.ABOVE_STOPS, G.ABOVE_STOPS[1:], strict=False))
_PACKED = ", ".join(f"CAST(list_reduce(list_prepend(0e0, list_transform({c}, lambda v: floor(v * 255 + 0.5e0))), lambda a, v: a * 256 + v) AS INTEGER) AS {c}" for c in ("height", "rgb", "class", "above", "object", "grey", "line"))


@query(scene_cte() + f""", ra AS (SELECT min(y) AS lo, max(y) AS hi FROM pts),
cc AS (SELECT pid, classification, CASE classification {_CLASS_HEX} ELSE '{G.OTHER_COLOUR}' END AS hex, greatest(0e0, least(1e0, (y - lo) / (hi - lo))) AS u, r, g, b, kind, intensity, point_source_id, y - terrain AS h, sqrt(greatest(0e0, least(1e0, (y - terrain - 0.25e0) / 29.75e0))) AS t FROM pts CROSS JOIN ra),
cl AS (SELECT pid, {_mix_sql(G.LOW_HEIGHT, G.HIGH_HEIGHT, "u")} AS height, [r / 255e0, g / 255e0, b / 255e0] AS rgb, [CAST(('0x' || substr(hex, 2, 2)) AS INTEGER) / 255e0, CAST(('0x' || substr(hex, 4, 2)) AS INTEGER) / 255e0, CAST(('0x' || substr(hex, 6, 2)) AS INTEGER) / 255e0] AS class,
  CASE WHEN h < -0.25e0 THEN {_mix_sql(G.UNDER, G.DEEP_UNDER, "greatest(0e0, least(1e0, (-h - 0.25e0) / 4))")} WHEN h < 0.25e0 THEN [{", ".join(f"{v}e0" for v in G.AT_GROUND)}] ELSE CASE {_ABOVE} END END AS above,
  CASE WHEN kind = 0 AND classification = 2 THEN [{", ".join(f"{v}e0" for v in G.NO_OBJECT_GROUND)}] WHEN kind = 0 THEN [{", ".join(f"{v}e0" for v in G.NO_OBJECT)}]
    WHEN kind <= 2 THEN {_hsl_sql("(kind * 0.6180339887e0 - floor(kind * 0.6180339887e0)) * 0.12e0", 0.75, "(kind * 0.7548776662e0 - floor(kind * 0.7548776662e0)) * 0.14e0 + 0.5e0")}
    ELSE {_hsl_sql("(kind * 0.6180339887e0 - floor(kind * 0.6180339887e0)) * 0.2e0 + 0.22e0", 0.6, "(kind * 0.7548776662e0 - floor(kind * 0.7548776662e0)) * 0.18e0 + 0.38e0")} END AS object,
  [pow(least(1e0, intensity / 4095e0), 0.8e0) * 0.92e0 + 0.04e0] AS grey, {_hsl_sql("point_source_id * 0.6180339887e0 - floor(point_source_id * 0.6180339887e0)", 0.72, "0.56e0")} AS line FROM cc)
SELECT pid, {_PACKED} FROM cl""")
def point_colours(spark, sf_dir):
    """Every point's colour by height, scan colour (and relief), class, height above ground, object, intensity and flight line."""
    p = hag_points(spark, sf_dir)
    lo, hi = map(F.lit, p.agg(F.min("y"), F.max("y")).first())
    code = F.col("classification")
    modes = {
        "height": G.colour_by_height(F.col("y"), lo, hi), "rgb": G.colour_by_rgb(F.col("r"), F.col("g"), F.col("b")), "class": G.colour_by_class(code), "above": G.colour_above_ground(F.col("height_above_ground"), F.lit(30.0)),
        "object": G.colour_by_object(F.col("kind"), code, F.lit(2)), "grey": F.slice(G.colour_by_intensity(F.col("intensity"), F.lit(0.0), F.lit(4095.0)), 1, 1), "line": G.colour_by_line(F.col("point_source_id")),
    }
    # Packed as red, green and blue of a byte each.
    return p.select("pid", *(F.aggregate(c, F.lit(0.0), lambda acc, v: acc * 256 + F.floor(v * 255 + 0.5)).cast("int").alias(k) for k, c in modes.items()))


@query(scene_cte() + f"SELECT classification, CASE classification {_CLASS_HEX} ELSE '{G.OTHER_COLOUR}' END AS colour, count(*) AS n FROM pts GROUP BY classification")
def class_palette(spark, sf_dir):
    """The classes of the scan and their colours."""
    h = tables.class_histogram(points(spark, sf_dir))
    return h.select("classification", G.class_colour(F.col("classification")).alias("colour"), "n")


@query(scene_cte() + ", s AS (SELECT intensity, row_number() OVER (ORDER BY intensity, pid) AS k, count(*) OVER () AS m FROM pts) SELECT intensity AS value FROM s WHERE k = CAST(floor(0.98e0 * (m - 1)) AS BIGINT) + 1")
def intensity_top(spark, sf_dir):
    return tables.upper_percentile(points(spark, sf_dir), "intensity", 0.98)


# ------------------------------------------------------------ grids


@query(LOW + " SELECT row, col, value FROM lo")
def min_surface(spark, sf_dir):
    return low_grid(spark, sf_dir)[0]


@query(BASE + " SELECT row, col, avg(y) AS value FROM pc WHERE classification = 2 GROUP BY row, col")
def mean_ground_surface(spark, sf_dir):
    p = points(spark, sf_dir)
    return raster.mean_ground_surface(p, Frame.of(p))


def _speckles(src: str, out: str) -> str:
    return f"""{out}_n AS (SELECT g.row + i AS row, g.col + j AS col, count(*) AS n, avg(value) AS m FROM {src} g CROSS JOIN (SELECT * FROM (VALUES (-1), (0), (1)) a(i) CROSS JOIN (VALUES (-1), (0), (1)) b(j)) o
  CROSS JOIN sg WHERE NOT (i = 0 AND j = 0) AND g.row + i BETWEEN 1 AND sr - 2 AND g.col + j BETWEEN 1 AND sc - 2 GROUP BY 1, 2 HAVING count(*) >= 4),
{out} AS (SELECT row, col, value FROM {src} UNION ALL SELECT row, col, m FROM {out}_n h WHERE NOT EXISTS (SELECT 1 FROM {src} g WHERE g.row = h.row AND g.col = h.col))"""


def _surface_cte(agg: str, cell: str) -> str:
    return f"""sg AS (SELECT min(x) AS x0, min(z) AS z0, CAST(ceil((max(x) - min(x)) / {cell}) AS INTEGER) + 1 AS sc, CAST(ceil((max(z) - min(z)) / {cell}) AS INTEGER) + 1 AS sr FROM pts),
g0 AS (SELECT CAST(floor((z - z0) / {cell}) AS INTEGER) AS row, CAST(floor((x - x0) / {cell}) AS INTEGER) AS col, {agg}(y) AS value FROM pts CROSS JOIN sg WHERE NOT {NOISE} GROUP BY 1, 2),
{_speckles("g0", "g1")}, {_speckles("g1", "g2")}"""


def _surface_sql(agg: str, cell: str) -> str:
    return f"{scene_cte()}, {_surface_cte(agg, cell)} SELECT row, col, floor(value * 1048576e0 + 0.5e0) / 1048576e0 AS value FROM g2"


def _surface(spark, sf_dir, how: str, cell: float = 0.5):
    p = points(spark, sf_dir)
    b = p.agg(F.min("x"), F.min("z"), F.max("x"), F.max("z")).first()
    cols, rows = math.ceil((b[2] - b[0]) / cell) + 1, math.ceil((b[3] - b[1]) / cell) + 1
    return raster.surface_grid(p, b[0], b[1], cell, cols, rows, how), (b[0], b[1], cell, cols, rows)


@query(_surface_sql("max", "0.5e0"))
def surface_grid_highest(spark, sf_dir):
    return _surface(spark, sf_dir, "highest")[0].withColumn("value", F.floor(F.col("value") * 1048576.0 + 0.5) / 1048576.0)


@query(_surface_sql("avg", "0.5e0"))
def surface_grid_mean(spark, sf_dir):
    return _surface(spark, sf_dir, "mean")[0].withColumn("value", F.floor(F.col("value") * 1048576.0 + 0.5) / 1048576.0)


@query(f"{LOW}, sg AS (SELECT cols AS sc, rws AS sr FROM fr), {_speckles('lo', 'g1')} SELECT row, col, round(value, 6) AS value FROM g1")
def fill_speckles(spark, sf_dir):
    g, f = low_grid(spark, sf_dir)
    return raster.fill_speckles(g, f.rows, f.cols).withColumn("value", F.round("value", 6))


def _slide_sql(src: str, out: str, agg: str, r: int) -> str:
    return f"""{out}_a AS (SELECT row, col, {agg}(value) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS value FROM {src}),
{out} AS (SELECT row, col, {agg}(value) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS value FROM {out}_a)"""


@query(f"{LOW}, {_slide_sql('lo', 'e', 'min', 3)} SELECT * FROM e")
def erode(spark, sf_dir):
    return raster.erode(low_grid(spark, sf_dir)[0], 3)


@query(f"{LOW}, {_slide_sql('lo', 'd', 'max', 2)} SELECT * FROM d")
def dilate(spark, sf_dir):
    return raster.dilate(low_grid(spark, sf_dir)[0], 2)


@query(f"{LOW}, {_slide_sql('lo', 'e', 'min', 5)}, {_slide_sql('e', 'd', 'max', 5)} SELECT * FROM d")
def open_clipped(spark, sf_dir):
    return raster.open_clipped(low_grid(spark, sf_dir)[0], 5)


@query(f"{BASE}, m AS (SELECT row, col, CAST(max(CASE WHEN kind IN (1, 2) THEN 1 ELSE 0 END) AS INTEGER) AS value FROM pc GROUP BY row, col), {_slide_sql('m', 'a', 'min', 1)}, {_slide_sql('a', 'b', 'max', 1)}, {_slide_sql('b', 'c', 'max', 1)}, {_slide_sql('c', 'd', 'min', 1)} SELECT * FROM d")
def binary_open_close(spark, sf_dir):
    p = points(spark, sf_dir)
    m = quality.with_cells(p, Frame.of(p)).groupBy("row", "col").agg(F.max(F.col("kind").isin(1, 2).cast("int")).alias("value"))
    return raster.binary_open_close(m)


FILLED = f"""{LOW}, c1 AS (SELECT CAST(floor(row / 2e0) AS INTEGER) AS row, CAST(floor(col / 2e0) AS INTEGER) AS col, avg(value) AS value FROM lo GROUP BY 1, 2),
cr AS (SELECT CAST(floor((rws + 1) / 2e0) AS INTEGER) AS rr, CAST(floor((cols + 1) / 2e0) AS INTEGER) AS cc FROM fr),
allc AS (SELECT CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col FROM fr, LATERAL (SELECT unnest(range(rws)) AS i) r, LATERAL (SELECT unnest(range(cols)) AS i) c),
em AS (SELECT a.row, a.col, greatest(0e0, least(rr - 1, (a.col + 0.5e0) / 2e0 - 0.5e0)) AS u, greatest(0e0, least(cc - 1, (a.row + 0.5e0) / 2e0 - 0.5e0)) AS v, rr, cc FROM allc a CROSS JOIN cr WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.row = a.row AND lo.col = a.col)),
pl AS (SELECT e.row, e.col, u - floor(u) AS fu, v - floor(v) AS fv, nw.value AS nw, coalesce(ne.value, nw.value) AS ne, coalesce(sw.value, nw.value) AS sw, coalesce(se.value, sw.value, ne.value, nw.value) AS se FROM em e
  LEFT JOIN c1 nw ON nw.row = floor(v) AND nw.col = floor(u) LEFT JOIN c1 ne ON ne.row = floor(v) AND ne.col = floor(u) + 1 LEFT JOIN c1 sw ON sw.row = floor(v) + 1 AND sw.col = floor(u) LEFT JOIN c1 se ON se.row = floor(v) + 1 AND se.col = floor(u) + 1),
fd AS (SELECT row, col, value FROM lo UNION ALL SELECT row, col, nw + (ne - nw) * fu + ((sw + (se - sw) * fu) - (nw + (ne - nw) * fu)) * fv FROM pl)"""
FILLED = FILLED.replace("least(rr - 1, (a.col", "least(cc - 1, (a.col").replace("least(cc - 1, (a.row", "least(rr - 1, (a.row")


@query(FILLED + " SELECT row, col, round(value, 6) AS value FROM fd")
def push_pull_fill(spark, sf_dir):
    g, f = low_grid(spark, sf_dir)
    return raster.push_pull(g, f.rows, f.cols).withColumn("value", F.round("value", 6))


@query(FILLED + f""", x1 AS (SELECT row, col, value FROM fd UNION ALL SELECT a.row, -1, 2 * a.value - b.value FROM fd a JOIN fd b ON b.row = a.row AND b.col = 1 WHERE a.col = 0
  UNION ALL SELECT a.row, cols, 2 * a.value - b.value FROM fd a CROSS JOIN fr JOIN fd b ON b.row = a.row AND b.col = cols - 2 WHERE a.col = cols - 1),
x2 AS (SELECT row, col, value FROM x1 UNION ALL SELECT -1, a.col, 2 * a.value - b.value FROM x1 a JOIN x1 b ON b.col = a.col AND b.row = 1 WHERE a.row = 0
  UNION ALL SELECT rws, a.col, 2 * a.value - b.value FROM x1 a CROSS JOIN fr JOIN x1 b ON b.col = a.col AND b.row = rws - 2 WHERE a.row = rws - 1), {_slide_sql('x2', 'e', 'min', 1)}, {_slide_sql('e', 'd', 'max', 1)}
SELECT row, col, round(least(d.value, fd.value), 6) AS value FROM d JOIN fd USING (row, col)""")
def open_extrapolated_r1(spark, sf_dir):
    g, f = low_grid(spark, sf_dir)
    return raster.opened(raster.push_pull(g, f.rows, f.cols), f.rows, f.cols, 1).withColumn("value", F.round("value", 6))


@query(FILLED + """, sl AS (SELECT row, col, value, lag(value) OVER r AS w, lead(value) OVER r AS e, lag(value) OVER c AS n, lead(value) OVER c AS s FROM fd WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row)),
gr AS (SELECT row, col, (coalesce(e, value) - coalesce(w, value)) / (CASE WHEN e IS NULL OR w IS NULL THEN 1e0 ELSE 2e0 END) AS gx, (coalesce(s, value) - coalesce(n, value)) / (CASE WHEN s IS NULL OR n IS NULL THEN 1e0 ELSE 2e0 END) AS gz FROM sl)
SELECT row, col, round(sqrt(gx * gx + gz * gz), 6) AS value FROM gr""")
def slope(spark, sf_dir):
    g, f = low_grid(spark, sf_dir)
    return raster.slope(raster.push_pull(g, f.rows, f.cols), f.cell).withColumn("value", F.round("value", 6))


@query(FILLED + """, q AS (SELECT pid, greatest(0e0, least(cols - 1, x - x0 - 0.5e0)) AS u, greatest(0e0, least(rws - 1, z - z0 - 0.5e0)) AS v FROM pts CROSS JOIN fr),
b AS (SELECT pid, u - floor(u) AS fu, v - floor(v) AS fv, nw.value AS nw, coalesce(ne.value, nw.value) AS ne, coalesce(sw.value, nw.value) AS sw, coalesce(se.value, CASE WHEN sw.value IS NULL THEN coalesce(ne.value, nw.value) ELSE sw.value END) AS se FROM q
  JOIN fd nw ON nw.row = floor(v) AND nw.col = floor(u) LEFT JOIN fd ne ON ne.row = floor(v) AND ne.col = floor(u) + 1 LEFT JOIN fd sw ON sw.row = floor(v) + 1 AND sw.col = floor(u) LEFT JOIN fd se ON se.row = floor(v) + 1 AND se.col = floor(u) + 1)
SELECT pid, round(nw + (ne - nw) * fu + ((sw + (se - sw) * fu) - (nw + (ne - nw) * fu)) * fv, 6) AS surface FROM b""")
def bilinear_sample(spark, sf_dir):
    g, f = low_grid(spark, sf_dir)
    own = points(spark, sf_dir).select("pid", "x", "z")
    return raster.bilinear(own, raster.push_pull(g, f.rows, f.cols), f).select("pid", F.round("surface", 6).alias("surface"))


_O9 = "(SELECT * FROM (VALUES (-1), (0), (1)) a(i) CROSS JOIN (VALUES (-1), (0), (1)) b(j)) o"
PITS = f"""{LOW}, nb AS (SELECT g.row + i AS row, g.col + j AS col, list_sort(list(value)) AS ns FROM lo g CROSS JOIN {_O9} WHERE NOT (i = 0 AND j = 0) GROUP BY 1, 2),
cd AS (SELECT lo.row, lo.col, value FROM lo JOIN nb USING (row, col) WHERE len(ns) >= 3 AND value < ns[CAST(floor((len(ns) - 1) / 2e0) AS INTEGER) + 1] - 0.25e0),
pr AS (SELECT a.row, a.col, b.row AS r2, b.col AS c2 FROM cd a JOIN cd b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND NOT (a.row = b.row AND a.col = b.col)),
kk AS (SELECT cd.row, cd.col, count(r2) AS k, max(r2) AS r2, max(c2) AS c2 FROM cd LEFT JOIN pr USING (row, col) GROUP BY 1, 2),
sm AS (SELECT a.* FROM kk a LEFT JOIN kk b ON b.row = a.r2 AND b.col = a.c2 WHERE a.k = 0 OR (a.k = 1 AND b.k = 1)),
so AS (SELECT g.row + i AS row, g.col + j AS col, min(value) AS m FROM (SELECT * FROM lo WHERE NOT EXISTS (SELECT 1 FROM cd WHERE cd.row = lo.row AND cd.col = lo.col)) g CROSS JOIN {_O9} WHERE NOT (i = 0 AND j = 0) GROUP BY 1, 2),
up AS (SELECT sm.row, sm.col, least(coalesce(a.m, b.m), coalesce(b.m, a.m)) AS up FROM sm LEFT JOIN so a ON a.row = sm.row AND a.col = sm.col LEFT JOIN so b ON sm.k = 1 AND b.row = sm.r2 AND b.col = sm.c2)
SELECT lo.row, lo.col, coalesce(up, value) AS value, up IS NOT NULL AS lifted FROM lo LEFT JOIN up USING (row, col)"""


@query(PITS)
def pits_raised(spark, sf_dir):
    g, f = low_grid(spark, sf_dir)
    return raster.raise_pits(g, f.rows, f.cols, 0.25)


@query(f"{LOW}, n AS (SELECT g.row + i AS row, g.col + j AS col, avg(value) AS value FROM lo g CROSS JOIN {_O9} GROUP BY 1, 2) SELECT lo.row, lo.col, round(n.value, 6) AS value FROM lo JOIN n USING (row, col)")
def smooth_grid(spark, sf_dir):
    return raster.smooth(low_grid(spark, sf_dir)[0], 1).withColumn("value", F.round("value", 6))


@query(f"{LOW}, n AS (SELECT g.row + i AS row, g.col + j AS col, sum(value * (2e0 - abs(i)) * (2e0 - abs(j))) / sum((2e0 - abs(i)) * (2e0 - abs(j))) AS value FROM lo g CROSS JOIN {_O9} GROUP BY 1, 2) SELECT lo.row, lo.col, round(n.value, 6) AS value FROM lo JOIN n USING (row, col)")
def smooth_canopy(spark, sf_dir):
    return raster.smooth_canopy(low_grid(spark, sf_dir)[0]).withColumn("value", F.round("value", 6))


@query(f"{LOW}, n AS (SELECT g.row + i AS row, g.col + j AS col, list_sort(list(value)) AS v FROM lo g CROSS JOIN {_O9} CROSS JOIN fr WHERE NOT (i = 0 AND j = 0) AND g.row + i BETWEEN 1 AND rws - 2 AND g.col + j BETWEEN 1 AND cols - 2 GROUP BY 1, 2) SELECT row, col, value FROM lo UNION ALL SELECT row, col, v[CAST(floor(len(v) / 2e0) AS INTEGER) + 1] FROM n WHERE len(v) >= 5 AND NOT EXISTS (SELECT 1 FROM lo WHERE lo.row = n.row AND lo.col = n.col)")
def fill_isolated_gaps(spark, sf_dir):
    g, f = low_grid(spark, sf_dir)
    return raster.fill_isolated_gaps(g, f.rows, f.cols)


def _plane_round(src: str, out: str, last: bool) -> str:
    """Cells (row, col, i, j, v) of src with their distance from their plane; but for the last round, without the lowest where it may go."""
    drop = "" if last else " WHERE NOT (n > 6 AND res < -0.15e0 AND k = 1)"
    return f"""{out}_s AS (SELECT row, col, count(*) AS n, avg(i) AS mi, avg(j) AS mj, avg(v) AS mv FROM {src} GROUP BY 1, 2),
{out}_d AS (SELECT c.row, c.col, i, j, v, s.n, i - mi AS a, j - mj AS b, v - mv AS d FROM {src} c JOIN {out}_s s ON s.row = c.row AND s.col = c.col),
{out}_q AS (SELECT row, col, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * d) AS ad, sum(b * d) AS bd FROM {out}_d GROUP BY 1, 2),
{out}_r AS (SELECT c.*, d - CASE WHEN abs(aa * bb - ab * ab) > 1e-9 THEN (a * (ad * bb - bd * ab) + b * (bd * aa - ad * ab)) / (aa * bb - ab * ab) ELSE 0e0 END AS res FROM {out}_d c JOIN {out}_q USING (row, col)),
{out} AS (SELECT row, col, i, j, v, n, res FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY round(res, 9), i, j) AS k FROM {out}_r) q{drop})"""


@query(f"""{LOW}, nb AS (SELECT g.row + i AS row, g.col + j AS col, -i * 1e0 AS i, -j * 1e0 AS j, value AS v FROM lo g CROSS JOIN {_O9}), n0 AS (SELECT nb.* FROM nb JOIN lo USING (row, col)),
{_plane_round("n0", "n1", False)}, {_plane_round("n1", "n2", False)}, {_plane_round("n2", "n3", True)}
SELECT row, col, CASE WHEN any_value(n) >= 6 THEN round(sqrt(avg(res * res)), 6) END AS value FROM n3 GROUP BY row, col""")
def plane_roughness(spark, sf_dir):
    return raster.plane_roughness(low_grid(spark, sf_dir)[0]).withColumn("value", F.round("value", 6))


# ------------------------------------------------------------ quality

FOOT = f"""{BASE}, pn AS (SELECT * FROM pc WHERE NOT {NOISE}), oc AS (SELECT row, col, CAST(sum(CASE WHEN return_number <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM pn GROUP BY row, col), rs AS (SELECT row, min(col) AS c0, max(col) AS c1 FROM oc GROUP BY row), cs AS (SELECT col, min(row) AS r0, max(row) AS r1 FROM oc GROUP BY col),
fc AS (SELECT rs.row, cs.col, coalesce(oc.n, 0) AS n FROM rs JOIN cs ON cs.col BETWEEN rs.c0 AND rs.c1 AND rs.row BETWEEN cs.r0 AND cs.r1 LEFT JOIN oc ON oc.row = rs.row AND oc.col = cs.col)"""


def _survey(spark, sf_dir):
    p = points(spark, sf_dir)
    f = Frame.of(p)
    return quality.survey_cells(p, f), f


@query(FOOT + " SELECT row, col, n FROM fc")
def footprint_cells(spark, sf_dir):
    return quality.footprint_cells(_survey(spark, sf_dir)[0])


DENS = FOOT + """, sd AS (SELECT n * 1e0 AS d, row_number() OVER (ORDER BY n) AS k, count(*) OVER () AS m FROM fc),
ds AS (SELECT any_value(m) AS cells, sum(d) / any_value(m) AS mu, min(CASE WHEN k > least(m - 1, floor(0.5e0 * m)) THEN d END) AS median, min(CASE WHEN k > least(m - 1, floor(0.05e0 * m)) THEN d END) AS p5,
  round(sum(CASE WHEN d < 2 THEN 1 ELSE 0 END) * 1e0 / any_value(m), 6) AS below_2, round(sum(CASE WHEN d < 8 THEN 1 ELSE 0 END) * 1e0 / any_value(m), 6) AS below_8 FROM sd)"""


@query(DENS + " SELECT cells, round(mu, 6) AS mean, median, p5, below_2, below_8, median * 2e0 AS full_median, round(1e0 / sqrt(greatest(mu * 2e0, 1e-6)), 6) AS spacing FROM ds")
def density_stats(spark, sf_dir):
    cells, f = _survey(spark, sf_dir)
    # As if every second point of a file had been loaded.
    return quality.density(quality.footprint_cells(cells), f, (1, 2))


@query(FOOT + " SELECT row, col, CASE WHEN n <= 0 THEN 'empty' WHEN n < 2 THEN 'sparse' WHEN n < 8 THEN 'thin' ELSE 'good' END AS band FROM fc")
def density_heatmap(spark, sf_dir):
    return quality.footprint_cells(_survey(spark, sf_dir)[0]).select("row", "col", G.density_colour(F.col("n")).alias("band"))


GAPS = """, em AS (SELECT row, col, CAST(row AS BIGINT) * (SELECT cols FROM fr) + col AS id FROM fc WHERE n = 0),
ed AS (SELECT a.id AS a, b.id AS b FROM em a JOIN em b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
rc AS (WITH RECURSIVE w(id, root) AS (SELECT id, id FROM em UNION SELECT ed.b, w.root FROM w JOIN ed ON ed.a = w.id WHERE w.root < ed.b) SELECT id, min(root) AS root FROM w GROUP BY id),
gp AS (SELECT root, count(*) AS cells FROM rc GROUP BY root)"""
COVER = GAPS + """, vt AS (SELECT count(*) AS foot, (4e0 * (1e0 / sqrt(greatest(sum(n) * 1e0 / count(*), 1e-6)))) * (4e0 * (1e0 / sqrt(greatest(sum(n) * 1e0 / count(*), 1e-6)))) AS least FROM fc),
gv AS (SELECT count(*) AS gap_regions, coalesce(max(cells), 0) AS largest, coalesce(sum(CASE WHEN cells >= least THEN 1 ELSE 0 END), 0) AS voids, coalesce(sum(CASE WHEN cells >= least THEN cells ELSE 0 END), 0) AS vc, coalesce(sum(cells), 0) AS gc FROM gp CROSS JOIN vt),
cv AS (SELECT foot * 1e0 AS footprint_area, gc * 1e0 AS gap_area, round(gc * 1e0 / greatest(1, foot), 6) AS gap_share, gap_regions, largest * 1e0 AS largest_gap_area, round(least, 6) AS void_threshold, CAST(voids AS BIGINT) AS voids, vc * 1e0 AS void_area, CAST(gc - vc AS BIGINT) AS scattered_cells FROM gv CROSS JOIN vt)"""


@query(FOOT + COVER + " SELECT * FROM cv")
def coverage_voids(spark, sf_dir):
    cells, f = _survey(spark, sf_dir)
    foot = quality.footprint_cells(cells)
    return quality.coverage(foot, f, quality.loaded_spacing(foot, f))


# Cells of 2 x ceil(spacing) from the extent's minimum.
PREC = """, ps AS (SELECT CAST(2 * ceil(1e0 / sqrt(greatest(sum(n) * 1e0 / count(*), 1e-6))) AS INTEGER) AS sz FROM fc),
mo AS (SELECT CAST(floor((z - z0) / sz) AS INTEGER) AS row, CAST(floor((x - x0) / sz) AS INTEGER) AS col, point_source_id AS src, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM pts CROSS JOIN fr CROSS JOIN ps WHERE classification = 2 GROUP BY 1, 2, 3),
bs AS (SELECT row, col, s / n AS mean, greatest(0e0, ss / n - (s / n) * (s / n)) AS var FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, src) AS k FROM mo WHERE n >= 4) q WHERE k = 1),
nx AS (SELECT b.row, b.col, b.mean, b.var, sz, w.mean AS w, e.mean AS e, n.mean AS n, s.mean AS s FROM bs b CROSS JOIN ps JOIN bs w ON w.row = b.row AND w.col = b.col - 1 JOIN bs e ON e.row = b.row AND e.col = b.col + 1 JOIN bs n ON n.col = b.col AND n.row = b.row - 1 JOIN bs s ON s.col = b.col AND s.row = b.row + 1),
sl AS (SELECT *, (e - w) / (2e0 * sz) * ((e - w) / (2e0 * sz)) + (s - n) / (2e0 * sz) * ((s - n) / (2e0 * sz)) AS s2 FROM nx),
lv AS (SELECT round(sqrt(greatest(0e0, var - s2 * sz * sz / 6)), 6) AS sp FROM sl WHERE round(sqrt(s2), 6) <= 0.05e0 AND round(abs(mean - (w + e + n + s) / 4), 6) <= 0.1e0),
pk AS (SELECT sp, row_number() OVER (ORDER BY sp) AS k, count(*) OVER () AS m FROM lv),
pr AS (SELECT (SELECT sz * 1e0 FROM ps) AS size, count(*) AS cells, min(CASE WHEN m >= 20 AND k > floor(m / 4e0) THEN sp END) AS hard, min(CASE WHEN m >= 20 AND k > floor(m / 2e0) THEN sp END) AS level FROM pk)"""


@query(FOOT + PREC + " SELECT * FROM pr")
def precision(spark, sf_dir):
    cells, f = _survey(spark, sf_dir)
    return quality.precision(cells, f, quality.loaded_spacing(quality.footprint_cells(cells), f))


OFFS = """, mp AS (SELECT row, col, point_source_id AS ps, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM pc WHERE classification = 2 GROUP BY 1, 2, 3),
mm AS (SELECT row, col, ps, s / n AS mean FROM mp WHERE n >= 3 AND sqrt(greatest(0e0, ss / n - (s / n) * (s / n))) <= 0.05e0), of AS (SELECT a.row, a.col, a.ps AS a, b.ps AS b, b.mean - a.mean AS o FROM mm a JOIN mm b ON a.row = b.row AND a.col = b.col AND a.ps < b.ps)"""
PAIRS = ", ok AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY o, row, col) AS k, count(*) OVER (PARTITION BY a, b) AS m FROM of), pp AS (SELECT a, b, count(*) AS cells, round(avg(o), 6) AS mean, round(sqrt(avg(o * o)), 6) AS rms, round(max(CASE WHEN k = floor(m / 2e0) + 1 THEN o END), 6) AS median FROM ok GROUP BY a, b HAVING count(*) >= 20)"


@query(BASE + OFFS + PAIRS + " SELECT * FROM pp")
def strip_pairs(spark, sf_dir):
    return quality.strip_pairs(quality.strip_offsets(_survey(spark, sf_dir)[0]))


OVER = ", sv AS (SELECT row, col FROM mp GROUP BY row, col HAVING count(*) > 1), ov AS (SELECT round((SELECT count(*) FROM sv) * 1e0 / count(*), 6) AS overlap_share, count(*) AS cells FROM fc), rm AS (SELECT coalesce(round(sqrt(avg(o * o)), 6), 0e0) AS rms FROM of)"


@query(FOOT + OFFS + OVER + " SELECT overlap_share, cells, rms FROM ov CROSS JOIN rm")
def strip_overlap(spark, sf_dir):
    cells, _ = _survey(spark, sf_dir)
    return quality.strip_overlap(cells, quality.footprint_cells(cells), quality.strip_offsets(cells))


def checkpoints_of(spark: SparkSession, sf_dir: str, p: DataFrame) -> DataFrame:
    """One checkpoint for each nation, at a place and height by formula."""
    ext = p.agg(F.max("x")).first()[0]
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    e, no = (F.col("n_nationkey") * 37 % 97) / F.lit(97.0) * ext, (F.col("n_nationkey") * 53 % 89) / F.lit(89.0) * ext
    return n.select(F.concat(F.lit("CP"), F.col("n_nationkey").cast("string")).alias("name"), e.alias("east"), (-no).alias("north"), (F.lit(9.0) + F.col("n_nationkey") / F.lit(64.0)).alias("elevation"))


CPS = """, cp AS (SELECT 'CP' || n_nationkey AS name, (n_nationkey * 37 % 97) / 97e0 * ext AS east, -((n_nationkey * 53 % 89) / 89e0 * ext) AS north, 9e0 + n_nationkey / 64e0 AS elevation FROM nation CROSS JOIN (SELECT max(x) AS ext FROM pts) q),
ft AS (SELECT name, count(*) AS n, sum(y / greatest(d2, 1e-4)) / sum(1e0 / greatest(d2, 1e-4)) AS h FROM (SELECT name, y, (x - east) * (x - east) + (z + north) * (z + north) AS d2 FROM cp JOIN pts ON classification = 2 AND x BETWEEN east - 1.5e0 AND east + 1.5e0) q WHERE d2 <= 1e0 GROUP BY name HAVING count(*) >= 3),
rz AS (SELECT cp.name, round(h - elevation, 6) AS residual, coalesce(n, 0) AS n FROM cp LEFT JOIN ft ON ft.name = cp.name)"""


@query(scene_cte() + CPS + " SELECT * FROM rz")
def checkpoint_residuals(spark, sf_dir):
    p = points(spark, sf_dir)
    return quality.checkpoint_residuals(p, checkpoints_of(spark, sf_dir, p))


ACC = CPS + ", ac AS (SELECT count(*) AS checkpoints, count(residual) AS measured, round(avg(residual), 6) AS mean, round(sqrt(avg(residual * residual)), 6) AS rmsez, round(sqrt(avg(residual * residual)) * 1.96e0, 6) AS nva, round(max(abs(residual)), 6) AS max_abs FROM rz)"


@query(scene_cte() + ACC + " SELECT * FROM ac")
def checkpoint_accuracy(spark, sf_dir):
    p = points(spark, sf_dir)
    return quality.accuracy(quality.checkpoint_residuals(p, checkpoints_of(spark, sf_dir, p)))


@query(DENS + COVER + PREC + OFFS + PAIRS + OVER + ACC + f""", nz AS (SELECT round(sum(CASE WHEN {NOISE} THEN 1 ELSE 0 END) * 1e0 / count(*), 6) AS share FROM pts), sp AS (SELECT CASE WHEN (SELECT count(*) FROM pp) > 0 THEN rms END AS rms FROM rm), ck AS (
SELECT 'density' AS "check", median AS value, 2e0 AS "limit", CASE WHEN median >= 2 THEN 'pass' ELSE 'fail' END AS verdict FROM ds
UNION ALL SELECT 'voids', voids * 1e0, 0e0, CASE WHEN voids = 0 THEN 'pass' ELSE 'review' END FROM cv
UNION ALL SELECT 'precision', hard, 0.06e0, CASE WHEN hard IS NULL THEN 'skipped' WHEN hard <= 0.06e0 THEN 'pass' ELSE 'fail' END FROM pr
UNION ALL SELECT 'strips', rms, 0.08e0, CASE WHEN rms IS NULL THEN 'skipped' WHEN rms <= 0.08e0 THEN 'pass' ELSE 'fail' END FROM sp
UNION ALL SELECT 'noise', share, 0.01e0, CASE WHEN share <= 0.01e0 THEN 'pass' ELSE 'review' END FROM nz
UNION ALL SELECT 'accuracy', rmsez, 0.1e0, CASE WHEN rmsez IS NULL THEN 'skipped' WHEN rmsez <= 0.1e0 THEN 'pass' ELSE 'fail' END FROM ac) SELECT * FROM ck""")
def quality_checks(spark, sf_dir):
    p = points(spark, sf_dir)
    return quality.quality_checks(p, Frame.of(p), checkpoints_of(spark, sf_dir, p))


@query(DENS + ACC + """ SELECT CASE WHEN median >= 8 AND coalesce(rmsez, 0) <= 0.05e0 THEN 'QL0' WHEN median >= 8 AND coalesce(rmsez, 0) <= 0.1e0 THEN 'QL1' WHEN median >= 2 AND coalesce(rmsez, 0) <= 0.1e0 THEN 'QL2' WHEN median >= 0.5e0 AND coalesce(rmsez, 0) <= 0.2e0 THEN 'QL3' END AS level FROM ds CROSS JOIN ac""")
def quality_level(spark, sf_dir):
    p = points(spark, sf_dir)
    return spark.createDataFrame([(quality.quality_report(p, Frame.of(p), checkpoints_of(spark, sf_dir, p)).level,)], "level string")


@query("""WITH l AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 4 = 0 THEN n_name || ',' || n_nationkey || '.5,' || (n_nationkey * 2) || ', 7' WHEN n_nationkey % 4 = 1 THEN n_nationkey || ';2;3.25' WHEN n_nationkey % 4 = 2 THEN 'name,east,north,elevation' ELSE 'junk' END AS v FROM nation),
f AS (SELECT n, list_transform(regexp_split_to_array(v, '[,;\\t]'), lambda s: trim(s)) AS f FROM l),
g AS (SELECT n, CASE WHEN len(f) >= 4 THEN f[1] END AS given, try_cast(f[-3] AS DOUBLE) AS east, try_cast(f[-2] AS DOUBLE) AS north, try_cast(f[-1] AS DOUBLE) AS elevation FROM f WHERE len(f) >= 3)
SELECT coalesce(given, 'CP' || row_number() OVER (ORDER BY n)) AS name, east, north, elevation FROM g WHERE east IS NOT NULL AND north IS NOT NULL AND elevation IS NOT NULL""")
def parse_checkpoints(spark, sf_dir):
    k, s = F.col("n_nationkey"), lambda c: c.cast("string")
    text = F.when(k % 4 == 0, F.concat("n_name", F.lit(","), s(k), F.lit(".5,"), s(k * 2), F.lit(", 7"))).when(k % 4 == 1, F.concat(s(k), F.lit(";2;3.25"))).when(k % 4 == 2, "name,east,north,elevation").otherwise("junk")
    return quality.parse_checkpoints(spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("n"), text.alias("value")))


# ------------------------------------------------------------ voxels, noise


@query(scene_cte() + """, o AS (SELECT min(x) AS ox, min(y) AS oy, min(z) AS oz FROM pts)
SELECT CAST(floor((x - ox) / 2e0) AS INTEGER) AS vx, CAST(floor((y - oy) / 2e0) AS INTEGER) AS vy, CAST(floor((z - oz) / 2e0) AS INTEGER) AS vz, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z,
  avg(intensity) AS intensity, CAST(floor(avg(r) + 0.5e0) AS INTEGER) AS r, CAST(floor(avg(g) + 0.5e0) AS INTEGER) AS g, CAST(floor(avg(b) + 0.5e0) AS INTEGER) AS b FROM pts CROSS JOIN o GROUP BY 1, 2, 3""")
def voxel_downsample(spark, sf_dir):
    return tables.voxel_downsample(points(spark, sf_dir), 2.0, votes=[])


@query(scene_cte() + """, o AS (SELECT min(x) AS ox, min(y) AS oy, min(z) AS oz FROM pts), v AS (SELECT CAST(floor((x - ox) / 2e0) AS INTEGER) AS vx, CAST(floor((y - oy) / 2e0) AS INTEGER) AS vy, CAST(floor((z - oz) / 2e0) AS INTEGER) AS vz, classification AS c, count(*) AS n FROM pts CROSS JOIN o GROUP BY 1, 2, 3, 4)
SELECT vx, vy, vz, c AS classification FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY n DESC, c) AS k FROM v) q WHERE k = 1""")
def voxel_majority(spark, sf_dir):
    return tables.voxel_downsample(points(spark, sf_dir), 2.0, means=[], votes=["classification"]).select("vx", "vy", "vz", "classification")


@query(scene_cte() + """, o AS (SELECT min(x) AS ox, min(y) AS oy, min(z) AS oz FROM pts), u AS (SELECT (x - ox) / 2e0 AS a, (y - oy) / 2e0 AS b_, (z - oz) / 2e0 AS c, r, g, b, ox, oy, oz FROM pts CROSS JOIN o),
k AS (SELECT CAST(floor(a) AS BIGINT) AS vx, CAST(floor(b_) AS BIGINT) AS vy, CAST(floor(c) AS BIGINT) AS vz, CAST(least(round_even((a - floor(a)) * 4096, 0), 4095) AS BIGINT) AS fx, CAST(least(round_even((b_ - floor(b_)) * 4096, 0), 4095) AS BIGINT) AS fy, CAST(least(round_even((c - floor(c)) * 4096, 0), 4095) AS BIGINT) AS fz, r, g, b, ox, oy, oz FROM u)
SELECT vx, vy, vz, count(*) AS n, (vx + sum(fx) * 1e0 / (count(*) * 4096)) * 2e0 + any_value(ox) AS x, (vy + sum(fy) * 1e0 / (count(*) * 4096)) * 2e0 + any_value(oy) AS y, (vz + sum(fz) * 1e0 / (count(*) * 4096)) * 2e0 + any_value(oz) AS z,
  CAST(round_even(sum(r) * 1e0 / count(*), 0) AS INTEGER) AS r, CAST(round_even(sum(g) * 1e0 / count(*), 0) AS INTEGER) AS g, CAST(round_even(sum(b) * 1e0 / count(*), 0) AS INTEGER) AS b FROM k GROUP BY vx, vy, vz""")
def voxel_thin(spark, sf_dir):
    return tables.voxel_thin(points(spark, sf_dir), 2.0)


ISO = ", c3 AS (SELECT pid, x, y, z, CAST(floor(x / 2.5e0) AS BIGINT) AS cx, CAST(floor(z / 2.5e0) AS BIGINT) AS cz FROM pts), nbr AS (SELECT a.pid, count(b.pid) AS k FROM (SELECT c3.*, cx + i AS qx, cz + j AS qz FROM c3 CROSS JOIN " + _O9 + ") a JOIN c3 b ON b.cx = a.qx AND b.cz = a.qz AND b.pid <> a.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 6.25e0 GROUP BY a.pid), iso AS (SELECT pid FROM pts WHERE pid NOT IN (SELECT pid FROM nbr WHERE k >= 2))"


@query(scene_cte() + ISO + " SELECT pid FROM iso")
def isolated_points(spark, sf_dir):
    return noise.isolated_points(points(spark, sf_dir), 2.5)


# Cells of 10 m from the extent's minimum.
ELM = """, lf AS (SELECT min(x) AS lx, min(z) AS lz FROM pts), ul AS (SELECT pid, y, CAST(floor((x - lx) / 10e0) AS BIGINT) AS cx, CAST(floor((z - lz) / 10e0) AS BIGINT) AS cz FROM pts CROSS JOIN lf{unlabelled}), wd AS (SELECT *, CASE WHEN lead(y) OVER (PARTITION BY cx, cz ORDER BY y, pid) - y > 1 THEN 1 ELSE 0 END AS wide FROM ul),
elm AS (SELECT pid, cx, cz, y, min(wide) OVER (PARTITION BY cx, cz ORDER BY y, pid ROWS UNBOUNDED PRECEDING) = 1 AS low FROM wd),
md AS (SELECT cx, cz, y AS median FROM (SELECT *, row_number() OVER (PARTITION BY cx, cz ORDER BY y, pid) AS k, count(*) OVER (PARTITION BY cx, cz) AS m FROM elm WHERE NOT low) q WHERE k = floor(m / 2e0) + 1)"""
_RAW = ELM.format(unlabelled="")


@query(scene_cte() + _RAW + " SELECT pid, low FROM elm")
def elm_low_outliers(spark, sf_dir):
    return noise.low_outliers(points(spark, sf_dir).drop("classification")).select("pid", "low")


NC = ISO + _RAW + ", nc AS (SELECT pts.pid, CASE WHEN elm.low THEN 7 WHEN iso.pid IS NOT NULL THEN CASE WHEN median IS NULL OR pts.y > median + 2 THEN 18 ELSE 7 END ELSE 1 END AS classification FROM pts JOIN elm ON elm.pid = pts.pid LEFT JOIN iso ON iso.pid = pts.pid LEFT JOIN md ON md.cx = elm.cx AND md.cz = elm.cz)"


@query(scene_cte() + NC + " SELECT * FROM nc")
def noise_classes(spark, sf_dir):
    return noise.detect_noise(points(spark, sf_dir).withColumn("classification", F.lit(1)), 2.5).select("pid", "classification")


@query(scene_cte() + NC + " SELECT CAST(0 AS BIGINT) AS kept, CAST(sum(CASE WHEN classification = 7 THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN classification = 18 THEN 1 ELSE 0 END) AS BIGINT) AS high, count(*) AS n FROM nc")
def noise_stats(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("classification", F.lit(1))
    return noise.noise_stats(p, noise.detect_noise(p, 2.5))


# ------------------------------------------------------------ ground, terrain, contours


@query()
def detect_ground(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("classification", F.when(G.is_noise(F.col("classification")), F.col("classification")).otherwise(0))
    return ground.detect_ground(p).select("pid", "classification", F.round("height_above_ground", 6).alias("height_above_ground"))


@query(scene_cte() + """, bl AS (SELECT CAST(floor(x / 20e0) AS INTEGER) AS bx, CAST(floor(z / 20e0) AS INTEGER) AS bz, sum(CASE WHEN classification = 2 THEN 1 ELSE 0 END) AS ground, sum(CASE WHEN classification IN (5, 6) AND above > 1 THEN 1 ELSE 0 END) AS other FROM pts GROUP BY 1, 2)
SELECT bx, bz, CAST(ground AS BIGINT) AS ground, CAST(other AS BIGINT) AS other, true AS kept, true AS left_out FROM bl""")
def ground_found(spark, sf_dir):
    """By blocks of 20 m, the scene's ground and what stands a metre or more above it, and whether the detection keeps 98 % of the one and takes in 2 % of the other at most."""
    p = points(spark, sf_dir)
    own = p.select("pid", "x", "z", "above", F.col("classification").alias("truth"))
    d = ground.detect_ground(p.withColumn("classification", F.when(G.is_noise(F.col("classification")), F.col("classification")).otherwise(0))).select("pid", "classification")
    j = own.join(d, "pid").withColumns({"g": F.col("truth") == 2, "o": F.col("truth").isin(5, 6) & (F.col("above") > 1), "hit": F.col("classification") == 2})
    n = lambda c: F.sum(c.cast("bigint"))
    b = j.groupBy(F.floor(F.col("x") / 20.0).cast("int").alias("bx"), F.floor(F.col("z") / 20.0).cast("int").alias("bz")).agg(n(F.col("g")).alias("ground"), n(F.col("o")).alias("other"), n(F.col("g") & F.col("hit")).alias("kept"), n(F.col("o") & F.col("hit")).alias("taken"))
    return b.select("bx", "bz", "ground", "other", (F.col("kept") >= F.col("ground") * 0.98).alias("kept"), (F.col("taken") <= F.col("other") * 0.02).alias("left_out"))


def _fill_sql(src: str, out: str, levels: int = 10) -> str:
    """Push-pull of src (row, col, value) over the whole frame: halved again and again, then sampled between the four nearest centres."""
    parts = [f"{out}d0 AS (SELECT rws AS rr, cols AS cc FROM fr)", f"{out}c0 AS MATERIALIZED (SELECT row, col, value AS v, 1e0 AS w FROM {src})"]
    for k in range(1, levels + 1):
        parts.append(f"{out}d{k} AS (SELECT CAST(floor((rr + 1) / 2e0) AS INTEGER) AS rr, CAST(floor((cc + 1) / 2e0) AS INTEGER) AS cc FROM {out}d{k - 1})")
        parts.append(f"{out}c{k} AS MATERIALIZED (SELECT CAST(floor(row / 2e0) AS INTEGER) AS row, CAST(floor(col / 2e0) AS INTEGER) AS col, sum(v * w) / sum(w) AS v, sum(w) AS w FROM {out}c{k - 1} GROUP BY 1, 2)")
    upper = f"{out}c{levels}"
    for k in range(levels - 1, -1, -1):
        me = out if k == 0 else f"{out}f{k}"
        name = "value" if k == 0 else "v"
        below = {c: f"LEFT JOIN {upper} {c} ON {c}.row = CAST(floor(a.v) AS INTEGER) + {i} AND {c}.col = CAST(floor(a.u) AS INTEGER) + {j}" for c, i, j in (("nw", 0, 0), ("ne", 0, 1), ("sw", 1, 0), ("se", 1, 1))}
        top, low = "(nw.v + (coalesce(ne.v, nw.v) - nw.v) * (a.u - floor(a.u)))", "(coalesce(sw.v, nw.v) + (coalesce(se.v, sw.v, ne.v, nw.v) - coalesce(sw.v, nw.v)) * (a.u - floor(a.u)))"
        parts.append(
            f"{out}a{k} AS (SELECT CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col, greatest(0e0, least(e.cc - 1, (c.i + 0.5e0) / 2e0 - 0.5e0)) AS u, greatest(0e0, least(e.rr - 1, (r.i + 0.5e0) / 2e0 - 0.5e0)) AS v "
            f"FROM {out}d{k} d, {out}d{k + 1} e, LATERAL (SELECT unnest(range(d.rr)) AS i) r, LATERAL (SELECT unnest(range(d.cc)) AS i) c)"
        )
        parts.append(f"{me} AS MATERIALIZED (SELECT a.row, a.col, coalesce(o.v, {top} + ({low} - {top}) * (a.v - floor(a.v))) AS {name} FROM {out}a{k} a LEFT JOIN {out}c{k} o ON o.row = a.row AND o.col = a.col {' '.join(below.values())})")
        upper = me
    return ", ".join(parts)


GROUND = f"{BASE}, gs AS (SELECT row, col, avg(y) AS value FROM pc WHERE classification = 2 GROUP BY row, col), {_fill_sql('gs', 'gf')}"


@query(GROUND + """, q AS (SELECT pid, y, greatest(0e0, least(cols - 1, x - x0 - 0.5e0)) AS u, greatest(0e0, least(rws - 1, z - z0 - 0.5e0)) AS v FROM pts CROSS JOIN fr),
b AS (SELECT pid, y, u - floor(u) AS fu, v - floor(v) AS fv, nw.value AS nw, coalesce(ne.value, nw.value) AS ne, coalesce(sw.value, nw.value) AS sw, coalesce(se.value, CASE WHEN sw.value IS NULL THEN coalesce(ne.value, nw.value) ELSE sw.value END) AS se FROM q
  JOIN gf nw ON nw.row = CAST(floor(v) AS INTEGER) AND nw.col = CAST(floor(u) AS INTEGER) LEFT JOIN gf ne ON ne.row = CAST(floor(v) AS INTEGER) AND ne.col = CAST(floor(u) AS INTEGER) + 1 LEFT JOIN gf sw ON sw.row = CAST(floor(v) AS INTEGER) + 1 AND sw.col = CAST(floor(u) AS INTEGER) LEFT JOIN gf se ON se.row = CAST(floor(v) AS INTEGER) + 1 AND se.col = CAST(floor(u) AS INTEGER) + 1)
SELECT pid, round(y - (nw + (ne - nw) * fu + ((sw + (se - sw) * fu) - (nw + (ne - nw) * fu)) * fv), 4) AS height_above_ground FROM b""")
def height_above_classified_ground(spark, sf_dir):
    return ground.height_above_classified_ground(points(spark, sf_dir)).select("pid", F.round("height_above_ground", 4).alias("height_above_ground"))


@query(f"{BASE} SELECT DISTINCT row + i AS row, col + j AS col FROM (SELECT DISTINCT row, col FROM pc) d CROSS JOIN {_O9} CROSS JOIN fr WHERE row + i BETWEEN 0 AND rws - 1 AND col + j BETWEEN 0 AND cols - 1")
def terrain_footprint(spark, sf_dir):
    p = points(spark, sf_dir)
    return terrain.footprint(p, Frame.of(p))


@query(GROUND + f""", ft AS (SELECT DISTINCT row + i AS row, col + j AS col FROM (SELECT DISTINCT row, col FROM pc) d CROSS JOIN {_O9})
SELECT gf.row, gf.col, round(gf.value, 4) AS elevation, gs.row IS NOT NULL AS measured FROM gf JOIN ft USING (row, col) LEFT JOIN gs ON gs.row = gf.row AND gs.col = gf.col""")
def terrain_model(spark, sf_dir):
    p = points(spark, sf_dir)
    return terrain.terrain_model(p, Frame.of(p)).withColumn("elevation", F.round("elevation", 4))


@query(f"{LOW}, r AS (SELECT max(value) - min(value) AS relief FROM lo) SELECT relief, CASE {' '.join(f'WHEN {i}e0 >= relief / 25e0 THEN {i}e0' for i, _ in terrain.INTERVALS)} END AS interval_m FROM r")
def contour_interval(spark, sf_dir):
    r = terrain.relief(low_grid(spark, sf_dir)[0]).select((F.col("high") - F.col("low")).alias("relief"))
    out = None
    for i, _ in terrain.INTERVALS:
        hit = F.lit(i) >= F.col("relief") / 25.0
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return r.select("relief", out.alias("interval_m"))


@query(f"""{LOW}, sq AS (SELECT a.row, a.col, a.value AS a, b.value AS b, c.value AS c, d.value AS d FROM lo a JOIN lo b ON b.row = a.row AND b.col = a.col + 1 JOIN lo c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN lo d ON d.row = a.row + 1 AND d.col = a.col),
kq AS (SELECT *, unnest(range(CAST(floor(least(a, b, c, d) / 1e0) AS BIGINT) + 1, CAST(floor(greatest(a, b, c, d) / 1e0) AS BIGINT) + 1)) AS k FROM sq),
cq AS (SELECT *, CASE WHEN a >= k THEN 1 ELSE 0 END + CASE WHEN b >= k THEN 2 ELSE 0 END + CASE WHEN c >= k THEN 4 ELSE 0 END + CASE WHEN d >= k THEN 8 ELSE 0 END AS code, (a + b + c + d) / 4 >= k AS up FROM kq),
sides AS (SELECT row, col, k, CASE code WHEN 1 THEN 'lt' WHEN 14 THEN 'lt' WHEN 2 THEN 'tr' WHEN 13 THEN 'tr' WHEN 3 THEN 'lr' WHEN 12 THEN 'lr' WHEN 4 THEN 'rb' WHEN 11 THEN 'rb' WHEN 6 THEN 'tb' WHEN 9 THEN 'tb' WHEN 7 THEN 'lb' WHEN 8 THEN 'lb' END AS s FROM cq WHERE code NOT IN (5, 10)
  UNION ALL SELECT row, col, k, unnest(CASE WHEN (code = 5) = up THEN ['tr', 'lb'] ELSE ['lt', 'rb'] END) FROM cq WHERE code IN (5, 10))
SELECT row, col, k, s FROM sides""")
def contour_segments(spark, sf_dir):
    s = terrain.contour_segments(low_grid(spark, sf_dir)[0], 1.0)
    side = lambda e: F.when(F.col(f"{e}.dir") == 0, F.when(F.col(f"{e}.r") == F.col("row"), "t").otherwise("b")).otherwise(F.when(F.col(f"{e}.c") == F.col("col"), "l").otherwise("r"))
    return s.select("row", "col", "k", F.concat(side("p"), side("q")).alias("s"))


@query()
def contours(spark, sf_dir):
    g, f = low_grid(spark, sf_dir)
    return terrain.contours(g, f, 1.0).select("k", "level", "major", "closed", F.size("points").alias("vertices"))


# ------------------------------------------------------------ components, objects


@query(FOOT + GAPS + " SELECT dense_rank() OVER (ORDER BY root) AS label, cells FROM gp")
def gap_components(spark, sf_dir):
    cells, f = _survey(spark, sf_dir)
    return C.gap_components(quality.footprint_cells(cells), f.cols)


LABEL = f"""{BASE}, mk AS (SELECT DISTINCT row, col, CAST(row AS BIGINT) * (SELECT cols FROM fr) + col AS id FROM pc WHERE kind >= 3),
ed AS (SELECT a.id AS a, b.id AS b FROM mk a JOIN mk b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
rc AS (WITH RECURSIVE w(id, root) AS (SELECT id, id FROM mk UNION SELECT ed.b, w.root FROM w JOIN ed ON ed.a = w.id WHERE w.root < ed.b) SELECT id, min(root) AS root FROM w GROUP BY id),
lb AS (SELECT row, col, dense_rank() OVER (ORDER BY root) AS label FROM mk JOIN rc USING (id))"""


def _tree_labels(spark, sf_dir):
    p = points(spark, sf_dir)
    f = Frame.of(p)
    return C.label_cells(quality.with_cells(p.filter("kind >= 3"), f).select("row", "col").distinct(), f.cols), f


@query(LABEL + " SELECT row, col, label FROM lb")
def patch_labels(spark, sf_dir):
    return _tree_labels(spark, sf_dir)[0]


@query(LABEL + " SELECT label, count(*) AS n, CAST(sum(col) AS BIGINT) AS sc, CAST(sum(row) AS BIGINT) AS sr, CAST(sum(CAST(col AS BIGINT) * col) AS BIGINT) AS scc, CAST(sum(CAST(row AS BIGINT) * row) AS BIGINT) AS srr, CAST(sum(CAST(row AS BIGINT) * col) AS BIGINT) AS src FROM lb GROUP BY label")
def patch_moments(spark, sf_dir):
    return C.patch_moments(_tree_labels(spark, sf_dir)[0])


CAND = f"{BASE}, cn AS (SELECT row, col, y - terrain AS h, number_of_returns AS nr, classification AS code FROM pc WHERE y - terrain >= 2 AND classification IN (0, 1, 3, 4, 5, 6)), tp AS (SELECT row, col, max(h) AS top, count(*) AS n, CAST(sum(CASE WHEN nr > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi, CAST(sum(CASE WHEN code = 6 THEN 1 ELSE 0 END) AS BIGINT) AS built, CAST(sum(CASE WHEN code IN (3, 4, 5) THEN 1 ELSE 0 END) AS BIGINT) AS veg FROM cn GROUP BY row, col)"


def _stats(spark, sf_dir):
    p = hag_points(spark, sf_dir)
    f = Frame.of(p)
    return objects.cell_stats(tables.object_candidates(p), f), f


@query(CAND + ", dp AS (SELECT row, col, count(*) AS deep FROM cn JOIN tp USING (row, col) WHERE h < top - 1 GROUP BY row, col) SELECT row, col, top, n, multi, built, veg, coalesce(deep, 0) AS deep FROM tp LEFT JOIN dp USING (row, col)")
def object_cell_stats(spark, sf_dir):
    return _stats(spark, sf_dir)[0]


@query(CAND + ", b AS (SELECT row, col, top FROM tp WHERE built * 2 > n) SELECT row + i AS row, col + j AS col, max(top) AS value FROM b CROSS JOIN (SELECT * FROM (VALUES (-2), (-1), (0), (1), (2)) a(i) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) c(j)) o GROUP BY 1, 2")
def near_building_height(spark, sf_dir):
    s, _ = _stats(spark, sf_dir)
    return raster.nearby_maximum(s.filter("built * 2 > n").select("row", "col", F.col("top").alias("value")), 2)


@query(CAND + """, cy AS (SELECT row, col, top AS value, greatest(1, CAST(floor(greatest(1e0, least(5e0, 0.5e0 + 0.2e0 * top)) + 0.5e0) AS INTEGER)) AS r FROM tp WHERE veg * 2 > n)
SELECT row, col, value FROM cy a WHERE NOT EXISTS (SELECT 1 FROM cy b WHERE (b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col) <= a.r * a.r AND abs(b.row - a.row) <= 6 AND (b.value > a.value OR (b.value = a.value AND (b.row < a.row OR (b.row = a.row AND b.col < a.col)))))""")
def treetops(spark, sf_dir):
    s, _ = _stats(spark, sf_dir)
    return crowns.treetops(s.filter("veg * 2 > n").select("row", "col", F.col("top").alias("value")), 1.0)


@query(CAND + ", b AS (SELECT CAST(floor(row / 100e0) * 1000 + floor(col / 100e0) AS BIGINT) AS label, row, col, top AS h FROM tp WHERE built * 2 > n), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, row, col) AS k, count(*) OVER (PARTITION BY label) AS m FROM b) SELECT label, max(m) AS cells, max(CASE WHEN k = CAST(floor(0.95e0 * (m - 1)) AS BIGINT) + 1 THEN h END) AS height FROM k GROUP BY label")
def roof_height_p95(spark, sf_dir):
    s, _ = _stats(spark, sf_dir)
    label = (F.floor(F.col("row") / 100.0) * 1000 + F.floor(F.col("col") / 100.0)).cast("bigint")
    return objects.roof_heights(s.filter("built * 2 > n").select(label.alias("label"), "row", "col", F.col("top").alias("h")))


@query(CAND + """, dp AS (SELECT row, col, count(*) AS deep FROM cn JOIN tp USING (row, col) WHERE h < top - 1 GROUP BY row, col), b AS (SELECT CAST(floor(row / 100e0) * 1000 + floor(col / 100e0) AS BIGINT) AS label, row, col, n - coalesce(deep, 0) AS u FROM tp LEFT JOIN dp USING (row, col) WHERE built * 2 > n),
ir AS (SELECT a.label, a.row, a.col, a.u, count(o.row) = 8 AS inner_ FROM b a LEFT JOIN b o ON o.label = a.label AND abs(o.row - a.row) <= 1 AND abs(o.col - a.col) <= 1 AND NOT (o.row = a.row AND o.col = a.col) GROUP BY 1, 2, 3, 4),
mk AS (SELECT label, greatest(u, 1) AS med FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, row, col) AS k, count(*) OVER (PARTITION BY label) AS m FROM ir WHERE inner_) q WHERE k = floor(m / 2e0) + 1)
SELECT label, round(sum(CASE WHEN inner_ OR med IS NULL THEN 1e0 ELSE least(1e0, u * 1e0 / med) END), 6) AS area FROM ir LEFT JOIN mk USING (label) GROUP BY label""")
def covered_cells(spark, sf_dir):
    s, _ = _stats(spark, sf_dir)
    label = (F.floor(F.col("row") / 100.0) * 1000 + F.floor(F.col("col") / 100.0)).cast("bigint")
    return objects.covered_area(s.filter("built * 2 > n").select("row", "col", label.alias("label")), s, 1.0).withColumn("area", F.round("area", 6))


@query(f"""{BASE}, bx AS (SELECT kind * 1000000 + CAST(floor(x / 100e0) AS INTEGER) * 1000 + CAST(floor(z / 100e0) AS INTEGER) AS label, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM pc WHERE kind IN (1, 2) GROUP BY 1),
ls AS (SELECT *, (r0 + r1) // 2 AS rm, (c0 + c1) // 2 AS cm FROM bx)
SELECT CAST(label AS BIGINT) AS label, 6 AS corners, ((r1 - r0 + 1) * (c1 - c0 + 1) - (r1 - rm) * (c1 - cm)) * 1e0 AS area, x0 + c0 AS min_x, x0 + c1 + 1 AS max_x, z0 + r0 AS min_z, z0 + r1 + 1 AS max_z FROM ls CROSS JOIN fr""")
def outlines(spark, sf_dir):
    """Outlines of the roofs' extents without a quarter: rings of six corners around as much as their cells cover."""
    p = points(spark, sf_dir)
    f = Frame.of(p)
    label = (F.col("kind") * 1_000_000 + F.floor(F.col("x") / 100.0) * 1000 + F.floor(F.col("z") / 100.0)).cast("bigint")
    box = quality.with_cells(p.filter("kind IN (1, 2)"), f).groupBy(label.alias("label")).agg(*(g(c).alias(f"{c[0]}{k}") for c in ("row", "col") for k, g in ((0, F.min), (1, F.max))))
    cells = box.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    cells = cells.filter((F.col("row") <= F.floor((F.col("r0") + F.col("r1")) / 2)) | (F.col("col") <= F.floor((F.col("c0") + F.col("c1")) / 2))).select("label", "row", "col")
    ring = objects.outline(cells, f).select("label", F.size("outline").alias("corners"), F.posexplode("outline").alias("k", "p"))
    w = Window.partitionBy("label").orderBy("k")
    nxt = F.coalesce(F.lead("p").over(w), F.first("p").over(w))
    e = ring.select("label", "corners", "p", (F.col("p.x") * nxt["z"] - nxt["x"] * F.col("p.z")).alias("part"))
    return e.groupBy("label").agg(F.max("corners").alias("corners"), F.round(F.abs(F.sum("part")) / 2, 6).alias("area"), *(g(f"p.{c}").alias(f"{n}_{c}") for c in "xz" for n, g in (("min", F.min), ("max", F.max))))


def _objects(spark, sf_dir):
    p = hag_points(spark, sf_dir).withColumn("classification", F.when(F.col("classification").isin(5, 6), 1).otherwise(F.col("classification")))
    return objects.detect_objects(p.select("pid", "x", "y", "z", "classification", "number_of_returns", "height_above_ground", "kind"))


@query(scene_cte() + f""", ob AS (SELECT DISTINCT kind * 1000000 + CAST(floor(x / 100e0) AS INTEGER) * 1000 + CAST(floor(z / 100e0) AS INTEGER) AS instance, kind FROM pts WHERE kind > 0 AND NOT {NOISE})
SELECT CAST(instance AS BIGINT) AS instance, CASE WHEN kind <= 2 THEN 'building' ELSE 'tree' END AS kind FROM ob""")
def objects_found(spark, sf_dir):
    """The scene's buildings and trees as the detection finds them: those that share over half of their points with an object of one kind."""
    found, made = _objects(spark, sf_dir)
    truth = points(spark, sf_dir).filter(f"kind > 0 AND NOT {NOISE}")
    truth = truth.select("pid", (F.col("kind") * 1_000_000 + F.floor(F.col("x") / 100.0) * 1000 + F.floor(F.col("z") / 100.0)).cast("bigint").alias("instance"))
    match = objects.match_objects(truth, found.select("pid", "object_id"))
    return match.join(made.select(F.col("id").alias("object_id"), "kind"), "object_id").select("instance", "kind")


@query()
def detect_objects(spark, sf_dir):
    o = _objects(spark, sf_dir)[1]
    return o.select("id", "kind", "point_count", *(F.round(c, 4).alias(c) for c in ("height", "area", "ground_y", "crown_radius")), F.size("outline").alias("corners"))


@query()
def object_inventory(spark, sf_dir):
    return objects.inventory(_objects(spark, sf_dir)[1])


@query()
def objects_geojson(spark, sf_dir):
    from .sinks import geojson

    return geojson.object_features(_objects(spark, sf_dir)[1], (543000.0, 0.0, -4179000.0))


# ------------------------------------------------------------ surfaces, polygons, picks, tiles


def _surface_cells(spark, sf_dir):
    g, (x0, z0, cell, cols, rows) = _surface(spark, sf_dir, "highest")
    seeds = spark.createDataFrame([(1, 32, 40), (2, 33, 41), (3, 100, 20)], "seed int, row int, col int")
    return measure.select_surfaces(g, seeds, cell, rows, cols), g, cell


@query()
def select_surface(spark, sf_dir):
    return _surface_cells(spark, sf_dir)[0]


ROOFS = f"{BASE}, sc AS (SELECT DISTINCT CAST(CASE WHEN kind = 1 THEN 1 WHEN kind = 2 THEN 2 WHEN kind = 3 THEN 3 ELSE 4 END AS INTEGER) AS seed, row, col FROM pc WHERE kind >= 1)"


def _roof_cells(spark, sf_dir):
    p = points(spark, sf_dir)
    seed = F.when(F.col("kind") < 4, F.col("kind")).otherwise(4).cast("int")
    return quality.with_cells(p.filter("kind >= 1"), Frame.of(p)).select(seed.alias("seed"), "row", "col").distinct()


def _seed_plane(src: str, out: str) -> str:
    return f"""{out}_m AS (SELECT seed, avg(r) AS mr, avg(c) AS mc, avg(v) AS mv FROM {src} WHERE v IS NOT NULL GROUP BY seed),
{out}_s AS (SELECT seed, any_value(mr) AS mr, any_value(mc) AS mc, any_value(mv) AS mv, sum((r - mr) * (r - mr)) AS aa, sum((r - mr) * (c - mc)) AS ab, sum((c - mc) * (c - mc)) AS bb, sum((r - mr) * (v - mv)) AS av, sum((c - mc) * (v - mv)) AS bv FROM {src} JOIN {out}_m USING (seed) WHERE v IS NOT NULL GROUP BY seed),
{out} AS (SELECT seed, (av * bb - bv * ab) / (aa * bb - ab * ab) AS kr, (bv * aa - av * ab) / (aa * bb - ab * ab) AS kc, mv - (av * bb - bv * ab) / (aa * bb - ab * ab) * mr - (bv * aa - av * ab) / (aa * bb - ab * ab) * mc AS k0, mv FROM {out}_s)"""


@query(f"""{ROOFS}, {_surface_cte("max", "1e0")}, ow AS (SELECT seed, row, col, row * 1e0 AS r, col * 1e0 AS c, value AS v FROM sc LEFT JOIN g2 USING (row, col)), {_seed_plane("ow", "p1")},
nr AS (SELECT ow.* FROM ow JOIN p1 USING (seed) WHERE abs(v - (k0 + kr * r + kc * c)) <= 0.3e0), {_seed_plane("nr", "p2")},
nx AS (SELECT o.seed, o.row, o.col, o.r, o.c, o.v, kr, kc, CASE WHEN abs(e.v - o.v - kc) < 0.3e0 THEN e.v END AS e, CASE WHEN abs(o.v - w.v - kc) < 0.3e0 THEN w.v END AS w, CASE WHEN abs(s.v - o.v - kr) < 0.3e0 THEN s.v END AS s, CASE WHEN abs(o.v - n.v - kr) < 0.3e0 THEN n.v END AS n
  FROM ow o JOIN p2 USING (seed) LEFT JOIN ow e ON e.seed = o.seed AND e.row = o.row AND e.col = o.col + 1 LEFT JOIN ow w ON w.seed = o.seed AND w.row = o.row AND w.col = o.col - 1 LEFT JOIN ow s ON s.seed = o.seed AND s.col = o.col AND s.row = o.row + 1 LEFT JOIN ow n ON n.seed = o.seed AND n.col = o.col AND n.row = o.row - 1),
gd AS (SELECT nx.*, CASE WHEN col BETWEEN 1 AND (SELECT sc FROM sg) - 2 THEN coalesce((e - w) / 2, e - v, v - w) END AS gx, coalesce((s - n) / 2, s - v, v - n) AS gz FROM nx),
ar AS (SELECT seed, count(*) AS cells, sum(coalesce(sqrt(1 + gx * gx + gz * gz), sqrt(1 + kr * kr + kc * kc))) AS area, avg(r) AS mr, avg(c) AS mc FROM gd GROUP BY seed),
ce AS (SELECT seed, r, c FROM (SELECT ow.seed, r, c, row_number() OVER (PARTITION BY ow.seed ORDER BY round((r - mr) * (r - mr) + (c - mc) * (c - mc), 6), row, col) AS k FROM ow JOIN ar USING (seed)) q WHERE k = 1)
SELECT seed, cells, cells * 1e0 AS plan_area, round(greatest(cells, area), 4) AS surface_area, round(degrees(atan(sqrt(kr * kr + kc * kc))), 4) AS slope, round(mv, 4) AS mean, x0 + c + 0.5e0 AS center_x, round(k0 + kr * r + kc * c, 4) AS center_y, z0 + r + 0.5e0 AS center_z
FROM ar JOIN ce USING (seed) JOIN p2 USING (seed) CROSS JOIN sg""")
def describe_surface(spark, sf_dir):
    g, (x0, z0, cell, cols, _) = _surface(spark, sf_dir, "highest", 1.0)
    return measure.describe_surfaces(_roof_cells(spark, sf_dir), g, cell, cols, x0, z0)


@query(ROOFS + """, sd AS (SELECT * FROM (VALUES (-1, 0, 0, 0, 1, 0), (1, 0, 0, 1, 1, 1), (0, -1, 0, 0, 0, 1), (0, 1, 1, 0, 1, 1)) t(i, j, x1, z1, x2, z2))
SELECT seed, col + x1 AS x1, row + z1 AS z1, col + x2 AS x2, row + z2 AS z2 FROM sc a CROSS JOIN sd WHERE NOT EXISTS (SELECT 1 FROM sc b WHERE b.seed = a.seed AND b.row = a.row + i AND b.col = a.col + j)""")
def surface_outline(spark, sf_dir):
    return measure.surface_outline(_roof_cells(spark, sf_dir))


#: Roofs and crowns in stripes of three rows, each a surface of its own that touches the next.
STRIPES = f"{BASE}, sc AS (SELECT DISTINCT CAST(kind * 10000000 + floor(row / 3e0) * 1000 + floor(col / 100e0) AS BIGINT) AS seed, row, col FROM pc WHERE kind >= 1), tc AS (SELECT DISTINCT a.seed AS a, b.seed AS b FROM sc a JOIN sc b ON a.seed < b.seed AND ((a.row = b.row AND b.col BETWEEN a.col - 1 AND a.col + 1) OR (a.col = b.col AND b.row BETWEEN a.row - 1 AND a.row + 1)))"


def _stripes(spark, sf_dir):
    p = points(spark, sf_dir)
    own = quality.with_cells(p.filter("kind >= 1"), Frame.of(p))
    return own.select((F.col("kind") * 10_000_000 + F.floor(F.col("row") / 3) * 1000 + F.floor(F.col("col") / 100)).cast("bigint").alias("seed"), "row", "col").distinct()


@query(STRIPES + " SELECT a, b FROM tc")
def surfaces_touch(spark, sf_dir):
    return measure.surfaces_touch(_stripes(spark, sf_dir))


@query(STRIPES.replace("WITH pts", "WITH RECURSIVE pts", 1) + """, bo AS (SELECT a, b FROM tc UNION ALL SELECT b, a FROM tc), re AS (SELECT DISTINCT seed, seed AS at_ FROM sc UNION SELECT re.seed, bo.b FROM re JOIN bo ON bo.a = re.at_),
ro AS (SELECT seed, min(at_) AS root FROM re GROUP BY seed) SELECT DISTINCT root AS seed, row, col FROM sc JOIN ro ON ro.seed = sc.seed""")
def merge_surfaces(spark, sf_dir):
    return measure.merge_touching(_stripes(spark, sf_dir))


@query(f"""{ROOFS}, {_surface_cte("max", "1e0")}, ow AS (SELECT seed, row, col, row * 1e0 AS r, col * 1e0 AS c, value AS v FROM sc LEFT JOIN g2 USING (row, col)), {_seed_plane("ow", "p1")},
nr AS (SELECT ow.* FROM ow JOIN p1 USING (seed) WHERE abs(v - (k0 + kr * r + kc * c)) <= 0.3e0), {_seed_plane("nr", "p2")},
sd AS (SELECT * FROM (VALUES (-1, 0, 0, 0, 1, 0), (1, 0, 0, 1, 1, 1), (0, -1, 0, 0, 0, 1), (0, 1, 1, 0, 1, 1)) t(i, j, x1, z1, x2, z2)),
ed AS (SELECT seed, col + x1 AS x1, row + z1 AS z1, col + x2 AS x2, row + z2 AS z2 FROM sc a CROSS JOIN sd WHERE NOT EXISTS (SELECT 1 FROM sc b WHERE b.seed = a.seed AND b.row = a.row + i AND b.col = a.col + j))
SELECT seed, x0 + x1 AS x1, round(k0 + kr * (z1 - 0.5e0) + kc * (x1 - 0.5e0) + 0.05e0, 4) AS y1, z0 + z1 AS z1, x0 + x2 AS x2, round(k0 + kr * (z2 - 0.5e0) + kc * (x2 - 0.5e0) + 0.05e0, 4) AS y2, z0 + z2 AS z2 FROM ed JOIN p2 USING (seed) CROSS JOIN sg""")
def surface_outline_in_space(spark, sf_dir):
    """Outlines of surfaces on their fitted planes."""
    g, (x0, z0, cell, _, _) = _surface(spark, sf_dir, "highest", 1.0)
    cells = _roof_cells(spark, sf_dir)
    own = cells.join(g, ["row", "col"], "left").select("seed", F.col("row").cast("double").alias("r"), F.col("col").cast("double").alias("c"), "value")
    out = measure.surface_outline(cells, measure.surface_planes(own), cell, x0, z0)
    return out.withColumns({"y1": F.round("y1", 4), "y2": F.round("y2", 4)})


@query(ROOFS + " SELECT count(*) * 1e0 AS area FROM (SELECT DISTINCT row, col FROM sc) q")
def combined_area(spark, sf_dir):
    return measure.combined_area(_roof_cells(spark, sf_dir), 1.0)


def _polygons(spark, sf_dir):
    """One quadrilateral for each region, by formula."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("int").alias("id"))
    k = F.col("id").cast("double")
    corner = lambda x, z: F.struct(x.alias("x"), (F.lit(8.0) + k / 4).alias("y"), z.alias("z"))
    x, z = k * 3 + 2.25, k * 2 + 3.25
    v = F.array(corner(x, z), corner(x + 12.5, z), corner(x + 12.5, z + 9.5), corner(x, z + 9.5))
    return r.select("id", v.alias("vertices"), F.lit("mean").alias("base"), F.lit(None).cast("double").alias("custom_base"), F.lit(4.0).alias("height"))


def _l_shapes(spark, sf_dir):
    """An L for each region, larger from one to the next, half a metre higher from corner to corner."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("int").alias("id"))
    k = F.col("id").cast("double")
    ring = [(F.lit(0.0), F.lit(0.0)), (k + 10, F.lit(0.0)), (k + 10, F.lit(4.0)), (F.lit(4.0), F.lit(4.0)), (F.lit(4.0), k + 8), (F.lit(0.0), k + 8)]
    v = F.array(*(F.struct(x.alias("x"), F.lit(i / 2).alias("y"), z.alias("z")) for i, (x, z) in enumerate(ring)))
    return r.select("id", v.alias("vertices"), F.lit("triangulated").alias("base"), F.lit(None).cast("double").alias("custom_base"), F.lit(0.0).alias("height"))


_L_SHAPES = """ls AS (SELECT CAST(r_regionkey AS INTEGER) AS id, i, i / 2e0 AS y, [0e0, k + 10, k + 10, 4e0, 4e0, 0e0][i + 1] AS x, [0e0, 0e0, 4e0, 4e0, k + 8, k + 8][i + 1] AS z FROM (SELECT r_regionkey, r_regionkey * 1e0 AS k FROM region) q CROSS JOIN (SELECT unnest(range(6)) AS i) s),
es AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, a.x * b.z - b.x * a.z AS part FROM ls a JOIN ls b ON b.id = a.id AND b.i = (a.i + 1) % 6)"""


@query(f"WITH {_L_SHAPES} SELECT id, round(sum(sqrt(dx * dx + dz * dz)), 6) AS perimeter, round(sum(sqrt(dx * dx + dy * dy + dz * dz)), 6) AS edge_length, round(abs(sum(part)) / 2, 6) AS plan_area FROM es GROUP BY id")
def polygon_area_perimeter(spark, sf_dir):
    return measure.polygon_frame(_l_shapes(spark, sf_dir))


@query(f"WITH {_L_SHAPES} SELECT id, 4 AS triangles, round(abs(sum(part)) / 2, 6) AS area FROM es GROUP BY id")
def polygon_triangulation(spark, sf_dir):
    """Concave polygons cut into triangles, which cover them."""
    t = measure.polygon_triangles(_l_shapes(spark, sf_dir))
    one = F.abs((F.col("bx") - F.col("ax")) * (F.col("cz") - F.col("az")) - (F.col("cx") - F.col("ax")) * (F.col("bz") - F.col("az"))) / 2
    return t.groupBy("id").agg(F.count("*").cast("int").alias("triangles"), F.round(F.sum(one), 6).alias("area"))


def _based(spark, sf_dir):
    """The rectangle of each region, sloping, once for each base."""
    corners = F.transform("vertices", lambda p: F.struct(p["x"].alias("x"), (p["y"] + (p["x"] - F.col("vertices")[0]["x"]) * 0.125 + (p["z"] - F.col("vertices")[0]["z"]) * 0.0625).alias("y"), p["z"].alias("z")))
    own = _polygons(spark, sf_dir).withColumn("vertices", corners).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(len(measure.BASES) - 1))))
    names = F.array(*map(F.lit, measure.BASES))
    return own.select((F.col("id") * len(measure.BASES) + F.col("b")).cast("int").alias("id"), "vertices", names[F.col("b")].alias("base"), F.lit(9.5).alias("custom_base"), "height")


_BASED = f"""pg AS (SELECT CAST(r_regionkey * 6 + b AS INTEGER) AS id, CAST(b AS INTEGER) AS b, r_regionkey * 3 + 2.25e0 AS xa, r_regionkey * 3 + 14.75e0 AS xb, r_regionkey * 2 + 3.25e0 AS za, r_regionkey * 2 + 12.75e0 AS zb, 8e0 + r_regionkey / 4e0 AS y0 FROM region CROSS JOIN (SELECT unnest(range(6)) AS b) q),
pb AS (SELECT *, CASE b WHEN 2 THEN y0 WHEN 3 THEN y0 + (12.5e0 * 0.125e0 + 9.5e0 * 0.0625e0) / 2 WHEN 4 THEN y0 + 12.5e0 * 0.125e0 + 9.5e0 * 0.0625e0 WHEN 5 THEN 9.5e0 END AS level FROM pg)"""


@query(f"""{scene_cte()}, {_surface_cte("avg", "1e0")}, {_BASED}, kept AS (SELECT * FROM g2),
ln AS (SELECT pb.*, s, (s + 0.5e0) / 4e0 + z0 AS z, x0 FROM pb CROSS JOIN sg, LATERAL (SELECT unnest(range(0, 400)) AS s) q WHERE (s + 0.5e0) / 4e0 + z0 > za AND (s + 0.5e0) / 4e0 + z0 <= zb),
pt AS (SELECT id, CAST(floor(s / 4e0) AS INTEGER) AS row, c AS col, (least(xb, x0 + c + 1) - greatest(xa, x0 + c)) / 4e0 AS part,
  coalesce(level, y0 + ((least(xb, x0 + c + 1) + greatest(xa, x0 + c)) / 2 - xa) * 0.125e0 + (z - za) * 0.0625e0) AS base FROM ln, LATERAL (SELECT unnest(range(0, 400)) AS c) q WHERE x0 + c + 1 > xa AND x0 + c < xb)
SELECT id, round(sum(part * (value - base)), 4) AS net, round(sum(part * base) / sum(part), 4) AS base_mean, 118.75e0 AS plan_area FROM pt JOIN kept USING (row, col) GROUP BY id""")
def polygon_bases(spark, sf_dir):
    """Volumes over all six bases: what is above them less what is below."""
    g, (x0, z0, cell, _, _) = _surface(spark, sf_dir, "mean", 1.0)
    out = measure.measure_polygons(_based(spark, sf_dir), g, x0, z0, cell)
    return out.select("id", F.round(F.col("cut") - F.col("fill"), 4).alias("net"), F.round("base_mean", 4).alias("base_mean"), "plan_area")


@query(f"""{scene_cte()}, {_surface_cte("avg", "1e0")}, {_BASED},
ln AS (SELECT pb.*, s, (s + 0.5e0) / 4e0 + z0 AS z, x0 FROM pb CROSS JOIN sg, LATERAL (SELECT unnest(range(0, 400)) AS s) q WHERE b = 3 AND (s + 0.5e0) / 4e0 + z0 > za AND (s + 0.5e0) / 4e0 + z0 <= zb),
pt AS (SELECT id, CAST(floor(s / 4e0) AS INTEGER) AS row, c AS col, (least(xb, x0 + c + 1) - greatest(xa, x0 + c)) / 4e0 AS part FROM ln, LATERAL (SELECT unnest(range(0, 400)) AS c) q WHERE x0 + c + 1 > xa AND x0 + c < xb)
SELECT id, round(sum(CASE WHEN (row * 7 + col * 3) % 5 = 0 THEN part ELSE 0e0 END) / sum(part), 6) AS unmeasured FROM pt GROUP BY id""")
def polygon_gaps(spark, sf_dir):
    """The share of polygons over cells without points, a fifth of the grid's."""
    g, (x0, z0, cell, _, _) = _surface(spark, sf_dir, "mean", 1.0)
    holed = g.filter((F.col("row") * 7 + F.col("col") * 3) % 5 != 0)
    return measure.measure_polygons(_based(spark, sf_dir).filter("base = 'mean'"), holed, x0, z0, cell).select("id", "unmeasured")


@query(f"""WITH {_BASED}, co AS (SELECT id, b, CASE b WHEN 0 THEN NULL ELSE level END AS level, i, y0 + [0e0, 1.5625e0, 2.15625e0, 0.59375e0][i + 1] AS y FROM pb CROSS JOIN (SELECT unnest(range(4)) AS i) q)
SELECT id, 8 AS outline, 6 AS base, CAST(sum(CASE WHEN level IS NOT NULL AND abs(y - level) > 0.01e0 THEN 2 ELSE 0 END) AS INTEGER) AS drops, 24 AS prism_edges, 30 AS prism_faces,
  round(sum(coalesce(level, y)) * 6 + 4e0 * 12, 4) AS upright FROM co GROUP BY id""")
def polygon_drawing(spark, sf_dir):
    """Places of the arrays that draw each polygon; upright adds up the heights of its edges' ends."""
    d = measure.polygon_drawing(_based(spark, sf_dir))
    heights = F.aggregate("prism_edges", F.lit(0.0), lambda acc, p: acc + p["y"])
    return d.select("id", *(F.size(c).alias(c) for c in ("outline", "base", "drops", "prism_edges", "prism_faces")), F.round(heights, 4).alias("upright"))


# The grid has no gaps under the polygons once speckles are filled, so no cell counts as filled.
@query(f"""{scene_cte()}, {_surface_cte("avg", "1e0")},
pg AS (SELECT CAST(r_regionkey AS INTEGER) AS id, r_regionkey * 3 + 2.25e0 AS xa, r_regionkey * 3 + 14.75e0 AS xb, r_regionkey * 2 + 3.25e0 AS za, r_regionkey * 2 + 12.75e0 AS zb, 8e0 + r_regionkey / 4e0 AS base FROM region),
ln AS (SELECT pg.*, s, (s + 0.5e0) / 4e0 + z0 AS z, x0 FROM pg CROSS JOIN sg, LATERAL (SELECT unnest(range(0, 400)) AS s) q WHERE (s + 0.5e0) / 4e0 + z0 > za AND (s + 0.5e0) / 4e0 + z0 <= zb),
pt AS (SELECT id, base, CAST(floor(s / 4e0) AS INTEGER) AS row, c AS col, (least(xb, x0 + c + 1) - greatest(xa, x0 + c)) / 4e0 AS part FROM ln, LATERAL (SELECT unnest(range(0, 400)) AS c) q WHERE x0 + c + 1 > xa AND x0 + c < xb),
sf AS (SELECT a.row, a.col, a.value, sqrt(1 + (e.value - w.value) / 2 * ((e.value - w.value) / 2) + (s.value - n.value) / 2 * ((s.value - n.value) / 2)) AS factor FROM g2 a JOIN g2 e ON e.row = a.row AND e.col = a.col + 1 JOIN g2 w ON w.row = a.row AND w.col = a.col - 1 JOIN g2 s ON s.col = a.col AND s.row = a.row + 1 JOIN g2 n ON n.col = a.col AND n.row = a.row - 1)
SELECT id, true AS valid, 118.75e0 AS plan_area, 44e0 AS perimeter, 44e0 AS edge_length, round(greatest(118.75e0, sum(part * factor) * 118.75e0 / sum(part)), 6) AS surface_area, round(sum(CASE WHEN value > base THEN part * (value - base) ELSE 0 END), 6) AS cut,
  round(sum(CASE WHEN value < base THEN part * (base - value) ELSE 0 END), 6) AS fill, 475e0 AS prism, round(sum(part * greatest(0e0, least(4e0, value - base))), 6) AS filled, round(sum(CASE WHEN value IS NULL THEN part ELSE 0 END) / sum(part), 6) AS unmeasured, round(sum(part * base) / sum(part), 6) AS base_mean
FROM pt LEFT JOIN sf USING (row, col) GROUP BY id""")
def polygon_volume(spark, sf_dir):
    g, (x0, z0, cell, _, _) = _surface(spark, sf_dir, "mean", 1.0)
    return measure.measure_polygons(_polygons(spark, sf_dir), g, x0, z0, cell)


_M = [0.02, 0.0, 0.0, 0.0, 0.0, 0.0, 0.01, 0.0, 0.0, -0.02, 0.0, 0.0, -0.32, 0.32, -0.5, 1.0]


@query(scene_cte() + """, s AS (SELECT pid, x, y, z, 0.01e0 * y - 0.5e0 AS depth, sqrt(((0.02e0 * x - 0.32e0 + 1) / 2 * 800 - 410) * ((0.02e0 * x - 0.32e0 + 1) / 2 * 800 - 410) + ((1 - (-0.02e0 * z + 0.32e0)) / 2 * 600 - 290) * ((1 - (-0.02e0 * z + 0.32e0)) / 2 * 600 - 290)) AS dist FROM pts)
SELECT pid, x, y, z FROM s WHERE depth BETWEEN -1 AND 1 AND dist <= 6 ORDER BY CASE WHEN dist <= 2 THEN 0 ELSE 1 END, CASE WHEN dist <= 2 THEN depth ELSE dist END, pid LIMIT 1""")
def pick_point(spark, sf_dir):
    return measure.pick_point(points(spark, sf_dir), _M, 410.0, 290.0, 800.0, 600.0).select("pid", "x", "y", "z")


@query(scene_cte() + """, b AS (SELECT min(x) AS x0, min(z) AS z0, greatest(1, CAST(ceil((max(x) - min(x)) / 16e0) AS INTEGER)) AS nx, greatest(1, CAST(ceil((max(z) - min(z)) / 16e0) AS INTEGER)) AS nz FROM pts)
SELECT CAST(greatest(0, least(nx - 1, floor((x - x0) / 16e0))) AS INTEGER) AS grid_x, CAST(greatest(0, least(nz - 1, floor((z - z0) / 16e0))) AS INTEGER) AS grid_z, count(*) AS n FROM pts CROSS JOIN b GROUP BY 1, 2""")
def tiles(spark, sf_dir):
    p = points(spark, sf_dir)
    b = p.agg(F.min("x"), F.min("z"), F.max("x"), F.max("z")).first()
    return tables.tiles(p, 16.0, b[0], b[1], b[2] - b[0], b[3] - b[1]).groupBy("grid_x", "grid_z").agg(F.count("*").alias("n"))


@query(scene_cte() + """, o AS (SELECT min(x) AS ox, min(y) AS oy, min(z) AS oz FROM pts), l AS (SELECT unnest([1e0, 2e0, 4e0, 8e0]) AS voxel)
SELECT voxel, count(DISTINCT (floor((x - ox) / voxel), floor((y - oy) / voxel), floor((z - oz) / voxel))) AS n FROM pts CROSS JOIN o CROSS JOIN l GROUP BY voxel""")
def lod_ladder(spark, sf_dir):
    return measure.lod_ladder(points(spark, sf_dir), 1.0, 2.0, 4)


#: Edge of the tiles in metres, and thinner tiers made of each.
TILE_EDGE, LEVELS = 32.0, 2


_STORES: dict = {}


def _store(spark, sf_dir) -> tilestore.TileStore:
    """The scene as a store of tiles with thinner tiers, made once for each session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = removed_at_exit(spark, f"{shared_dir(spark)}/pm-tiles-{uuid.uuid4().hex}")
        _STORES[key] = tilestore.write_tiles(points(spark, sf_dir).select("pid", "x", "y", "z"), path, TILE_EDGE, levels=LEVELS)
    return _STORES[key]


_SPACING = "greatest(sqrt(greatest((max_x - min_x) * (max_z - min_z), 1e-6) / n), 0.005e0)"
_BOX = "min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z"
_TILED = f"""ex AS (SELECT min(x) AS x0, min(z) AS z0, greatest(1, ceil((max(x) - min(x)) / {TILE_EDGE}e0)) AS nx, greatest(1, ceil((max(z) - min(z)) / {TILE_EDGE}e0)) AS nz FROM pts),
p0 AS (SELECT pid, x, y, z, CAST(greatest(0, least(nx - 1, floor((x - x0) / {TILE_EDGE}e0))) AS INTEGER) AS grid_x, CAST(greatest(0, least(nz - 1, floor((z - z0) / {TILE_EDGE}e0))) AS INTEGER) AS grid_z FROM pts CROSS JOIN ex),
b0 AS (SELECT grid_x, grid_z, 0e0 AS voxel, count(*) AS n, {_BOX} FROM p0 GROUP BY 1, 2)"""


def _thinned_sql(k: int) -> str:
    """Tier k of every tile, from the points p and boxes b of the tier above."""
    ladder = ", ".join(f"({i}, {tilestore.GROWTH**i!r}e0)" for i in range(tilestore.ATTEMPTS + 1))
    at = ", ".join(f"floor(({c} - min_{c}) / v)" for c in "xyz")
    return f"""a{k} AS (SELECT *, greatest(voxel, {_SPACING}) * {tilestore.GROWTH}e0 AS first, greatest(1, floor(n * {tilestore.FRACTION}e0)) AS target FROM b{k - 1}),
l{k} AS (SELECT a.*, g.i, a.first * g.f AS v FROM a{k} a CROSS JOIN (VALUES {ladder}) g(i, f)),
h{k} AS (SELECT grid_x, grid_z, i, v, target, count(*) AS kept FROM (SELECT DISTINCT p.grid_x, p.grid_z, i, v, target, {at} FROM p{k - 1} p JOIN l{k} l ON l.grid_x = p.grid_x AND l.grid_z = p.grid_z) q GROUP BY ALL),
v{k} AS (SELECT grid_x, grid_z, min(v) AS v FROM h{k} WHERE kept <= target OR kept <= 1 OR i = {tilestore.ATTEMPTS} GROUP BY 1, 2),
p{k} AS (SELECT p.grid_x, p.grid_z, any_value(v) AS voxel, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p{k - 1} p JOIN a{k} a ON a.grid_x = p.grid_x AND a.grid_z = p.grid_z JOIN v{k} v ON v.grid_x = p.grid_x AND v.grid_z = p.grid_z GROUP BY p.grid_x, p.grid_z, {at}),
b{k} AS (SELECT grid_x, grid_z, max(voxel) AS voxel, count(*) AS n, {_BOX} FROM p{k} GROUP BY 1, 2)"""


_TIERS = "ts AS (" + " UNION ALL ".join(
    f"SELECT 'tile-' || o.grid_x || '-' || o.grid_z AS tile, {k} AS tier, t.n, t.voxel, o.min_x, o.max_x, o.min_y, o.max_y, o.min_z, o.max_z FROM b0 o JOIN b{k} t ON t.grid_x = o.grid_x AND t.grid_z = o.grid_z" for k in range(LEVELS + 1)
) + ")"
TIERS = f"{scene_cte()}, {_TILED}, " + ", ".join(_thinned_sql(k) for k in range(1, LEVELS + 1)) + f", {_TIERS}, td AS (SELECT *, {_SPACING} AS spacing FROM ts)"


@query(f"{scene_cte()}, {_TILED} SELECT 'tile-' || grid_x || '-' || grid_z AS tile, grid_x, grid_z, n, min_x, max_x, min_y, max_y, min_z, max_z FROM b0")
def tile_manifest(spark, sf_dir):
    """Every tile's number of points and box, as a reader finds them."""
    return _store(spark, sf_dir).manifest.filter("tier = 0").select("tile", "grid_x", "grid_z", "n", *(f"{s}_{c}" for c in "xyz" for s in ("min", "max")))


@query(TIERS + " SELECT tile, tier, n, round(voxel, 6) AS voxel, round(spacing, 6) AS spacing FROM td")
def tile_lod(spark, sf_dir):
    """Every tile's tiers: voxels grown until a quarter of the points is left."""
    return _store(spark, sf_dir).manifest.select("tile", "tier", "n", F.round("voxel", 6).alias("voxel"), F.round("spacing", 6).alias("spacing"))


@query(f"""{scene_cte()}, {_TILED}, s1 AS (SELECT CAST(sum(CASE WHEN pid >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n, round(sum(x), 3) AS sx, round(sum(y), 3) AS sy, round(sum(z), 3) AS sz FROM p0) SELECT 0 AS tier, n, sx, sy, sz FROM s1""")
def tile_store_lossless(spark, sf_dir):
    """All points of the store, none twice."""
    p = _store(spark, sf_dir).points().select("pid", "x", "y", "z").distinct()
    return p.agg(F.lit(0).alias("tier"), F.count("pid").alias("n"), *(F.round(F.sum(c), 3).alias(f"s{c}") for c in "xyz")).select("tier", "n", "sx", "sy", "sz")


@query(f"{scene_cte()} SELECT pid, x, y, z FROM pts WHERE x BETWEEN 20e0 AND 45.5e0 AND z BETWEEN 10e0 AND 70e0")
def points_in_rectangle(spark, sf_dir):
    """A rectangle of the plan, read from the tiles it meets."""
    return _store(spark, sf_dir).within(20.0, 10.0, 45.5, 70.0).select("pid", "x", "y", "z")


_CORNERS = "SELECT * FROM (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j) CROSS JOIN (VALUES (0), (1)) c(k)"
#: The view projection of pick_point, with a perspective: w = 1 + 0.01 z.
_VIEW = [*_M[:11], 0.01, *_M[12:]]


@query(f"""{scene_cte()}, {_TILED}, cr AS (SELECT grid_x, grid_z, CASE WHEN i = 1 THEN max_x ELSE min_x END AS x, CASE WHEN j = 1 THEN max_y ELSE min_y END AS y, CASE WHEN k = 1 THEN max_z ELSE min_z END AS z FROM b0 CROSS JOIN ({_CORNERS}) o),
sc AS (SELECT grid_x, grid_z, 1 + 0.01e0 * z AS w, ((0.02e0 * x - 0.32e0) / (1 + 0.01e0 * z) + 1) * 400e0 AS sx, (1 - (-0.02e0 * z + 0.32e0) / (1 + 0.01e0 * z)) * 300e0 AS sy FROM cr)
SELECT 'tile-' || grid_x || '-' || grid_z AS tile FROM sc GROUP BY grid_x, grid_z HAVING min(w) <= 0 OR (410 BETWEEN min(sx) - 6 AND max(sx) + 6 AND 290 BETWEEN min(sy) - 6 AND max(sy) + 6)""")
def tiles_under_cursor(spark, sf_dir):
    return measure.tiles_under_cursor(_store(spark, sf_dir).manifest.filter("tier = 0"), _VIEW, 410.0, 290.0, 800.0, 600.0).select("tile")


@query(scene_cte() + """, s AS (SELECT pid, x, y, z, 1 + 0.01e0 * z AS w FROM pts), d AS (SELECT *, sqrt(pow((((0.02e0 * x - 0.32e0) / w + 1) / 2e0) * 800 - 410, 2) + pow(((1 - (-0.02e0 * z + 0.32e0) / w) / 2e0) * 600 - 290, 2)) AS dist, (0.01e0 * y - 0.5e0) / w AS depth FROM s WHERE w > 0)
SELECT pid, x, y, z, round(depth, 9) AS depth, round(dist, 9) AS dist FROM d WHERE depth BETWEEN -1 AND 1 AND dist <= 6 ORDER BY dist > 2, CASE WHEN dist <= 2 THEN depth ELSE dist END, pid LIMIT 1""")
def pick_in_tiles(spark, sf_dir):
    """The point under a cursor, sought in the tiles that may hold it."""
    near = _store(spark, sf_dir).under_cursor(_VIEW, 410.0, 290.0, 800.0, 600.0)
    return measure.pick_point(near, _VIEW, 410.0, 290.0, 800.0, 600.0).select("pid", "x", "y", "z", F.round("depth", 9).alias("depth"), F.round("dist", 9).alias("dist"))


def _tiers(spark, sf_dir):
    return _store(spark, sf_dir).manifest


@query(TIERS + f" SELECT tier AS level, CASE WHEN tier = 0 THEN 'full' ELSE 'lod' || tier END AS id, CASE WHEN tier > 0 THEN {tilestore.FRACTION}e0 END AS fraction, count(*) AS tiles, CAST(sum(n) AS BIGINT) AS points FROM td GROUP BY tier")
def tier_specs(spark, sf_dir):
    """The tiers asked for, and what was made of them."""
    made = _tiers(spark, sf_dir).groupBy(F.col("tier").alias("level")).agg(F.count("*").alias("tiles"), F.sum("n").alias("points"))
    return made.join(measure.tier_specs(spark, LEVELS), "level").select("level", "id", "fraction", "tiles", "points")


@query(TIERS + """, t0 AS (SELECT tile, n AS nf, sum(n) OVER () AS total FROM td WHERE tier = 0), f AS (SELECT td.tile, tier, td.n <= greatest(1, floor(total * 0.3e0 * nf / total + 0.5e0)) AS fits FROM td JOIN t0 ON t0.tile = td.tile)
SELECT tile, coalesce(min(CASE WHEN fits THEN tier END), max(tier)) AS tier FROM f GROUP BY tile""")
def tier_for_budget(spark, sf_dir):
    t = _tiers(spark, sf_dir)
    return measure.tier_for_budget(t, t.filter("tier = 0").agg(F.sum("n")).first()[0] * 0.3)


@query("""WITH t(tier, m) AS (VALUES (0, 10e0), (1, 50e0), (2, 120e0), (3, 400e0)) SELECT CAST(n_nationkey AS INTEGER) AS camera, coalesce((SELECT arg_max(tier, m) FROM t WHERE m <= n_nationkey * 20e0), 0) AS tier FROM nation""")
def tier_for_distance(spark, sf_dir):
    t = spark.createDataFrame([(0, 10.0), (1, 50.0), (2, 120.0), (3, 400.0), (4, None)], "tier int, min_distance double")
    c = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("camera"), (F.col("n_nationkey") * F.lit(20.0)).alias("distance"))
    return measure.tier_for_distance(t, c)


_GAPS = """, d AS (SELECT *, spacing * 500 / greatest(sqrt(pow(greatest(min_x - 5, 0e0, 5 - max_x), 2) + pow(greatest(min_y - 40, 0e0, 40 - max_y), 2) + pow(greatest(min_z - 5, 0e0, 5 - max_z), 2)), 1e-3) AS gap FROM td)"""


@query(TIERS + _GAPS + " SELECT tile, CAST(coalesce(max(CASE WHEN gap <= 6 THEN tier END), min(tier)) AS INTEGER) AS tier FROM d GROUP BY tile")
def tier_screen_space(spark, sf_dir):
    return measure.tier_for_screen(_tiers(spark, sf_dir), 5.0, 40.0, 5.0, 500.0, 6.0)


# Steps one after the other: what is spent and whether a step has been refused, in the order of the gaps.
@query(TIERS + _GAPS + """, st AS (SELECT tile, max(tier) AS coarsest, arg_max(n, tier) AS n0 FROM d GROUP BY tile), b AS (SELECT floor(sum(n0) * 1.8e0) AS budget, sum(n0) AS spent FROM st),
sp AS (SELECT tile, tier, gap0, more FROM (SELECT tile, tier, n - lag(n) OVER w AS more, lag(gap) OVER w AS gap0, min_x FROM d WINDOW w AS (PARTITION BY tile ORDER BY tier DESC)) q WHERE gap0 > 2 AND min_x < 80),
ru AS (SELECT *, sum(more) OVER (ORDER BY gap0 DESC, tile, tier DESC ROWS UNBOUNDED PRECEDING) AS total FROM sp)
SELECT st.tile, CAST(coalesce(min(ru.tier), any_value(st.coarsest)) AS INTEGER) AS tier FROM st LEFT JOIN (SELECT ru.* FROM ru, b WHERE ru.total + b.spent <= b.budget) ru ON ru.tile = st.tile GROUP BY st.tile""")
def tier_screen_budget(spark, sf_dir):
    """The same view with a budget of points; tiles from 80 m east on are out of view."""
    t = _tiers(spark, sf_dir)
    least = t.groupBy("tile").agg(F.max_by("n", "tier").alias("n")).agg(F.sum("n")).first()[0]
    return measure.tier_for_screen(t, 5.0, 40.0, 5.0, 500.0, 2.0, math.floor(least * 1.8), F.col("min_x") < 80)


@query(TIERS + _GAPS + """, ch AS (SELECT tile, coalesce(max(CASE WHEN gap <= 6 THEN tier END), min(tier)) AS tier FROM d GROUP BY tile)
SELECT td.tier, count(*) AS tiles, CAST(sum(td.n) AS BIGINT) AS points, round(sum(td.spacing * td.n) / sum(td.n), 6) AS spacing FROM td JOIN ch ON ch.tile = td.tile AND ch.tier = td.tier GROUP BY td.tier""")
def lod_usage(spark, sf_dir):
    """What the view by screen space draws."""
    chosen = _tiers(spark, sf_dir).join(tier_screen_space(spark, sf_dir), ["tile", "tier"])
    return tables.lod_usage(chosen).withColumn("spacing", F.round("spacing", 6))


@query(scene_cte() + f" SELECT pid, point_source_id FROM pts WHERE NOT {NOISE} AND point_source_id <> 2")
def visible_points(spark, sf_dir):
    hidden = spark.createDataFrame([(2,)], "point_source_id int")
    return tables.visible(points(spark, sf_dir), "hidden", hidden).select("pid", "point_source_id")


@query(scene_cte() + """, t AS (SELECT CASE WHEN classification IN (5, 6) THEN 1 ELSE classification END AS truth, CASE WHEN y - terrain > 20 THEN 18 WHEN y - terrain < -4 THEN 7 WHEN y - terrain <= 0.5e0 THEN 2 ELSE 1 END AS c FROM pts)
SELECT round(sum(CASE WHEN truth = 2 AND c <> 2 THEN 1 ELSE 0 END) * 1e0 / sum(CASE WHEN truth = 2 THEN 1 ELSE 0 END), 6) AS type_1, round(sum(CASE WHEN truth <> 2 AND c = 2 THEN 1 ELSE 0 END) * 1e0 / sum(CASE WHEN truth <> 2 THEN 1 ELSE 0 END), 6) AS type_2,
  round(sum(CASE WHEN (truth = 2) <> (c = 2) THEN 1 ELSE 0 END) * 1e0 / count(*), 6) AS total, round(sum(CASE WHEN truth IN (7, 18) AND c IN (7, 18) THEN 1 ELSE 0 END) * 1e0 / sum(CASE WHEN truth IN (7, 18) THEN 1 ELSE 0 END), 6) AS noise_recall FROM t""")
def ground_errors(spark, sf_dir):
    # Classes by height over the exact terrain, against those the scene was made with; tests judge detect_ground.
    h = F.col("height_above_ground")
    guess = F.when(h > 20, 18).when(h < -4, 7).when(h <= 0.5, 2).otherwise(1)
    truth = F.when(F.col("classification").isin(5, 6), 1).otherwise(F.col("classification"))
    return tables.ground_errors(hag_points(spark, sf_dir).select(truth.alias("truth"), guess.alias("classification")))


@query(BASE + " SELECT row, col, count(*) AS n, sum(y) AS s, sum(y * y) AS ss, min(y) AS lo, max(y) AS hi FROM pc GROUP BY row, col")
def streaming_cell_stats(spark, sf_dir):
    from .streaming import cells

    p = points(spark, sf_dir)
    return cells.cell_stats_stream(p, Frame.of(p))


_STATES: dict = {}


def _state(spark, sf_dir):
    """The scene taken in as a stream of files in two runs, the second of files that came late, with a compaction between them."""
    from .streaming.partials import ScanState

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATES:
        p = points(spark, sf_dir).drop("kind", "terrain", "above")
        at = removed_at_exit(spark, f"{shared_dir(spark)}/pm-state-{uuid.uuid4().hex}")
        low = p.agg(F.min("x"), F.min("y"), F.min("z")).first()
        state = ScanState(spark, at, Frame.of(p), 2.0, tuple(low))
        # Files are as many as the scene has parts; a batch takes one for each core, so neither a task nor a batch grows with the scene.
        files = max(2, spark.sparkContext.defaultParallelism)
        for late in (0, 1):
            p.filter(F.pmod(F.xxhash64("pid"), F.lit(3)).isin([1, 2] if not late else [0])).write.mode("append").parquet(f"{at}/in")
            stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
            state.follow(stream).awaitTermination()
            if not late:
                state.compact()
        _STATES[key] = state
    return _STATES[key]


@query(ORACLES["class_histogram"])
def streamed_classes(spark, sf_dir):
    return _state(spark, sf_dir).table("classes")


@query(ORACLES["density_stats"])
def streamed_density(spark, sf_dir):
    s = _state(spark, sf_dir)
    return quality.density(quality.footprint_cells(settled(s.survey())), s.frame, (1, 2))


@query(ORACLES["strip_pairs"])
def streamed_strips(spark, sf_dir):
    return quality.strip_pairs(quality.strip_offsets(settled(_state(spark, sf_dir).survey())))


@query(ORACLES["voxel_majority"])
def streamed_votes(spark, sf_dir):
    return _state(spark, sf_dir).thinned().select("vx", "vy", "vz", "classification")


@query(ORACLES["streaming_cell_stats"])
def streamed_cells(spark, sf_dir):
    return _state(spark, sf_dir).table("cells")


# ------------------------------------------------------------ files

#: The scene's own frame, in which it is written and read again; a reader would move the frame of a wide one to its middle.
SCENE_ORIGIN = "0,0,0"


@query(scene_cte() + """SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, round(floor(x / 0.001e0 + 0.5e0) * 0.001e0, 6) AS x, round(floor(y / 0.001e0 + 0.5e0) * 0.001e0, 6) AS y, round(-(floor(-z / 0.001e0 + 0.5e0) * 0.001e0) + 0e0, 6) AS z,
  intensity, return_number, number_of_returns, classification, point_source_id, r, g, b FROM pts""")
def las_points(spark, sf_dir):
    """The scene written as LAS and read again: coordinates to the millimetre, points numbered on."""
    from .sinks.las import write_las
    from .sources.scan import read_scan

    path = removed_at_exit(spark, f"{shared_dir(spark)}/pm-scan-{uuid.uuid4().hex}.las")
    write_las(points(spark, sf_dir), path)
    out = read_scan(spark, path, origin=SCENE_ORIGIN)
    whole = ("return_number", "number_of_returns", "classification", "point_source_id", "r", "g", "b")
    return out.select("pid", *(F.round(c, 6).alias(c) for c in "xyz"), "intensity", *(F.col(c).cast("int").alias(c) for c in whole))


_HALF_UP = "floor(({0}) * {1} + 0.5e0) / {1}"


@query(scene_cte() + f""", ob AS (SELECT kind, CAST(floor(x / 100e0) AS INTEGER) AS bx, CAST(floor(z / 100e0) AS INTEGER) AS bz, count(*) AS n, (min(x) + max(x)) / 2 AS cx, (min(z) + max(z)) / 2 AS cz, min(terrain) AS gy, max(y - terrain) AS h, (max(x) - min(x)) * (max(z) - min(z)) AS area FROM pts WHERE kind > 0 AND NOT {NOISE} GROUP BY 1, 2, 3),
ol AS (SELECT *, kind * 1000000 + bx * 1000 + bz AS id FROM ob)
SELECT CAST(id AS BIGINT) AS id, id || ',' || CASE WHEN kind <= 2 THEN 'building' ELSE 'tree' END || ',' || printf('%.3f', {_HALF_UP.format("543000e0 + cx", "1000e0")}) || ',' || printf('%.3f', {_HALF_UP.format("4179000e0 - cz", "1000e0")}) || ',' || printf('%.2f', {_HALF_UP.format("gy", "100e0")})
  || ',' || printf('%.2f', {_HALF_UP.format("h", "100e0")}) || ',' || printf('%.1f', {_HALF_UP.format("area", "10e0")}) || ',' || CASE WHEN kind <= 2 THEN '' ELSE printf('%.2f', {_HALF_UP.format("sqrt(area / pi())", "100e0")}) END || ',' || n AS line FROM ol""")
def inventory_lines(spark, sf_dir):
    """The lines of an inventory of the scene's own buildings and trees, each with the points it was made of."""
    from .sinks import geojson

    block = [F.floor(F.col(c) / 100.0).cast("int").alias(f"b{c}") for c in "xz"]
    own = points(spark, sf_dir).filter(f"kind > 0 AND NOT {NOISE}").groupBy("kind", *block).agg(
        F.count("*").alias("point_count"), F.struct(((F.min("x") + F.max("x")) / 2).alias("x"), ((F.min("z") + F.max("z")) / 2).alias("z")).alias("center"), F.min("terrain").alias("ground_y"),
        F.max(F.col("y") - F.col("terrain")).alias("height"), ((F.max("x") - F.min("x")) * (F.max("z") - F.min("z"))).alias("area"),
    )
    own = own.withColumns({"id": (F.col("kind") * 1_000_000 + F.col("bx") * 1000 + F.col("bz")).cast("bigint"), "crown_radius": F.when(F.col("kind") > 2, F.sqrt(F.col("area") / F.lit(math.pi)))})
    own = own.withColumn("kind", F.when(F.col("kind") <= 2, "building").otherwise("tree"))
    return geojson.inventory_lines(own, (543000.0, 0.0, -4179000.0))


@query(scene_cte() + """SELECT round(floor(x / 0.001e0 + 0.5e0) * 0.001e0, 6) AS x, round(floor(y / 0.001e0 + 0.5e0) * 0.001e0, 6) AS y, round(-(floor(-z / 0.001e0 + 0.5e0) * 0.001e0) + 0e0, 6) AS z,
  intensity, return_number, number_of_returns, classification, point_source_id, r, g, b FROM pts""")
def las_tiles(spark, sf_dir):
    """The scene written as a folder of LAS files by tiles, each by one task, and read again as one scan."""
    from .sinks.las import write_las_tiles
    from .sources.scan import read_scan

    folder = removed_at_exit(spark, f"{shared_dir(spark)}/pm-scans-{uuid.uuid4().hex}")
    write_las_tiles(points(spark, sf_dir), folder, TILE_EDGE, per_file=20_000)
    out = read_scan(spark, folder, origin=SCENE_ORIGIN)
    whole = ("return_number", "number_of_returns", "classification", "point_source_id", "r", "g", "b")
    return out.select(*(F.round(c, 6).alias(c) for c in "xyz"), "intensity", *(F.col(c).cast("int").alias(c) for c in whole))
