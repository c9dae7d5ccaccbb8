"""GeoJSON and CSV of objects, contours and measurements; map coordinates are east and north."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def _place(x, z, origin, digits: int = 3):
    ox, _, oz = map(float, origin)
    return F.array(G.js_round(F.lit(ox) + x, digits), G.js_round(-(F.lit(oz) + z), digits))


def object_features(objects: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """id, feature: a polygon for each building (anticlockwise), a point for each tree."""
    ring = F.transform("outline", lambda p: _place(p["x"], p["z"], origin))
    n = F.size("outline")
    nxt = lambda i: F.get("outline", ((i + 1) % n).cast("int"))
    turn = F.aggregate(F.transform("outline", lambda p, i: p["x"] * -nxt(i)["z"] - nxt(i)["x"] * -p["z"]), F.lit(0.0), lambda s, v: s + v)
    ring = F.when(turn < 0, F.reverse(ring)).otherwise(ring)
    ring = F.concat(ring, F.slice(ring, 1, 1))
    r = lambda c: G.js_round(F.col(c), 2)
    common = [F.col("id"), F.col("kind"), F.col("point_count"), r("height").alias("height"), r("area").alias("area"), r("ground_y").alias("ground")]
    building = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(*common).alias("properties")))
    tree = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), _place(F.col("center.x"), F.col("center.z"), origin).alias("coordinates")).alias("geometry"), F.struct(*common, r("crown_radius").alias("crown_radius")).alias("properties")))
    return objects.select("id", F.when(F.col("kind") == "building", building).otherwise(tree).alias("feature"))


def contour_features(lines: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """k, feature: one LineString a contour."""
    path = F.transform("points", lambda p: _place(p["x"], p["z"], origin))
    props = F.struct(G.js_round(F.col("level"), 3).alias("elevation"), F.col("major").alias("index"))
    return lines.select("k", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), path.alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("feature"))


def _feature(kind: str, coordinates, props):
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*props).alias("properties"))).alias("feature")


def _spot(p, origin, digits: int = 3):
    """East, north and elevation of a point."""
    return F.concat(_place(p["x"], p["z"], origin, digits), F.array(G.js_round(F.lit(float(origin[1])) + p["y"], digits)))


def ruler_features(rulers: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """id, feature of rulers (id, a, b as structs x, y, z) with distance, rise and slope, taken between the rounded ends."""
    own = rulers.select("id", _spot(F.col("a"), origin).alias("a"), _spot(F.col("b"), origin).alias("b"))
    d = [F.col("b")[k] - F.col("a")[k] for k in range(3)]
    flat = F.sqrt(d[0] * d[0] + d[1] * d[1])
    r = lambda v, n, name: G.js_round(v, n).alias(name)
    props = [F.lit("distance").alias("kind"), F.col("id"), r(F.sqrt(flat * flat + d[2] * d[2]), 3, "distance"), r(flat, 3, "horizontal"), r(d[2], 3, "vertical"), r(F.degrees(F.atan2(F.abs(d[2]), flat)), 2, "slope_degrees")]
    return own.select("id", _feature("LineString", F.array("a", "b"), props))


def polygon_features(polygons: DataFrame, figures: DataFrame, origin: tuple[float, float, float], cell: float) -> DataFrame:
    """id, feature of polygons (id, vertices, base, custom_base, height) with the figures of :func:`measure.measure_polygons`; rings run anticlockwise."""
    n = F.size("vertices")
    nxt = lambda i: F.get("vertices", ((i + 1) % n).cast("int"))
    turn = F.aggregate(F.transform("vertices", lambda p, i: p["x"] * -nxt(i)["z"] - nxt(i)["x"] * -p["z"]), F.lit(0.0), lambda s, v: s + v)
    ring = F.transform("vertices", lambda p: _spot(p, origin))
    ring = F.when(turn < 0, F.reverse(ring)).otherwise(ring)
    ring = F.concat(ring, F.slice(ring, 1, 1))
    j = polygons.select("id", "vertices", "base", "custom_base", "height").join(figures, "id")
    r = lambda v, n, name: G.js_round(F.col(v) if isinstance(v, str) else v, n).alias(name)
    props = [
        F.lit("polygon").alias("kind"), F.col("id"), r("plan_area", 2, "plan_area"), r("surface_area", 2, "surface_area"), r("perimeter", 3, "perimeter"), F.col("base"),
        r(F.lit(float(origin[1])) + F.coalesce("custom_base", "base_mean"), 3, "base_elevation"), r("cut", 2, "cut_volume"), r("fill", 2, "fill_volume"), r(F.col("cut") - F.col("fill"), 2, "net_volume"),
        r("height", 3, "extrusion_height"), r("prism", 2, "prism_volume"), r("filled", 2, "prism_filled_volume"), r("unmeasured", 4, "unmeasured_share"), r(F.lit(float(cell)), 3, "grid_cell"),
    ]
    return j.select("id", _feature("Polygon", F.array(ring), props))


def surface_features(surfaces: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """id, feature: a point at the centre of each surface of :func:`measure.describe_surfaces`."""
    centre = F.struct(F.col("center_x").alias("x"), F.col("center_y").alias("y"), F.col("center_z").alias("z"))
    r = lambda v, n, name: G.js_round(v, n).alias(name)
    props = [F.lit("surface").alias("kind"), F.col("seed").alias("id"), r(F.col("plan_area"), 2, "plan_area"), r(F.col("surface_area"), 2, "surface_area"), r(F.col("slope"), 2, "slope_degrees"), r(F.lit(float(origin[1])) + F.col("mean"), 3, "mean_elevation")]
    return surfaces.select(F.col("seed").alias("id"), _feature("Point", _spot(centre, origin), props))


def collection(features: DataFrame, order: str = "id", epsg: int | None = None) -> str:
    """One FeatureCollection; without an EPSG code no reference system is claimed. For results of reviewable size."""
    out: dict = {"type": "FeatureCollection"}
    if epsg:
        out["crs"] = {"type": "name", "properties": {"name": f"urn:ogc:def:crs:EPSG::{epsg}"}}
    out["features"] = [json.loads(r["feature"]) for r in features.orderBy(order).toLocalIterator()]
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def _fixed(v, digits: int):
    return F.when(v.isNull(), F.lit("")).otherwise(F.format_string(f"%.{digits}f", G.js_round(v, digits)))


def inventory_lines(objects: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """id, line: nine columns with fixed decimals; buildings have no crown."""
    ox, oy, oz = map(float, origin)
    crown = F.when(F.col("kind") == "building", F.lit("")).otherwise(_fixed(F.col("crown_radius"), 2))
    cols = [F.col("id").cast("string"), F.col("kind"), _fixed(F.lit(ox) + F.col("center.x"), 3), _fixed(-(F.lit(oz) + F.col("center.z")), 3), _fixed(F.lit(oy) + F.col("ground_y"), 2), _fixed(F.col("height"), 2), _fixed(F.col("area"), 1), crown, F.col("point_count").cast("string")]
    return objects.select("id", F.concat_ws(",", *cols).alias("line"))


INVENTORY_HEADER = "id,kind,x,y,ground_elevation,height,area,crown_radius,point_count"


def inventory_csv(objects: DataFrame, origin: tuple[float, float, float]) -> str:
    lines = [r["line"] for r in inventory_lines(objects, origin).orderBy("id").toLocalIterator()]
    return "\r\n".join([INVENTORY_HEADER, *lines]) + "\r\n"


def class_summary_csv(summary: DataFrame) -> str:
    """Code, name, points and share of a class summary; at most 256 rows."""
    rows = summary.select("classification", G.csv_field(F.col("name")), "n", F.format_string("%.3f", "share")).collect()
    return "\r\n".join(["code,name,point_count,share_percent", *(",".join(map(str, r)) for r in rows)]) + "\r\n"
