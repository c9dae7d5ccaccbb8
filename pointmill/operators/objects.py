"""Buildings and trees: from heights above ground to objects, outlines and an inventory."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import settled
from . import raster as R
from .components import label_cells, narrow, numbered, patch_moments
from .crowns import segment_crowns
from .quality import Frame, with_cells
from .tables import object_candidates


@dataclass(frozen=True)
class ObjectOptions:
    cell: float | None = None
    min_height: float = 2.0
    roughness: float = 0.15
    crown_depth: float = 1.0
    deep_share: float = 0.35
    multi_share: float = 0.6
    building_height: float = 2.5
    building_area: float = 20.0
    tree_height: float = 2.5
    crown_area: float = 2.0
    min_points: int = 10
    crown_share: float = 0.35
    canopy_width: float = 2.5
    max_tree: float = 60.0
    slenderness: float = 8.0

    def __post_init__(self):
        if self.cell is not None and self.cell <= 0 or self.min_height <= 0 or not 0 < self.crown_share < 1:
            raise ValueError("cell and min_height must be positive, crown_share between 0 and 1")


def cell_stats(points: DataFrame, frame: Frame, crown_depth: float = 1.0) -> DataFrame:
    """Per cell of candidates: top, n, multi (several returns), built, veg (by label) and deep (well under the top)."""
    own = with_cells(points, frame)
    h = F.col("height_above_ground")
    code = F.col("classification")
    n = lambda c: F.sum(c.cast("long"))
    stats = own.groupBy("row", "col").agg(
        F.max(h).alias("top"), F.count("*").alias("n"), n(F.coalesce(F.col("number_of_returns") > 1, F.lit(False))).alias("multi"), n(code == 6).alias("built"), n(code.isin(3, 4, 5)).alias("veg"),
    )
    deep = own.select("row", "col", h.alias("h")).join(stats.select("row", "col", "top"), ["row", "col"]).filter(F.col("h") < F.col("top") - F.lit(crown_depth))
    deep = deep.groupBy("row", "col").agg(F.count("*").alias("deep"))
    return stats.join(deep, ["row", "col"], "left").withColumn("deep", F.coalesce("deep", F.lit(0)).cast("bigint"))


def roof_cells(stats: DataFrame, frame: Frame, o: ObjectOptions) -> DataFrame:
    """stats with roughness, vegetation (by label) and roof."""
    tops = R.fill_isolated_gaps(stats.select("row", "col", F.col("top").alias("value")), frame.rows, frame.cols)
    rough = R.plane_roughness(tops, o.roughness).select("row", "col", F.col("value").alias("roughness"))
    out = stats.join(rough, ["row", "col"], "left")
    veg, built = F.col("veg") * 2 > F.col("n"), F.col("built") * 2 > F.col("n")
    solid = (F.col("top") >= o.building_height) & F.coalesce(F.col("roughness") <= o.roughness, F.lit(False)) & (F.col("deep") <= F.lit(o.deep_share) * F.col("n")) & ~(F.col("multi") >= F.lit(o.multi_share) * F.col("n"))
    return out.withColumns({"vegetation": veg, "roof": ~veg & (built | solid)})


def mask_open_close(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Close after open, 3 by 3, of a sparse mask (row, col); beyond the grid counts as set when eroding, as unset when dilating."""
    return mask_erode(mask_dilate(mask_dilate(mask_erode(cells, rows, cols), rows, cols), rows, cols), rows, cols)


def mask_dilate(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    out = R.spread(cells.select("row", "col"), 1, True).distinct()
    return out.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))


def mask_erode(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    near = R.spread(cells.select("row", "col"), 1, True).groupBy("row", "col").agg(F.count("*").alias("k"))
    edge = lambda c, n: F.when((F.col(c) == 0) & (F.col(c) == n - 1), 1).when((F.col(c) == 0) | (F.col(c) == n - 1), 2).otherwise(3)
    return cells.select("row", "col").join(near, ["row", "col"]).filter(F.col("k") == edge("row", rows) * edge("col", cols)).select("row", "col")


def grow_to_walls(labels: DataFrame, cells: DataFrame, o: ObjectOptions, passes: int = 2) -> DataFrame:
    """labels (row, col, label, h) grown over smooth cells within a metre of the height beside them; the first neighbour in scan order wins."""
    smooth = cells.filter((F.col("top") >= o.min_height) & ~F.col("vegetation") & F.coalesce(F.col("roughness") <= o.roughness, F.lit(False))).select("row", "col", "top")
    for _ in range(passes):
        near = labels.withColumn("o", R._offsets(1))
        near = near.select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.struct(-F.col("o.i"), -F.col("o.j"), "label").alias("rank"), "label", "h")
        fresh = near.join(smooth.join(labels.select("row", "col"), ["row", "col"], "left_anti"), ["row", "col"]).filter(F.abs(F.col("top") - F.col("h")) <= 1)
        fresh = fresh.groupBy("row", "col").agg(F.min_by("label", "rank").alias("label"), F.first("top").alias("h"))
        labels = settled(labels.unionByName(fresh.select("row", "col", "label", "h")))
    return labels


def absorb_tall(labels: DataFrame, cells: DataFrame, frame: Frame, o: ObjectOptions) -> DataFrame:
    """Unlabelled patches that rise above any tree join the building they touch most, or become one of their own."""
    tall = cells.filter((F.col("top") > o.max_tree) & ~F.col("vegetation")).join(labels.select("row", "col"), ["row", "col"], "left_anti").select("row", "col", F.col("top").alias("h"))
    if not tall.limit(1).count():
        return labels
    patch = label_cells(tall, frame.cols).withColumnRenamed("label", "patch")
    beside = R.spread(labels.select("row", "col", "label")).join(patch, ["row", "col"]).groupBy("patch", "label").agg(F.count("*").alias("k"))
    host = beside.groupBy("patch").agg(F.max(F.struct("k", (-F.col("label")).alias("m"))).alias("w")).select("patch", (-F.col("w.m")).alias("host"))
    most = labels.agg(F.coalesce(F.max("label"), F.lit(0))).first()[0]
    own = patch.join(host, "patch", "left").select("row", "col", F.coalesce("host", F.col("patch") + F.lit(most)).alias("label"))
    return labels.unionByName(own.join(tall, ["row", "col"]).select("row", "col", "label", "h"))


def roof_heights(labels: DataFrame) -> DataFrame:
    """Per label its number of cells and the 95th percentile of their tops (column h)."""
    w = Window.partitionBy("label").orderBy("h", "row", "col")
    out = labels.select("label", "h", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("label")).alias("m"))
    return out.groupBy("label").agg(F.max("m").alias("cells"), F.max(F.when(F.col("k") == F.floor(F.lit(0.95) * (F.col("m") - 1)) + 1, F.col("h"))).alias("height"))


def covered_area(labels: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """Area of each label: inner cells count whole, rim cells by their share of the inner median of upper points."""
    own = labels.select("row", "col", "label").join(cells.select("row", "col", (F.col("n") - F.col("deep")).alias("u")), ["row", "col"], "left").withColumn("u", F.coalesce("u", F.lit(0)))
    same = R.spread(own.select("row", "col", F.col("label").alias("l2"))).groupBy("row", "col", "l2").agg(F.count("*").alias("k"))
    own = own.join(same, (own["row"] == same["row"]) & (own["col"] == same["col"]) & (own["label"] == same["l2"]), "left").select(own["row"], own["col"], "label", "u", (F.coalesce("k", F.lit(0)) == 8).alias("inner"))
    w = Window.partitionBy("label").orderBy("u", "row", "col")
    inner = own.filter("inner").select("label", "u", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("label")).alias("m"))
    med = inner.filter(F.col("k") == F.floor(F.col("m") / 2) + 1).select("label", F.greatest(F.col("u"), F.lit(1)).alias("med"))
    part = F.when(F.col("inner") | F.col("med").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("u") / F.col("med")))
    return own.join(med, "label", "left").groupBy("label").agg((F.sum(part) * F.lit(cell * cell)).alias("area"))


def outline(labels: DataFrame, frame: Frame, tolerance: float = 0.75) -> DataFrame:
    """label, outline: the largest boundary ring of each label's cells, simplified by ``tolerance`` cells."""
    x0, z0, cell = frame.min_x, frame.min_z, frame.cell

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = simplify_ring(boundary_ring(set(zip(pdf["row"], pdf["col"], strict=True))), tolerance)
        pts = [{"x": x0 + cell * c, "z": z0 + cell * r} for r, c in ring]
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "outline": [pts]})

    return labels.select("label", "row", "col").groupBy("label").applyInPandas(trace, "label bigint, outline array<struct<x:double,z:double>>")


def boundary_ring(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners (row, col) of the boundary loop with the largest area, cells on its right; cells that touch at a corner stay in one loop."""
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for here, there, beyond in (((r, c), (r, c + 1), (r - 1, c)), ((r, c + 1), (r + 1, c + 1), (r, c + 1)), ((r + 1, c + 1), (r + 1, c), (r + 1, c)), ((r + 1, c), (r, c), (r, c - 1))):
            if beyond not in cells:
                step.setdefault(here, []).append(there)
    best: list[tuple[int, int]] = []
    best_area = -1.0
    while step:
        start = min(step)
        ring, at, came = [], start, None
        while at in step:
            ways = step[at]
            if came is not None and len(ways) > 1:
                # At a corner where two cells touch, turn left, so that the loop goes on to the other cell.
                d = (at[0] - came[0], at[1] - came[1])
                ways.sort(key=lambda w: d[0] * (w[1] - at[1]) - d[1] * (w[0] - at[0]))
            to = ways.pop()
            if not ways:
                del step[at]
            ring.append(at)
            came, at = at, to
        area = abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
        if area > best_area:
            best, best_area = ring, area
    return [b for a, b, c in zip(best[-1:] + best[:-1], best, best[1:] + best[:1], strict=True) if (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])]


def simplify_ring(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on both halves of a ring, cut at its first point and the one farthest from it."""
    if len(ring) < 4:
        return ring
    p = np.array(ring, float)
    far = int(((p - p[0]) ** 2).sum(1).argmax())

    def half(a: np.ndarray) -> list[np.ndarray]:
        keep, todo = {0, len(a) - 1}, [(0, len(a) - 1)]
        while todo:
            i, j = todo.pop()
            if j - i < 2:
                continue
            d = a[j] - a[i]
            length = math.hypot(*d)
            rel = a[i + 1 : j] - a[i]
            dist = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
            k = int(dist.argmax())
            if dist[k] > tolerance:
                keep.add(i + 1 + k)
                todo += [(i, i + 1 + k), (i + 1 + k, j)]
        return [a[k] for k in sorted(keep)]

    out = half(p[: far + 1])[:-1] + half(np.concatenate([p[far:], p[:1]]))[:-1]
    return [tuple(x.tolist()) for x in out]


def detect_objects(points: DataFrame, options: ObjectOptions = ObjectOptions(), max_cells: int | None = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """(points with object_id and labels 6 and 5, objects).

    points need ``height_above_ground``. Buildings are numbered from 1 by area,
    then trees by height. objects: id, kind, point_count, height, area,
    ground_y, crown_radius, top, center, outline.
    """
    o = options
    n, area = F.count("*"), F.greatest(F.lit(1.0), (F.max("x") - F.min("x")) * (F.max("z") - F.min("z")))
    cell = o.cell or points.agg(F.when(n > 0, G.object_cell(area, n))).first()[0] or 1.0
    frame = Frame.of(points, cell, max_cells)
    rows, cols = frame.rows, frame.cols
    cells = settled(roof_cells(cell_stats(object_candidates(points, o.min_height), frame, o.crown_depth), frame, o))
    flat = settled(mask_open_close(cells.filter("roof"), rows, cols))
    patches = label_cells(flat, cols)
    big = patches.groupBy("label").agg(F.count("*").alias("k")).filter(F.col("k") >= o.building_area / (cell * cell)).select("label")
    tops = cells.select("row", "col", F.col("top").alias("h"))
    built = settled(patches.join(big, "label", "left_semi").join(tops, ["row", "col"], "left").select("row", "col", "label", "h"))
    built = settled(absorb_tall(grow_to_walls(built, cells, o), cells, frame, o))
    roofs = settled(roof_heights(built))
    near_wall = R.nearby_maximum(built.join(roofs, "label").select("row", "col", F.col("height").alias("value")), 2).select("row", "col", F.col("value").alias("wall"))
    near_flat = mask_dilate(flat.unionByName(built.select("row", "col")).distinct(), rows, cols).withColumn("near_flat", F.lit(True))
    own = cells.join(near_wall, ["row", "col"], "left").join(near_flat, ["row", "col"], "left")
    wall = ~F.col("vegetation") & F.coalesce(F.col("top") >= F.lit(0.8) * F.col("wall"), F.lit(False))
    canopy = own.filter(F.col("top").between(o.min_height, o.max_tree) & ~wall & (F.col("vegetation") | F.col("near_flat").isNull())).select("row", "col", F.col("top").alias("value"))
    gaps = R.spread(canopy).filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).groupBy("row", "col").agg(F.count("*").alias("k"), F.avg("value").alias("value")).filter("k >= 5")
    gaps = gaps.join(canopy, ["row", "col"], "left_anti").join(near_flat, ["row", "col"], "left_anti").select("row", "col", "value")
    canopy = settled(canopy.unionByName(gaps))
    labels = label_cells(canopy, cols)
    thin = labels.join(narrow(patch_moments(labels), cell, o.canopy_width), "label", "left_semi")
    canopy = canopy.join(thin.select("row", "col"), ["row", "col"], "left_anti")
    opened = mask_dilate(mask_erode(canopy, rows, cols), rows, cols)
    canopy = settled(canopy.join(opened, ["row", "col"], "left_semi"))
    crowns = settled(segment_crowns(R.smooth_canopy(canopy), cell, cols, o.min_height, o.tree_height, o.crown_share))
    shape = _crown_shapes(crowns, cell, o)
    crowns = crowns.join(shape.select("crown"), "crown", "left_semi")
    owned = _owners(points, frame, crowns, built, roofs, o)
    owned = settled(owned)
    measured = owned.filter("own_kind is not null").groupBy("own_kind", "own_label").agg(
        F.count("*").alias("point_count"), F.avg(F.col("y") - F.col("height_above_ground")).alias("ground_y"), F.max("height_above_ground").alias("peak"),
        F.max_by(F.struct("x", "y", "z"), F.struct("height_above_ground", -F.col("pid"))).alias("top"),
    )
    b = measured.filter("own_kind = 'building'").withColumnRenamed("own_label", "label").join(roofs, "label").join(covered_area(built, cells, cell), "label")
    centre = built.groupBy("label").agg(F.struct((F.avg("col") * cell + frame.min_x + cell / 2).alias("x"), (F.avg("row") * cell + frame.min_z + cell / 2).alias("z")).alias("center"))
    b = b.join(centre, "label").join(outline(built, frame), "label")
    b = numbered(b, [F.desc("area"), "label"], "id").select("id", F.lit("building").alias("kind"), "label", "point_count", "height", "area", "ground_y", F.lit(None).cast("double").alias("crown_radius"), "top", "center", "outline")
    nb = b.count()
    t = measured.filter("own_kind = 'tree'").filter(F.col("point_count") >= o.min_points).withColumnRenamed("own_label", "label").join(shape.withColumnRenamed("crown", "label"), "label")
    t = numbered(t, [F.desc("peak"), "label"], "id").select((F.col("id") + nb).alias("id"), F.lit("tree").alias("kind"), "label", "point_count", F.col("peak").alias("height"), "area", "ground_y",
                 F.sqrt(F.col("area") / F.lit(math.pi)).alias("crown_radius"), "top", F.struct(F.col("top.x").alias("x"), F.col("top.z").alias("z")).alias("center"), F.lit(None).cast("array<struct<x:double,z:double>>").alias("outline"))
    objects = settled(b.unionByName(t))
    ids = objects.select(F.col("kind").alias("own_kind"), F.col("label").alias("own_label"), F.col("id").alias("object_id"))
    out = owned.join(ids, ["own_kind", "own_label"], "left").drop("own_label")
    new = F.when(F.col("object_id").isNotNull() & F.col("classification").isin(0, 1), F.when(F.col("own_kind") == "building", 6).otherwise(5)).otherwise(F.col("classification"))
    out = out.withColumns({"classification": new.cast("int"), "object_id": F.coalesce("object_id", F.lit(0)).cast("bigint")}).drop("own_kind")
    return out, objects.drop("label")


def _crown_shapes(crowns: DataFrame, cell: float, o: ObjectOptions) -> DataFrame:
    """crown, area of those that are large enough, at most four times as long as wide (of the box around them) and stout enough."""
    box = crowns.groupBy("crown").agg(F.count("*").alias("n"), F.max("top").alias("t"), *((F.max(c) - F.min(c) + 1).alias(c) for c in ("row", "col")))
    area = F.col("n") * F.lit(cell * cell)
    ok = (area >= o.crown_area) & (F.greatest("row", "col") <= 4 * F.least("row", "col")) & (F.col("t") <= F.lit(o.slenderness * 2) * F.sqrt(area / F.lit(math.pi)))
    return box.filter(ok).select("crown", area.alias("area"))


def _owners(points: DataFrame, frame: Frame, crowns: DataFrame, built: DataFrame, roofs: DataFrame, o: ObjectOptions) -> DataFrame:
    """points with own_kind and own_label: the crown over it, else the building of its cell, else that of a neighbour cell it doesn't rise above."""
    own = with_cells(points, frame)
    crown = crowns.select("row", "col", "crown", F.col("top").alias("ctop"))
    cell = built.select("row", "col", F.col("label").alias("b0"))
    near = built.join(roofs, "label").withColumn("o", R._offsets(1))
    near = near.select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.struct((-F.col("o.i")).alias("i"), (-F.col("o.j")).alias("j"), "label", "height").alias("n"))
    near = near.groupBy("row", "col").agg(F.sort_array(F.collect_list("n")).alias("near"))  # 8 at most
    h, code = F.col("height_above_ground"), F.col("classification")
    out = own.join(crown, ["row", "col"], "left").join(cell, ["row", "col"], "left").join(near, ["row", "col"], "left")
    cand = (h >= o.min_height) & code.isin(0, 1, 3, 4, 5, 6)
    in_crown = F.col("crown").isNotNull() & (h <= F.lit(1.15) * F.col("ctop") + 1) & (code != 6)
    beside = F.get(F.filter("near", lambda x: h <= x["height"] + 1), F.lit(0))["label"]
    kind = F.when(cand & in_crown, "tree").when(cand & (F.col("b0").isNotNull() | beside.isNotNull()), "building")
    label = F.when(cand & in_crown, F.col("crown")).when(cand, F.coalesce("b0", beside))
    return out.withColumns({"own_kind": kind, "own_label": label}).drop("row", "col", "crown", "ctop", "b0", "near", "object_id")


def inventory(objects: DataFrame) -> DataFrame:
    """Counts and extremes of buildings and trees."""
    b, t = F.col("kind") == "building", F.col("kind") == "tree"
    return objects.agg(
        F.sum(b.cast("long")).alias("buildings"), F.sum(t.cast("long")).alias("trees"), F.max(F.when(b, F.col("height"))).alias("tallest_building"), F.min(F.when(t, F.col("height"))).alias("shortest_tree"),
        F.max(F.when(t, F.col("height"))).alias("tallest_tree"), F.sum(F.when(b, F.col("area"))).alias("built_area"),
    )


def match_objects(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """instance, object_id, iou of one-to-one matches of points (pid, instance) and (pid, object_id), best first."""
    t, f = truth.filter("instance > 0"), found.filter("object_id > 0")
    both = t.join(f, "pid").groupBy("instance", "object_id").agg(F.count("*").alias("s"))
    nt, nf = t.groupBy("instance").agg(F.count("*").alias("nt")), f.groupBy("object_id").agg(F.count("*").alias("nf"))
    iou = both.join(nt, "instance").join(nf, "object_id").withColumn("iou", F.col("s") / (F.col("nt") + F.col("nf") - F.col("s"))).filter(F.col("iou") >= least)
    # Two pairs over a half can share neither side, unless both are exactly a half.
    a, b = Window.partitionBy("instance").orderBy(F.desc("iou"), "object_id"), Window.partitionBy("object_id").orderBy(F.desc("iou"), "instance")
    return iou.withColumns({"ka": F.row_number().over(a), "kb": F.row_number().over(b)}).filter("ka = 1 and kb = 1").select("instance", "object_id", "iou")


