"""Interactive measurements: surfaces, polygons, picks, levels of detail."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import settled
from .components import connected_components, running_total
from .raster import dense_array, push_pull
from .raster import slope as grid_slope

# ---------------------------------------------------------------- surfaces


@dataclass(frozen=True)
class SurfaceOptions:
    tolerance: float = 0.12
    drift: float = 0.6
    max_cells: int = 4_000_000
    #: Edge in cells of the first window around a seed; it is doubled while the surface reaches its edge.
    window: int = 256


def select_surfaces(grid: DataFrame, seeds: DataFrame, cell: float, rows: int, cols: int, options: SurfaceOptions = SurfaceOptions()) -> DataFrame:
    """seed, row, col of the surface grown from each seed (seed, row, col; each seed once) of a surface grid.

    The order of growth matters, so a seed is grown in one task, within a window
    of cells around it that meets the grid by an equi-join on tiles. Surfaces
    that reach the edge of their window are grown again in one twice as wide, so
    what a task holds follows the surface's size, never the grid's.
    """
    tile = options.window // 2
    tiled = settled(grid.select("row", "col", "value", F.floor(F.col("row") / tile).cast("int").alias("tr"), F.floor(F.col("col") / tile).cast("int").alias("tc")))
    kind = seeds.schema["seed"].dataType.simpleString()

    def grow(reach: int, pdf: pd.DataFrame) -> pd.DataFrame:
        sr, sc = int(pdf["sr"].iloc[0]), int(pdf["sc"].iloc[0])
        r0, c0 = max(0, sr - reach), max(0, sc - reach)
        h, w = min(rows, sr + reach + 1) - r0, min(cols, sc + reach + 1) - c0
        a = dense_array(pdf.assign(row=pdf["row"] - r0, col=pdf["col"] - c0), h, w, h * w)
        region = grow_surface(a, sr - r0, sc - c0, cell, options)
        inner = (0 if r0 == 0 else 1, 0 if c0 == 0 else 1, h if r0 + h == rows else h - 1, w if c0 + w == cols else w - 1)
        cut = any(r < inner[0] or c < inner[1] or r >= inner[2] or c >= inner[3] for r, c in region)
        # A surface cut off by the window is told by one row without a cell.
        cells = [(None, None)] if cut else [(r + r0, c + c0) for r, c in sorted(region)]
        got = pd.DataFrame(cells, columns=["row", "col"]).astype("Int32")
        got.insert(0, "seed", pdf["seed"].iloc[0])
        return got

    todo, out, reach = settled(seeds.select("seed", F.col("row").alias("sr"), F.col("col").alias("sc"))), None, tile
    while True:
        whole = reach >= max(rows, cols)
        span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile).cast("int"), F.floor((F.col(c) + reach) / tile).cast("int")))  # noqa: B023, E731
        placed = todo.withColumn("tr", span("sr")).withColumn("tc", span("sc")).join(tiled, ["tr", "tc"]).filter((F.abs(F.col("row") - F.col("sr")) <= reach) & (F.abs(F.col("col") - F.col("sc")) <= reach))

        got = settled(placed.select("seed", "sr", "sc", "row", "col", "value").groupBy("seed").applyInPandas(_within(grow, reach), f"seed {kind}, row int, col int"))
        done = got.filter("row is not null")
        out = done if out is None else out.unionByName(done)
        cut = settled(todo.join(got.filter("row is null").select("seed"), "seed", "left_semi"))
        if whole or not cut.limit(1).count():
            return out
        todo, reach = cut, reach * 2


def _within(grow, reach: int):
    """grow with its window, as a function of one group."""
    return lambda pdf: grow(reach, pdf)


class _Plane:
    """A plane a dx + b dz + c by least squares over cells that are added one by one, in metres from the seed."""

    def __init__(self, a: np.ndarray, row: int, col: int, cell: float):
        self.top, self.row, self.col, self.cell = a, row, col, cell
        self.k = (0.0, 0.0, float(a[row, col]))
        self.clear()

    def clear(self) -> None:
        self.m, self.r, self.n = np.zeros((3, 3)), np.zeros(3), 0

    def at(self, p: tuple[int, int]) -> np.ndarray:
        return np.array([(p[1] - self.col) * self.cell, (p[0] - self.row) * self.cell, 1.0])

    def add(self, p: tuple[int, int]) -> None:
        v = self.at(p)
        self.m += np.outer(v, v)
        self.r += v * self.top[p]
        self.n += 1

    def fit(self) -> None:
        if self.n >= 3 and abs(np.linalg.det(self.m)) >= 1e-9:
            self.k = tuple(np.linalg.solve(self.m, self.r))

    def off(self, p: tuple[int, int]) -> float:
        return abs(self.top[p] - (self.k[0] * (p[1] - self.col) * self.cell + self.k[1] * (p[0] - self.row) * self.cell + self.k[2]))


def grow_surface(a: np.ndarray, row: int, col: int, cell: float, o: SurfaceOptions = SurfaceOptions()) -> set[tuple[int, int]]:
    """Cells of the surface under a seed: breadth first over neighbours whose height follows the plane's slope within the tolerance."""
    rows, cols = a.shape
    full = lambda r, c: 0 <= r < rows and 0 <= c < cols and not math.isnan(a[r, c])
    rings = ((r, c) for d in range(4) for r in range(row - d, row + d + 1) for c in range(col - d, col + d + 1))
    seed = next((p for p in rings if full(*p)), None)
    if seed is None:
        return set()
    plane = _Plane(a, *seed, cell)
    # The first plane: all cells around, then without those off it, up to three times.
    kept = [(r, c) for r in range(seed[0] - 3, seed[0] + 4) for c in range(seed[1] - 3, seed[1] + 4) if full(r, c)]
    for _ in range(3):
        plane.clear()
        for p in kept:
            plane.add(p)
        plane.fit()
        on = [p for p in kept if plane.off(p) <= o.tolerance * 1.5]
        if len(on) < 6 or len(on) == len(kept):
            break
        kept = on
    if plane.off(seed) > o.tolerance * 1.5:
        plane.k = (0.0, 0.0, float(a[seed]))
    plane.clear()
    plane.add(seed)
    region, todo, refit = {seed}, deque([seed]), 16
    while todo:
        r, c = todo.popleft()
        for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            n = (r + dr, c + dc)
            if n in region or not full(*n):
                continue
            if abs(a[n] - (a[r, c] + (plane.k[0] * dc + plane.k[1] * dr) * cell)) > o.tolerance or plane.off(n) > o.drift:
                continue
            if len(region) > o.max_cells:
                break
            region.add(n)
            todo.append(n)
            plane.add(n)
            if plane.n >= refit:
                plane.fit()
                refit *= 2
    return region | _enclosed(region, a)


def _enclosed(region: set[tuple[int, int]], a: np.ndarray) -> set[tuple[int, int]]:
    """Patches inside the region; large ones that hold points stay out."""
    r0, r1 = min(r for r, _ in region), max(r for r, _ in region)
    c0, c1 = min(c for _, c in region), max(c for _, c in region)
    most = max(16, math.floor(0.02 * len(region) + 0.5))
    seen, out = set(region), set()
    for r in range(r0, r1 + 1):
        for c in range(c0, c1 + 1):
            if (r, c) in seen:
                continue
            patch, todo, open_ = [], [(r, c)], False
            seen.add((r, c))
            while todo:
                p = todo.pop()
                patch.append(p)
                open_ |= p[0] in (r0, r1) or p[1] in (c0, c1)
                for n in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)):
                    if r0 <= n[0] <= r1 and c0 <= n[1] <= c1 and n not in seen:
                        seen.add(n)
                        todo.append(n)
            if not open_ and (len(patch) <= most or all(math.isnan(a[p]) for p in patch)):
                out.update(patch)
    return out


def describe_surfaces(cells: DataFrame, grid: DataFrame, cell: float, cols: int, min_x: float = 0.0, min_z: float = 0.0, near: float = 0.3) -> DataFrame:
    """Per seed: cells, plan_area, surface_area, slope in degrees, mean height and the centre, for distinct cells (seed, row, col).

    A plane is fitted twice, the second time to cells near the first; mean is
    that of the cells near. surface_area adds up each cell's own slope, from the
    neighbours within the surface that follow the plane; where a direction has
    none, or at the grid's left and right edge, the plane's slope counts. It is
    never below the plan area. The centre is the cell nearest to the mean place.
    """
    size = float(cell)
    own = cells.select("seed", "row", "col").join(grid.select("row", "col", "value"), ["row", "col"], "left")
    own = own.select("seed", "row", "col", (F.col("row") * size).alias("r"), (F.col("col") * size).alias("c"), "value")
    plane = surface_planes(own, near)
    own = own.join(plane.select("seed", "k0", "kr", "kc"), "seed")

    def along(part: str, order: str, slope: str):
        w = Window.partitionBy("seed", part).orderBy(order)
        here, rise = F.col("value"), F.col(slope) * size
        ahead = F.when(F.lead(order).over(w) == F.col(order) + 1, F.lead("value").over(w))
        behind = F.when(F.lag(order).over(w) == F.col(order) - 1, F.lag("value").over(w))
        ahead, behind = F.when(F.abs(ahead - here - rise) < near, ahead), F.when(F.abs(here - behind - rise) < near, behind)
        two = (ahead - behind) / (2 * size)
        return F.coalesce(two, (ahead - here) / size, (here - behind) / size)

    own = own.withColumns({"gx": along("row", "col", "kc"), "gz": along("col", "row", "kr")})
    gx = F.when(F.col("col").between(1, cols - 2), F.col("gx"))
    factor = F.sqrt(1 + F.col("kr") * F.col("kr") + F.col("kc") * F.col("kc"))
    part = F.coalesce(F.sqrt(1 + gx * gx + F.col("gz") * F.col("gz")), factor) * F.lit(size * size)
    total = own.groupBy("seed").agg(F.count("*").alias("cells"), F.sum(part).alias("area"), F.avg("r").alias("mr"), F.avg("c").alias("mc"))
    d = (F.col("r") - F.col("mr")) * (F.col("r") - F.col("mr")) + (F.col("c") - F.col("mc")) * (F.col("c") - F.col("mc"))
    middle = own.select("seed", "row", "col", "r", "c").join(total.select("seed", "mr", "mc"), "seed").groupBy("seed").agg(F.min_by(F.struct("r", "c"), F.struct(F.round(d, 6), "row", "col")).alias("m"))
    out = total.join(middle, "seed").join(plane, "seed")
    plan = F.col("cells") * F.lit(size * size)
    y = F.col("k0") + F.col("kr") * F.col("m.r") + F.col("kc") * F.col("m.c")
    return out.select(
        "seed", "cells", F.round(plan, 6).alias("plan_area"), F.round(F.greatest(plan, F.col("area")), 4).alias("surface_area"), F.round(F.degrees(F.atan(F.sqrt(F.col("kr") * F.col("kr") + F.col("kc") * F.col("kc")))), 4).alias("slope"), F.round("mean", 4).alias("mean"),
        (F.lit(min_x) + F.col("m.c") + size / 2).alias("center_x"), F.round(y, 4).alias("center_y"), (F.lit(min_z) + F.col("m.r") + size / 2).alias("center_z"),
    )


def surface_planes(own: DataFrame, near: float = 0.3) -> DataFrame:
    """Per seed the plane k0 + kr r + kc c of cells (seed, r, c, value) fitted twice, and the mean of the cells near it."""
    known = own.filter("value is not null")
    first = _planes(known)
    off = F.abs(F.col("value") - (F.col("k0") + F.col("kr") * F.col("r") + F.col("kc") * F.col("c")))
    second = _planes(known.join(first, "seed").filter(off <= near).select("seed", "r", "c", "value"))
    out = own.select("seed").distinct().join(first.withColumnsRenamed({"k0": "f0", "kr": "fr", "kc": "fc"}).drop("mean", "level"), "seed", "left").join(second, "seed", "left")
    pick = lambda a, b: F.coalesce(F.when(~F.col("level"), F.col(a)), F.col(b), F.lit(0.0))
    return out.select("seed", pick("k0", "f0").alias("k0"), pick("kr", "fr").alias("kr"), pick("kc", "fc").alias("kc"), "mean")


def _planes(own: DataFrame) -> DataFrame:
    """Least-squares k0 + kr r + kc c per seed, from sums about the mean; ``level`` where the cells don't tell a plane."""
    m = own.groupBy("seed").agg(F.avg("r").alias("mr"), F.avg("c").alias("mc"), F.avg("value").alias("mean"))
    d = own.join(m, "seed").select("seed", "mr", "mc", "mean", (F.col("r") - F.col("mr")).alias("a"), (F.col("c") - F.col("mc")).alias("b"), (F.col("value") - F.col("mean")).alias("v"))
    s = d.groupBy("seed").agg(*(F.first(x).alias(x) for x in ("mr", "mc", "mean")), *(F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in (("a", "a"), ("b", "b"), ("a", "b"), ("a", "v"), ("b", "v"))))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    told = F.abs(det) > 1e-9
    kr = F.when(told, (F.col("av") * F.col("bb") - F.col("bv") * F.col("ab")) / det).otherwise(0.0)
    kc = F.when(told, (F.col("bv") * F.col("aa") - F.col("av") * F.col("ab")) / det).otherwise(0.0)
    out = s.select("seed", kr.alias("kr"), kc.alias("kc"), "mr", "mc", "mean", (~told).alias("level"))
    return out.select("seed", (F.col("mean") - F.col("kr") * F.col("mr") - F.col("kc") * F.col("mc")).alias("k0"), "kr", "kc", "mean", "level")


def surface_outline(cells: DataFrame, planes: DataFrame | None = None, cell: float = 1.0, min_x: float = 0.0, min_z: float = 0.0, lift: float = 0.05) -> DataFrame:
    """seed and the borders of its surface: every edge between a cell of it and one outside, as x1, z1, x2, z2 in cells from the grid's corner.

    With ``planes`` (as :func:`surface_planes` gives them) the ends are places in space instead,
    x1, y1, z1, x2, y2, z2, on the fitted plane and ``lift`` above it. The plane's height
    at a cell's corner is that of the plane through cells' heights at their middles.
    """
    # Step in row and col, then both ends in col and row.
    sides = [(-1, 0, 0, 0, 1, 0), (1, 0, 0, 1, 1, 1), (0, -1, 0, 0, 0, 1), (0, 1, 1, 0, 1, 1)]
    o = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("i", "j", "x1", "z1", "x2", "z2"), t, strict=True))) for t in sides)))
    e = cells.select("seed", "row", "col").withColumn("o", o)
    e = e.select("seed", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), *((F.col(c) + F.col(f"o.{k}")).alias(k) for k, c in (("x1", "col"), ("z1", "row"), ("x2", "col"), ("z2", "row"))))
    e = e.join(cells.select("seed", "row", "col"), ["seed", "row", "col"], "left_anti").select("seed", "x1", "z1", "x2", "z2")
    if planes is None:
        return e
    size = float(cell)
    y = lambda k: (F.col("k0") + F.col("kr") * (F.col(f"z{k}") - 0.5) * size + F.col("kc") * (F.col(f"x{k}") - 0.5) * size + lift).alias(f"y{k}")
    at = lambda c, k, low: (F.lit(low) + F.col(f"{c}{k}") * size).alias(f"{c}{k}")
    return e.join(planes.select("seed", "k0", "kr", "kc"), "seed").select("seed", *(v for k in (1, 2) for v in (at("x", k, min_x), y(k), at("z", k, min_z))))


def surfaces_touch(cells: DataFrame) -> DataFrame:
    """a, b of the surfaces that share a cell or have cells side by side."""
    o = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)))))
    a = cells.withColumn("o", o).select(F.col("seed").alias("a"), (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    return a.join(cells.select(F.col("seed").alias("b"), "row", "col"), ["row", "col"]).filter("a < b").select("a", "b").distinct()


def merge_touching(cells: DataFrame) -> DataFrame:
    """row, col once for each group of touching surfaces, named by its smallest seed."""
    comp = connected_components(surfaces_touch(cells), "a", "b")
    return cells.join(comp, cells.seed == comp.node, "left").select(F.coalesce("root", "seed").alias("seed"), "row", "col").distinct()


def combined_area(cells: DataFrame, cell: float) -> DataFrame:
    return cells.agg((F.countDistinct("row", "col") * F.lit(cell * cell)).alias("area"))


# ---------------------------------------------------------------- polygons

BASES = ("triangulated", "fit", "lowest", "mean", "highest", "custom")


def edges_cross(ring: list[tuple[float, float]]) -> bool:
    n = len(ring)
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for i in range(n):
        a, b = ring[i], ring[(i + 1) % n]
        for j in range(i + 1, n):
            if j in (i, (i + 1) % n) or (j + 1) % n == i:
                continue
            c, d = ring[j], ring[(j + 1) % n]
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def triangulate(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]] | None:
    """Ear clipping of a simple ring (either direction); None if it crosses itself or has less than three corners."""
    n = len(ring)
    if n < 3 or edges_cross(ring):
        return None
    area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    left = list(range(n)) if area > 0 else list(range(n))[::-1]
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            a, b, c = ring[i], ring[j], ring[m]
            if side(a, b, c) <= 0:
                continue
            if any(side(a, b, ring[p]) >= 0 and side(b, c, ring[p]) >= 0 and side(c, a, ring[p]) >= 0 for p in left if p not in (i, j, m)):
                continue
            out.append((i, j, m))
            del left[k]
            break
        else:
            k = min(range(len(left)), key=lambda k: abs(side(ring[left[k - 1]], ring[left[k]], ring[left[(k + 1) % len(left)]])))
            del left[k]
    return [*out, tuple(left)] if len(left) == 3 else out


def plane_through(p: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """y = a + b x + c z by least squares; level at the mean where the points don't tell a plane."""
    m = np.array([(1.0, x, z) for x, _, z in p])
    y = np.array([h for _, h, _ in p])
    k, _, rank, _ = np.linalg.lstsq(m, y, rcond=None)
    return tuple(k) if rank == 3 else (float(y.mean()), 0.0, 0.0)


def base_planes(vertices: list[tuple[float, float, float]], triangles: list[tuple[int, int, int]], base: str, custom: float | None = None) -> list[tuple[float, float, float]]:
    """One base plane for each triangle."""
    if base not in BASES:
        raise ValueError(f"base is one of {', '.join(BASES)}")
    if base == "triangulated":
        return [plane_through([vertices[i] for i in t]) for t in triangles]
    heights = [y for _, y, _ in vertices]
    mean = sum(heights) / len(heights)
    if base == "fit":
        plane = plane_through(vertices)
    else:
        plane = ({"lowest": min(heights), "highest": max(heights), "mean": mean}.get(base, mean if custom is None else custom), 0.0, 0.0)
    return [plane] * len(triangles)


def polygon_frame(polygons: DataFrame) -> DataFrame:
    """id, perimeter on the plan, edge_length in space and plan_area of polygons (id, vertices)."""
    v = polygons.select("id", F.posexplode("vertices").alias("k", "p"))
    w = Window.partitionBy("id").orderBy("k")
    nxt = F.coalesce(F.lead("p").over(w), F.first("p").over(w))
    e = v.select("id", "p", nxt.alias("q"))
    dx, dy, dz = (F.col(f"q.{c}") - F.col(f"p.{c}") for c in "xyz")
    return e.groupBy("id").agg(
        F.round(F.sum(F.sqrt(dx * dx + dz * dz)), 6).alias("perimeter"), F.round(F.sum(F.sqrt(dx * dx + dy * dy + dz * dz)), 6).alias("edge_length"),
        F.round(F.abs(F.sum(F.col("p.x") * F.col("q.z") - F.col("q.x") * F.col("p.z"))) / 2, 6).alias("plan_area"),
    )


def polygon_crops(polygons: DataFrame, grid: DataFrame, min_x: float, min_z: float, cell: float) -> DataFrame:
    """id, row, col, value, gap, factor of the grid under each polygon and a cell around it, empty cells filled by push-pull.

    gap tells filled cells, factor is the area along the surface of a unit of
    plan. A polygon over no value at all has no rows.
    """
    c = float(cell)
    at = lambda v, low: F.floor((v - F.lit(low)) / c).cast("int")
    box = polygons.select(
        "id", (at(F.array_min(F.transform("vertices", lambda p: p["x"])), min_x) - 1).alias("c0"), (at(F.array_max(F.transform("vertices", lambda p: p["x"])), min_x) + 1).alias("c1"),
        (at(F.array_min(F.transform("vertices", lambda p: p["z"])), min_z) - 1).alias("r0"), (at(F.array_max(F.transform("vertices", lambda p: p["z"])), min_z) + 1).alias("r1"),
    )
    own = box.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).join(grid.select("row", "col", "value"), ["row", "col"])
    own = settled(own.select("id", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "value", (F.col("r1") - F.col("r0") + 1).alias("h"), (F.col("c1") - F.col("c0") + 1).alias("w")))
    full = settled(push_pull(own, "h", "w", ("id",)))
    steep = grid_slope(full, c, ("id",)).select("id", "row", "col", F.sqrt(1 + F.col("value") * F.col("value")).alias("factor"))
    out = full.join(steep, ["id", "row", "col"]).join(own.select("id", "row", "col", F.lit(False).alias("seen")), ["id", "row", "col"], "left").join(box.select("id", "r0", "c0"), "id")
    return out.select("id", (F.col("row") + F.col("r0")).alias("row"), (F.col("col") + F.col("c0")).alias("col"), "value", F.coalesce("seen", F.lit(True)).alias("gap"), "factor")


def polygon_triangles(polygons: DataFrame) -> DataFrame:
    """id, height and, for each triangle, its corners in plan and base plane (y = k0 + kx x + kz z); invalid polygons have no rows."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                v = [(p["x"], p["y"], p["z"]) for p in x.vertices]
                t = triangulate([(a, c) for a, _, c in v])
                if t is None:
                    continue
                custom = None if x.custom_base is None or pd.isna(x.custom_base) else float(x.custom_base)
                for n, (tri, plane) in enumerate(zip(t, base_planes(v, t, x.base, custom), strict=True)):
                    rows.append((x.id, n, float(x.height), *(w for i in tri for w in (v[i][0], v[i][2])), *map(float, plane)))
            yield pd.DataFrame(rows, columns=["id", "tri", "height", "ax", "az", "bx", "bz", "cx", "cz", "k0", "kx", "kz"])

    return polygons.select("id", "vertices", "base", "custom_base", "height").mapInPandas(cut, "id int, tri int, height double, ax double, az double, bx double, bz double, cx double, cz double, k0 double, kx double, kz double")


def measure_polygons(polygons: DataFrame, grid: DataFrame, min_x: float, min_z: float, cell: float) -> DataFrame:
    """One row a polygon (id, vertices, base, custom_base, height) against a mean surface grid.

    valid, plan_area, perimeter, edge_length, surface_area, cut, fill, prism,
    filled, unmeasured, base_mean. Integrals are taken by four lines through each
    row of cells, cut at cell borders; the parts meet the grid, whose gaps are
    filled around the polygon, by an equi-join. A polygon that crosses itself or
    has no area is not valid and has zeros; one over no data is valid with
    unmeasured 1 and else zeros.
    """
    parts = polygon_parts(polygon_triangles(polygons), min_x, min_z, cell)
    j = parts.join(polygon_crops(polygons, grid, min_x, min_z, cell), ["id", "row", "col"])
    rise, part = F.col("value") - F.col("base"), F.col("part")
    m = j.groupBy("id").agg(
        F.sum(part).alias("covered"), F.sum(F.when(rise > 0, part * rise).otherwise(0.0)).alias("cut"), F.sum(F.when(rise <= 0, -part * rise).otherwise(0.0)).alias("fill"),
        F.sum(part * F.greatest(F.lit(0.0), F.least(F.col("height"), rise))).alias("filled"), F.sum(part * F.col("factor")).alias("along"),
        F.sum(F.when(F.col("gap"), part).otherwise(0.0)).alias("gaps"), F.sum(part * F.col("base")).alias("bases"),
    )
    cut_up = parts.select("id").distinct().withColumn("cut_up", F.lit(True))
    out = polygon_frame(polygons).join(polygons.select("id", F.greatest(F.lit(0.0), F.col("height")).alias("h")), "id").join(cut_up, "id", "left").join(m, "id", "left")
    valid = F.coalesce("cut_up", F.lit(False)) & (F.col("plan_area") > 0)
    known, area = valid & F.col("covered").isNotNull(), F.col("plan_area")
    value = lambda v: F.round(F.when(known, v).otherwise(0.0), 6)
    return out.select(
        "id", valid.alias("valid"), "plan_area", "perimeter", "edge_length", value(F.greatest(area, F.col("along") * area / F.col("covered"))).alias("surface_area"), value(F.col("cut")).alias("cut"), value(F.col("fill")).alias("fill"),
        value(area * F.col("h")).alias("prism"), value(F.col("filled")).alias("filled"), F.round(F.when(known, F.least(F.lit(1.0), F.col("gaps") / F.col("covered"))).when(valid, 1.0).otherwise(0.0), 6).alias("unmeasured"), value(F.col("bases") / F.col("covered")).alias("base_mean"),
    )


def polygon_drawing(polygons: DataFrame, closed: bool = True) -> DataFrame:
    """id and what a view draws of polygons (id, vertices, base, custom_base, height), as arrays of places (x, y, z): outline, base, drops, prism_edges, prism_faces.

    outline has both ends of each edge, drops both ends of each upright from a corner to the
    base where they are over 0.01 apart; base and prism_faces have three corners
    a triangle. Open polygons, those with fewer than three corners or edges that cross, have an outline only; without a
    height there is no prism. The base is that of :func:`base_planes`, level bases at one height, others on their plane.
    """

    def draw(batches):
        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                v = [(float(p["x"]), float(p["y"]), float(p["z"])) for p in x.vertices]
                n = len(v)
                outline = [p for i in range(n if closed and n > 2 else n - 1) for p in (v[i], v[(i + 1) % n])]
                t = triangulate([(a, c) for a, _, c in v]) if closed and n >= 3 else None
                base, drops, edges, faces = [], [], [], []
                if t:
                    custom = None if x.custom_base is None or pd.isna(x.custom_base) else float(x.custom_base)
                    # Triangles between the corners themselves have these as their base.
                    low = [y for _, y, _ in v] if x.base == "triangulated" else [k + kx * a + kz * c for (a, _, c), (k, kx, kz) in zip(v, base_planes(v, [(0, 1, 2)] * n, x.base, custom), strict=True)]
                    foot = [(a, y, c) for (a, _, c), y in zip(v, low, strict=True)]
                    base = [foot[i] for tri in t for i in tri]
                    drops = [p for a, f in zip(v, foot, strict=True) if abs(a[1] - f[1]) > 0.01 for p in (a, f)]
                    h = max(0.0, float(x.height))
                    if h > 0:
                        top = [(a, y + h, c) for a, y, c in foot]
                        for i in range(n):
                            j = (i + 1) % n
                            edges += [top[i], top[j], foot[i], top[i], foot[i], foot[j]]
                            faces += [foot[i], foot[j], top[j], foot[i], top[j], top[i]]
                        faces += [top[i] for tri in t for i in tri]
                rows.append((x.id, *([{"x": float(a), "y": float(y), "z": float(c)} for a, y, c in part] for part in (outline, base, drops, edges, faces))))
            yield pd.DataFrame(rows, columns=["id", "outline", "base", "drops", "prism_edges", "prism_faces"])

    place = "array<struct<x:double,y:double,z:double>>"
    return polygons.select("id", "vertices", "base", "custom_base", "height").mapInPandas(draw, f"id int, outline {place}, base {place}, drops {place}, prism_edges {place}, prism_faces {place}")


def polygon_parts(triangles: DataFrame, min_x: float, min_z: float, cell: float) -> DataFrame:
    """id, row, col, height, part, base: pieces of triangles within cells, with their area and the base's height in their middle."""
    c = float(cell)
    lo_z, hi_z = F.least("az", "bz", "cz"), F.greatest("az", "bz", "cz")
    line = F.explode(F.sequence(F.floor((lo_z - min_z) / c * 4).cast("bigint"), F.floor((hi_z - min_z) / c * 4).cast("bigint")))
    t = triangles.withColumn("s", line).withColumn("z", (F.col("s") + 0.5) / 4 * c + min_z)

    def crossing(p: str, q: str):
        pz, qz, px, qx = F.col(f"{p}z"), F.col(f"{q}z"), F.col(f"{p}x"), F.col(f"{q}x")
        return F.when((pz <= F.col("z")) != (qz <= F.col("z")), px + (F.col("z") - pz) / (qz - pz) * (qx - px))

    xs = [crossing(*e) for e in (("a", "b"), ("b", "c"), ("c", "a"))]
    t = t.withColumns({"l": F.least(*xs), "r": F.greatest(*xs)}).filter("l < r")
    t = t.withColumn("col", F.explode(F.sequence(F.floor((F.col("l") - min_x) / c).cast("int"), F.floor((F.col("r") - min_x) / c).cast("int"))))
    left, right = F.greatest(F.col("l"), F.lit(min_x) + F.col("col") * c), F.least(F.col("r"), F.lit(min_x) + (F.col("col") + 1) * c)
    t = t.withColumns({"o0": left, "o1": right}).filter("o0 < o1").withColumn("row", F.floor(F.col("s") / 4).cast("int"))
    return t.select("id", "row", "col", F.greatest(F.lit(0.0), F.col("height")).alias("height"), ((F.col("o1") - F.col("o0")) * c / 4).alias("part"), (F.col("k0") + F.col("kx") * (F.col("o0") + F.col("o1")) / 2 + F.col("kz") * F.col("z")).alias("base"))


# ---------------------------------------------------------------- picks


def pick_point(points: DataFrame, matrix: list[float], x: float, y: float, width: float, height: float, dot: float = 2.0, tolerance: float = 6.0) -> DataFrame:
    """The point under a cursor (one row, or none): of the dots that cover it the nearest in depth, else the nearest on screen.

    matrix is the view projection, 16 numbers by columns; y runs down the screen.
    """
    p = [F.lit(matrix[i]) * F.col("x") + F.lit(matrix[4 + i]) * F.col("y") + F.lit(matrix[8 + i]) * F.col("z") + F.lit(matrix[12 + i]) for i in range(4)]
    own = points.select("pid", "x", "y", "z", *(v.alias(f"p{i}") for i, v in enumerate(p))).filter("p3 > 0")
    sx, sy = (F.col("p0") / F.col("p3") + 1) / 2 * width, (1 - F.col("p1") / F.col("p3")) / 2 * height
    own = own.withColumns({"dist": F.hypot(sx - x, sy - y), "depth": F.col("p2") / F.col("p3")}).filter(F.col("depth").between(-1, 1) & (F.col("dist") <= tolerance))
    rank = F.struct((F.col("dist") > dot).cast("int").alias("a"), F.when(F.col("dist") <= dot, F.col("depth")).otherwise(F.col("dist")).alias("b"), F.col("pid").alias("p"))
    best = own.agg(F.min_by(F.struct("pid", "x", "y", "z", "depth", "dist"), rank).alias("h")).select("h.*")
    return best.filter("pid is not null")


def tiles_under_cursor(tiles: DataFrame, matrix: list[float], x: float, y: float, width: float, height: float, reach: float = 6.0) -> DataFrame:
    """Those tiles (min_x .. max_z) that may hold the point under a cursor; the others certainly project clear of it.

    A box that reaches behind the camera has no rectangle on the screen and stays.
    """
    corners = F.array(*(F.struct(*(F.lit(bool(k >> i & 1)).alias(c) for i, c in enumerate("xyz"))) for k in range(8)))

    def seen(at):
        p = [F.when(at[c], F.col(f"max_{c}")).otherwise(F.col(f"min_{c}")) for c in "xyz"]
        return F.struct(*((F.lit(float(matrix[i])) * p[0] + F.lit(float(matrix[4 + i])) * p[1] + F.lit(float(matrix[8 + i])) * p[2] + F.lit(float(matrix[12 + i]))).alias(k) for i, k in enumerate(("a", "b", "c", "w"))))

    own = tiles.withColumn("_v", F.transform(corners, seen))
    w, sx, sy = (F.transform("_v", f) for f in (lambda v: v["w"], lambda v: (F.try_divide(v["a"], v["w"]) + 1) * (width / 2), lambda v: (1 - F.try_divide(v["b"], v["w"])) * (height / 2)))
    inside = F.lit(float(x)).between(F.array_min(sx) - reach, F.array_max(sx) + reach) & F.lit(float(y)).between(F.array_min(sy) - reach, F.array_max(sy) + reach)
    return own.filter((F.array_min(w) <= 0) | inside).drop("_v")


# ---------------------------------------------------------------- levels of detail


def tier_specs(spark: SparkSession, levels: int = 5, fraction: float = 0.25) -> DataFrame:
    """level, id, fraction of the tiers built for a scan: the scan itself, then levels that keep a part of the one before."""
    rows = [(0, "full", None), *((k, f"lod{k}", float(fraction)) for k in range(1, levels + 1))]
    return spark.createDataFrame(rows, "level int, id string, fraction double")


def lod_ladder(points: DataFrame, first_voxel: float, growth: float = 1.35, steps: int = 24) -> DataFrame:
    """voxel, n: how many voxels hold points at each step of a geometric ladder, in one pass over the points."""
    low = points.agg(F.min("x"), F.min("y"), F.min("z")).first()
    ladder = F.explode(F.array(*(F.lit(float(first_voxel * growth**k)) for k in range(steps))))
    v = points.select("x", "y", "z", ladder.alias("voxel"))
    keys = [F.floor((F.col(c) - F.lit(float(o))) / F.col("voxel")).alias(f"k{c}") for c, o in zip("xyz", low, strict=True)]
    return v.select("voxel", *keys).distinct().groupBy("voxel").agg(F.count("*").alias("n"))


def build_lod(points: DataFrame, levels: int = 5, fraction: float = 0.25, growth: float = 1.35, attempts: int = 24) -> list[tuple[float, DataFrame]]:
    """(voxel, points) of each tier: the scan itself, then thinner ones, each made of the one before."""
    from ..storage import settled
    from .tables import voxel_downsample

    b = points.agg(F.count("*"), (F.max("x") - F.min("x")) * (F.max("z") - F.min("z"))).first()
    tiers, n, own = [(0.0, points)], b[0], points
    voxel = max(math.sqrt(max(b[1] or 0, 1e-6) / max(n, 1)), 0.005)
    for _ in range(levels):
        target = n * fraction
        ladder = {r["voxel"]: r["n"] for r in lod_ladder(own, voxel, growth, attempts).collect()}
        voxel = next((v for v, k in sorted(ladder.items()) if k <= target), max(ladder))
        own = settled(voxel_downsample(own, voxel).drop("vx", "vy", "vz", "n"))
        n = ladder[voxel]
        tiers.append((voxel, own))
        if n <= 1:
            break
    return tiers


def tier_for_budget(tiers: DataFrame, budget: int) -> DataFrame:
    """Per tile the first tier (0 is the finest) within its share of a point budget, else the leanest; tiers: tile, tier, n."""
    total = tiers.filter("tier = 0").agg(F.sum("n").alias("total"))
    own = tiers.join(tiers.filter("tier = 0").select("tile", F.col("n").alias("full")), "tile").crossJoin(F.broadcast(total))  # one row
    share = F.greatest(F.lit(1), F.floor(F.lit(float(budget)) * F.col("full") / F.col("total") + 0.5))
    fits = own.withColumn("fits", F.col("n") <= share)
    return fits.groupBy("tile").agg(F.coalesce(F.min(F.when(F.col("fits"), F.col("tier"))), F.max("tier")).alias("tier"))


def tier_for_distance(tiers: DataFrame, cameras: DataFrame) -> DataFrame:
    """Per camera (camera, distance) the tier with the greatest least distance that it reaches, else that of the smallest, else the full one; tiers: tier, min_distance (null: never chosen)."""
    own = tiers.filter("min_distance IS NOT NULL")
    nearest = own.agg(F.min_by("tier", F.struct("min_distance", (-F.col("tier")).alias("t"))).alias("nearest"))
    j = cameras.join(F.broadcast(own), own.min_distance <= cameras.distance, "left")  # a handful of tiers
    chosen = j.groupBy("camera").agg(F.max_by("tier", F.struct("min_distance", "tier")).alias("tier"))
    return chosen.crossJoin(F.broadcast(nearest)).select("camera", F.coalesce("tier", "nearest", F.lit(0)).alias("tier"))  # one row


def distance_to_box(x: float, y: float, z: float) -> list:
    """Distance from a position to boxes min_x .. max_z."""
    d = [F.greatest(F.col(f"min_{c}") - v, F.lit(0.0), F.lit(v) - F.col(f"max_{c}")) for c, v in (("x", x), ("y", y), ("z", z))]
    return [F.sqrt(sum((q * q for q in d), F.lit(0.0))).alias("distance")]


def tier_for_screen(tiers: DataFrame, x: float, y: float, z: float, pixels_per_unit: float, gap: float = 2.0, budget: int | None = None, in_view: Column | None = None) -> DataFrame:
    """Per tile the coarsest tier whose points lie at most ``gap`` pixels apart on screen; with a budget of points, widest gaps are refined first.

    tiers: tile, tier (0 is the finest), spacing, n and the tile's box. Every tile
    starts at its leanest tier, at which those stay for which ``in_view`` doesn't hold. Steps to a
    finer tier are taken in the order of the gaps they close, ties by tile, up to the first
    that would overrun the budget; their running sum is that of range partitions,
    so no task holds them all.
    """
    if gap <= 0 or pixels_per_unit <= 0:
        raise ValueError("gap and pixels_per_unit must be positive")
    own = tiers.withColumn("distance", distance_to_box(x, y, z)[0]).withColumn("gap", F.col("spacing") * F.lit(float(pixels_per_unit)) / F.greatest(F.col("distance"), F.lit(1e-3)))
    seen = F.lit(True) if in_view is None else F.coalesce(in_view, F.lit(False))
    if budget is None:
        fine = F.max(F.when((F.col("gap") <= gap) | ~seen, F.col("tier")))
        return own.groupBy("tile").agg(F.coalesce(fine, F.min("tier")).cast("int").alias("tier"))
    w = Window.partitionBy("tile").orderBy(F.desc("tier"))
    # A step's gap is that of the tier it leaves; a tile's later steps never come before its earlier ones.
    step = own.withColumns({"from_gap": F.min("gap").over(w.rowsBetween(Window.unboundedPreceding, -1)), "more": F.col("n") - F.lag("n").over(w)})
    start = settled(step.groupBy("tile").agg(F.max("tier").alias("coarsest"), F.max_by("n", "tier").alias("n0")))
    spent = start.agg(F.coalesce(F.sum("n0"), F.lit(0))).first()[0]
    wanted = step.filter((F.col("from_gap") > gap) & seen).select("tile", "tier", "from_gap", "more")
    taken = running_total(wanted, [F.desc("from_gap"), F.col("tile"), F.desc("tier")], "more", "total").filter(F.col("total") + F.lit(spent) <= budget)
    return start.join(taken.groupBy("tile").agg(F.min("tier").alias("t")), "tile", "left").select("tile", F.coalesce("t", "coarsest").cast("int").alias("tier"))
