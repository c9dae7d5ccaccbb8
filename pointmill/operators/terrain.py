"""Terrain models and contour lines."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled
from . import raster as R
from .components import placed_edge_roots
from .quality import Frame, with_cells

MIN_MEASURED, MIN_RING = 16, 8
#: Contour intervals and how many of them make an index line (fixed values).
INTERVALS = [(0.1, 5), (0.2, 5), (0.25, 4), (0.5, 5), (1.0, 5), (2.0, 5), (2.5, 4), (5.0, 5), (10.0, 5), (20.0, 5), (25.0, 4), (50.0, 5), (100.0, 5), (200.0, 5), (250.0, 4), (500.0, 5)]


def footprint(points: DataFrame, frame: Frame) -> DataFrame:
    """Occupied cells, those of noise included, and the cells beside them."""
    occupied = with_cells(points, frame).select("row", "col").distinct()
    out = R.spread(occupied, 1, True).distinct()
    return out.filter(F.col("row").between(0, frame.rows - 1) & F.col("col").between(0, frame.cols - 1))


def terrain_model(points: DataFrame, frame: Frame) -> DataFrame:
    """row, col, elevation, measured within the footprint; ValueError with fewer than 16 measured cells."""
    ground = settled(R.mean_ground_surface(points, frame))
    if ground.count() < MIN_MEASURED:
        raise ValueError(f"less than {MIN_MEASURED} cells have ground points")
    full = R.push_pull(ground, frame.rows, frame.cols)
    own = full.join(footprint(points, frame), ["row", "col"], "left_semi")
    seen = ground.select("row", "col", F.lit(True).alias("m"))
    return own.join(seen, ["row", "col"], "left").select("row", "col", F.col("value").alias("elevation"), F.coalesce("m", F.lit(False)).alias("measured"))


def contour_interval(relief: float) -> tuple[float, int]:
    """The first interval that gives about 25 lines or fewer; beyond the list, a multiple of its last."""
    wanted = max(relief, 0.0) / 25
    last, every = INTERVALS[-1]
    return next(((i, k) for i, k in INTERVALS if i >= wanted), (last * -(-wanted // last), every))


def contour_segments(grid: DataFrame, interval: float, origin_y: float = 0.0) -> DataFrame:
    """row, col, k and the two edges of each piece of contour k * interval in a square of four cells.

    An edge is named by its upper left cell and direction (0 right, 1 down); at
    is where the line crosses it, from 0 to 1. A corner at the level is above it.
    """
    right = Window.partitionBy("row").orderBy("col")
    g = grid.select("row", "col", F.col("value").alias("a"), F.when(F.lead("col").over(right) == F.col("col") + 1, F.lead("value").over(right)).alias("b"))
    down = Window.partitionBy("col").orderBy("row")
    below = F.lead("row").over(down) == F.col("row") + 1
    g = g.select("row", "col", "a", "b", F.when(below, F.lead("a").over(down)).alias("d"), F.when(below, F.lead("b").over(down)).alias("c")).dropna(subset=["a", "b", "c", "d"])
    low, high = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    first = F.floor((low + origin_y) / interval).cast("bigint") + 1
    last = F.floor((high + origin_y) / interval).cast("bigint")
    g = g.filter(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    level = F.col("k") * F.lit(float(interval)) - F.lit(float(origin_y))
    g = g.withColumn("level", level)
    up = {c: F.col(c) >= F.col("level") for c in "abcd"}
    code = sum((up[c].cast("int") * w for c, w in zip("abcd", (1, 2, 4, 8), strict=True)), F.lit(0))
    t = lambda p, q: (F.col("level") - F.col(p)) / (F.col(q) - F.col(p))
    edge = {
        "top": F.struct(F.col("row").alias("r"), F.col("col").alias("c"), F.lit(0).alias("dir"), t("a", "b").alias("at")),
        "left": F.struct(F.col("row").alias("r"), F.col("col").alias("c"), F.lit(1).alias("dir"), t("a", "d").alias("at")),
        "right": F.struct(F.col("row").alias("r"), (F.col("col") + 1).alias("c"), F.lit(1).alias("dir"), t("b", "c").alias("at")),
        "bottom": F.struct((F.col("row") + 1).alias("r"), F.col("col").alias("c"), F.lit(0).alias("dir"), t("d", "c").alias("at")),
    }
    seg = lambda p, q: F.struct(edge[p].alias("p"), edge[q].alias("q"))
    mean_up = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= F.col("level")
    table = {1: ("left", "top"), 2: ("top", "right"), 3: ("left", "right"), 4: ("right", "bottom"), 6: ("top", "bottom"), 7: ("left", "bottom")}
    g = g.withColumn("code", code)
    one = None
    for n, (p, q) in table.items():
        hit = F.col("code").isin(n, 15 - n)
        one = F.when(hit, F.array(seg(p, q))) if one is None else one.when(hit, F.array(seg(p, q)))
    crossed = F.array(seg("top", "right"), seg("left", "bottom")), F.array(seg("left", "top"), seg("right", "bottom"))
    saddle = F.when((F.col("code") == 5) == mean_up, crossed[0]).otherwise(crossed[1])
    g = g.withColumn("s", F.explode(F.when(F.col("code").isin(5, 10), saddle).otherwise(one)))
    return g.select("row", "col", "k", "level", "s.p", "s.q")


def contours(grid: DataFrame, frame: Frame, interval: float | None = None, major_every: int | None = None, origin_y: float = 0.0, passes: int = 2) -> DataFrame:
    """k, level, major, closed, points of the chained lines; rings of fewer than 8 vertices are left out.

    Pieces are grouped into lines by the edges that they share; each line is put
    in order in one task, so a task holds what one row of the result holds.
    """
    own = settled(R.smooth(grid, passes))
    if interval is None:
        lo, hi = own.agg(F.min("value"), F.max("value")).first()
        interval, every = contour_interval((hi or 0.0) - (lo or 0.0))
    else:
        every = 5
    every = major_every or every
    if interval <= 0:
        raise ValueError("the interval must be positive")
    pieces = settled(contour_segments(own, interval, origin_y))
    # An edge of the grid on a level is a number; pieces link the two edges that they run between.
    least = pieces.agg(F.min("k")).first()[0] or 0
    node = lambda e: (F.col("k") - least) * (2 * frame.rows * frame.cols) + (F.col(f"{e}.r").cast("bigint") * frame.cols + F.col(f"{e}.c")) * 2 + F.col(f"{e}.dir")
    pieces = pieces.select("row", "col", "k", "level", "p", "q", node("p").alias("a"), node("q").alias("b"))
    pieces = pieces.join(placed_edge_roots(pieces).withColumnRenamed("root", "line"), ["a", "b"])
    x0, z0, cell = frame.min_x, frame.min_z, frame.cell

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        level, k = float(pdf["level"].iloc[0]), int(pdf["k"].iloc[0])
        ends: dict[tuple, list[int]] = {}
        where: dict[tuple, tuple[float, float]] = {}
        links = []
        for p, q in zip(pdf["p"], pdf["q"], strict=True):
            pair = []
            for e in (p, q):
                key = (e["r"], e["c"], e["dir"])
                where[key] = (x0 + cell * (e["c"] + 0.5 + (0 if e["dir"] else e["at"])), z0 + cell * (e["r"] + 0.5 + (e["at"] if e["dir"] else 0)))
                pair.append(key)
                ends.setdefault(key, []).append(len(links))
            links.append(tuple(pair))
        used = [False] * len(links)
        out = []
        starts = sorted(e for e, own_ in ends.items() if len(own_) == 1) + sorted(ends)
        for s in starts:
            if all(used[i] for i in ends[s]):
                continue
            path, at = [s], s
            while (i := next((i for i in ends[at] if not used[i]), None)) is not None:
                used[i] = True
                at = links[i][1] if links[i][0] == at else links[i][0]
                path.append(at)
            closed = path[0] == path[-1] and len(path) > 2
            if closed and len(path) - 1 < MIN_RING:
                continue
            out.append((k, level + origin_y, k % every == 0, closed, [{"x": where[e][0], "y": level, "z": where[e][1]} for e in path]))
        return pd.DataFrame(out, columns=["k", "level", "major", "closed", "points"])

    return pieces.groupBy("k", "line").applyInPandas(chain, "k bigint, level double, major boolean, closed boolean, points array<struct<x:double,y:double,z:double>>")


def relief(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min("value").alias("low"), F.max("value").alias("high"))


