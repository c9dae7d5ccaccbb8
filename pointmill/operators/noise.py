"""Stray points: isolated ones, and low outliers of a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import settled
from .quality import Frame, with_cells
from .tables import without_noise

#: Sparse cubes, and points in them (each is compared around 27 cells), are broadcast only up to so many; beyond, they are shuffled.
BROADCAST_CUBES, BROADCAST_POINTS = 200_000, 10_000
#: Cells of columns grow only beyond so many.
LEAST_COLUMNS = 4_000_000


def isolated_points(points: DataFrame, radius: float, least: int = 2) -> DataFrame:
    """pid of the points with fewer than ``least`` others strictly within ``radius``.

    Points in a cube of half the radius that holds more than ``least`` points
    can't be isolated: that settles nearly all of them by one aggregation. Only
    the rest meets candidates, over the nine columns around it, by an
    equi-join; counts are bounded by the join's residual condition and added up map-side.
    """
    if radius <= 0 or least < 1:
        raise ValueError("radius and least must be positive")
    h = radius / 2
    cube = {f"q{c}": F.floor(F.col(c) / F.lit(h)).cast("bigint") for c in "xyz"}
    own = points.select("pid", "x", "y", "z")
    keyed = own.withColumns(cube)
    few = settled(keyed.groupBy("qx", "qy", "qz").agg(F.count("*").alias("n")).filter(F.col("n") <= least).drop("n"))
    sparse = settled(keyed.join(_near(few, BROADCAST_CUBES), ["qx", "qy", "qz"]).select("pid", "x", "y", "z"))
    cells = {f"c{c}": F.floor(F.col(c) / F.lit(radius)).cast("bigint") for c in "xyz"}
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("ijk", o, strict=True))) for o in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))))
    probe = sparse.withColumns(cells).withColumn("o", around)
    probe = probe.select(F.col("pid").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), (F.col("cz") + F.col("o.k")).alias("cz"))
    if sparse.count() <= BROADCAST_POINTS:
        probe = F.broadcast(probe)
    dx, dy, dz = F.col("px") - F.col("x"), F.col("py") - F.col("y"), F.col("pz") - F.col("z")
    near = own.withColumns(cells).join(probe, ["cx", "cy", "cz"]).filter((dx * dx + dy * dy + dz * dz < radius * radius) & (F.col("p") != F.col("pid")))
    enough = near.groupBy("p").agg(F.count("*").alias("k")).filter(F.col("k") >= least)
    return sparse.select("pid").join(enough, F.col("pid") == F.col("p"), "left_anti")


def _near(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast where it is counted small; it is settled already."""
    return F.broadcast(df) if df.count() <= rows else df


def column_frame(points: DataFrame, cell: float) -> Frame:
    """Cells from the extent's minimum; they grow by half while they are more than the points and four million."""
    b = points.agg(F.min("x"), F.min("z"), F.max("x") - F.min("x"), F.max("z") - F.min("z"), F.count("*")).first()
    if not b[4]:
        return Frame(0.0, 0.0, float(cell), 0, 0)
    size = float(cell)
    while (b[2] / size + 1) * (b[3] / size + 1) > max(LEAST_COLUMNS, b[4]):
        size *= 1.5
    return Frame(b[0], b[1], size, G.grid_size(b[2], size), G.grid_size(b[3], size))


def judged_columns(points: DataFrame, frame: Frame, gap: float = 1.0) -> DataFrame:
    """points without those labelled as noise, with row, col, ``low`` and ``median``.

    low are the lowest points of a cell up to the last gap of more than ``gap``
    that follows only such gaps; the last point of a cell is never low. median is
    the upper median height of the cell's other points. One shuffle serves both.
    """
    cell = Window.partitionBy("row", "col")
    w = cell.orderBy("y", "pid")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = with_cells(without_noise(points), frame)
    own = own.withColumns({"_wide": F.coalesce(F.lead("y").over(w) - F.col("y") > gap, F.lit(False)).cast("int"), "_k": F.row_number().over(w)})
    own = own.withColumn("_low", F.min("_wide").over(upto))
    own = own.withColumns({"_lows": F.sum("_low").over(cell), "_m": F.count("*").over(cell)})
    middle = F.col("_lows") + F.floor((F.col("_m") - F.col("_lows")) / 2) + 1
    own = own.withColumns({"low": F.col("_low") == 1, "median": F.max(F.when(F.col("_k") == middle, F.col("y"))).over(cell)})
    return own.drop("_wide", "_k", "_low", "_lows", "_m")


def low_outliers(points: DataFrame, cell: float = 10.0, gap: float = 1.0) -> DataFrame:
    """pid, low of the points that aren't labelled as noise; see :func:`judged_columns`."""
    return judged_columns(points, column_frame(points, cell), gap).select("pid", "low")


def detect_noise(points: DataFrame, radius: float | None = None, least: int = 2, cell: float = 10.0, gap: float = 1.0) -> DataFrame:
    """points with the classification of what is noise: 7 for low outliers, 18 for isolated points well above the median, else 7.

    Points that are labelled as noise already keep their label.
    """
    frame = column_frame(points, cell)
    if radius is None:
        b = points.agg((F.max("x") - F.min("x")).alias("w"), (F.max("z") - F.min("z")).alias("h"), F.count("*").alias("n"))
        radius = b.select(G.noise_radius(F.col("w") * F.col("h"), F.col("n"))).first()[0] or 1.0
    alone = settled(isolated_points(points, radius, least).select(F.col("pid").alias("_ip")))
    labelled = "classification" in points.columns
    old = F.col("classification") if labelled else F.lit(0)
    out = judged_columns(points, frame, gap).join(_near(alone, BROADCAST_CUBES), F.col("pid") == F.col("_ip"), "left")
    high = F.col("median").isNull() | (F.col("y") > F.col("median") + 2)
    new = F.when(F.col("low"), 7).when(F.col("_ip").isNotNull(), F.when(high, 18).otherwise(7)).otherwise(old)
    out = out.withColumn("classification", new.cast("int")).drop("row", "col", "low", "median", "_ip")
    return out.unionByName(points.filter(G.is_noise(old)).withColumn("classification", old.cast("int"))) if labelled else out


def noise_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Points labelled before, and newly as 7 and 18."""
    b = before.select(F.col("pid").alias("bp"), G.is_noise(F.col("classification")).alias("old"))
    j = after.join(b, F.col("pid") == F.col("bp"))
    new = lambda c: F.sum(((F.col("classification") == c) & ~F.col("old")).cast("long"))
    return j.agg(F.sum(F.col("old").cast("long")).alias("kept"), new(7).alias("low"), new(18).alias("high"), F.count("*").alias("n"))
