"""Ground by progressive openings of the lowest surface, and heights above it.

The surface is a keyed grid. Openings at growing radii run on dense tiles with
a margin as wide as all openings together can reach, so tiles are filtered
apart, in parallel, with the result of the whole grid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from . import raster as R
from .quality import Frame, with_cells


@dataclass(frozen=True)
class GroundOptions:
    cell: float = 1.0
    slope: float = 0.15
    window: float = 18.0
    threshold: float = 0.5
    scaler: float = 1.25
    low_depth: float = 2.0
    #: Cells grow until a grid fits so many; grids are keyed tables, so none has to.
    max_cells: int | None = None
    tile: int = 1_024

    def __post_init__(self):
        if min(self.cell, self.window, self.threshold) <= 0 or min(self.slope, self.scaler, self.low_depth) < 0:
            raise ValueError("cell, window and threshold must be positive, the others not negative")

    @property
    def radii(self) -> range:
        return range(1, max(1, int(np.ceil(self.window / self.cell))) + 1)


def object_cells(surface: DataFrame, frame: Frame, options: GroundOptions) -> DataFrame:
    """row, col of the cells of a dense surface that an opening lowers by more than the slope allows at its radius."""
    slope, cell, radii = options.slope, frame.cell, list(options.radii)

    def mark(grid: np.ndarray, _row: int, _col: int) -> np.ndarray:
        hit, before = np.zeros(grid.shape, bool), grid
        for r in radii:
            after = R.open_extrapolated(before, r)
            hit |= before - after > slope * r * cell
            before = after
        return np.where(hit, 1.0, np.nan)

    return R.on_tiles(surface, frame.rows, frame.cols, 2 * sum(radii), mark, options.tile).select("row", "col")


def detect_ground(points: DataFrame, options: GroundOptions = GroundOptions()) -> DataFrame:
    """points with ``classification`` (2 ground, 1 other, 7 far below; other labels stay) and ``height_above_ground``.

    Raises ValueError where no point is left without noise.
    """
    frame = Frame.of(points, options.cell, options.max_cells)
    lowest = settled(R.minimum_surface(points, frame))
    if not lowest.limit(1).count():
        raise ValueError("every point is marked as noise")
    lowest = settled(R.push_pull(lowest, frame.rows, frame.cols))
    lowest = settled(R.raise_pits(lowest, frame.rows, frame.cols, max(2 * options.threshold, 2 * options.slope * frame.cell)).select("row", "col", "value"))
    objects = settled(object_cells(lowest, frame, options))
    bare = lowest.join(objects, ["row", "col"], "left_anti")
    surface = settled(R.push_pull(bare, frame.rows, frame.cols)) if bare.limit(1).count() else lowest
    slopes = R.slope(surface, frame.cell).withColumnRenamed("value", "slope")
    slopes = F.broadcast(slopes) if frame.rows * frame.cols <= R.BROADCAST_CELLS else slopes
    own = with_cells(points, frame).join(slopes, ["row", "col"], "left")
    own = R.bilinear(own, surface, frame, "surface")
    old = F.coalesce(F.col("classification"), F.lit(0)) if "classification" in points.columns else F.lit(0)
    d = F.col("y") - F.col("surface")
    new = F.when(~old.isin(0, 1, 2), old).when(F.abs(d) <= options.threshold + options.scaler * F.col("slope"), 2).when(d < -options.low_depth, 7).otherwise(1)
    out = own.withColumn("classification", new.cast("int")).drop("row", "col", "slope", "surface")
    return height_above_ground(settled(out), frame, surface)


def height_above_ground(points: DataFrame, frame: Frame, fallback: DataFrame | None = None) -> DataFrame:
    """points with their height over the mean ground surface, gaps filled; over the fallback surface where no point is ground."""
    ground = R.mean_ground_surface(points, frame)
    if ground.limit(1).count():
        ground = R.push_pull(settled(ground), frame.rows, frame.cols)
    elif fallback is not None:
        ground = fallback
    else:
        return points.withColumn("height_above_ground", F.lit(None).cast("double"))
    out = R.bilinear(points.drop("height_above_ground"), ground, frame, "_ground")
    return out.withColumn("height_above_ground", F.col("y") - F.col("_ground")).drop("_ground")


def height_above_classified_ground(points: DataFrame, cell: float = 1.0, max_cells: int | None = None) -> DataFrame | None:
    """Heights over the ground that the scan itself labels; None where less than 100 points or half a percent are ground."""
    n, ground = points.agg(F.count("*"), F.sum((F.col("classification") == 2).cast("long"))).first()
    if (ground or 0) < max(100, 0.005 * n):
        return None
    return height_above_ground(points, Frame.of(points, cell, max_cells))


def ground_stats(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("n"), F.sum((F.col("classification") == 2).cast("long")).alias("ground"), F.sum((F.col("classification") == 7).cast("long")).alias("low_noise"))


