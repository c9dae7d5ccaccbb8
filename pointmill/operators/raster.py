"""Raster operators on keyed grids (row, col, value); absent rows are empty cells.

Neighbourhoods are offsets exploded and grouped, or window frames along rows
and columns; whole-grid work in one task is limited by an explicit number of cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled
from .quality import Frame, with_cells
from .tables import without_noise

MAX_DENSE_CELLS = 4_000_000
#: Grids of up to so many cells are filled in one task.
DENSE_CELLS = 1_000_000
#: Grids of up to so many cells are broadcast to points.
BROADCAST_CELLS = 250_000


def minimum_surface(points: DataFrame, frame: Frame) -> DataFrame:
    return with_cells(without_noise(points), frame).groupBy("row", "col").agg(F.min("y").alias("value"))


def mean_ground_surface(points: DataFrame, frame: Frame) -> DataFrame:
    return with_cells(points.filter("classification = 2"), frame).groupBy("row", "col").agg(F.avg("y").alias("value"))


def surface_grid(points: DataFrame, min_x: float, min_z: float, cell: float, cols: int, rows: int, how: str = "highest", speckle_passes: int = 2) -> DataFrame:
    """Highest or mean height of each cell without noise; points outside are left out; then speckles are filled."""
    if how not in ("highest", "mean"):
        raise ValueError("how is 'highest' or 'mean'")
    own = without_noise(points).withColumns({"row": F.floor((F.col("z") - F.lit(min_z)) / F.lit(cell)).cast("int"), "col": F.floor((F.col("x") - F.lit(min_x)) / F.lit(cell)).cast("int")})
    own = own.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    out = own.groupBy("row", "col").agg((F.max if how == "highest" else F.avg)("y").alias("value"))
    return filled_speckles(out, rows, cols, speckle_passes)


def on_tiles(grid: DataFrame, rows: int, cols: int, margin: int, f, tile: int = 1_024, flag: str | None = None) -> DataFrame:
    """A grid worked on in dense tiles, each in one task: f(array, first row, first column) gives an array of the same cells.

    A tile comes with the cells up to ``margin`` around it, as far as f looks, so
    its own cells get the whole grid's result. NaN is an empty cell. With ``flag``
    f gives a second array, of truth values, for a column of that name.
    """
    span = lambda c: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - margin, F.lit(0)) / tile).cast("int"), F.floor((F.col(c) + margin) / tile).cast("int")))
    placed = grid.select("row", "col", "value", span("row").alias("tr")).withColumn("tc", span("col"))
    placed = placed.filter((F.col("tr") <= (rows - 1) // tile) & (F.col("tc") <= (cols - 1) // tile))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        r0, c0 = max(0, tr * tile - margin), max(0, tc * tile - margin)
        h, w = min(rows, (tr + 1) * tile + margin) - r0, min(cols, (tc + 1) * tile + margin) - c0
        out = f(dense_array(pdf.assign(row=pdf["row"] - r0, col=pdf["col"] - c0), h, w, h * w), r0, c0)
        top, left = tr * tile - r0, tc * tile - c0
        parts = [a[top : top + tile, left : left + tile] for a in (out if flag else (out,))]
        r, c = np.nonzero(~np.isnan(parts[0]))
        columns = {"row": (r + tr * tile).astype("int32"), "col": (c + tc * tile).astype("int32"), "value": parts[0][r, c]}
        return pd.DataFrame(columns | ({flag: parts[1][r, c]} if flag else {}))

    return placed.groupBy("tr", "tc").applyInPandas(work, "row int, col int, value double" + (f", {flag} boolean" if flag else ""))


def filled_speckles(grid: DataFrame, rows: int, cols: int, passes: int = 2, least: int = 4) -> DataFrame:
    """Like so many passes of :func:`fill_speckles`, in tiles."""

    def fill(a: np.ndarray, r0: int, c0: int) -> np.ndarray:
        for _ in range(passes):
            known = ~np.isnan(a)
            p, k = np.pad(np.where(known, a, 0.0), 1), np.pad(known.astype(float), 1)
            shifts = [(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
            total, n = (sum(x[i : i + a.shape[0], j : j + a.shape[1]] for i, j in shifts) for x in (p, k))
            inner = np.zeros(a.shape, bool)
            inner[max(0, 1 - r0) : rows - 1 - r0, max(0, 1 - c0) : cols - 1 - c0] = True
            hole = ~known & inner & (n >= least)
            a = np.where(hole, total / np.maximum(n, 1), a)
        return a

    return on_tiles(grid, rows, cols, passes, fill) if passes else grid.select("row", "col", "value")


def opened(grid: DataFrame, rows: int, cols: int, radius: int) -> DataFrame:
    """Square opening of a dense grid whose edges go on with their slope, in tiles."""
    return on_tiles(grid, rows, cols, 2 * radius + 1, lambda a, _r, _c: open_extrapolated(a, radius))


def _offsets(radius: int = 1, centre: bool = False):
    return F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if centre or i or j)))


def spread(grid: DataFrame, radius: int = 1, centre: bool = False) -> DataFrame:
    """Each cell's row once for each neighbour, keyed by the neighbour."""
    keep = [c for c in grid.columns if c not in ("row", "col")]
    out = grid.withColumn("o", _offsets(radius, centre))
    return out.select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), *keep)


def fill_speckles(grid: DataFrame, rows: int, cols: int, least: int = 4) -> DataFrame:
    """Empty inner cells with at least ``least`` of 8 neighbours filled take their mean."""
    near = spread(grid).filter(F.col("row").between(1, rows - 2) & F.col("col").between(1, cols - 2))
    near = near.groupBy("row", "col").agg(F.count("*").alias("n"), F.avg("value").alias("m")).filter(F.col("n") >= least)
    holes = near.join(grid.select("row", "col"), ["row", "col"], "left_anti")
    return grid.select("row", "col", "value").unionByName(holes.select("row", "col", F.col("m").alias("value")))


def _slide(grid: DataFrame, radius: int, f) -> DataFrame:
    # Range frames over the coordinate, so that gaps in a sparse grid count as gaps.
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    out = grid.select("row", "col", f("value").over(across).alias("value"))
    return out.select("row", "col", f("value").over(down).alias("value"))


def erode(grid: DataFrame, radius: int) -> DataFrame:
    return _slide(grid, radius, F.min)


def dilate(grid: DataFrame, radius: int) -> DataFrame:
    return _slide(grid, radius, F.max)


def open_clipped(grid: DataFrame, radius: int) -> DataFrame:
    """Erosion then dilation of a dense grid; windows are cut off at the edges."""
    return dilate(erode(grid, radius), radius)


def binary_open_close(mask: DataFrame) -> DataFrame:
    """Close after open, 3 by 3, of a dense 0/1 grid; the outside is neutral."""
    return erode(dilate(dilate(erode(mask, 1), 1), 1), 1)


def slope(grid: DataFrame, cell: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Magnitude of central differences, one-sided at the edges, of a dense grid, or of one for each of ``keys``."""

    def along(part, order):
        w = Window.partitionBy(*keys, part).orderBy(order)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        steps = (before.isNotNull().cast("int") + after.isNotNull().cast("int")).cast("double")
        rise = F.coalesce(after, F.col("value")) - F.coalesce(before, F.col("value"))
        return F.when(steps > 0, rise / (steps * F.lit(float(cell)))).otherwise(F.lit(0.0))

    out = grid.withColumns({"gx": along("row", "col"), "gz": along("col", "row")})
    return out.select(*keys, "row", "col", F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz")).alias("value"))


def bilinear(points: DataFrame, grid: DataFrame, frame: Frame, name: str = "surface") -> DataFrame:
    """points with the value of a dense grid between the four nearest cell centres, clamped at the edges.

    The grid is widened once (each cell carries its right, lower and diagonal
    neighbour), so every point needs one equi-join only.
    """
    right = Window.partitionBy("row").orderBy("col")
    wide = grid.select("row", "col", "value", F.lead("value", 1).over(right).alias("e"))
    down = Window.partitionBy("col").orderBy("row")
    wide = wide.select("row", "col", "value", F.coalesce("e", "value").alias("e"), F.lead("value").over(down).alias("s"), F.lead(F.coalesce("e", "value")).over(down).alias("se"))
    wide = wide.select(F.col("row").alias("gr"), F.col("col").alias("gc"), F.col("value").alias("nw"), F.col("e").alias("ne"), F.coalesce("s", "value").alias("sw"), F.coalesce("se", "e").alias("se"))
    clip = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), v))
    u = clip((F.col("x") - F.lit(frame.min_x)) / F.lit(frame.cell) - 0.5, frame.cols)
    v = clip((F.col("z") - F.lit(frame.min_z)) / F.lit(frame.cell) - 0.5, frame.rows)
    out = points.withColumns({"_u": u, "_v": v}).withColumns({"_c": F.floor("_u").cast("int"), "_r": F.floor("_v").cast("int")})
    if frame.rows * frame.cols <= BROADCAST_CELLS:
        wide = F.broadcast(wide)
    out = out.join(wide, (F.col("_r") == F.col("gr")) & (F.col("_c") == F.col("gc")), "left")
    fu, fv = F.col("_u") - F.col("_c"), F.col("_v") - F.col("_r")
    top = F.col("nw") + (F.col("ne") - F.col("nw")) * fu
    low = F.col("sw") + (F.col("se") - F.col("sw")) * fu
    return out.withColumn(name, top + (low - top) * fv).drop("_u", "_v", "_c", "_r", "gr", "gc", "nw", "ne", "sw", "se")


def push_pull(grid: DataFrame, rows: int | str, cols: int | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A dense grid: empty cells filled from coarser and coarser weighted means; measured cells stay.

    Each level halves the grid. Levels of more than DENSE_CELLS are DataFrames,
    stored once; all coarser ones, and small grids, are filled in one task. With
    ``keys`` many grids are filled at once, rows and cols then name columns. A
    grid without any value has no cells in the result.
    """
    if any(isinstance(n, int) and n < 1 for n in (rows, cols)):
        raise ValueError("a grid has at least one cell")
    size = [F.lit(n) if isinstance(n, int) else F.col(n) for n in (rows, cols)]
    level = grid.select(*keys, "row", "col", F.col("value").cast("double").alias("v"), F.lit(1.0).alias("w"), size[0].cast("int").alias("_r"), size[1].cast("int").alias("_c"))
    most = rows * cols if isinstance(rows, int) and isinstance(cols, int) else _most(level)
    return _filled(level, keys, most).select(*keys, "row", "col", F.col("v").alias("value"))


def _most(level: DataFrame) -> int:
    return level.agg(F.max(F.col("_r").cast("bigint") * F.col("_c"))).first()[0] or 0


def _filled(level: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """keys, row, col, v of a level (v, w, and its size _r, _c) without gaps; most is the size of the largest grid."""
    if most <= DENSE_CELLS:

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            v, w = (np.zeros((int(pdf["_r"].iloc[0]), int(pdf["_c"].iloc[0]))) for _ in range(2))
            at = pdf["row"].to_numpy(), pdf["col"].to_numpy()
            v[at], w[at] = pdf["v"].to_numpy(), pdf["w"].to_numpy()
            full = fill_array(v, w)
            r, c = np.indices(full.shape, dtype="int32").reshape(2, -1)
            out = pd.DataFrame({"row": r, "col": c, "v": full.ravel()})
            for k in reversed(keys):
                out.insert(0, k, pdf[k].iloc[0])
            return out

        own = "".join(f"{k} {level.schema[k].dataType.simpleString()}, " for k in keys)
        return level.groupBy(*keys).applyInPandas(fill, f"{own}row int, col int, v double")
    level = settled(level)
    own = level.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.col("_r").cast("bigint") * F.col("_c")).alias("all"))
    if not own.filter("n < all").limit(1).count():
        return level.select(*keys, "row", "col", "v")
    half = lambda c: F.floor((F.col(c) + 1) / 2).cast("int")
    coarse = level.groupBy(*keys, F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col"))
    coarse = settled(coarse.agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"), F.sum("w").alias("w"), F.max(half("_r")).alias("_r"), F.max(half("_c")).alias("_c")))
    return settled(_pull(level, _filled(coarse, keys, _most(coarse)), keys))


def fill_array(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The same of one array with weights (0 for empty cells), level by level."""
    rows, cols = v.shape
    if (w > 0).all() or v.size == 1 or not (w > 0).any():
        return v
    pad = ((0, rows % 2), (0, cols % 2))
    four = lambda a: np.pad(a, pad).reshape((rows + 1) // 2, 2, (cols + 1) // 2, 2).sum((1, 3))
    weight = four(w)
    up = fill_array(np.divide(four(v * w), weight, out=np.zeros(weight.shape), where=weight > 0), weight)
    for axis in (1, 0):
        edge = np.pad(up, [(1, 1) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        before, after = np.take(edge, range(up.shape[axis]), axis), np.take(edge, range(2, up.shape[axis] + 2), axis)
        both = np.stack([up * 0.75 + before * 0.25, up * 0.75 + after * 0.25], axis + 1)
        up = both.reshape(up.shape[0] * (2 if axis == 0 else 1), up.shape[1] * (2 if axis == 1 else 1))
    return np.where(w > 0, v, up[:rows, :cols])


def _pull(fine: DataFrame, coarse: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The level under a dense one: own values, else values between the four nearest centres of the coarse level.

    A cell's centre lies a quarter of a coarse cell from its parent's, so it is
    three quarters parent and one quarter the next one, in both directions;
    beyond the edge the parent counts for the next one.
    """
    across = Window.partitionBy(*keys, "row").orderBy("col")
    down = Window.partitionBy(*keys, "col").orderBy("row")
    own = F.col("v")
    g = coarse.select(*keys, "row", "col", (own * 0.75 + F.coalesce(F.lag("v").over(across), own) * 0.25).alias("l"), (own * 0.75 + F.coalesce(F.lead("v").over(across), own) * 0.25).alias("r"))
    next_ = lambda f, c: F.coalesce(f(c).over(down), F.col(c))
    part = lambda i, j, c: F.struct((F.col("row") * 2 + i).alias("row"), (F.col("col") * 2 + j).alias("col"), (F.col(c) * 0.75 + next_(F.lead if i else F.lag, c) * 0.25).alias("u"))
    g = g.select(*keys, F.array(*(part(i, j, "lr"[j]) for i in (0, 1) for j in (0, 1))).alias("p")).select(*keys, F.explode("p").alias("p")).select(*keys, "p.*")
    g = g.join(fine.select(*keys, "row", "col", "v"), [*keys, "row", "col"], "left")
    size = fine.groupBy(*keys).agg(F.max("_r").alias("_r"), F.max("_c").alias("_c"))
    g = g.join(size, list(keys)) if keys else g.crossJoin(F.broadcast(size))  # one row
    return g.filter((F.col("row") < F.col("_r")) & (F.col("col") < F.col("_c"))).select(*keys, "row", "col", F.coalesce("v", "u").alias("v"))


def raise_pits(grid: DataFrame, rows: int, cols: int, depth: float) -> DataFrame:
    """Pits of one or two cells lifted to their least sound neighbour; ``lifted`` tells which. In tiles.

    A candidate lies more than ``depth`` under the lower median of at least three
    neighbours; a patch has at most two cells where no candidate has more than
    one candidate beside it and that one has no other. Of a pair, both take the
    least sound neighbour of either.
    """
    return on_tiles(grid, rows, cols, 4, lambda a, _r, _c: _without_pits(a, depth), flag="lifted")


def _without_pits(a: np.ndarray, depth: float) -> tuple[np.ndarray, np.ndarray]:
    def around(x: np.ndarray, fill: float) -> np.ndarray:
        p = np.pad(x, 1, constant_values=fill)
        return np.stack([p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3) if (i, j) != (1, 1)], -1)

    near = np.sort(around(a, np.nan), -1)
    n = (~np.isnan(near)).sum(-1)
    median = np.take_along_axis(near, (np.maximum(n - 1, 0) // 2)[..., None], -1)[..., 0]
    with np.errstate(invalid="ignore"):
        pit = (n >= 3) & (a < median - depth)
    k = around(pit.astype(float), 0.0).sum(-1)
    small = pit & ((k == 0) | ((k == 1) & (around(pit * k, 0.0).sum(-1) == 1)))
    sound = around(np.where(np.isnan(a) | pit, np.inf, a), np.inf).min(-1)
    # A pair's other cell is the only pit beside it.
    other = around(np.where(pit, sound, np.inf), np.inf).min(-1)
    up = np.where(k == 1, np.minimum(sound, other), sound)
    lifted = small & np.isfinite(up)
    return np.where(lifted, up, a), lifted


def smooth(grid: DataFrame, passes: int = 2) -> DataFrame:
    """Means of 3 by 3 over cells with data."""
    for _ in range(passes):
        near = spread(grid.withColumnRenamed("value", "nv"), centre=True).groupBy("row", "col").agg(F.avg("nv").alias("value"))
        grid = grid.select("row", "col").join(near, ["row", "col"])
    return grid


def smooth_canopy(grid: DataFrame) -> DataFrame:
    """Binomial 3 by 3 weights over cells with data."""
    out = grid.withColumn("o", _offsets(1, True))
    w = (F.lit(2.0) - F.abs(F.col("o.i"))) * (F.lit(2.0) - F.abs(F.col("o.j")))
    out = out.select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), (F.col("value") * w).alias("wv"), w.alias("w"))
    near = out.groupBy("row", "col").agg((F.sum("wv") / F.sum("w")).alias("value"))
    return grid.select("row", "col").join(near, ["row", "col"])


def nearby_maximum(grid: DataFrame, radius: int = 2) -> DataFrame:
    return spread(grid, radius, True).groupBy("row", "col").agg(F.max("value").alias("value"))


def fill_isolated_gaps(grid: DataFrame, rows: int, cols: int, least: int = 5) -> DataFrame:
    """Empty inner cells with at least five neighbours take their upper median."""
    near = spread(grid).filter(F.col("row").between(1, rows - 2) & F.col("col").between(1, cols - 2))
    near = near.groupBy("row", "col").agg(F.sort_array(F.collect_list("value")).alias("v")).filter(F.size("v") >= least)  # 8 values at most
    holes = near.join(grid.select("row", "col"), ["row", "col"], "left_anti")
    return grid.select("row", "col", "value").unionByName(holes.select("row", "col", F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("value")))


def plane_roughness(grid: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """RMS distance of each cell's 3 by 3 from its plane; up to two low cells are left out; null for less than six cells.

    Of cells that lie equally low the first in row order goes. The nine heights
    are columns; planes are solved for a batch of cells at once.
    """
    near = grid.withColumnRenamed("value", "nv").withColumn("o", _offsets(1, True))
    near = near.select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), (4 - F.col("o.i") * 3 - F.col("o.j")).alias("k"), "nv")
    near = near.groupBy("row", "col").agg(*(F.max(F.when(F.col("k") == k, F.col("nv"))).alias(f"v{k}") for k in range(9)))
    near = grid.select("row", "col").join(near, ["row", "col"])

    @F.pandas_udf("double")
    def fit(*v: pd.Series) -> pd.Series:
        return pd.Series(_roughness(np.stack([x.to_numpy(float) for x in v], -1), tolerance))

    return near.select("row", "col", fit(*(f"v{k}" for k in range(9))).alias("value")).select("row", "col", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


def _roughness(v: np.ndarray, tolerance: float) -> np.ndarray:
    """For rows of nine heights in row order, NaN where there is none."""
    i, j = np.repeat([-1.0, 0.0, 1.0], 3), np.tile([-1.0, 0.0, 1.0], 3)
    use = ~np.isnan(v)
    v = np.where(use, v, 0.0)
    for turn in range(3):
        n = np.maximum(use.sum(1), 1)[:, None]
        mean = lambda x: (use * x).sum(1, keepdims=True) / n  # noqa: B023, E731
        a, b, h = use * (i - mean(i)), use * (j - mean(j)), use * (v - mean(v))
        aa, ab, bb, ah, bh = ((p * q).sum(1) for p, q in ((a, a), (a, b), (b, b), (a, h), (b, h)))
        det = aa * bb - ab * ab
        told = np.abs(det) > 1e-9
        safe = np.where(told, det, 1.0)
        # Divided last, as the SQL does: residuals of exactly the tolerance occur, and the last bit decides on them.
        kr, kc = ah * bb - bh * ab, bh * aa - ah * ab
        res = h - np.where(told[:, None], (a * kr[:, None] + b * kc[:, None]) / safe[:, None], 0.0)
        if turn < 2:
            low = np.where(use, np.round(res, 9), np.inf).argmin(1)
            go = (use.sum(1) > 6) & (res[np.arange(len(v)), low] < -tolerance)
            use = use & ~(go[:, None] & (np.arange(9) == low[:, None]))
    return np.where(use.sum(1) >= 6, np.sqrt((use * res * res).sum(1) / np.maximum(use.sum(1), 1)), np.nan)


def dense_array(grid: pd.DataFrame, rows: int, cols: int, limit: int = MAX_DENSE_CELLS) -> np.ndarray:
    """A numpy array with NaN for empty cells; only for grids whose size has been checked."""
    if rows * cols > limit:
        raise ValueError(f"{rows} x {cols} cells are more than {limit}")
    out = np.full((rows, cols), np.nan)
    out[grid["row"].to_numpy(), grid["col"].to_numpy()] = grid["value"].to_numpy()
    return out


def _sliding(a: np.ndarray, r: int, op) -> np.ndarray:
    """Running extreme of r cells either side along the last axis, in two passes over blocks."""
    n = a.shape[-1]
    w = 2 * r + 1
    fill = np.inf if op is np.minimum else -np.inf
    m = -(-(n + 2 * r) // w) * w
    p = np.full((*a.shape[:-1], m), fill)
    p[..., r : r + n] = a
    blocks = p.reshape(*a.shape[:-1], m // w, w)
    left = op.accumulate(blocks, axis=-1).reshape(p.shape)
    right = op.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(p.shape)
    return op(right[..., :n], left[..., w - 1 : w - 1 + n])


def _open_line(a: np.ndarray, r: int) -> np.ndarray:
    """Opening along the last axis; beyond the ends the surface goes on with the slope it has over the reach of the window."""
    n = a.shape[-1]
    if n < 2:
        return a
    reach = min(r, n - 1)
    k = np.arange(1, r + 1)
    lead = (a[..., :1] - a[..., reach : reach + 1]) / reach
    trail = (a[..., -1:] - a[..., n - 1 - reach : n - reach]) / reach
    padded = np.concatenate([a[..., :1] + lead * k[::-1], a, a[..., -1:] + trail * k], -1)
    return padded


def open_extrapolated(a: np.ndarray, radius: int) -> np.ndarray:
    """Square opening of a dense array whose edges go on with their slope; never above the input."""
    p = _open_line(a, radius)
    p = np.swapaxes(_open_line(np.swapaxes(p, 0, 1), radius), 0, 1)
    for op in (np.minimum, np.maximum):
        p = _sliding(p, radius, op)
        p = np.swapaxes(_sliding(np.swapaxes(p, 0, 1), radius, op), 0, 1)
    r, (h, w) = radius, a.shape
    return np.minimum(p[r : r + h, r : r + w] if a.shape[0] > 1 and a.shape[1] > 1 else p[-h:, -w:], a)
