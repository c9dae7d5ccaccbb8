"""Tree crowns: treetops of a canopy height model and the flood that divides the canopy among them.

The flood takes the highest cell on its front, and the crown that reaches a cell
first has it. Its order is told by a key that each cell carries, so tiles are
flooded apart, each with what reaches it over its border, and again while that
changes. The result is that of one flood over the whole grid.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from .raster import on_tiles

#: Cells along a tile of the flood, and of the search for treetops.
TILE, TOP_TILE = 256, 1_024
_WHOLE = 1 << 30


def top_window(height: np.ndarray | float):
    """Radius in which a treetop of that height has nothing higher."""
    return np.clip(0.5 + 0.2 * height, 1.0, 5.0)


def crown_reach(height: float) -> float:
    """The widest crown radius of a tree of that height."""
    return min(12.0, max(1.5, 1 + 0.3 * height))


def treetops(canopy: DataFrame, cell: float, tile: int = TOP_TILE) -> DataFrame:
    """row, col, value of the highest canopy cells within their window (wider for taller trees); the first cell in row order wins a tie."""
    widest = max(1, math.floor(5.0 / cell + 0.5))
    offsets = sorted(((i, j) for i in range(-widest, widest + 1) for j in range(-widest, widest + 1) if 0 < i * i + j * j <= widest * widest), key=lambda o: o[0] ** 2 + o[1] ** 2)

    def tops(a: np.ndarray, _r: int, _c: int) -> np.ndarray:
        p = np.pad(a, widest, constant_values=np.nan)
        r, c = np.nonzero(~np.isnan(a))
        v = a[r, c]
        reach = np.maximum(1, np.floor(top_window(v) / cell + 0.5))
        for i, j in offsets:
            other = p[r + widest + i, c + widest + j]
            # Beyond a cell's own window it has no rival; before it in row order, an equal one is enough.
            beaten = (other >= v if (i, j) < (0, 0) else other > v) & (i * i + j * j <= reach * reach)
            r, c, v, reach = r[~beaten], c[~beaten], v[~beaten], reach[~beaten]
        out = np.full(a.shape, np.nan)
        out[r, c] = v
        return out

    return on_tiles(canopy, _WHOLE, _WHOLE, widest, tops, tile)


def _key_after(key: tuple, step: tuple) -> tuple:
    """The key of a cell claimed from one with ``key``: the lows of its way that nothing lower follows, then itself.

    The flood takes cells in ascending order of their keys: a way with a higher
    lowest cell is followed first, ways over the same lowest cell are told apart by
    what comes behind it.
    """
    n = len(key)
    while n and key[n - 1] < step:
        n -= 1
    return (*key[:n], step)


def flood_tile(height: dict, tops: list, events: list, cell: float, min_height: float, crown_share: float) -> tuple[dict, dict]:
    """Cells' owners and keys, of {(row, col): height}, treetops (row, col, height) and events (key, top) from beyond the border.

    A key is a tuple of (-height, row, col), so ties of height go to the first cell in row order.
    """
    owner = {(r, c): (r, c, v) for r, c, v in tops}
    keys = {(r, c): ((-v, r, c),) for r, c, v in tops}
    heap = [(keys[at], top) for at, top in owner.items()] + events
    heapq.heapify(heap)
    limits: dict[tuple, tuple[float, float, float]] = {}
    while heap:
        key, top = heapq.heappop(heap)
        if top not in limits:
            limits[top] = max(min_height, crown_share * top[2]), top[2] + 0.5, (crown_reach(top[2]) / cell) ** 2
        floor, ceiling, reach = limits[top]
        _, r, c = key[-1]
        for n in ((r - 1, c - 1), (r - 1, c), (r - 1, c + 1), (r, c - 1), (r, c + 1), (r + 1, c - 1), (r + 1, c), (r + 1, c + 1)):
            v = height.get(n)
            if v is None or n in owner or not floor <= v <= ceiling or (n[0] - top[0]) ** 2 + (n[1] - top[1]) ** 2 > reach:
                continue
            owner[n] = top
            keys[n] = _key_after(key, (-v, *n))
            heapq.heappush(heap, (keys[n], top))
    return owner, keys


_OWNED = "tr int, tc int, row int, col int, top_row int, top_col int, top double, way array<double>"


def segment_crowns(canopy: DataFrame, cell: float, cols: int, min_height: float = 2.0, tree_height: float = 2.5, crown_share: float = 0.35, tile: int = TILE) -> DataFrame:
    """row, col, crown (first cell of its top as a number), top (its height) of the canopy cells that a crown reaches.

    A crown spreads over canopy cells that touch it, not below ``crown_share`` of its
    top or ``min_height``, not half a metre above its top, not beyond its reach. A
    cell belongs to the crown that reaches it first in a flood that takes the
    highest cell of its front, ties to the first cell in row order. No canopy gives
    no rows. The outermost cells of a tile tell the tiles beside it who owns them and
    when; a tile is flooded again where that has changed, so only tiles with
    contested borders take part in later rounds.
    """
    t = lambda c: F.floor(F.col(c) / tile).cast("int")
    top = treetops(canopy, cell).filter(F.col("value") >= tree_height).select("row", "col", F.lit(True).alias("is_top"))
    cells = settled(canopy.select("row", "col", "value").join(top, ["row", "col"], "left").withColumns({"tr": t("row"), "tc": t("col")}))
    own = ["tr", "tc"]
    tiles = settled(cells.select(*own).distinct())

    def flood(pdf: pd.DataFrame, beyond: pd.DataFrame | None) -> pd.DataFrame:
        names = ["tr", "tc", "row", "col", "top_row", "top_col", "top", "way"]
        if not len(pdf):
            return pd.DataFrame(columns=names)
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        rc = list(zip(pdf["row"].tolist(), pdf["col"].tolist(), strict=True))
        tops = [(*at, v) for at, v, top in zip(rc, pdf["value"].tolist(), pdf["is_top"].tolist(), strict=True) if top is True]
        events = []
        if beyond is not None:
            for way, *top in zip(beyond["way"], beyond["top_row"].tolist(), beyond["top_col"].tolist(), beyond["top"].tolist(), strict=True):
                events.append((tuple((h, int(r), int(c)) for h, r, c in np.reshape(way, (-1, 3)).tolist()), tuple(top)))
        owner, keys = flood_tile(dict(zip(rc, pdf["value"].tolist(), strict=True)), tops, events, cell, min_height, crown_share)
        edge = (0, tile - 1)
        out = [(tr, tc, r, c, *by, [float(x) for step in keys[r, c] for x in step] if r % tile in edge or c % tile in edge else None) for (r, c), by in owner.items()]
        return pd.DataFrame(out, columns=names)

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        return flood(pdf, None)

    def again(pdf: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
        return flood(pdf, beyond)

    owned = [settled(cells.groupBy(*own).applyInPandas(alone, _OWNED))]
    last = tiles.withColumn("round", F.lit(0))
    border = settled(owned[0].filter("way IS NOT NULL"))
    around = F.array(*(F.struct(F.floor((F.col("row") + i) / tile).cast("int").alias("tr"), F.floor((F.col("col") + j) / tile).cast("int").alias("tc")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    told, empty = None, tiles.limit(0).select(*own, F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("decimal(38,0)").alias("s"))
    while True:
        beyond = border.withColumn("at", F.explode(F.array_distinct(around))).filter((F.col("at.tr") != F.col("tr")) | (F.col("at.tc") != F.col("tc")))
        beyond = settled(beyond.select("at.tr", "at.tc", "top_row", "top_col", "top", "way").join(tiles, own, "left_semi"))
        now = settled(beyond.groupBy(*own).agg(F.count("*").alias("n"), F.sum(F.xxhash64("top_row", "top_col", "way").cast("decimal(38,0)")).alias("s")))
        before = (empty if told is None else told).withColumnsRenamed({"n": "n0", "s": "s0"})
        changed = now.join(before, own, "full").filter(~(F.col("n").eqNullSafe(F.col("n0")) & F.col("s").eqNullSafe(F.col("s0")))).select(*own)
        changed = settled(changed)
        if not changed.limit(1).count():
            break
        told = now
        flooded = cells.join(changed, own, "left_semi").groupBy(*own).cogroup(beyond.join(changed, own, "left_semi").groupBy(*own)).applyInPandas(again, _OWNED)
        owned.append(settled(flooded))
        last = settled(last.join(changed, own, "left_anti").unionByName(changed.withColumn("round", F.lit(len(owned) - 1))))
        border = settled(border.join(changed, own, "left_anti").unionByName(owned[-1].filter("way IS NOT NULL")))
    out = owned[0].withColumn("round", F.lit(0))
    for k, part in enumerate(owned[1:], 1):
        out = out.unionByName(part.withColumn("round", F.lit(k)))
    if len(owned) > 1:
        out = out.join(last, [*own, "round"], "left_semi")
    return out.select("row", "col", (F.col("top_row").cast("bigint") * cols + F.col("top_col")).alias("crown"), "top")
