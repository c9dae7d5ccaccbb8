"""Scans kept as tiles: columns of the plan in folders of their own, a manifest of boxes and counts, and thinner tiers of every tile.

Readers ask the manifest, one row a tile and tier, and open only the folders of the
tiles they need, so neither listing nor scanning grows with the rest of the store.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import settled, shuffled_by_rows
from .measure import tiles_under_cursor
from .tables import tile_size, tiles, voxel_downsample

#: Points that a tile holds about; rows of the largest file.
PER_TILE, PER_FILE = 100_000, 4_000_000
#: A reader names the folders of up to so many tiles one by one; beyond, the manifest is joined and Spark prunes folders itself.
NAMED_TILES = 10_000
#: Thinning: share of points that a tier keeps of the one above, growth of the voxel between attempts, attempts, those tried in one pass.
FRACTION, GROWTH, ATTEMPTS, AT_ONCE = 0.25, 1.35, 24, 4
#: Voxels, one for each point and size tried, that a task tells apart at most about.
TASK_VOXELS = 1_000_000
_BOX = [f"{side}_{c}" for side in ("min", "max") for c in "xyz"]
_TILE = ["grid_x", "grid_z"]


def tile_id() -> Column:
    return F.concat_ws("-", F.lit("tile"), F.col("grid_x").cast("string"), F.col("grid_z").cast("string"))


def tile_boxes(points: DataFrame, *more: str) -> DataFrame:
    """grid_x, grid_z, tile (its name), n and min_x .. max_z of the points of each tile (of each tile and ``more``)."""
    out = points.groupBy(*_TILE, *more).agg(F.count("*").alias("n"), *(f(c).alias(f"{side}_{c}") for side, f in (("min", F.min), ("max", F.max)) for c in "xyz"))
    return out.withColumn("tile", tile_id())


def spacing() -> Column:
    """Typical distance of a row's n points over the plan of its box."""
    return G.point_spacing((F.col("max_x") - F.col("min_x")) * (F.col("max_z") - F.col("min_z")), F.col("n"))


def thinned(points: DataFrame, boxes: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """The next tier of every tile: points, with voxel, of the largest voxels tried, or the first that keep at most ``fraction`` of the tile's points.

    boxes: grid_x, grid_z, n, their box and the voxel of ``points`` (0 for a scan). A tile's first
    voxel is a step wider than its points' spacing, each other one a step wider than that before, up to ATTEMPTS;
    AT_ONCE of them are counted in one pass, and only tiles that need more take part in the next. Points are counted and averaged by voxel, so no
    tile is gathered anywhere.
    """
    steps = F.greatest(F.col("voxel"), spacing()) * F.lit(GROWTH)
    target = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fraction)))
    asked = settled(boxes.select(*_TILE, steps.alias("first"), target.alias("target"), *(F.col(f"min_{c}").alias(f"o{c}") for c in "xyz")))
    left, found = asked, None
    for start in range(0, ATTEMPTS + 1, AT_ONCE):
        upto = min(start + AT_ONCE, ATTEMPTS + 1)
        tried = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("first") * F.lit(GROWTH**k)).alias("v")) for k in range(start, upto))))
        keys = [F.floor((F.col(c) - F.col(f"o{c}")) / F.col("t.v")).cast("int").alias(f"v{c}") for c in "xyz"]
        held = points.join(left, _TILE).withColumn("t", tried).select(*_TILE, "target", "t.k", "t.v", *keys).distinct().groupBy(*_TILE, "target", "k", "v").agg(F.count("*").alias("kept"))
        fits = (F.col("kept") <= F.col("target")) | (F.col("kept") <= 1) | (F.col("k") == ATTEMPTS)
        got = settled(held.filter(fits).groupBy(*_TILE).agg(F.min("v").alias("voxel")))
        found = got if found is None else found.unionByName(got)
        left = settled(left.join(got, _TILE, "left_anti"))
        if not left.limit(1).count():
            break
    voxels = asked.join(found, _TILE).select(*_TILE, F.col("voxel").alias("_voxel"), *(F.col(f"o{c}").alias(f"_o{c}") for c in "xyz"))
    own = points.join(voxels, _TILE)
    out = voxel_downsample(own, F.col("_voxel"), origin=tuple(F.col(f"_o{c}") for c in "xyz"), by=(*_TILE, "_voxel"))
    return out.drop("vx", "vy", "vz", "n").withColumnRenamed("_voxel", "voxel")


@dataclass(frozen=True)
class TileStore:
    """A store on any filesystem that Spark writes: ``tier=k/grid_x=i/grid_z=j`` and ``manifest`` below ``path``."""

    spark: SparkSession
    path: str

    @property
    def manifest(self) -> DataFrame:
        """tile, grid_x, grid_z, tier (0: the scan itself), n, voxel, spacing (of n points over the tile) and the tile's box min_x .. max_z."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def points(self, where: DataFrame | None = None, tier: int = 0) -> DataFrame:
        """Points of one tier, of all tiles or of those that ``where`` (grid_x, grid_z) lists; only their folders are read."""
        at = f"{self.path}/tier={tier}"
        read = self.spark.read.option("basePath", at).schema(self._schema(tier))
        if where is None:
            return read.parquet(at)
        wanted = where.select(*_TILE).distinct()
        named = wanted.limit(NAMED_TILES + 1).collect()
        if len(named) > NAMED_TILES:
            return read.parquet(at).join(F.broadcast(wanted) if wanted.count() <= 1_000_000 else wanted, _TILE, "left_semi")
        folders = [f"{at}/grid_x={x}/grid_z={z}" for x, z in named]
        return read.parquet(*folders) if folders else self.spark.createDataFrame([], self._schema(tier))

    def _schema(self, tier: int):
        from pyspark.sql.types import StructType

        text = self.spark.read.text(f"{self.path}/schema").filter(F.col("value").startswith(f"{tier} ")).first()[0]
        return StructType.fromJson(json.loads(text.split(" ", 1)[1]))

    def under_cursor(self, matrix: list[float], x: float, y: float, width: float, height: float, reach: float = 6.0, tier: int = 0) -> DataFrame:
        """Points of the tiles that may hold the one under a cursor."""
        return self.points(tiles_under_cursor(self.manifest.filter(F.col("tier") == tier), matrix, x, y, width, height, reach), tier)

    def within(self, min_x: float, min_z: float, max_x: float, max_z: float, tier: int = 0) -> DataFrame:
        """Points of a rectangle of the plan, edges included."""
        box = (F.col("max_x") >= min_x) & (F.col("min_x") <= max_x) & (F.col("max_z") >= min_z) & (F.col("min_z") <= max_z)
        found = self.points(self.manifest.filter((F.col("tier") == 0) & box), tier)
        return found.filter(F.col("x").between(min_x, max_x) & F.col("z").between(min_z, max_z))

    def chosen(self, tiers: DataFrame) -> DataFrame:
        """Points of each tile's chosen tier (tile, tier), as the selections by budget, distance and screen give it, with ``tier``.

        Tiers of a thinner scan lack what only a single point has, such as pid: null.
        """
        own = self.manifest.select("tile", "tier", *_TILE).join(tiers.select("tile", "tier"), ["tile", "tier"])
        own = settled(own)
        parts = [self.points(own.filter(F.col("tier") == k), k).withColumn("tier", F.lit(k)) for k in sorted(r["tier"] for r in own.select("tier").distinct().collect())]
        if not parts:
            return self.points(own, 0).withColumn("tier", F.lit(0))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out


def write_tiles(points: DataFrame, path: str, tile: float | None = None, per_tile: int = PER_TILE, levels: int = 0, fraction: float = FRACTION) -> TileStore:
    """points as a store of tiles of ``tile`` metres (by default so that one holds about ``per_tile`` points) with ``levels`` thinner tiers.

    Every point is in exactly one tile with all its channels. Partitions are
    balanced: small tiles share a task, a tile with many points is dealt over
    several. Each tier is written and read again before the next is made of it. No points give a store without tiles.
    """
    spark = points.sparkSession
    ext = points.agg(F.count("*"), F.min("x"), F.min("z"), F.max("x"), F.max("z")).first()
    n, x0, z0, x1, z1 = (ext[0], *(v or 0.0 for v in ext[1:]))
    span = max(x1 - x0, z1 - z0)
    # As few tiles as fit a scan that needs only one.
    edge = tile or tile_size(n, span, per_tile) or max(span, 1.0)
    if not edge > 0 or not math.isfinite(edge):
        raise ValueError("tile must be a positive number")
    own, voxel = tiles(points, edge, x0, z0, x1 - x0, z1 - z0), F.lit(0.0)
    store, rows, schemas, boxes = TileStore(spark, path), [], [], None
    with shuffled_by_rows(spark, n * AT_ONCE, TASK_VOXELS):
        for tier in range(levels + 1):
            if tier:
                # The box and spacing of what is thinned, which is smaller than the tile.
                above = tile_boxes(store.points(tier=tier - 1)).join(rows[-1].select(*_TILE, "voxel"), _TILE)
                made = thinned(store.points(tier=tier - 1), settled(above), fraction)
                made = made.withColumn("_voxel", F.col("voxel")).drop("voxel").withColumnRenamed("_voxel", "voxel")
            else:
                made = own.withColumn("voxel", voxel)
            data = made.hint("rebalance", *_TILE)
            data.write.mode("overwrite").option("maxRecordsPerFile", PER_FILE).partitionBy(*_TILE).parquet(f"{path}/tier={tier}")
            schema = made.select(*(c for c in made.columns if c not in _TILE), *_TILE).schema
            schemas.append((f"{tier} {schema.json()}",))
            spark.createDataFrame(schemas, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
            counts = store.points(tier=tier).groupBy(*_TILE).agg(F.count("*").alias("n"), F.max("voxel").alias("voxel"))
            if boxes is None:
                boxes = settled(tile_boxes(store.points()).drop("n"))
            rows.append(settled(counts.join(boxes, _TILE).withColumn("tier", F.lit(tier)).withColumn("spacing", spacing())))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    out.select("tile", *_TILE, "tier", "n", "voxel", "spacing", *_BOX).write.mode("overwrite").parquet(f"{path}/manifest")
    return store
