"""Relational operators over the points table: bounds, histograms, filters, thinning, voxels, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import settled


def bounds(points: DataFrame) -> DataFrame:
    """One row: point count, extent, centre, size and diagonal."""
    out = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in "xyz" for k, f in (("min", F.min), ("max", F.max))))
    size = {c: F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"}
    return out.select(
        "*", *((F.col(f"min_{c}") + F.col(f"max_{c}")).alias(f"sum_{c}") for c in "xyz"),
        *(size[c].alias(f"size_{c}") for c in "xyz"), F.sqrt(size["x"] * size["x"] + size["y"] * size["y"] + size["z"] * size["z"]).alias("diagonal"),
    ).select("n", *(f"{k}_{c}" for k in ("min", "max") for c in "xyz"), *((F.col(f"sum_{c}") / 2).alias(f"center_{c}") for c in "xyz"), *(f"size_{c}" for c in "xyz"), "diagonal")


def choose_origin(points: DataFrame) -> DataFrame:
    b = bounds(points)
    return b.select(*(G.origin_coordinate(F.col(f"min_{c}"), F.col(f"max_{c}")).alias(f"origin_{c}") for c in "xyz"))


def thin_every(points: DataFrame, keep_every: int, index: str = "pid") -> DataFrame:
    if keep_every < 1:
        raise ValueError("keep_every must be at least 1")
    return points.filter(F.col(index) % keep_every == 0)


def trim_to(points: DataFrame, target: int, count: int, index: str = "pid") -> DataFrame:
    """Even trimming of a dense index to exactly ``target`` of ``count`` points."""
    i = F.col(index)
    return points.filter(F.floor((i + 1) * target / count) != F.floor(i * target / count))


def class_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("classification").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "classification")


def class_summary(points: DataFrame) -> DataFrame:
    """Per class its name, count and share in percent (3 decimals), largest first."""
    h = points.groupBy("classification").agg(F.count("*").alias("n"))
    total = points.agg(F.count("*").alias("total"))
    out = h.crossJoin(F.broadcast(total))  # one row
    share = G.js_round(F.col("n") * F.lit(100.0) / F.col("total"), 3)
    return out.select("classification", G.class_name(F.col("classification")).alias("name"), "n", share.alias("share")).orderBy(F.desc("n"), "classification")


def flight_line_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("point_source_id").agg(F.count("*").alias("n")).orderBy("point_source_id")


def without_noise(points: DataFrame) -> DataFrame:
    """Points that are no noise; a scan without classes stays as it is."""
    return points if "classification" not in points.columns else points.filter(~G.is_noise(F.col("classification")))


def first_returns(points: DataFrame) -> DataFrame:
    return points if "return_number" not in points.columns else points.filter(F.coalesce(F.col("return_number") <= 1, F.lit(True)))


def object_candidates(points: DataFrame, min_height: float = 2.0) -> DataFrame:
    return points.filter((F.col("height_above_ground") >= min_height) & F.col("classification").isin(0, 1, 3, 4, 5, 6))


def returns_summary(points: DataFrame) -> DataFrame:
    one = F.sum((F.col("number_of_returns") <= 1).cast("long"))
    return points.agg(F.round(one / F.count("*"), 6).alias("single_share"), F.max("number_of_returns").alias("max_returns"))


def noise_share(points: DataFrame) -> DataFrame:
    n = F.sum(G.is_noise(F.col("classification")).cast("long"))
    return points.agg(n.alias("noise"), F.count("*").alias("n"), F.round(n / F.count("*"), 6).alias("share"))


def describe_point(points: DataFrame, pid: int, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    own = points.filter(F.col("pid") == pid)
    extra = [F.nullif(F.col("object_id"), F.lit(0)).alias("object_id")] if "object_id" in points.columns else []
    return own.select("pid", *G.map_coordinates(F.col("x"), F.col("y"), F.col("z"), origin), G.class_name(F.col("classification")).alias("class_name"), "return_number", "number_of_returns", "point_source_id", *extra)


def voxel_downsample(
    points: DataFrame, voxel: float | Column, means: list[str] | None = None, votes: list[str] | None = None,
    origin: tuple | None = None, by: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each voxel: means of continuous channels, rounded mean colours, majority votes of categorical ones.

    A vote is won by the most frequent value, the lowest on a tie. Votes are
    aggregated by (voxel, value), so no voxel's points are ever gathered. ``voxel``
    and ``origin`` may be columns, which are constant within the groups ``by``.
    """
    if not isinstance(voxel, Column) and voxel <= 0:
        raise ValueError("voxel must be positive")
    if origin is None:
        low = points.agg(F.min("x"), F.min("y"), F.min("z")).first()
        origin = (low[0], low[1], low[2])
    means = [c for c in (["intensity", "height_above_ground"] if means is None else means) if c in points.columns]
    votes = [c for c in (["classification", "return_number", "number_of_returns", "object_id", "point_source_id"] if votes is None else votes) if c in points.columns]
    number = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    keys = ["vx", "vy", "vz"]
    keyed = points.withColumns({k: F.floor((F.col(c) - number(o)) / number(voxel)).cast("int") for k, c, o in zip(keys, "xyz", origin, strict=True)})
    keys = [*by, *keys]
    colours = [c for c in "rgb" if c in points.columns]
    out = keyed.groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.avg(c).alias(c) for c in (*"xyz", *means)),
        *(F.floor(F.avg(c) + F.lit(0.5)).cast("int").alias(c) for c in colours),
    )
    if votes:
        # All votes in one pass: each point casts one vote in each of the polls, counted by (voxel, poll, value).
        cast = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("bigint").alias("v")) for k, c in enumerate(votes))))
        polls = keyed.select(*keys, cast.alias("p")).filter(F.col("p.v").isNotNull()).groupBy(*keys, F.col("p.k").alias("k"), F.col("p.v").alias("v")).agg(F.count("*").alias("c"))
        best = lambda k: F.max(F.when(F.col("k") == k, F.struct(F.col("c"), (-F.col("v")).alias("m"))))
        won = polls.groupBy(*keys).agg(*(best(k).alias(f"w{k}") for k in range(len(votes))))
        out = out.join(won.select(*keys, *((-F.col(f"w{k}.m")).cast(points.schema[c].dataType).alias(c) for k, c in enumerate(votes))), keys, "left")
    return out


def voxel_thin(points: DataFrame, voxel: float, unit: int = 4096, origin: tuple[float, float, float] | None = None) -> DataFrame:
    """One row for each voxel: n, mean place and mean colour, by sums of whole units of 1/4096 of a voxel.

    Whole numbers add up the same in any order, so the result is exact however the
    points are dealt; halves go to the even unit.
    """
    if voxel <= 0:
        raise ValueError("voxel must be positive")
    low = origin or tuple(points.agg(F.min("x"), F.min("y"), F.min("z")).first())
    keys = ["vx", "vy", "vz"]
    at = {c: (F.col(c) - F.lit(float(o))) / F.lit(float(voxel)) for c, o in zip("xyz", low, strict=True)}
    keyed = points.withColumns({k: F.floor(at[c]).cast("bigint") for k, c in zip(keys, "xyz", strict=True)} | {f"_{c}": F.least(F.rint((at[c] - F.floor(at[c])) * unit), F.lit(unit - 1.0)).cast("bigint") for c in "xyz"})
    colours = [c for c in "rgb" if c in points.columns]
    out = keyed.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(f"_{c}").alias(c) for c in "xyz"), *(F.sum(F.col(c).cast("bigint")).alias(c) for c in colours))
    place = [((F.col(k) + F.col(c) / (F.col("n") * unit)) * F.lit(float(voxel)) + F.lit(float(o))).alias(c) for k, c, o in zip(keys, "xyz", low, strict=True)]
    return out.select(*keys, "n", *place, *(F.rint(F.col(c) / F.col("n")).cast("int").alias(c) for c in colours))


def tile_size(n: int, span: float, per_tile: int = 100_000) -> float | None:
    """Edge of a tile; None where one tile is enough."""
    import math

    per_axis = math.ceil(math.sqrt(n / per_tile))
    return None if per_axis < 2 else span / per_axis


def tiles(points: DataFrame, tile: float, min_x: float, min_z: float, size_x: float, size_z: float) -> DataFrame:
    """points with grid_x, grid_z; every point has one tile, the outer ones take what lies on the far edge."""
    import math

    nx, nz = max(1, math.ceil(size_x / tile)), max(1, math.ceil(size_z / tile))
    return points.withColumns({"grid_x": G.cell_index(F.col("x"), min_x, tile, nx), "grid_z": G.cell_index(F.col("z"), min_z, tile, nz)})


def upper_percentile(values: DataFrame, column: str, fraction: float) -> DataFrame:
    """The value at floor(f * (m - 1)) of all m values in ascending order.

    From a histogram: range partitions of the distinct values are summed apart,
    and only partition totals meet in one place.
    """
    h = settled(values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c")).repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    run = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = h.groupBy("p").agg(F.sum("c").alias("s")).select("p", F.coalesce(F.sum("s").over(run), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("m"))
    upto = F.sum("c").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    ranked = h.join(F.broadcast(sizes), "p").withColumn("upto", upto)
    at = F.floor(F.lit(fraction) * (F.col("m") - 1))
    return ranked.filter((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(F.col("v").alias("value"))


def pick_sorted(values: Column, index: Column) -> Column:
    """The value at a 0-based index of an array in ascending order."""
    return F.get(F.sort_array(values), index.cast("int"))


def visible(points: DataFrame, noise: str = "shown", hidden_lines: DataFrame | None = None) -> DataFrame:
    """What a view shows: noise shown, hidden or alone, without the flight lines listed (point_source_id)."""
    if noise not in ("shown", "hidden", "only"):
        raise ValueError("noise is 'shown', 'hidden' or 'only'")
    flag = G.is_noise(F.col("classification"))
    out = points if noise == "shown" else points.filter(flag if noise == "only" else ~flag)
    return out if hidden_lines is None else out.join(hidden_lines.select("point_source_id").distinct(), "point_source_id", "left_anti")


def lod_usage(chosen: DataFrame) -> DataFrame:
    """Per tier its tiles, points and spacing weighted by points; chosen: tile, tier, n, spacing."""
    return chosen.groupBy("tier").agg(F.count("*").alias("tiles"), F.sum("n").alias("points"), (F.sum(F.col("spacing") * F.col("n")) / F.sum("n")).alias("spacing"))


def ground_errors(points: DataFrame) -> DataFrame:
    """Error rates of classes against ``truth``: type I (ground not found), type II (other taken for ground), total, and noise recall."""
    is_ground, found = F.col("truth") == 2, F.col("classification") == 2
    rate = lambda bad, of: F.round(F.sum((bad & of).cast("long")) / F.sum(of.cast("long")), 6)
    return points.agg(
        rate(~found, is_ground).alias("type_1"), rate(found, ~is_ground).alias("type_2"), rate(found != is_ground, F.lit(True)).alias("total"),
        rate(G.is_noise(F.col("classification")), G.is_noise(F.col("truth"))).alias("noise_recall"),
    )
