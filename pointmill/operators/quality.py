"""Survey quality: density, coverage, precision, strips, checkpoints, verdicts.

Grids are keyed tables (row, col, value) with absent rows for empty cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import settled
from .components import gap_sizes
from .tables import class_summary, noise_share, returns_summary, without_noise

#: Level, least density, most vertical error, precision and overlap offset (fixed values of the quality levels).
LEVELS = [("QL0", 8.0, 0.05, 0.04, 0.04), ("QL1", 8.0, 0.10, 0.06, 0.08), ("QL2", 2.0, 0.10, 0.06, 0.08), ("QL3", 0.5, 0.20, 0.12, 0.16)]
ACCEPTED = LEVELS[2]


@dataclass(frozen=True)
class Frame:
    """Extent of a grid, known before a plan is made."""

    min_x: float
    min_z: float
    cell: float
    cols: int
    rows: int

    @staticmethod
    def of(points: DataFrame, cell: float = 1.0, max_cells: int | None = None) -> Frame:
        if cell <= 0:
            raise ValueError("the cell size must be positive")
        b = points.agg(F.min("x"), F.min("z"), F.max("x"), F.max("z")).first()
        if b[0] is None:
            return Frame(0.0, 0.0, cell, 0, 0)
        w, h = b[2] - b[0], b[3] - b[1]
        if max_cells and G.grid_size(w, cell) * G.grid_size(h, cell) > max_cells:
            cell = max(cell, (w * h / max_cells) ** 0.5)
            while G.grid_size(w, cell) * G.grid_size(h, cell) > max_cells:
                cell *= 1.05
        return Frame(b[0], b[1], cell, G.grid_size(w, cell), G.grid_size(h, cell))


def with_cells(points: DataFrame, frame: Frame) -> DataFrame:
    return points.withColumns({"row": G.cell_index(F.col("z"), frame.min_z, frame.cell, frame.rows), "col": G.cell_index(F.col("x"), frame.min_x, frame.cell, frame.cols)})


def survey_sums(points: DataFrame, frame: Frame) -> DataFrame:
    """Counts and sums by cell and strip, without noise, which add up over parts of a scan: n, first returns, and k, s, ss of single returns (o) and of ground (g)."""
    own = with_cells(without_noise(points), frame)
    one = lambda c: F.sum(c.cast("long"))
    first = F.coalesce(F.col("return_number") <= 1, F.lit(True)) if "return_number" in own.columns else F.lit(True)
    single = F.coalesce(F.col("number_of_returns") <= 1, F.lit(True)) if "number_of_returns" in own.columns else F.lit(True)
    hard = {"o": single} | ({"g": F.col("classification") == 2} if "classification" in own.columns else {})
    if "point_source_id" not in own.columns:
        own = own.withColumn("point_source_id", F.lit(0))
    sums = [F.count("*").alias("n"), one(first).alias("first")]
    for k, at in hard.items():
        sums += [one(at).alias(f"{k}k"), F.sum(F.when(at, F.col("y"))).alias(f"{k}s"), F.sum(F.when(at, F.col("y") * F.col("y"))).alias(f"{k}ss")]
    return own.groupBy("row", "col", "point_source_id").agg(*sums)


def survey_of(sums: DataFrame) -> DataFrame:
    """The cells of :func:`survey_cells` from sums of a whole scan; read more than once."""
    known = "g" if "gk" in sums.columns and sums.filter("gk > 0").limit(1).count() else "o"
    return sums.select("row", "col", "point_source_id", "n", "first", *(F.col(f"{known}{c}").alias(c) for c in ("k", "s", "ss")))


def survey_cells(points: DataFrame, frame: Frame) -> DataFrame:
    """One row for each strip in each cell, without noise: n points, ``first`` returns, and of the hard surface its k points, sum s and squares ss of heights.

    Hard is ground if any point is ground, else single returns, which leaves
    canopy out. Density, coverage, precision and strips are all derived from
    this one aggregate, so a scan is read and shuffled once.
    """
    return survey_of(settled(survey_sums(points, frame)))


def footprint_cells(cells: DataFrame) -> DataFrame:
    """Cells between the first and last occupied one of both their row and their column, with the count of first returns."""
    occupied = cells.groupBy("row", "col").agg(F.sum("first").alias("n"))
    spans = occupied.groupBy("row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    tall = occupied.groupBy("col").agg(F.min("row").alias("r0"), F.max("row").alias("r1"))
    inside = spans.select("row", F.explode(F.sequence("c0", "c1")).alias("col")).join(tall, "col").filter(F.col("row").between(F.col("r0"), F.col("r1")))
    return inside.select("row", "col").join(occupied, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def density(foot: DataFrame, frame: Frame, thinning: tuple[int, int] | None = None) -> DataFrame:
    """One row: first returns per square metre over the footprint: mean, median, 5th percentile, shares of thin cells.

    ``full_median`` and ``spacing`` are those of the file that a thinned scan,
    (loaded, total) points, came from.
    """
    scale = 1.0 if thinning is None else thinning[1] / max(1, thinning[0])
    cells = foot.select((F.col("n") / F.lit(frame.cell * frame.cell)).alias("d"))
    # A histogram of densities: as many rows as there are different counts, however large the scan.
    h = cells.groupBy("d").agg(F.count("*").alias("c"))
    run = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("d", "c", F.sum("c").over(run).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("m"))
    at = lambda f: F.coalesce(F.min(F.when(F.col("upto") > F.least(F.col("m") - 1, F.floor(F.lit(f) * F.col("m"))), F.col("d"))), F.lit(0.0))
    share = lambda t: F.round(F.sum(F.when(F.col("d") < t, F.col("c")).otherwise(0)) / F.max("m"), 6)
    mean = F.sum(F.col("d") * F.col("c")) / F.max("m")
    out = h.agg(
        F.max("m").alias("cells"), mean.alias("mean"), at(0.5).alias("median"), at(0.05).alias("p5"), share(2.0).alias("below_2"), share(8.0).alias("below_8"),
    )
    full = F.lit(1.0) / F.sqrt(F.greatest(F.col("mean") * F.lit(scale), F.lit(1e-6)))
    return out.select("cells", F.round("mean", 6).alias("mean"), "median", "p5", "below_2", "below_8", (F.col("median") * F.lit(scale)).alias("full_median"), F.round(full, 6).alias("spacing"))


def loaded_spacing(foot: DataFrame, frame: Frame) -> float:
    """Spacing of the loaded first returns, by their mean density."""
    mean = foot.agg(F.sum("n") / F.count("*")).first()[0] or 0.0
    return 1.0 / max(mean / (frame.cell * frame.cell), 1e-6) ** 0.5


def coverage(foot: DataFrame, frame: Frame, spacing: float) -> DataFrame:
    """One row: footprint and gaps without a first return; a gap of at least (4 x spacing) squared is a void, cells of the others are scattered."""
    area, least = frame.cell * frame.cell, (4 * spacing) * (4 * spacing)
    gaps = gap_sizes(foot, frame.cols).withColumn("void", F.col("cells") * F.lit(area) >= F.lit(least))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    g = gaps.agg(
        F.count("*").alias("gap_regions"), F.coalesce(F.max("cells"), F.lit(0)).alias("largest"), n(F.col("void").cast("int")).alias("voids"), n(F.when(F.col("void"), F.col("cells"))).alias("void_cells"), n("cells").alias("gap_cells"),
    )
    out = foot.agg(F.count("*").alias("cells")).crossJoin(F.broadcast(g))  # one row each
    return out.select(
        (F.col("cells") * F.lit(area)).alias("footprint_area"), (F.col("gap_cells") * F.lit(area)).alias("gap_area"), F.round(F.col("gap_cells") / F.greatest(F.lit(1), F.col("cells")), 6).alias("gap_share"), "gap_regions",
        (F.col("largest") * F.lit(area)).alias("largest_gap_area"), F.round(F.lit(least), 6).alias("void_threshold"), "voids", (F.col("void_cells") * F.lit(area)).alias("void_area"), (F.col("gap_cells") - F.col("void_cells")).alias("scattered_cells"),
    )


def precision(cells: DataFrame, frame: Frame, spacing: float) -> DataFrame:
    """Detrended spread within level, hard cells of 2 x ceil(spacing), where the strip with most points speaks for a cell; null under 20 cells.

    The larger cells are made of whole cells of the frame.
    """
    per = max(1, round(2 * math.ceil(spacing) / frame.cell))
    size = per * frame.cell
    up = lambda c: F.floor(F.col(c) / per).cast("int").alias(c)
    m = cells.groupBy(up("row"), up("col"), "point_source_id").agg(*(F.sum(c).alias(c) for c in ("k", "s", "ss"))).filter("k >= 4")
    best = m.groupBy("row", "col").agg(F.max(F.struct("k", (-F.col("point_source_id")).alias("t"), "s", "ss")).alias("b"))
    mean = F.col("b.s") / F.col("b.k")
    best = settled(best.select("row", "col", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("b.ss") / F.col("b.k") - mean * mean).alias("var")))
    near = None
    for name, dr, dc in (("w", 0, 1), ("e", 0, -1), ("n", 1, 0), ("s", -1, 0)):
        o = best.select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("mean").alias(name))
        near = (near if near is not None else best).join(o, ["row", "col"])
    gx, gz = (F.col("e") - F.col("w")) / (2 * size), (F.col("s") - F.col("n")) / (2 * size)
    slope2 = gx * gx + gz * gz
    rough = F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("var") - slope2 * size * size / 6)), 6)
    level = (F.round(F.sqrt(slope2), 6) <= 0.05) & (F.round(F.abs(F.col("mean") - (F.col("w") + F.col("e") + F.col("n") + F.col("s")) / 4), 6) <= 0.1)
    h = near.filter(level).select(rough.alias("spread")).groupBy("spread").agg(F.count("*").alias("c"))
    run = Window.orderBy("spread").rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("spread", F.sum("c").over(run).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("m"))
    return h.agg(
        F.lit(float(size)).alias("size"), F.coalesce(F.max("m"), F.lit(0)).cast("bigint").alias("cells"),
        F.min(F.when((F.col("m") >= 20) & (F.col("upto") > F.floor(F.col("m") / 4)), F.col("spread"))).alias("hard"),
        F.min(F.when((F.col("m") >= 20) & (F.col("upto") > F.floor(F.col("m") / 2)), F.col("spread"))).alias("level"),
    )


def strip_offsets(cells: DataFrame, flatness: float = 0.05) -> DataFrame:
    """row, col, a, b, offset: mean height of strip b over strip a in the cells that both cover and whose heights deviate by ``flatness`` at most."""
    mean = F.col("s") / F.col("k")
    flat = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("k") - mean * mean)) <= flatness
    m = cells.filter("k >= 3").filter(flat).select("row", "col", "point_source_id", mean.alias("mean"))
    a, b = (m.select("row", "col", F.col("point_source_id").alias(k), F.col("mean").alias(f"m{k}")) for k in "ab")
    return a.join(b, ["row", "col"]).filter("a < b").select("row", "col", "a", "b", (F.col("mb") - F.col("ma")).alias("offset"))


def strip_pairs(offsets: DataFrame, min_cells: int = 20) -> DataFrame:
    """Per pair of strips with enough common cells: cells, mean, RMS and median offset."""
    # The median by a histogram of offsets within the pair: no pair's offsets are gathered.
    h = offsets.groupBy("a", "b", "offset").agg(F.count("*").alias("c"))
    run = Window.partitionBy("a", "b").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("*", F.sum("c").over(run).alias("upto"), F.sum("c").over(Window.partitionBy("a", "b")).alias("m"))
    o = F.col("offset")
    out = h.groupBy("a", "b").agg(
        F.sum("c").alias("cells"), F.round(F.sum(o * F.col("c")) / F.sum("c"), 6).alias("mean"), F.round(F.sqrt(F.sum(o * o * F.col("c")) / F.sum("c")), 6).alias("rms"),
        F.round(F.min(F.when(F.col("upto") > F.floor(F.col("m") / 2), o)), 6).alias("median"),
    )
    return out.filter(F.col("cells") >= min_cells)


def strip_overlap(cells: DataFrame, foot: DataFrame, offsets: DataFrame) -> DataFrame:
    """Cells with a hard surface of more than one strip as a share of the footprint, and RMS over all offsets (0 where there are none)."""
    several = cells.filter("k > 0").groupBy("row", "col").agg(F.count("*").alias("strips")).filter("strips > 1").agg(F.count("*").alias("several"))
    o = offsets.agg(F.coalesce(F.round(F.sqrt(F.avg(F.col("offset") * F.col("offset"))), 6), F.lit(0.0)).alias("rms"))
    out = foot.agg(F.count("*").alias("cells")).crossJoin(F.broadcast(several)).crossJoin(F.broadcast(o))  # one row each
    return out.select(F.round(F.col("several") / F.greatest(F.lit(1), F.col("cells")), 6).alias("overlap_share"), "cells", "rms")


def checkpoint_residuals(points: DataFrame, checkpoints: DataFrame, radius: float = 1.0) -> DataFrame:
    """Per checkpoint (name, east, north, elevation in the points' frame: x, -z, y) the residual of its weighted height.

    Points meet checkpoints on cells of the radius' size, so the join is an
    equi-join; a checkpoint with fewer than three points near it keeps a null.
    """
    r = float(radius)
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    cp = checkpoints.select("name", "east", "north", "elevation").withColumn("s", shift)
    cp = cp.withColumns({"cx": F.floor(F.col("east") / r).cast("bigint") + F.col("s.i"), "cz": F.floor(-F.col("north") / r).cast("bigint") + F.col("s.j")}).drop("s")
    ground = "classification" in points.columns and bool(points.filter("classification = 2").limit(1).count())
    own = points.filter("classification = 2") if ground else points
    own = own.select("pid", "x", "y", "z", F.floor(F.col("x") / r).cast("bigint").alias("cx"), F.floor(F.col("z") / r).cast("bigint").alias("cz"))
    d2 = (F.col("x") - F.col("east")) * (F.col("x") - F.col("east")) + (F.col("z") + F.col("north")) * (F.col("z") + F.col("north"))
    near = cp.join(own, ["cx", "cz"]).withColumn("d2", d2).filter(F.col("d2") <= r * r)
    if not ground:
        w = Window.partitionBy("name").orderBy("y", "pid")
        near = near.select("*", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("name")).alias("m"))
        near = near.filter((F.col("m") >= 3) & (F.col("k") <= F.greatest(F.lit(3), F.ceil(F.col("m") / 3))))
    weight = F.lit(1.0) / F.greatest(F.col("d2"), F.lit(1e-4))
    fit = near.groupBy("name").agg(F.count("*").alias("n"), (F.sum(weight * F.col("y")) / F.sum(weight)).alias("h")).filter("n >= 3")
    return checkpoints.join(fit, "name", "left").select("name", F.round(F.col("h") - F.col("elevation"), 6).alias("residual"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def accuracy(residuals: DataFrame) -> DataFrame:
    r = F.col("residual")
    rmse = F.sqrt(F.avg(r * r))
    return residuals.agg(
        F.count("*").alias("checkpoints"), F.count(r).alias("measured"), F.round(F.avg(r), 6).alias("mean"), F.round(rmse, 6).alias("rmsez"), F.round(rmse * 1.96, 6).alias("nva"), F.round(F.max(F.abs(r)), 6).alias("max_abs"),
    )


def quality_level(full_median: Column, rmsez: Column, checked: Column) -> Column:
    """The first level that the median density of the full file and vertical error reach; without any checkpoint QL0 is not claimed.

    Checkpoints of which none was measured count as accurate.
    """
    out = F.lit(None).cast("string")
    for name, least, most, _, _ in reversed(LEVELS):
        ok = (full_median >= least) & (F.coalesce(rmsez, F.lit(0.0)) <= most)
        out = F.when(ok, F.lit(name)).otherwise(out)
    return F.when((out == "QL0") & ~checked, F.lit("QL1")).otherwise(out)


@dataclass(frozen=True)
class QualityReport:
    """All parts of a survey's report as small tables; each is derived from the survey's cells."""

    foot: DataFrame
    density: DataFrame
    coverage: DataFrame
    precision: DataFrame
    pairs: DataFrame
    overlap: DataFrame
    noise: DataFrame
    classes: DataFrame | None
    returns: DataFrame | None
    residuals: DataFrame | None
    accuracy: DataFrame | None
    checks: DataFrame
    level: str | None


def quality_report(points: DataFrame, frame: Frame, checkpoints: DataFrame | None = None, thinning: tuple[int, int] | None = None, flatness: float = 0.05) -> QualityReport:
    """Density, coverage, precision, strips, noise, classes, returns, accuracy, verdicts and level of a survey.

    ``checks`` has one row for each check against the accepted level: check,
    value, limit, verdict (pass, fail, review or skipped).
    """
    cells = survey_cells(points, frame)
    foot = settled(footprint_cells(cells))
    spacing = loaded_spacing(foot, frame)
    offsets = settled(strip_offsets(cells, flatness))
    d, cov, prec = (settled(x) for x in (density(foot, frame, thinning), coverage(foot, frame, spacing), precision(cells, frame, spacing)))
    pairs, over = settled(strip_pairs(offsets)), settled(strip_overlap(cells, foot, offsets))
    labelled = "classification" in points.columns
    noise = settled(noise_share(points)) if labelled else None
    residuals = settled(checkpoint_residuals(without_noise(points), checkpoints)) if checkpoints is not None else None
    acc = settled(accuracy(residuals)) if residuals is not None else None
    _, least, most, allowed, overlap = ACCEPTED
    judged = lambda v, limit: "skipped" if v is None else "pass" if v <= limit else "fail"
    median, voids, hard = d.first()["full_median"], cov.first()["voids"], prec.first()["hard"]
    rms = over.first()["rms"] if "point_source_id" in points.columns and pairs.limit(1).count() else None
    share = noise.first()["share"] if noise is not None else None
    rmsez = acc.first()["rmsez"] if acc is not None else None
    rows = [
        ("density", median, least, "pass" if median >= least else "fail"), ("voids", float(voids), 0.0, "pass" if voids == 0 else "review"), ("precision", hard, allowed, judged(hard, allowed)),
        ("strips", rms, overlap, judged(rms, overlap)), ("accuracy", rmsez, most, judged(rmsez, most)), ("noise", share, 0.01, "skipped" if share is None else "pass" if share <= 0.01 else "review"),
    ]
    spark = points.sparkSession
    checks = spark.createDataFrame(rows, "check string, value double, limit double, verdict string")
    level = spark.range(1).select(quality_level(F.lit(median), F.lit(rmsez).cast("double"), F.lit(checkpoints is not None))).first()[0]
    classes = class_summary(points) if labelled else None
    returns = returns_summary(points) if "number_of_returns" in points.columns else None
    return QualityReport(foot, d, cov, prec, pairs, over, noise, classes, returns, residuals, acc, checks, level)


def quality_checks(points: DataFrame, frame: Frame, checkpoints: DataFrame | None = None) -> DataFrame:
    """The verdicts of :func:`quality_report`."""
    return quality_report(points, frame, checkpoints).checks


def parse_checkpoints(lines: DataFrame, line: str = "value", number: str = "n") -> DataFrame:
    """name, east, north, elevation of text lines with ``number`` in file order.

    Fields are split on commas, semicolons and tabs; the last three must be
    numbers; a fourth gives the name, else CP and the running number. Other lines are skipped.
    """
    f = F.transform(F.split(F.col(line), "[,;\t]"), lambda s: F.trim(s))
    out = lines.select(F.col(number).alias("n"), f.alias("f")).filter(F.size("f") >= 3)
    last = lambda k: F.try_element_at(F.col("f"), F.lit(-k)).try_cast("double")
    out = out.select("n", F.when(F.size("f") >= 4, F.col("f")[0]).alias("given"), last(3).alias("east"), last(2).alias("north"), last(1).alias("elevation")).dropna(subset=["east", "north", "elevation"])
    k = F.row_number().over(Window.orderBy("n"))
    return out.select(F.coalesce(F.nullif(F.col("given"), F.lit("")), F.concat(F.lit("CP"), k.cast("string"))).alias("name"), "east", "north", "elevation")


