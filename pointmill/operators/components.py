"""Connected components of graphs and of grid masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled, shuffles_freed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows ``node, root`` for every node of an undirected edge list; root is the smallest node reachable.

    Alternates the two star contractions: every edge is moved to the smallest
    known neighbour until only stars remain. Each contraction is an
    aggregation with map-side minima and an equi-join, so a hub with many
    edges is never gathered in one task; every round is checkpointed. Null
    endpoints and self-loops are ignored; no edges give an empty table.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = settled(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if not e.limit(1).count():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = settled(small)
        with shuffles_freed(e.sparkSession):
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v"))).distinct()


def cell_roots(mask: DataFrame, cols: int, connectivity: int = 8, tile: int = 1_024) -> DataFrame:
    """mask's cells (row, col) with ``root``: the number row * cols + col of the first cell of their component.

    Tiles are labelled apart, each in one task; only what touches a neighbour
    tile takes part in the components of the whole mask.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    reach = 1 if connectivity == 8 else 0
    t = lambda c: F.floor(F.col(c) / tile).cast("int")
    placed = mask.select("row", "col", t("row").alias("tr"), t("col").alias("tc"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col, first = tile_roots(pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64), reach)
        return pd.DataFrame({"row": row.astype("int32"), "col": col.astype("int32"), "root": row[first] * cols + col[first]})

    own = settled(placed.groupBy("tr", "tc").applyInPandas(label, "row int, col int, root bigint"))
    edge = own.filter(F.pmod("row", F.lit(tile)).isin(0, tile - 1) | F.pmod("col", F.lit(tile)).isin(0, tile - 1))
    half = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if reach else [])
    beside = edge.withColumn("o", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half))))
    beside = beside.select(F.col("root").alias("a"), (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    edges = settled(beside.join(edge.select("row", "col", F.col("root").alias("b")), ["row", "col"]).filter("a <> b").select("a", "b").distinct())
    if not edges.limit(1).count():
        return own
    comp = connected_components(edges).withColumnRenamed("root", "whole")
    return own.join(comp, own.root == comp.node, "left").select("row", "col", F.coalesce("whole", "root").alias("root"))


def placed_edge_roots(edges: DataFrame, tile: int = 1_024) -> DataFrame:
    """``a, b, root`` of the edges (a, b, and the cell row, col in which each lies); root is the smallest node of their component.

    Like :func:`cell_roots`: tiles apart, then only the nodes that two tiles share.
    """
    t = lambda c: F.floor(F.col(c) / tile).cast("int")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(k: int) -> int:
            while parent.setdefault(k, k) != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        pairs = list(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "root": [find(a) for a, _ in pairs]})

    own = settled(edges.select("a", "b", t("row").alias("tr"), t("col").alias("tc")).groupBy("tr", "tc").applyInPandas(join, "a bigint, b bigint, root bigint"))
    ends = own.select(F.col("a").alias("node"), "root").union(own.select("b", "root"))
    shared = ends.groupBy("node").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("x", "y").distinct()
    comp = connected_components(shared, "x", "y").withColumnRenamed("root", "whole")
    return own.join(comp, own.root == comp.node, "left").select("a", "b", F.coalesce("whole", "root").alias("root"))


def tile_roots(row: np.ndarray, col: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells in row order, and for each the position of the first cell of its component; runs of cells in a row are joined with those of the row before."""
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)
    start = np.flatnonzero(fresh)
    r, lo = row[start].tolist(), col[start].tolist()
    hi = col[np.append(start[1:], len(row)) - 1].tolist()
    parent = list(range(len(start)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above = 0
    for k in range(len(start)):
        while above < k and (r[above] < r[k] - 1 or (r[above] == r[k] - 1 and hi[above] < lo[k] - reach)):
            above += 1
        u = above
        while u < k and r[u] == r[k] - 1 and lo[u] <= hi[k] + reach:
            a, b = find(u), find(k)
            parent[max(a, b)] = min(a, b)
            u += 1
    root = start[np.array([find(k) for k in range(len(start))], np.int64)] if len(start) else start
    return row, col, root[np.cumsum(fresh) - 1]


def numbered(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """rows with ``name``: numbers from 1 in the order of ``keys`` (columns, or descending ones), which tell all rows apart.

    Range partitions count inside; only their sizes, as many as there are partitions, meet in one place.
    """
    placed = settled(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return placed.withColumn(name, inside).join(F.broadcast(sizes), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_part", "_before")


def running_total(rows: DataFrame, keys: list, value: str, name: str) -> DataFrame:
    """rows with ``name``: the sum of ``value`` over all rows up to each, in the order of ``keys``, which tell all rows apart.

    Like :func:`numbered`: range partitions sum inside, only their totals meet in one place.
    """
    placed = settled(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, inside).join(F.broadcast(totals), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def label_cells(mask: DataFrame, cols: int, connectivity: int = 8) -> DataFrame:
    """mask's cells (row, col) with ``label``: numbers from 1 in the order of each component's first cell."""
    out = settled(cell_roots(mask, cols, connectivity))
    return out.join(numbered(out.select("root").distinct(), ["root"], "label"), "root").select("row", "col", "label")


def gap_sizes(cells: DataFrame, cols: int) -> DataFrame:
    """Empty cells (n = 0) of a footprint, grouped over shared edges: root and number of cells."""
    return cell_roots(cells.filter("n = 0"), cols, 4).groupBy("root").agg(F.count("*").alias("cells"))


def gap_components(cells: DataFrame, cols: int) -> DataFrame:
    """Like :func:`gap_sizes`, numbered from 1 (column label) in the order of the first cells."""
    return numbered(gap_sizes(cells, cols), ["root"], "label").select("label", "cells")


def patch_moments(labels: DataFrame) -> DataFrame:
    """n and the sums of col, row, their squares and product for each label."""
    r, c = F.col("row").cast("bigint"), F.col("col").cast("bigint")
    return labels.groupBy("label").agg(
        F.count("*").alias("n"), F.sum(c).alias("sc"), F.sum(r).alias("sr"), F.sum(c * c).alias("scc"), F.sum(r * r).alias("srr"), F.sum(r * c).alias("src"),
    )


def narrow(moments: DataFrame, cell: float, least: float = 2.5) -> DataFrame:
    """Labels of patches whose width by second moments is under ``least``."""
    n = F.col("n")
    cc, rr, rc = (F.col(s) / n - F.col(a) * F.col(b) / (n * n) for s, a, b in (("scc", "sc", "sc"), ("srr", "sr", "sr"), ("src", "sr", "sc")))
    small = (cc + rr) / 2 - F.sqrt((cc - rr) * (cc - rr) / 4 + rc * rc)
    return moments.filter(F.sqrt(F.lit(12.0) * (F.greatest(small, F.lit(0.0)) + F.lit(1.0 / 12))) * F.lit(float(cell)) < least).select("label")
