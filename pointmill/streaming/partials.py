"""What a growing scan is asked for, kept up to date by partial sums of each micro-batch.

Each family of figures adds up over parts of a scan: points by class; heights by cell; returns and hard
surface by cell and strip (from which density, coverage, precision and strip offsets
follow); means and votes by voxel. A batch appends one partial table a family under its
number, so a batch that is run again replaces its own rows, and files that come late
are just a later batch. Compaction merges what is there into a base that names the last batch it
holds; readers take the latest base and the batches behind it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import Frame, survey_of, survey_sums
from .cells import cell_partials

#: How columns of partials merge; all others are keys.
MERGED = {"n": "sum", "s": "sum", "ss": "sum", "lo": "min", "hi": "max", "first": "sum"} | {f"{k}{c}": "sum" for k in "og" for c in ("k", "s", "ss")} | {f"sum_{c}": "sum" for c in ("x", "y", "z", "intensity", "r", "g", "b")}
FAMILIES = ("classes", "cells", "survey", "voxels", "votes")
#: Rows of partials that a task merges about.
MERGE_ROWS = 1_000_000


def merged(parts: DataFrame) -> DataFrame:
    """Partials of one family with one row a key."""
    keys = [c for c in parts.columns if c not in MERGED]
    return parts.groupBy(*keys).agg(*(getattr(F, MERGED[c])(c).alias(c) for c in parts.columns if c in MERGED))


@dataclass(frozen=True)
class ScanState:
    """Partials of a scan below ``path``, on cells of ``frame`` and voxels of ``voxel`` from ``origin``."""

    spark: SparkSession
    path: str
    frame: Frame
    voxel: float
    origin: tuple[float, float, float]

    def partials(self, points: DataFrame) -> dict[str, DataFrame]:
        """The partial table of each family over points; classes need ``classification``."""
        at = [F.floor((F.col(c) - F.lit(float(o))) / F.lit(float(self.voxel))).cast("int").alias(f"v{c}") for c, o in zip("xyz", self.origin, strict=True)]
        own = points.select("*", *at)
        sums = [F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in ("x", "y", "z", "intensity", "r", "g", "b") if c in points.columns]
        return {
            "classes": points.groupBy("classification").agg(F.count("*").alias("n")),
            "cells": cell_partials(points, self.frame),
            "survey": survey_sums(points, self.frame),
            "voxels": own.groupBy("vx", "vy", "vz").agg(F.count("*").alias("n"), *sums),
            "votes": own.groupBy("vx", "vy", "vz", "classification").agg(F.count("*").alias("n")),
        }

    def keep(self, batch: DataFrame, batch_id: int) -> None:
        """Adds a micro-batch, read once; under the number of an earlier one it replaces that."""
        batch = batch.persist()
        try:
            for name, part in self.partials(batch).items():
                part.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    def follow(self, points: DataFrame) -> StreamingQuery:
        """Takes in all that a stream of points offers by now; called again, it goes on from there."""
        return points.writeStream.foreachBatch(self.keep).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()

    def _folders(self, name: str) -> tuple[str | None, int, list[int]]:
        """The latest base that is whole, the last batch it holds, and the batches behind it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(conf)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        whole = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{n}/_SUCCESS"))]
        upto = max((int(n[5:]) for n in whole if n.startswith("base=")), default=-1)
        return (f"{self.path}/{name}/base={upto}" if upto >= 0 else None), upto, sorted(int(n[6:]) for n in whole if n.startswith("batch=") and int(n[6:]) > upto)

    def table(self, name: str) -> DataFrame:
        """A family's merged table over all batches so far."""
        if name not in FAMILIES:
            raise ValueError(f"families are {', '.join(FAMILIES)}")
        base, _, batches = self._folders(name)
        paths = ([base] if base else []) + [f"{self.path}/{name}/batch={k}" for k in batches]
        if not paths:
            raise ValueError("no batch has come yet")
        parts = [self.spark.read.parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        # Rows of all batches are counted (from the files' footers), so that more of them are merged by more tasks.
        tasks = math.ceil(out.count() / MERGE_ROWS)
        if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            out = out.repartition(tasks, *(c for c in out.columns if c not in MERGED))
        return merged(out)

    def compact(self) -> None:
        """Merges the batches so far into one base a family; older ones stay until readers are done with them."""
        for name in FAMILIES:
            _, _, batches = self._folders(name)
            if batches:
                self.table(name).write.mode("overwrite").parquet(f"{self.path}/{name}/base={batches[-1]}")

    def survey(self) -> DataFrame:
        """The cells by strip that density, coverage, precision and strips are made of, as :func:`quality.survey_cells` gives them."""
        return survey_of(self.table("survey"))

    def thinned(self) -> DataFrame:
        """One row a voxel, as :func:`tables.voxel_downsample` gives it: n, means, rounded mean colours and the most frequent class."""
        v = self.table("voxels")
        means = [(F.col(f"sum_{c}") / F.col("n")).alias(c) for c in ("x", "y", "z", "intensity") if f"sum_{c}" in v.columns]
        colours = [F.floor(F.col(f"sum_{c}") / F.col("n") + 0.5).cast("int").alias(c) for c in "rgb" if f"sum_{c}" in v.columns]
        won = self.table("votes").groupBy("vx", "vy", "vz").agg(F.max(F.struct("n", (-F.col("classification")).alias("m"))).alias("w"))
        return v.select("vx", "vy", "vz", "n", *means, *colours).join(won.select("vx", "vy", "vz", (-F.col("w.m")).cast("int").alias("classification")), ["vx", "vy", "vz"])
