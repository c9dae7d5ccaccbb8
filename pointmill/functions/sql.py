"""Kernels for SQL text: ``register(spark)`` adds epsg_of_wkt, ear_clip, plane_through and the table function around_cell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    from ..operators import measure
    from ..sources import crs

    # Batches of Arrow values; texts, rings and planes are small, and each is worked on alone.
    each = lambda f, kind: F.pandas_udf(lambda v: pd.Series([f(x) for x in v], dtype=object), kind)

    def ear_clip(vertices):
        out = measure.triangulate([(v["x"], v["z"]) for v in vertices]) if vertices is not None and len(vertices) else None
        return None if out is None else [list(t) for t in out]

    def plane_through(vertices):
        return None if vertices is None or not len(vertices) else [float(k) for k in measure.plane_through([(v["x"], v["y"], v["z"]) for v in vertices])]

    spark.udf.register("epsg_of_wkt", each(crs.epsg_of_wkt, "int"))
    spark.udf.register("ear_clip", each(ear_clip, "array<array<int>>"))
    spark.udf.register("plane_through", each(plane_through, "array<double>"))

    @F.udtf(returnType="row int, col int")
    class AroundCell:
        def eval(self, row: int, col: int, radius: int):
            for i in range(-radius, radius + 1):
                for j in range(-radius, radius + 1):
                    yield row + i, col + j

    spark.udtf.register("around_cell", AroundCell)
