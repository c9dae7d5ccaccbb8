"""A synthetic survey of a works site: two flight strips over ground, halls, trees and a mast, with stray points.

Every value is a hash of the point's number and a seed, so any number of tasks
makes the same scan; only its statistics are meant, not single points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Halls as x, z, width, depth, eaves, ridge above eaves; trees as x, z, height, crown radius, for each site of 200 m.
HALLS = [(20.0, 20.0, 48.0, 30.0, 9.0, 3.0), (100.0, 30.0, 36.0, 24.0, 6.0, 0.0), (60.0, 110.0, 60.0, 30.0, 12.0, 4.0)]
TREES = [(20.0 + 23.0 * k, 170.0 + 7.0 * (k % 3), 8.0 + k, 2.5 + 0.25 * k) for k in range(7)]
SITE = 200.0


def uniform(seed: int, salt: int, key: Column) -> Column:
    """Evenly spread over [0, 1) by a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def gaussian(seed: int, salt: int, key: Column) -> Column:
    u, v = uniform(seed, salt, key), uniform(seed, salt + 1_000, key)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def synthetic_survey(spark: SparkSession, count: int, sites: int = 1, seed: int = 1, noise: float = 2e-4, strip_offset: float = 0.04) -> DataFrame:
    """Exactly ``count`` points over ``sites`` x ``sites`` works sites; ``truth`` is the class each point should get."""
    if count < 0 or sites < 1:
        raise ValueError("count must not be negative, sites at least 1")
    side = SITE * sites
    p = spark.range(count).withColumnRenamed("id", "pid")
    i = F.col("pid")
    p = p.select("pid", (uniform(seed, 1, i) * side).alias("x"), (uniform(seed, 2, i) * side).alias("z"), uniform(seed, 3, i).alias("r1"), uniform(seed, 4, i).alias("r2"), gaussian(seed, 5, i).alias("g"))
    u, v = F.pmod(F.col("x"), F.lit(SITE)), F.pmod(F.col("z"), F.lit(SITE))
    ground = F.lit(20.0) + F.lit(0.01) * F.col("x") + F.sin(F.col("z") / 40.0)
    above, truth = F.lit(0.0), F.lit(2)
    for x, z, w, d, eaves, ridge in HALLS:
        inside = u.between(x, x + w) & v.between(z, z + d)
        roof = F.lit(eaves) + F.lit(ridge) * (1 - F.abs(v - (z + d / 2)) / (d / 2))
        above, truth = F.when(inside, roof).otherwise(above), F.when(inside, 6).otherwise(truth)
    for x, z, h, r in TREES:
        q = ((u - x) * (u - x) + (v - z) * (v - z)) / (r * r)
        # Pulses stop within the crown or go through to the ground.
        crown = (q < 1) & (F.col("r1") < 0.8)
        above, truth = F.when(crown, h * (1 - 0.5 * q) - F.col("r2") * 0.35 * h * (1 - q)).otherwise(above), F.when(crown, 5).otherwise(truth)
    strip = F.when(F.col("z") < 0.45 * side, 1).when(F.col("z") > 0.55 * side, 2).otherwise(1 + (F.col("r1") > 0.5).cast("int"))
    stray = F.col("r2") > 1 - noise
    y = ground + above + F.lit(0.02) * F.col("g") + F.when(strip == 2, F.lit(strip_offset)).otherwise(0.0) + F.when(stray, F.when(F.col("r1") < 0.5, -6.0).otherwise(30.0)).otherwise(0.0)
    tree = truth == 5
    return p.select(
        "pid", "x", y.alias("y"), "z", F.lit(0).alias("classification"), F.when(tree & (F.col("r2") < 0.3), 2).otherwise(1).alias("return_number"), F.when(tree, 2).otherwise(1).alias("number_of_returns"),
        strip.alias("point_source_id"), F.floor(F.col("r2") * 4096).cast("double").alias("intensity"), F.when(stray, F.when(F.col("r1") < 0.5, 7).otherwise(18)).otherwise(truth).alias("truth"),
    )
