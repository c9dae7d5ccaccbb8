"""A deterministic point cloud made from the ``lineitem`` table.

Closed-form integer and dyadic arithmetic only, so every SQL engine builds the
same points: a sloping site that repeats every 100 m, with a flat roof, a
gable, three trees, two flight strips that overlap (the second 6.25 cm higher),
stray birds and multipath echoes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .storage import stored

#: Columns: pid, x (east), y (up), z (south), classification, return_number, number_of_returns, point_source_id, intensity, kind, ext
SCENE_SQL = """h AS (SELECT ((l_orderkey * 8 + l_linenumber) * 20000 + l_partkey) * 1000 + l_suppkey AS k,
  (l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 1299709 + l_suppkey * 15485863) % ({ext} * 64) AS xi,
  (l_partkey * 611953 + l_orderkey * 7927 + l_linenumber * 32452843 + l_suppkey * 49979687) % ({ext} * 64) AS zi,
  (l_partkey * 15487469 + l_orderkey * 179424673 + l_linenumber * 86028121 + l_suppkey * 2038074743) % 1000003 AS r, {ext} AS ext
  FROM {source}),
g AS (SELECT k, r, CAST(ext AS DOUBLE) AS ext, CAST(xi AS DOUBLE) / 64e0 AS x, CAST(zi AS DOUBLE) / 64e0 AS z,
  CAST(xi % 6400 AS DOUBLE) / 64e0 AS u, CAST(zi % 6400 AS DOUBLE) / 64e0 AS v FROM h),
s AS (SELECT *, CASE WHEN u >= 10 AND u < 30 AND v >= 10 AND v < 22 THEN 1
  WHEN u >= 60 AND u < 76 AND v >= 20 AND v < 34 THEN 2
  WHEN (u - 20) * (u - 20) + (v - 60) * (v - 60) < 16 THEN 3 WHEN (u - 50) * (u - 50) + (v - 70) * (v - 70) < 25 THEN 4
  WHEN (u - 80) * (u - 80) + (v - 75) * (v - 75) < 12.25e0 THEN 5 ELSE 0 END AS kind,
  CASE WHEN z < 0.4e0 * ext THEN 1 WHEN z >= 0.6e0 * ext THEN 2 ELSE 1 + CAST(r % 2 AS INT) END AS psid FROM g),
t AS (SELECT *, 8e0 + 0.03125e0 * u + (v - 50) * (v - 50) / 1024e0 AS terrain, CASE kind WHEN 1 THEN 8e0 WHEN 2 THEN 5e0 + 0.5e0 * (8e0 - abs(u - 68))
  WHEN 3 THEN 12e0 * (1e0 - 0.0375e0 * ((u - 20) * (u - 20) + (v - 60) * (v - 60))) - CAST(r % 256 AS DOUBLE) / 64e0
  WHEN 4 THEN 16e0 * (1e0 - 0.024e0 * ((u - 50) * (u - 50) + (v - 70) * (v - 70))) - CAST(r % 256 AS DOUBLE) / 64e0
  WHEN 5 THEN 10e0 * (1e0 - 0.05e0 * ((u - 80) * (u - 80) + (v - 75) * (v - 75))) - CAST(r % 256 AS DOUBLE) / 64e0 ELSE 0e0 END AS above FROM s)
SELECT k AS pid, x, floor((terrain + above + CASE WHEN r % 1500 = 7 THEN 25e0 WHEN r % 1500 = 11 THEN -6e0 ELSE 0e0 END
  + CASE WHEN psid = 2 THEN 0.0625e0 ELSE 0e0 END) * 64e0) / 64e0 AS y, z,
  CAST(CASE WHEN r % 1500 = 7 THEN 18 WHEN r % 1500 = 11 THEN 7 WHEN kind = 0 THEN 2 WHEN kind <= 2 THEN 6 ELSE 5 END AS INT) AS classification,
  CAST(CASE WHEN kind >= 3 AND r % 3 = 0 THEN 2 ELSE 1 END AS INT) AS return_number, CAST(CASE WHEN kind >= 3 THEN 2 ELSE 1 END AS INT) AS number_of_returns,
  CAST(psid AS INT) AS point_source_id, CAST(r % 4096 AS DOUBLE) AS intensity, CAST(r % 256 AS INT) AS r, CAST(r % 251 AS INT) AS g, CAST(r % 241 AS INT) AS b,
  CAST(kind AS INT) AS kind, terrain, greatest(above, 0e0) AS above
FROM t
"""


#: Edge of the site in metres, by the number of points.
EXTENT_SQL = "SELECT CAST(greatest(32, floor(sqrt(count(*) / 6e0))) AS BIGINT) AS ext FROM {lineitem}"

_STORED: dict = {}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene as a table in the shared folder, made once for each session and input.

    The extent is read first and stands in the text as a literal, so that no
    join hinders the optimiser; what reads the table sees plain columns.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        ext = spark.sql(EXTENT_SQL, lineitem=lineitem).first()[0]
        made = spark.sql("WITH " + SCENE_SQL.replace("{source}", "{lineitem}").replace("{ext}", f"CAST({ext} AS BIGINT)"), lineitem=lineitem)
        # One small file gives few tasks; a large input has more splits than that and isn't shuffled.
        tasks = spark.sparkContext.defaultParallelism
        if made.rdd.getNumPartitions() < tasks:
            made = made.repartition(tasks, "pid")
        _STORED[key] = stored(made, "scene")
    return _STORED[key]


def scene_cte(name: str = "pts") -> str:
    """The scene as the first common table expression of a query."""
    body = SCENE_SQL.format(ext="ext", source="lineitem CROSS JOIN e")
    return f"WITH {name} AS (WITH e AS ({EXTENT_SQL.format(lineitem='lineitem')}), {body})"
