"""Cell statistics of a growing scan, kept up to date by bounded micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import Frame, with_cells
from ..storage import removed_at_exit, shared_dir

#: Partials that add up: a batch's rows merge with what was there.
PARTIALS = {"n": "sum", "s": "sum", "ss": "sum", "lo": "min", "hi": "max"}


def cell_partials(points: DataFrame, frame: Frame) -> DataFrame:
    """row, col, n, s, ss, lo, hi: count, sum and sum of squares, least and greatest height."""
    y = F.col("y")
    return with_cells(points, frame).groupBy("row", "col").agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"), F.min(y).alias("lo"), F.max(y).alias("hi"))


def merge_partials(parts: DataFrame) -> DataFrame:
    return parts.groupBy("row", "col").agg(*(getattr(F, f)(c).alias(c) for c, f in PARTIALS.items()))


def cell_stats_stream(points: DataFrame, frame: Frame, files: int = 8, per_batch: int = 2) -> DataFrame:
    """The partials of points that arrive as files, read as a stream and merged batch by batch.

    Each batch appends its own partials under its id, so a batch that is run
    again after a failure replaces its rows; the result is their merge.
    """
    spark = points.sparkSession
    at = removed_at_exit(spark, f"{shared_dir(spark)}/pm-stream-{uuid.uuid4().hex}")
    own = points.select("x", "y", "z")
    own.repartition(files, F.xxhash64("x", "z")).write.parquet(f"{at}/in")

    def keep(batch: DataFrame, batch_id: int) -> None:
        cell_partials(batch, frame).write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", per_batch).parquet(f"{at}/in")
    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return merge_partials(spark.read.parquet(f"{at}/out").drop("batch"))


def histogram_stream(stream: DataFrame, column: str = "classification") -> DataFrame:
    """A running histogram of a streaming points table (complete output mode)."""
    return stream.groupBy(column).agg(F.count("*").alias("n"))


def event_windows(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a streaming table in tumbling windows of event time; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
