"""What the corpus operators share: inputs, folds, bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import removed_at_exit, settled, shared_dir, shuffles_freed, stored

#: Working columns carry this prefix, so that they never meet a column of the caller.
P = "__pm_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts can be long: batches for Python hold at most so many, so that neither side buffers tens of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(id_col: str, modulus: int):
    """crc32 of the id as text, modulo: the folds of the learning operators."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


#: A key with more than this share of all rows is hot, so there are fewer than SHARE hot keys, however large the input.
SHARE = 5_000


def spread_join(rows: DataFrame, keys: DataFrame, on: str, count: str, how: str = "inner") -> DataFrame:
    """rows joined with keys on the column ``on``, of which keys has each value once, ``count`` rows of rows hold it; count is dropped.

    Rows of hot keys stay where they are and meet a broadcast of those keys,
    whose number is bounded by SHARE; only the others are shuffled, and none of
    their keys is large. keys is read three times: settle it first.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * F.lit(SHARE) > F.lit(total)
    many = keys.filter(hot).drop(count)
    out = rows.join(F.broadcast(many.select(on)), on, "left_anti").join(keys.filter(~hot).drop(count), on, how)
    return out.unionByName(rows.join(F.broadcast(many), on).select(out.columns))


def bounded_rows(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """About ``bound`` rows, by a threshold on a hash of the id: a row's luck depends on its id alone."""
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 24)) < int((1 << 24) * bound / n))


__all__ = ["P", "bounded_batches", "bounded_rows", "connected_components", "id_bucket", "removed_at_exit", "settled", "shared_dir", "shuffle_partitions", "shuffles_freed", "spread_join", "stored", "table"]
