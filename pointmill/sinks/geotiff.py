"""GeoTIFF of a terrain model: strips of 32-bit floats, -9999 for no data; beyond 4 GB as BigTIFF."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import Frame
from .parts import assemble

#: Cells of a strip, but a whole row at least.
STRIP_CELLS = 1 << 20
NO_DATA = -9999.0


def geotiff_head(rows: int, cols: int, strip: int, west: float, north: float, cell: float, epsg: int | None = None, big: bool | None = None) -> bytes:
    """All before the samples, in strips of ``strip`` rows; west and north are the outer corner of the first cell, big is BigTIFF."""
    n, size = -(-rows // strip), rows * cols * 4
    big = size + 16 * n + 4096 > 2**32 if big is None else big
    # Systems of degrees are those from 4000 to 4999.
    degrees = epsg is not None and 4000 <= epsg < 5000
    keys = [(1024, 0, 1, 2 if degrees else 1)] if epsg else []
    keys += [(1025, 0, 1, 1)] + ([(2048 if degrees else 3072, 0, 1, epsg)] if epsg else [])
    geo = struct.pack("<4H", 1, 1, 0, len(keys)) + b"".join(struct.pack("<4H", *k) for k in keys)
    long, kind = ("<u8", 16) if big else ("<u4", 4)
    lengths = np.minimum(strip, rows - strip * np.arange(n)) * cols * 4
    places = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else lengths
    short = lambda v: struct.pack("<H", v)
    tags: list[tuple[int, int, int, bytes]] = [
        (256, 4, 1, struct.pack("<I", cols)), (257, 4, 1, struct.pack("<I", rows)), (258, 3, 1, short(32)), (259, 3, 1, short(1)), (262, 3, 1, short(1)), (273, kind, n, places.astype(long).tobytes()), (277, 3, 1, short(1)),
        (278, 4, 1, struct.pack("<I", strip)), (279, kind, n, lengths.astype(long).tobytes()), (284, 3, 1, short(1)), (339, 3, 1, short(3)), (33550, 12, 3, struct.pack("<3d", cell, cell, 0)),
        (33922, 12, 6, struct.pack("<6d", 0, 0, 0, west, north, 0)), (34735, 3, len(geo) // 2, geo), (42113, 2, 6, b"-9999\0"),
    ]
    inline, entry = (8, "<HHQ") if big else (4, "<HHI")
    start = (16 + 8 + 20 * len(tags) + 8) if big else (8 + 2 + 12 * len(tags) + 4)
    at, end = {}, start
    for tag, _, _, value in tags:
        if len(value) > inline:
            at[tag] = end
            end += len(value) + len(value) % 2
    end += -end % 8
    body, entries = b"", b""
    for tag, k, count, value in tags:
        if tag == 273:
            value = (places + end).astype(long).tobytes()
        if tag in at:
            body += value + b"\0" * (len(value) % 2)
            value = at[tag].to_bytes(inline, "little")
        entries += struct.pack(entry, tag, k, count) + value.ljust(inline, b"\0")
    top = b"II" + (struct.pack("<HHHQQ", 43, 8, 0, 16, len(tags)) if big else struct.pack("<HIH", 42, 8, len(tags)))
    return (top + entries + b"\0" * inline + body).ljust(end, b"\0")


def write_geotiff(model: DataFrame, frame: Frame, path: str, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), epsg: int | None = None, strip_cells: int = STRIP_CELLS) -> None:
    """model (row, col, elevation) as an image whose rows run south as those of the grid; absent cells have no data.

    Each strip is made by one task, which writes it to its place in the file
    (see :func:`parts.assemble`); no grid is ever held as a whole.
    """
    rows, cols = max(1, frame.rows), max(1, frame.cols)
    strip = max(1, min(rows, strip_cells // cols))
    n, up = -(-rows // strip), float(origin[1])
    spark = model.sparkSession

    def encode(key: tuple, t: pa.Table) -> pa.Table:
        k = key[0].as_py()
        out = np.full((min(strip, rows - k * strip), cols), NO_DATA, "<f4")
        t = t.filter(t.column("col").is_valid())
        out[t.column("row").to_numpy() - k * strip, t.column("col").to_numpy()] = t.column("elevation").to_numpy() + up
        return pa.table({"at": pa.array([k * strip * cols * 4], pa.int64()), "bytes": pa.array([out.tobytes()], pa.binary())})

    cells = model.filter("elevation IS NOT NULL").select(F.floor(F.col("row") / strip).cast("bigint").alias("k"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("elevation").cast("double").alias("elevation"))
    # A row without a cell for each strip, so that strips without data are written too.
    every = spark.range(n).select(F.col("id").alias("k"), *(F.lit(None).cast(t).alias(c) for c, t in (("row", "bigint"), ("col", "bigint"), ("elevation", "double"))))
    parts = cells.unionByName(every).groupBy("k").applyInArrow(encode, "at bigint, bytes binary")
    head = geotiff_head(rows, cols, strip, origin[0] + frame.min_x, -(origin[2] + frame.min_z), frame.cell, epsg)
    assemble(parts, path, head, len(head) + rows * cols * 4)
