"""LAS 1.4 output: point formats 6 and 7 with height above ground and object id as extra bytes."""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import placed
from ..storage import removed_at_exit, settled, shared_dir
from .parts import assemble

CHUNK = 1_000_000
LIMIT = 2**31 - 1
MAX_VLR = 65_535


def scale_for(low, high, offset) -> float:
    """A millimetre, or ten times as much until all coordinates fit."""
    scale = 0.001
    while any(abs(v - o) / scale > LIMIT for v, o in zip((*low, *high), (*offset, *offset), strict=True)):
        scale *= 10
    return scale


def extra_vlr() -> bytes:
    """The record that describes both extra values."""
    out = b""
    for name, kind in ((b"HeightAboveGround", 9), (b"ObjectId", 5)):
        out += struct.pack("<HBB32s4s", 0, kind, 0, name, b"") + bytes(8 * 3 * 5) + struct.pack("<32s", name)
    return _vlr("LASF_Spec", 4, "Extra bytes", out)


def _vlr(user: str, record: int, description: str, data: bytes) -> bytes:
    return struct.pack("<H16sHH32s", 0, user.encode(), record, len(data), description.encode()[:32]) + data


def record_type(colour: bool, extra: bool) -> np.dtype:
    own = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8")]
    own += [("r", "<u2"), ("g", "<u2"), ("b", "<u2")] if colour else []
    own += [("hag", "<f4"), ("object", "<u4")] if extra else []
    return np.dtype(own)


@dataclass(frozen=True)
class Form:
    """How records are written: their layout and what all files of a scan share."""

    names: tuple[str, ...]
    colour: bool
    extra: bool
    scale: float
    offset: tuple[float, float, float]
    stretch: float
    deepen: int
    vlrs: bytes
    n_vlrs: int
    wkt: bool

    @property
    def kind(self) -> np.dtype:
        return record_type(self.colour, self.extra)

    def encode(self, b: pa.RecordBatch | pa.Table) -> np.ndarray:
        """Records of a batch with the columns of ``names``; missing values count as 0."""
        v = {c: np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float)) if isinstance(b, pa.RecordBatch) else np.nan_to_num(b.column(c).to_numpy().astype(float)) for c in self.names}
        out, one = np.zeros(b.num_rows, self.kind), np.ones(b.num_rows)
        for f, c in (("X", v["x"]), ("Y", -v["z"]), ("Z", v["y"])):
            out[f] = np.floor(c / self.scale + 0.5).astype("<i4")
        if "intensity" in v:
            out["intensity"] = np.clip(np.floor(v["intensity"] * self.stretch + 0.5), 0, 65535)
        out["returns"] = np.clip(v.get("return_number", one), 0, 15).astype("u1") | (np.clip(v.get("number_of_returns", one), 0, 15).astype("u1") << 4)
        for f, c, most in (("classification", "classification", 255), ("source", "point_source_id", 65535)):
            if c in v:
                out[f] = np.clip(v[c], 0, most)
        for c in "rgb" if self.colour else "":
            out[c] = np.clip(v[c] * self.deepen, 0, 65535)
        if self.extra:
            out["hag"] = v.get("height_above_ground", 0 * one)
            if "object_id" in v:
                out["object"] = np.clip(v["object_id"], 0, 2**32 - 1)
        return out

    def head(self, n: int, low, high, per_return: list[int]) -> bytes:
        """The header and records before the points; low and high in map coordinates (east, north, up)."""
        head = struct.pack("<4sHH16sBB32s32sHHHIIBHI5I", b"LASF", 0, 0x10 if self.wkt else 0, b"", 1, 4, b"", b"pointmill", 1, 2000, 375, 375 + len(self.vlrs), self.n_vlrs, 7 if self.colour else 6, self.kind.itemsize, 0, *[0] * 5)
        head += struct.pack("<3d3d6d", *[self.scale] * 3, *self.offset, high[0], low[0], high[1], low[1], high[2], low[2])
        return head + struct.pack("<QQIQ15Q", 0, 0, 0, n, *per_return) + self.vlrs


def _box(origin, x0, x1, y0, y1, z0, z1) -> tuple[tuple, tuple]:
    ox, oy, oz = map(float, origin)
    return (ox + x0, -(oz + z1), oy + y0), (ox + x1, -(oz + z0), oy + y1)


def _returns() -> list:
    """The number of points of each return from 1 to 15; others count with the nearest."""
    k = F.greatest(F.lit(1), F.least(F.lit(15), F.coalesce("return_number", F.lit(1))))
    return [F.count_if(k == i) for i in range(1, 16)]


def _form(points: DataFrame, origin, records: list[dict] | None) -> tuple[Form, tuple]:
    """The form of a scan's files, and its number of points, box (as x0, x1, y0, y1, z0, z1) and points of each return, from one pass."""
    cols = set(points.columns)
    colour, extra = {"r", "g", "b"} <= cols, bool({"height_above_ground", "object_id"} & cols)
    top = F.max("intensity") if "intensity" in cols else F.lit(None)
    shade = F.max(F.greatest("r", "g", "b")) if colour else F.lit(None)
    n, top, shade, *rest = points.agg(F.count("*"), top, shade, *(f(c) for c in "xyz" for f in (F.min, F.max)), *(_returns() if "return_number" in cols else [])).first()
    box = [v if n else 0.0 for v in rest[:6]]
    per_return = rest[6:] or [n, *[0] * 14]
    offset = (float(origin[0]), -float(origin[2]), float(origin[1]))
    kept = [r for r in records or [] if len(r["data"]) <= MAX_VLR]
    vlrs = b"".join(_vlr(r["user_id"], r["record_id"], r["description"], r["data"]) for r in kept) + (extra_vlr() if extra else b"")
    names = [c for c in ("x", "y", "z", "intensity", "return_number", "number_of_returns", "classification", "point_source_id", "r", "g", "b", "height_above_ground", "object_id") if c in cols]
    low, high = _box(origin, *box)
    form = Form(
        tuple(names), colour, extra, scale_for(low, high, offset), offset, 65535.0 if top is not None and top <= 1 else 1.0, 257 if shade is not None and shade <= 255 else 1,
        vlrs, len(kept) + extra, any(r["record_id"] == 2112 for r in records or []),
    )
    return form, (n, box, per_return)


def write_las(points: DataFrame, path: str, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), records: list[dict] | None = None) -> int:
    """Writes points (x east, y up, z south, in a frame at ``origin``) ordered by pid as one file; the number written.

    Executors sort and encode range partitions; how many records lie before a
    partition follows from the partitions' sizes, so they then write their chunks to
    their places in the file themselves (see :func:`parts.assemble`). Intensities of at
    most 1 are stretched; colours of a byte become 16 bits. No points give a file with a header.
    """
    spark = points.sparkSession
    form, (n, box, per_return) = _form(points, origin, records)
    stride, names = form.kind.itemsize, form.names

    def encode(batches):
        before, held, rows = 0, [], 0
        for b in batches:
            held.append(form.encode(b).tobytes())
            rows += b.num_rows
            if rows >= CHUNK:
                yield pa.record_batch([pa.array([before], pa.int64()), pa.array([rows], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["before", "n", "bytes"])
                before, held, rows = before + rows, [], 0
        if rows:
            yield pa.record_batch([pa.array([before], pa.int64()), pa.array([rows], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["before", "n", "bytes"])

    ordered = points.orderBy("pid").select(*names).mapInArrow(encode, "before bigint, n bigint, bytes binary")
    at = removed_at_exit(spark, f"{shared_dir(spark)}/pm-las-{uuid.uuid4().hex}")
    ordered.withColumn("part", F.spark_partition_id()).write.parquet(at)
    chunks = spark.read.schema("before bigint, n bigint, bytes binary, part int").parquet(at)
    sizes = chunks.groupBy("part").agg(F.sum("n").alias("n"))
    starts = sizes.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * stride).alias("start"))  # one row a partition
    parts = chunks.join(F.broadcast(starts), "part").select((F.col("start") + F.col("before") * stride).alias("at"), "bytes")
    head = form.head(n, *_box(origin, *box), per_return)
    assemble(parts, path, head, len(head) + n * stride)
    return n


def write_las_tiles(points: DataFrame, folder: str, tile: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), records: list[dict] | None = None, per_file: int = CHUNK) -> DataFrame:
    """Writes points as a folder of files by tiles of the plan: path, grid_x, grid_z, slice, n and box of each.

    A tile with more than ``per_file`` points is dealt over several files by a hash of pid.
    Each file is made whole by one task on whatever filesystem the folder is on, and
    named by what it holds, so a task that is run again writes the same files again.
    """
    from ..operators.tables import tiles

    form, (_n, box, _r) = _form(points, origin, records)
    own = tiles(points, tile, box[0], box[4], box[1] - box[0], box[5] - box[4])
    key = ["grid_x", "grid_z"]
    slices = own.groupBy(*key).agg(F.ceil(F.count("*") / per_file).cast("int").alias("slices")).filter("slices > 1")
    own = own.join(slices, key, "left").withColumn("slice", F.pmod(F.xxhash64("pid"), F.coalesce("slices", F.lit(1))).cast("int"))
    names = [*form.names, "pid"]

    def put(t: pa.Table) -> pa.Table:
        gx, gz, k = (t.column(c)[0].as_py() for c in (*key, "slice"))
        t = t.sort_by("pid")
        v = {c: t.column(c).to_numpy() for c in "xyz"}
        spans = [f(v[c]) for c in "xyz" for f in (np.min, np.max)]
        returned = np.clip(t.column("return_number").fill_null(1).to_numpy(), 1, 15) if "return_number" in form.names else np.ones(len(t), int)
        there, root = placed(folder)
        there.create_dir(root, recursive=True)
        name = f"tile-{gx}-{gz}-{k}.las"
        with there.open_output_stream(f"{root}/{name}") as f:
            f.write(form.head(len(t), *_box(origin, *spans), np.bincount(returned.astype(int), minlength=16)[1:16].tolist()))
            f.write(form.encode(t).tobytes())
        row = [f"{folder.rstrip('/')}/{name}", gx, gz, k, len(t), *map(float, spans)]
        return pa.table({c: [x] for c, x in zip(_FILE, row, strict=True)}, schema=_FILES)

    done = own.select(*names, *key, "slice").groupBy(*key, "slice").applyInArrow(put, "path string, grid_x int, grid_z int, slice int, n bigint, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    return settled(done)


_FILES = pa.schema([("path", pa.string()), ("grid_x", pa.int32()), ("grid_z", pa.int32()), ("slice", pa.int32()), ("n", pa.int64()), *((f"{side}_{c}", pa.float64()) for c in "xyz" for side in ("min", "max"))])
_FILE = _FILES.names


def write_clean(points: DataFrame, path: str, **how) -> int:
    """The scan without noise."""
    from ..operators.tables import without_noise

    return write_las(without_noise(points), path, **how)
