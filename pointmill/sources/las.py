"""LAS scans as a Spark data source: byte ranges of fixed-width records, read in parallel.

``spark.read.format("lasscan").load(path)``; options: ``keepEvery`` (every
k-th point), ``maxPoints`` (thins evenly to fit), ``columns`` (comma-separated
subset, so that others are never decoded), ``blockBytes``, ``origin`` ("x,y,z": of the
local frame, instead of the extent's centre to the next thousand).
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files
from .crs import RECORDS, reference_of

#: Point formats: least length, offset of colours, offset of the class byte, offset of the source id (fixed values of the LAS format).
LAYOUTS = {0: (20, None, 15, 18), 1: (28, None, 15, 18), 2: (26, 20, 15, 18), 3: (34, 28, 15, 18), 4: (57, None, 15, 18), 5: (63, 28, 15, 18), 6: (30, None, 16, 20), 7: (36, 30, 16, 20), 8: (38, 30, 16, 20), 9: (59, None, 16, 20), 10: (67, 30, 16, 20)}
SCHEMA = "pid bigint, x double, y double, z double, intensity double, return_number smallint, number_of_returns smallint, classification smallint, point_source_id int, r smallint, g smallint, b smallint"
BLOCK_BYTES = 16 << 20
MAX_RECORD_BYTES = 64 << 20


@dataclass(frozen=True)
class LasHeader:
    version: tuple[int, int]
    header_size: int
    offset: int
    n_vlrs: int
    format: int
    compressed: bool
    stride: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    evlr_offset: int = 0
    n_evlrs: int = 0
    records: list[dict] = field(default_factory=list)

    @property
    def usable_extent(self) -> bool:
        return all(map(math.isfinite, (*self.low, *self.high))) and all(a <= b for a, b in zip(self.low, self.high, strict=True)) and any(self.low + self.high)

    @property
    def origin(self) -> tuple[float, float, float]:
        """Of the local frame (x east, y up, z south): the extent's centre, else the header's offset, to the next thousand."""
        e, n, u = [(a + b) / 2 for a, b in zip(self.low, self.high, strict=True)] if self.usable_extent else self.shift
        near = lambda v: math.floor(v / 1000 + 0.5) * 1000.0
        return near(e), near(u), near(-n)


def parse_header(data: bytes) -> LasHeader | None:
    """None if the bytes are no usable LAS header."""
    if len(data) < 227 or data[:4] != b"LASF":
        return None
    major, minor, size = data[24], data[25], struct.unpack_from("<H", data, 94)[0]
    offset, n_vlrs, fmt, stride, count = struct.unpack_from("<IIBHI", data, 96)
    scale, shift, box = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155), struct.unpack_from("<6d", data, 179)
    evlr_offset = n_evlrs = 0
    if (major, minor) >= (1, 4) and len(data) >= 375:
        evlr_offset, n_evlrs = struct.unpack_from("<QI", data, 235)
        count = struct.unpack_from("<Q", data, 247)[0] or count
    kind = fmt & 0x3F
    if kind not in LAYOUTS or stride < LAYOUTS[kind][0] or size < 227 or offset < size or any(s == 0 or not math.isfinite(s) for s in scale):
        return None
    return LasHeader((major, minor), size, offset, n_vlrs, kind, bool(fmt & 0x80), stride, count, scale, shift, box[1::2], box[::2], evlr_offset, n_evlrs)


def read_records(f, header: LasHeader, size: int) -> list[dict]:
    """The variable length records that describe the reference system, those behind the points included."""
    out = []
    for at, n, long in ((header.header_size, header.n_vlrs, False), (header.evlr_offset, header.n_evlrs, True)):
        for _ in range(n if at else 0):
            f.seek(at)
            head = f.read(60 if long else 54)
            if len(head) < (60 if long else 54):
                break
            user, rid = head[2:18].split(b"\0")[0].decode("latin-1"), struct.unpack_from("<H", head, 18)[0]
            length = struct.unpack_from("<Q" if long else "<H", head, 20)[0]
            at += len(head) + length
            if at > size:
                break
            if user == "LASF_Projection" and rid in RECORDS and length <= MAX_RECORD_BYTES:
                out.append({"user_id": user, "record_id": rid, "description": head[28 if long else 22 :].split(b"\0")[0].decode("latin-1"), "data": f.read(length)})
    return out


def decode(raw: np.ndarray, header: LasHeader, origin, first: int, keep_every: int, colour_scale: float | None, columns: list[str]) -> pa.RecordBatch:
    """Arrow columns of records (n, stride) of bytes; ``first`` is the index of the first."""
    pid = np.arange(first, first + len(raw), dtype=np.int64)
    if keep_every > 1:
        on = pid % keep_every == 0
        raw, pid = raw[on], pid[on]
    _, rgb, cls, src = LAYOUTS[header.format]
    at = lambda o, t, k=1: np.ascontiguousarray(raw[:, o : o + np.dtype(t).itemsize * k]).view(t)
    s, b = header.scale, header.shift
    modern = header.format >= 6
    make = {
        "pid": lambda: pid,
        "x": lambda: at(0, "<i4")[:, 0] * s[0] + (b[0] - origin[0]),
        "y": lambda: at(8, "<i4")[:, 0] * s[2] + (b[2] - origin[1]),
        "z": lambda: -(at(4, "<i4")[:, 0] * s[1] + (b[1] + origin[2])) + 0.0,
        "intensity": lambda: at(12, "<u2")[:, 0].astype(np.float64),
        "return_number": lambda: (raw[:, 14] & (0xF if modern else 0x7)).astype(np.int16),
        "number_of_returns": lambda: ((raw[:, 14] >> (4 if modern else 3)) & (0xF if modern else 0x7)).astype(np.int16),
        "classification": lambda: (raw[:, cls] & (0xFF if modern else 0x1F)).astype(np.int16),
        "point_source_id": lambda: at(src, "<u2")[:, 0].astype(np.int32),
    }
    for k, c in enumerate("rgb"):
        make[c] = (lambda k=k: pa.nulls(len(pid), pa.int16())) if rgb is None else (lambda k=k: (at(rgb, "<u2", 3)[:, k] / (colour_scale or 1)).astype(np.int16))
    return pa.RecordBatch.from_arrays([x if isinstance(x := make[c](), pa.Array) else pa.array(x) for c in columns], columns)


@dataclass
class _Range(InputPartition):
    file: int
    first: int
    count: int


@dataclass
class LasFile:
    """One file of a scan: its header, records of the reference system, whole points, and the number of the first in the scan."""

    path: str
    header: LasHeader
    records: list[dict]
    count: int
    colour_scale: float | None
    first: int = 0

    @staticmethod
    def of(path: str) -> LasFile:
        with files.open_at(path) as f:
            size = f.size()
            header = parse_header(f.read(375))
            if header is None:
                raise ValueError(f"{path} is no LAS file that can be read")
            if header.compressed:
                raise ValueError(f"{path} is compressed (LAZ); decompress it first, no decoder is part of this package")
            # A file that was cut short ends with the last whole record.
            count = min(header.count, max(0, size - header.offset) // header.stride)
            return LasFile(path, header, read_records(f, header, size), count, colour_scale(f, header, count))


def colour_scale(f, header: LasHeader, count: int) -> float | None:
    """257 where a sample of runs over the file holds 16-bit colours."""
    rgb = LAYOUTS[header.format][1]
    if rgb is None or not count:
        return None
    top = 0
    for k in range(64):
        first = count * k // 64
        f.seek(header.offset + first * header.stride)
        raw = f.read(min(64, count - first) * header.stride)
        raw = np.frombuffer(raw[: len(raw) // header.stride * header.stride], np.uint8).reshape(-1, header.stride)
        if len(raw):
            top = max(top, int(np.ascontiguousarray(raw[:, rgb : rgb + 6]).view("<u2").max()))
    return 257.0 if top > 255 else 1.0


class LasReader(DataSourceReader):
    """One or many files as one scan: points are numbered on from file to file and share one local frame."""

    def __init__(self, paths: list[str], options, columns: list[str]):
        self.columns = columns
        self.files = files.each(LasFile.of, paths)
        self.count = 0
        for f in self.files:
            f.first = self.count
            self.count += f.count
        references = {reference_of(f.records)["epsg"] for f in self.files} - {None}
        if len(references) > 1:
            raise ValueError(f"the files of a scan share one reference system, not {', '.join(map(str, sorted(references)))}")
        self.header, self.records = self.files[0].header, self.files[0].records
        most = int(options.get("maxPoints", 0) or 0)
        self.keep_every = int(options.get("keepEvery", 0) or 0) or (max(1, -(-self.count // most)) if most else 1)
        self.block_bytes = int(options.get("blockBytes", BLOCK_BYTES))
        usable = [f.header for f in self.files if f.header.usable_extent]
        whole = replace(usable[0], low=tuple(map(min, *(h.low for h in usable), usable[0].low)), high=tuple(map(max, *(h.high for h in usable), usable[0].high))) if usable else self.header
        self.origin = files.origin_of(options) or whole.origin

    def partitions(self):
        out = []
        for k, f in enumerate(self.files):
            block = max(1, self.block_bytes // f.header.stride)
            out += [_Range(k, i, min(block, f.count - i)) for i in range(0, f.count, block)]
        return out or [_Range(0, 0, 0)]

    def read(self, part: _Range):
        if not part.count:
            return
        own = self.files[part.file]
        stride = own.header.stride
        with files.open_at(own.path) as f:
            f.seek(own.header.offset + part.first * stride)
            for i in range(0, part.count, 65_536):
                n = min(65_536, part.count - i)
                raw = np.frombuffer(f.read(n * stride), np.uint8).reshape(-1, stride)
                yield decode(raw, own.header, self.origin, own.first + part.first + i, self.keep_every, own.colour_scale, self.columns)


class LasSource(DataSource):
    @classmethod
    def name(cls):
        return "lasscan"

    def _columns(self) -> list[str]:
        known = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
        own = [c.strip() for c in (self.options.get("columns") or "").split(",") if c.strip()] or known
        if unknown := set(own) - set(known):
            raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
        return own

    def schema(self):
        kinds = dict(c.strip().split(" ") for c in SCHEMA.split(","))
        return ", ".join(f"{c} {kinds[c]}" for c in self._columns())

    def reader(self, schema):
        return LasReader(files.of_options(self.options), self.options, self._columns())


def scan_info(path: str) -> dict:
    """Origin, counts and reference system of a scan (a file, a folder or a pattern), from headers alone."""
    r = LasReader(files.listed(path, (".las", ".laz")), {}, ["pid"])
    return {"origin": r.origin, "total": sum(f.header.count for f in r.files), "loaded": r.count, **reference_of(r.records), "records": r.records}
