"""PLY scans as a Spark data source: binary little-endian files in byte ranges; ASCII and big-endian ones in one task each.

``spark.read.format("plyscan").load(path)``; options ``keepEvery``, ``maxPoints``, ``blockBytes`` as for LAS.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

#: Scalar types of the format (fixed values).
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
INTENSITY, CLASS = ("intensity", "scalar_intensity"), ("classification", "scalar_classification", "class")
SCHEMA = "pid bigint, x double, y double, z double, intensity double, classification smallint, r smallint, g smallint, b smallint"
BLOCK_BYTES = 16 << 20


@dataclass(frozen=True)
class PlyHeader:
    format: str
    count: int
    names: tuple[str, ...]
    types: tuple[str, ...]
    offset: int

    @property
    def dtype(self) -> np.dtype:
        end = ">" if self.format == "binary_big_endian" else "<"
        return np.dtype([(n, end + t) for n, t in zip(self.names, self.types, strict=True)])


def parse_header(data: bytes) -> PlyHeader | None:
    """None if it is no PLY header with scalar vertex properties before all other elements."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        return None
    offset = data.find(b"\n", end) + 1
    fmt, count, names, types, element = "", 0, [], [], None
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            fmt = w[1]
        elif w[0] == "element":
            if element is None and w[1] != "vertex":
                return None
            element = w[1]
            count = int(w[2]) if element == "vertex" else count
        elif w[0] == "property" and element == "vertex":
            if w[1] not in TYPES:
                return None
            names.append(w[2].lower())
            types.append(TYPES[w[1]])
    if not {"x", "y", "z"} <= set(names) or len(set(names)) != len(names):
        return None
    return PlyHeader(fmt, count, tuple(names), tuple(types), offset)


@dataclass
class _Range(InputPartition):
    file: int
    first: int
    count: int


@dataclass
class PlyFile:
    path: str
    header: PlyHeader
    count: int
    first: int = 0

    @staticmethod
    def of(path: str) -> PlyFile:
        with files.open_at(path) as f:
            header = parse_header(f.read(65_536))
            if header is None:
                raise ValueError(f"{path} is no PLY file that can be read")
            return PlyFile(path, header, header.count if header.format == "ascii" else min(header.count, (f.size() - header.offset) // header.dtype.itemsize))

    def rows(self, first: int, n: int) -> np.ndarray:
        with files.open_at(self.path) as f:
            if self.header.format == "ascii":
                f.seek(self.header.offset)
                lines = [x.split() for _, x in zip(range(first + n), io.BufferedReader(f), strict=False)][first:]
                return np.array([tuple(map(float, x[: len(self.header.names)])) for x in lines if x], dtype=[(c, "f8") for c in self.header.names])
            f.seek(self.header.offset + first * self.header.dtype.itemsize)
            return np.frombuffer(f.read(n * self.header.dtype.itemsize), self.header.dtype)

    def sample(self) -> np.ndarray | None:
        """x, y, z of runs over the file; of a text file, all."""
        if not self.count:
            return None
        runs = [self.rows(0, self.count)] if self.header.format == "ascii" else [self.rows(self.count * k // 32, min(32, self.count - self.count * k // 32)) for k in range(32)]
        return np.concatenate([np.stack([r[c].astype(float) for c in "xyz"], 1) for r in runs])


class PlyReader(DataSourceReader):
    """One or many files as one scan: points are numbered on from file to file and share one local frame."""

    def __init__(self, paths: list[str], options):
        self.files = files.each(PlyFile.of, paths)
        self.count = 0
        for f in self.files:
            f.first = self.count
            self.count += f.count
        most = int(options.get("maxPoints", 0) or 0)
        self.keep_every = int(options.get("keepEvery", 0) or 0) or (max(1, -(-self.count // most)) if most else 1)
        self.block_bytes = int(options.get("blockBytes", BLOCK_BYTES))
        # The centre of samples of all files, to the next thousand, where none is asked for.
        own = [s for s in files.each(lambda p: next(f for f in self.files if f.path == p).sample(), [f.path for f in self.files]) if s is not None]
        low, high = (getattr(np.concatenate(own), k)(0) if own else np.zeros(3) for k in ("min", "max"))
        self.origin = files.origin_of(options) or tuple(math.floor((a + b) / 2 / 1000 + 0.5) * 1000.0 for a, b in zip(low, high, strict=True))

    def partitions(self):
        out = []
        for k, f in enumerate(self.files):
            block = max(1, f.count) if f.header.format == "ascii" else max(1, self.block_bytes // f.header.dtype.itemsize)
            out += [_Range(k, i, min(block, f.count - i)) for i in range(0, f.count, block)]
        return out or [_Range(0, 0, 0)]

    def read(self, part: _Range):
        if not part.count:
            return
        own = self.files[part.file]
        rows = own.rows(part.first, part.count)
        pid = np.arange(part.first, part.first + len(rows), dtype=np.int64) + own.first
        if self.keep_every > 1:
            on = pid % self.keep_every == 0
            rows, pid = rows[on], pid[on]
        names = own.header.names
        kinds = dict(zip(names, own.header.types, strict=True))
        find = lambda options: next((c for c in options if c in names), None)
        none = lambda t: pa.nulls(len(pid), t)
        cols = [pa.array(pid), *(pa.array(rows[c].astype(np.float64) - o) for c, o in zip("xyz", self.origin, strict=True))]
        i, k = find(INTENSITY), find(CLASS)
        cols.append(pa.array(rows[i].astype(np.float64)) if i else none(pa.float64()))
        cols.append(pa.array(rows[k].astype(np.int16)) if k else none(pa.int16()))
        for c in ("red", "green", "blue"):
            # Colours of more than a byte are brought to a byte.
            cols.append(none(pa.int16()) if c not in names else pa.array((rows[c] / (256 if kinds[c] not in ("u1", "i1") else 1)).astype(np.int16)))
        yield pa.RecordBatch.from_arrays(cols, [c.strip().split(" ")[0] for c in SCHEMA.split(",")])


class PlySource(DataSource):
    @classmethod
    def name(cls):
        return "plyscan"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PlyReader(files.of_options(self.options), self.options)
