"""Opening a scan by what it holds, not by its name."""

from __future__ import annotations

import json
import os
from dataclasses import is_dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import files, las, ply

EXTENSIONS = (".las", ".laz", ".ply")


def sniff(head: bytes) -> str:
    """'lasscan' or 'plyscan' by the first bytes of a file."""
    if las.parse_header(head) is not None:
        return "lasscan"
    if head.startswith(b"ply"):
        return "plyscan"
    raise ValueError("neither a LAS nor a PLY file")


def scan_name(path: str) -> str:
    stem, ext = os.path.splitext(os.path.basename(path))
    if ext.lower() not in EXTENSIONS:
        raise ValueError(f"{ext or 'no extension'}: a scan ends in {', '.join(EXTENSIONS)}")
    return stem


def register(spark: SparkSession) -> None:
    spark.dataSource.register(las.LasSource)
    spark.dataSource.register(ply.PlySource)


def read_scan(spark: SparkSession, path: str | list[str], **options: Any) -> DataFrame:
    """The points of a scan: a file, a folder, a pattern with * and ?, or a list of these, read as one scan in one local frame.

    ValueError for a wrong name, an empty file, no file at all, an unknown format, or files of both formats.
    """
    found = [f for p in ([path] if isinstance(path, str) else path) for f in files.listed(p, EXTENSIONS)]
    if not found:
        raise ValueError(f"no scan in {path}")

    def kind_of(p: str) -> str:
        scan_name(p)
        try:
            with files.open_at(p) as f:
                head = f.read(375)
        except OSError as e:
            raise ValueError(f"{p} can't be read: {e}") from e
        if not head:
            raise ValueError(f"{p} is empty")
        return sniff(head)

    kinds = set(files.each(kind_of, found))
    if len(kinds) > 1:
        raise ValueError("the files of a scan are all LAS or all PLY")
    register(spark)
    return spark.read.format(kinds.pop()).options(**{k: str(v) for k, v in options.items()}).option("scanFiles", json.dumps(found)).load(found[0])


def merged(defaults: Any, own: dict) -> Any:
    """defaults (a dataclass or a mapping) with what own sets, nested ones field by field; unknown names are left out."""
    fields = defaults if isinstance(defaults, dict) else vars(defaults)
    new = {k: merged(fields[k], v) if isinstance(v, dict) and (isinstance(fields[k], dict) or is_dataclass(fields[k])) else v for k, v in own.items() if k in fields}
    return {**defaults, **new} if isinstance(defaults, dict) else replace(defaults, **new)


def load_options(path: str | None, defaults: Any) -> Any:
    """defaults (a dataclass or a mapping, nested too) with the fields that a JSON file sets; whatever fails leaves the defaults."""
    try:
        with open(path) as f:
            own = json.load(f)
        return merged(defaults, own)
    except (OSError, TypeError, ValueError, AttributeError):
        return defaults


#: Sample surveys that the catalogue lists (names and kinds only; nothing is fetched).
SAMPLES = [("factory", "synthetic"), ("scene", "lineitem")]


def sample_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLES, "name string, kind string")
