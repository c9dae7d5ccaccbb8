"""Scan files wherever driver and executors reach them: local paths, and hdfs, s3, gs and abfs addresses through Arrow's filesystems."""

from __future__ import annotations

import fnmatch
import json
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs

#: Headers are read by so many threads.
THREADS = 16


def placed(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of an address and the path in it."""
    path = path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_at(path: str):
    """A file that can be read from any byte; close it, or use it in a with statement."""
    system, at = placed(path)
    return system.open_input_file(at)


def listed(path: str, extensions: tuple[str, ...]) -> list[str]:
    """The files that a path stands for, by name: itself, those of a folder with one of the extensions, or those that match a pattern with * and ?."""
    system, at = placed(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if any(c in at for c in "*?["):
        folder, _, pattern = at.rpartition("/")
        found = system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
        return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))
    if system.get_file_info(at).type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(at))
        return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(extensions))
    return [path]


def of_options(options) -> list[str]:
    """The files that a data source was given: the option scanFiles (JSON) or path."""
    return json.loads(options["scanFiles"]) if options.get("scanFiles") else [options["path"]]


def origin_of(options) -> tuple[float, float, float] | None:
    """The origin of the local frame that a data source was asked for: the option origin, as x,y,z."""
    if not options.get("origin"):
        return None
    x, y, z = map(float, options["origin"].split(","))
    return x, y, z


def each(f, paths: list[str]) -> list:
    """f of every path, in order, several at a time."""
    if len(paths) == 1:
        return [f(paths[0])]
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(f, paths))
