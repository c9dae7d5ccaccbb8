"""One file of many executors: every part has its place, and whoever made it writes it there."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from ..sources.files import placed


def assemble(parts: DataFrame, path: str, head: bytes, total: int) -> None:
    """A file of ``head`` and then parts (``at``: their place behind the head, ``bytes``), ``total`` bytes in all.

    In a local folder, which driver and executors share, executors write into
    their places of one file, so a part that is written twice does no harm. On
    other filesystems each part becomes a file beside the target, and the filesystem
    is asked to join these, which HDFS does without reading them; where it can't,
    the error says so. The driver handles the head and the parts' places.
    """
    system, at = placed(path)
    if isinstance(system, fs.LocalFileSystem):
        tmp = f"{at}.tmp"
        with open(tmp, "wb") as f:
            f.truncate(total)
            f.write(head)

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                with open(tmp, "r+b") as f:
                    for place, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                        f.seek(len(head) + place)
                        f.write(data.as_buffer())
                yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

        parts.select("at", "bytes").mapInArrow(put, "n bigint").agg({"n": "sum"}).collect()
        os.replace(tmp, at)
        return
    folder = f"{path}.parts"

    def put_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, root = placed(folder)
        there.create_dir(root, recursive=True)
        for b in batches:
            for place, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with there.open_output_stream(f"{root}/{place:020d}") as f:
                    f.write(data.as_buffer())
            yield b.select([0])

    places = sorted(r["at"] for r in parts.select("at", "bytes").mapInArrow(put_file, "at bigint").collect())
    with system.open_output_stream(at) as f:
        f.write(head)
    jvm, conf = parts.sparkSession.sparkContext._jvm, parts.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = parts.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(places))
    for k, place in enumerate(places):
        files[k] = jvm.org.apache.hadoop.fs.Path(f"{folder}/{place:020d}")
    store = target.getFileSystem(conf)
    try:
        if places:
            store.concat(target, files)
    except Exception as e:
        raise ValueError(f"{store.getScheme()} can't join the parts in {folder}; write a folder of files instead") from e
    store.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
