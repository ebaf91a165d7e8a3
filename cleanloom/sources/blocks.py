"""First and last blocks of many files, without reading what lies between.

Spark lists the files and deals them out; each task opens its files and takes a block from either end, more only where a block
holds too few lines. A file in a store that Python cannot open is read by Spark itself, and cut afterwards.
"""

from __future__ import annotations

import bz2
import gzip
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.core import as_list

#: Bytes taken from an end of a file.
BLOCK = 65536

BREAK = r"\r\n|\n|\r"


def listing(spark: SparkSession, paths) -> DataFrame:
    """(file, size) of the files under the paths; their content is not read."""
    return spark.read.format("binaryFile").load(as_list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"))


def _open(uri: str):
    """A file by its address, decompressed as Spark's text reader does it; fails for stores that are not known here."""
    where = urlsplit(uri)
    if where.scheme in ("", "file"):
        raw = open(unquote(where.path), "rb")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(unquote(uri))
        raw = store.open_input_file(path)
    return gzip.open(raw) if uri.endswith(".gz") else bz2.open(raw) if uri.endswith(".bz2") else raw


def _breaks(data: bytes) -> int:
    return data.count(b"\n") or data.count(b"\r")


def _head(f, lines: int, block: int) -> tuple[bytes, bool]:
    """The first whole lines, at least so many unless the file ends before, and whether that is the whole file."""
    data = f.read(block)
    while True:
        more = f.read(block)
        if not more:
            return data, True
        if _breaks(data) >= lines:
            return data[: max(data.rfind(b"\n"), data.rfind(b"\r")) + 1], False
        data += more


def _tail(f, size: int, lines: int, block: int) -> bytes:
    """The last whole lines, at least so many unless the file begins after."""
    data, at = b"", size
    while at > 0:
        step = min(block, at)
        at -= step
        f.seek(at)
        data = f.read(step) + data
        if _breaks(data.rstrip(b"\r\n")) > lines:
            cut = data.find(b"\n") if b"\n" in data else data.find(b"\r")
            return data[cut + 1:]
    return data


def edges(spark: SparkSession, paths, lines: int = 20, last: int = 0, block: int = BLOCK) -> DataFrame:
    """(file, size, head, whole, tail): the first lines of each file, whether they are all of it, and its last lines if asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri, size in zip(batch.column("file").to_pylist(), batch.column("size").to_pylist()):
                try:
                    with _open(uri) as f:
                        head, whole = _head(f, lines, block)
                        packed = uri.endswith((".gz", ".bz2"))
                        out.append((head, whole, head if whole else None if packed or not last else _tail(f, size, last, block)))
                except FileNotFoundError:
                    raise
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
                    out.append((None, None, None))  # no store that Python knows
            head, whole, tail = (list(c) for c in zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("size"), pa.array(head, pa.binary()), pa.array(whole, pa.bool_()), pa.array(tail, pa.binary())],
                                             names=["file", "size", "head", "whole", "tail"])

    files = listing(spark, paths)
    if _python_opens(files):
        return files.mapInArrow(read, "file string, size long, head binary, whole boolean, tail binary")
    content = spark.read.format("binaryFile").load(as_list(paths))
    return content.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("content").alias("head"), F.lit(True).alias("whole"), F.col("content").alias("tail"))


def _python_opens(files: DataFrame) -> bool:
    """Whether Python can open the stores of the files, by the schemes of their addresses."""
    schemes = [r[0] for r in files.select(F.substring_index("file", ":", 1)).distinct().limit(100).collect()]
    for s in schemes:
        if s not in ("file", "s3", "s3a", "gs", "gcs", "hdfs", "abfs", "abfss"):
            return False
    return True


def decoded(data: Column, latin: Column) -> Column:
    """Bytes as text: UTF-8, or Latin-1 where ``latin`` holds; a mark of byte order at the start is dropped."""
    text = F.when(latin, F.decode(data.cast("binary"), "ISO-8859-1")).otherwise(data.cast("string"))
    return F.when(text.startswith("﻿"), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def is_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))
