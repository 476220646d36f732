"""Byte ranges of files read in parallel, by whatever file system pyarrow knows the path's scheme of."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

SPLIT = 64 << 20
CHUNK = 4 << 20


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of the files of a folder by name; those that begin with . or _ are passed over."""
    system, where = open_path(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(where))
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def size(path: str) -> int:
    return sum(n for _, n in listed(path))


def splits(spark: SparkSession, files: list[tuple[str, int]], begin: int = 0, step: int = SPLIT) -> DataFrame:
    """(file, a, b): byte ranges, one task each; a file's number of them is its size over ``step``."""
    rows = [(f, a, min(a + step, n)) for f, n in files for a in range(begin, n, step)]
    table = spark.createDataFrame(rows, "file string, a long, b long")
    return table.repartition(len(rows), "file", "a") if len(rows) > 1 else table


def lines(spark: SparkSession, path: str, begin: int = 0, step: int = SPLIT) -> DataFrame:
    """(at, next, line): lines that begin at byte ``begin`` of a file or later, with their offsets and their successors'.

    A line belongs to the range in which it begins; the last one may lack its end mark. Offsets tell the order.
    """
    [(file, n)] = listed(path)

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                system, where = open_path(file)
                with system.open_input_file(where) as f:
                    at = a
                    if a > begin:  # the line that runs into this range belongs to an earlier one
                        f.seek(a - 1)
                        rest, at = b"", a - 1
                        while not rest.endswith(b"\n") and (more := f.read(1 << 20)):
                            cut = more.find(b"\n")
                            rest = more if cut < 0 else more[: cut + 1]
                            at += len(rest)
                    f.seek(at)
                    held, out = b"", []
                    while at < b:
                        more = f.read(1 << 20)
                        held += more
                        parts = held.split(b"\n")
                        held = parts.pop()
                        for x in parts:
                            if at >= b:
                                break
                            out.append((at, at + len(x) + 1, x))
                            at += len(x) + 1
                        if not more:
                            if held and at < b:
                                out.append((at, at + len(held), held))
                            break
                        if len(out) > 4096:
                            yield _lines(out)
                            out = []
                    if out:
                        yield _lines(out)

    return splits(spark, [(file, n)], begin, step).mapInArrow(run, "at long, next long, line string")


def _lines(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode("utf-8") for r in rows], pa.string())], ["at", "next", "line"])


def write_whole(path: str, data: bytes) -> None:
    """Write a small file so that a reader sees the old or the new one, never a part."""
    system, where = open_path(path)
    new = f"{where}.{uuid.uuid4().hex}"
    with system.open_output_stream(new) as f:
        f.write(data)
    system.move(new, where)


def write_joined(path: str, parts: Iterable[str | bytes]) -> None:
    """Write a file from other files (by path) and bytes, one after another, as ``write_whole`` does; no more than a chunk is held."""
    system, where = open_path(path)
    new = f"{where}.{uuid.uuid4().hex}"
    with system.open_output_stream(new) as out:
        for part in parts:
            if isinstance(part, bytes):
                out.write(part)
                continue
            other, at = open_path(part)
            with other.open_input_stream(at) as f:
                while chunk := f.read(CHUNK):
                    out.write(chunk)
    system.move(new, where)


def read_whole(path: str) -> bytes | None:
    """Null if there is no such file."""
    system, where = open_path(path)
    if system.get_file_info(where).type == fs.FileType.NotFound:
        return None
    with system.open_input_file(where) as f:
        return f.read()
