"""Vectors in a binary file: for each a 32-bit id, a 32-bit count, then the values, all little-endian."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listed, open_path, splits


def write(vectors: DataFrame, path: str, half: bool = False) -> int:
    """Files of (doc_id, embedding) in a folder, one per task; returns the number of vectors.

    ``half``: 16-bit values, the count being that of their bytes. A task writes under a name of its own and moves the file
    into place at its end, so a task that runs twice leaves one file. Null vectors aren't written. Ids must fit 32 bits.
    """
    system, where = open_path(path)
    system.create_dir(where)
    for f, _ in listed(path):
        system.delete_file(open_path(f)[1])

    def run(batches):
        system, where = open_path(path)
        task, rows = TaskContext.get().partitionId(), 0
        new = f"{where}/.{uuid.uuid4().hex}"
        with system.open_output_stream(new) as f:
            for batch in batches:
                for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = np.asarray(v, "<f2" if half else "<f4").tobytes()
                    f.write(np.array([i, len(data) if half else len(v)], "<u4").tobytes() + data)
                    rows += 1
        system.move(new, f"{where}/part-{task:06d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    rows = vectors.where("embedding is not null and doc_id between 0 and 4294967295").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, "rows long").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def read(spark: SparkSession, path: str, half: bool = False) -> DataFrame:
    """(doc_id, embedding) of a file or of a folder's files; all vectors must have the length of the first, or an error is raised.

    With one length all records have one size, so ranges of a file are read by separate tasks.
    """
    files = [(f, n) for f, n in listed(path) if n]
    if not files:
        return spark.createDataFrame([], "doc_id long, embedding array<float>")
    system, where = open_path(files[0][0])
    with system.open_input_file(where) as f:
        count = int(np.frombuffer(f.read(8), "<u4")[1])
    width = 8 + count * (1 if half else 4)

    def run(batches):
        for batch in batches:
            for file, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, where = open_path(file)
                with system.open_input_file(where) as f:
                    f.seek(a)
                    while a < b:
                        raw = f.read(min(b - a, width * 8192))
                        if not raw or len(raw) % width:
                            raise ValueError(f"{file}: a record is cut off, or vectors differ in length")
                        rows = np.frombuffer(raw, np.uint8).reshape(-1, width)
                        head = np.ascontiguousarray(rows[:, :8]).view("<u4")
                        if (head[:, 1] != count).any():
                            raise ValueError(f"{file}: vectors differ in length")
                        values = np.ascontiguousarray(rows[:, 8:]).view("<f2" if half else "<f4").astype(np.float32)
                        offsets = np.arange(len(rows) + 1, dtype=np.int32) * values.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(head[:, 0].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))], ["doc_id", "embedding"])
                        a += len(raw)

    step = max(1, (64 << 20) // width) * width
    return splits(spark, files, 0, step).mapInArrow(run, "doc_id long, embedding array<float>")
