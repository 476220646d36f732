"""Helpers shared by the corpus operators: table access, checkpoints, hashing."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session without one
    (tests) gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share. A session that isn't local must name it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="loam-")


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that a checkpoint has replaced.

    They go when the driver's last reference is collected, which otherwise may not happen before the job ends.
    """
    for _ in range(4):  # what one collection lets go is what the next one finds, and Spark deletes in the background
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def release() -> None:
    """Give freed memory back to the system at the end of a task: workers are used again, and keep what they don't return."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def partitions(df: DataFrame) -> int:
    """The session's shuffle width, which the caller sizes to the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_rows(batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text") -> Iterator[tuple[list, list]]:
    """(keys, texts) of slices of at most 256 rows, so that no batch is turned into Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part.column(part.schema.get_field_index(key)).to_pylist(), part.column(part.schema.get_field_index(text)).to_pylist()


# --- 64-bit hashing of words, vectorised ------------------------------------------------------
# A word's value is a polynomial over its bytes modulo 2**64, taken from prefix sums (the radix is
# odd, hence invertible), then finalised with the splitmix64 mixer. Bytes first go through a random
# table in which A-Z share the values of a-z.

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, r in enumerate((_RADIX, _INVERSE)):
            a = np.full(size, r, np.uint64)
            a[0] = 1
            _POWERS[i] = np.multiply.accumulate(a)
    return _POWERS[0], _POWERS[1]


def mix64(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> np.uint64(30))
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs without white space."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def word_hashes(text: str | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of the UTF-8 bytes; A-Z count as a-z."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    raw = np.frombuffer(data, np.uint8)
    if len(raw) > _PIECE:  # so that the table of powers stays small; pieces end between words
        got, at = [], 0
        while at < len(raw):
            stop = at + _PIECE
            while stop < len(raw) and not (gap := np.flatnonzero(_IS_SPACE[raw[stop : stop + _PIECE]]))[:1].size:
                stop += _PIECE
            stop = len(raw) if stop >= len(raw) else stop + int(gap[0])
            h, start, end = _hashed(raw[at:stop])
            got.append((h, start + at, end + at))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*got))
    return _hashed(raw)


_PIECE = 1 << 21


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = word_bounds(raw)
    if not len(start):
        return np.empty(0, np.uint64), start, end
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start]), start, end


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


class IdFilter:
    """A bitmap over hashed 64-bit ids, without false negatives and of bounded size (8 MB at most).

    It only spares work: what it lets through still has to be joined. It is built by an aggregation to
    words, so that at most ``2**20`` of them reach the driver, whatever the number of ids.
    """

    def __init__(self, ids: DataFrame, column: str, most_bits: int = 26):
        n = ids.count()
        self.bits = min(most_bits, max(10, int(16 * max(n, 1)).bit_length()))
        mask = (1 << self.bits) - 1

        def words(batches):
            for batch in batches:
                at = distinct_sorted(self.places(batch.column(0).to_numpy(zero_copy_only=False)) & mask)
                w, first = np.unique(at >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(bits.view(np.int64), pa.int64())], ["w", "b"])

        rows = ids.select(column).where(f"{column} is not null").mapInArrow(words, "w long, b long").groupBy("w").agg({"b": "bit_or"}).toArrow()
        self.words = np.zeros(max(1, (1 << self.bits) >> 6), np.uint64)
        self.words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)

    @staticmethod
    def places(ids: np.ndarray) -> np.ndarray:
        return (mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(2)).astype(np.int64)

    def maybe(self, ids: np.ndarray) -> np.ndarray:
        at = self.places(ids) & ((1 << self.bits) - 1)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def without_ids(docs: DataFrame, removed: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't among ``removed``; rows with a null id stay.

    Rows that a bitmap of the removed ids rules out pass by without a shuffle; only the others, about as
    many as are removed, meet the exact anti join.
    """
    gate = docs.sparkSession.sparkContext.broadcast(IdFilter(removed, column))

    def split(hit: bool):
        def run(batches):
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index(column))
                known = np.asarray(ids.is_valid())
                maybe = gate.value.maybe(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) & known
                part = batch.filter(pa.array(maybe if hit else ~maybe))
                if part.num_rows:
                    yield part

        return docs.mapInArrow(run, docs.schema)

    return split(False).unionByName(split(True).join(removed.select(column).distinct(), column, "left_anti").select(*docs.columns))


def with_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id may be among ``ids``: a bitmap spares a join's shuffle of others, the join must still follow."""
    gate = rows.sparkSession.sparkContext.broadcast(IdFilter(ids, column))

    def run(batches):
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(column))
            part = batch.filter(pa.array(gate.value.maybe(at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            if part.num_rows:
                yield part

    return rows.mapInArrow(run, rows.schema)


# --- packed arrays: numpy blobs shuffle at a fraction of the cost of rows -----------------------


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned integers, byte by byte (high planes of small numbers compress away)."""
    return np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()
