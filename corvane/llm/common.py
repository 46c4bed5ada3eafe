"""Shared pieces: tables, staged results in the shared folder, and byte-level text primitives."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters are all but these bytes: space and tab to carriage return.
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without: it gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_staged: list[tuple[SparkSession, str]] = []


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_staged() -> None:
    """What results were built on lives as long as the driver: they may still be read until then."""
    for spark, path in _staged:
        _drop(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, dropped when the driver ends."""
    path = f"{shared_dir(spark)}/corvane/{uuid.uuid4().hex}-{name}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    return len(_staged)


def drop_since(since: int) -> None:
    """Drop all tables staged since a mark but the last, when nothing else of them will be read."""
    for spark, path in _staged[since:-1]:
        _drop(spark, path)
    del _staged[since:-1]


def split_join(rows: DataFrame, own: DataFrame, on, hot: Column, how: str = "inner") -> DataFrame:
    """rows joined with own, which has one row a key, on on(rows, own).

    The rows of own that are hot (whose number the caller bounds) are broadcast
    and met where the rows of their key lie; all others meet in a shuffle that
    holds no hot key.
    """
    many, few = own.filter(hot), own.filter(~hot)
    there = rows.join(F.broadcast(many), on(rows, many))
    return there.unionByName(rows.join(F.broadcast(many), on(rows, many), "left_anti").join(few, on(rows, few), how))


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let no Arrow batch of this session hold much more than `size` bytes: texts differ in length by many orders."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(name, str(size))


def _trim() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another libc keeps it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(f):
    """An Arrow function after whose batches, or whose group, a worker keeps no more memory than it needs: idle ones stay beside the next stage's."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def batches(*args):
            try:
                yield from f(*args)
            finally:
                _trim()

        return batches

    @functools.wraps(f)
    def group(*args):
        try:
            return f(*args)
        finally:
            _trim()

    return group


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16**13))


# -- text as bytes ---------------------------------------------------------


def _table_of(values) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(values)] = True
    return t


IS_SPACE = _table_of([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, limit: int = _CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, end row, their bytes, offsets within those bytes."""
    raw, offsets = text_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, P, P^2, ... modulo 2^64, or those of P's inverse."""
    key = "inverse" if inverse else "plain"
    if len(_powers.get(key, ())) < n:
        steps = np.full(max(n, 2 * _CHUNK), _P_INV if inverse else _P, U64)
        steps[0] = 1
        if n > 4 * _CHUNK:
            return np.cumprod(steps)
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * P^position over [i, j)."""
    h = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, equal for equal bytes wherever they stand."""
    inverse = powers(len(h), inverse=True)
    return mix((h[end] - h[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the number of words before it (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)
