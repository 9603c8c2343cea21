"""Helpers shared by the corpus operators: scratch tables, Arrow slicing, word hashing on NumPy arrays."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where the session names none and has no cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="texloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: survives lost executors and is read by columns."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/texloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.written_path = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Remove tables that `written` returned, once nothing reads them any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give this Python process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if libc := ctypes.util.find_library("c"):
        trim = getattr(ctypes.CDLL(libc), "malloc_trim", None)
        if trim:
            trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which a reused Python worker gives free memory back, so that idle workers of earlier stages stay small."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows: Spark's default of 10,000 texts a batch is held several times over in each task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Row slices of at most `limit` text bytes each (a longer text comes alone), so that temporary arrays stay bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


# Arithmetic modulo 2^64 with an odd base, so that every power has an inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 18


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            a, b = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            a[0] = b[0] = 1
            _powers, _inverses = np.cumprod(a), np.cumprod(b)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending; by sorting, which is several times as fast as np.unique's hash table."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def prefix_sums(data: bytes | np.ndarray) -> np.ndarray:
    """Sums from which `window_hashes` has the hash of any run of the bytes."""
    codes = np.frombuffer(data, np.uint8)
    powers, _ = _tables(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end."""
    _, inverses = _tables(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def _piece_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[buf], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    hashes = window_hashes(prefix_sums(buf), starts, ends)
    return starts, ends, hashes


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word (a run of bytes other than space and tab to carriage return).

    Long inputs are worked in pieces cut at white space; a piece is longer than the limit only where one word is."""
    parts, start = [], 0
    while start < len(data):
        stop = min(len(data), start + _PIECE)
        if stop < len(data):
            window = np.frombuffer(data, np.uint8, stop - start, start)
            spaces = np.flatnonzero(_SPACE[window[-65536:]])
            if len(spaces):
                stop = stop - min(65536, len(window)) + int(spaces[-1]) + 1
            else:
                rest = [p for p in (data.find(s, stop) for s in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if p >= 0]
                stop = min(rest, default=len(data) - 1) + 1
        s, e, h = _piece_words(np.frombuffer(data, np.uint8, stop - start, start))
        parts.append((s + start, e + start, h))
        start = stop
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def joined(texts: list[bytes | None]) -> tuple[bytes, np.ndarray]:
    """All texts with a line feed after each, and where each begins (with the total length last)."""
    texts = [t or b"" for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return b"\n".join(texts) + b"\n" if texts else b"", offsets


def per_document(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds into the words: document i has words bounds[i]:bounds[i+1]."""
    return np.searchsorted(starts, offsets, "left")


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered hash of two hashes."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()
