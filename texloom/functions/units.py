"""Reading strips as units: the words of each pixel, pair of pixels or block as plain long columns.

This is the one step that Columns lack, bytes to numbers; it knows sizes, not formats. All decoding is Column arithmetic
over lo and hi, the first and second 64 bits of a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

#: Units of one batch of rows.
UNITS = 1 << 16
#: A struct column with the geometry of a row's format.
UNIT = "texloom unit"
GEOMETRY = ["size", "across", "high", "plane1", "plane2"]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values begin (one more than values), and the bytes of a binary column."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    starts = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return starts, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _bytes_of(starts: np.ndarray, data: np.ndarray, size: int) -> np.ndarray:
    """Values of `size` bytes each as the rows of a table."""
    if len(starts) == 1:
        return data[starts[0] : starts[0] + size].reshape(1, size)
    return data[starts[:, None] + np.arange(size)]


def _equal_units(table: np.ndarray, width: int, rows: int, size: int, wide: int, plane1: int, plane2: int) -> tuple[np.ndarray, ...]:
    """lo, hi and the place of each unit of strips of one size and geometry, whose bytes are the rows of a table."""
    m = len(table)
    if not plane1:
        n = table.shape[1] // size
        words = np.zeros((m * n, 16), np.uint8)
        words[:, :size] = table.reshape(m * n, size)
        words = words.view("<i8")
        return words[:, 0], words[:, 1], np.tile(np.arange(wide), m * n // wide), np.tile(np.repeat(np.arange(n // wide), wide), m)
    half, split = -(-width // 2), plane1 * width * rows
    luma = np.ascontiguousarray(table[:, :split]).view(f"<u{plane1}").astype(np.int64)
    chroma = np.ascontiguousarray(table[:, split:]).view(f"<u{plane2}").astype(np.int64)
    x, y = np.tile(np.arange(width), rows), np.repeat(np.arange(rows), width)
    return luma.reshape(-1), chroma[:, y // 2 * half + x // 2].reshape(-1), np.tile(x, m), np.tile(y, m)


def strip_units(strips: DataFrame, width_column: str = "width", rows_column: str = "rows") -> DataFrame:
    """A row for each unit of each strip: the other columns of `strips`, unit_x, unit_y, lo, hi.

    `strips` has data, width and rows (or columns of other names), and in `UNIT` the geometry of its format: size (bytes of a unit), across and high (its
    pixels), plane1 and plane2 (bytes of a luma sample and of a chroma pair, 0 but for two planes, where each pixel is a unit
    with its luma in lo and its chroma in hi). Strips of another length, null or empty ones give no rows; `UNIT` is dropped.
    Strips of one size and geometry are read together, at most about `UNITS` units at once."""
    own = [c for c in strips.columns if c not in ("data", UNIT)]
    more = ["unit_x", "unit_y", "lo", "hi"]
    schema = StructType([strips.schema[c] for c in own] + [StructField(c, LongType()) for c in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, data = _binary(batch.column("data"))
            unit = batch.column(UNIT)
            given = [batch.column(width_column), batch.column(rows_column), *(pc.struct_field(unit, c) for c in GEOMETRY)]
            table = np.stack([pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in given] + [np.diff(starts)], axis=1)
            valid = pc.is_valid(batch.column("data")).to_numpy(zero_copy_only=False) & pc.is_valid(unit).to_numpy(zero_copy_only=False) & (table[:, 0] > 0) & (table[:, 1] > 0)
            index = np.flatnonzero(valid)
            if not len(index):
                continue
            kinds, of = np.unique(table[index], axis=0, return_inverse=True)
            order = np.argsort(of.reshape(-1), kind="stable")
            for kind, found in zip(kinds.tolist(), np.split(index[order], np.cumsum(np.bincount(of.reshape(-1), minlength=len(kinds)))[:-1]), strict=True):
                width, high, size, across, rows, plane1, plane2, length = kind
                wide = -(-width // across)
                n = width * high if plane1 else wide * -(-high // rows)
                if length != (plane1 * n + plane2 * -(-width // 2) * -(-high // 2) if plane1 else n * size):
                    continue
                step = max(1, UNITS // n)
                for at in range(0, len(found), step):
                    part = found[at : at + step]
                    lo, hi, x, y = _equal_units(_bytes_of(starts[part], data, length), width, high, size, wide, plane1, plane2)
                    taken = pa.array(np.repeat(part, n))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in own), pa.array(x), pa.array(y), pa.array(lo), pa.array(hi)], [*own, *more])

    return strips.mapInArrow(run, schema)


def unit_of(size: int, across: int, high: int) -> Column:
    """The geometry of a format in one plane."""
    return F.struct(*(F.lit(v).alias(c) for c, v in zip(GEOMETRY, (size, across, high, 0, 0), strict=True))).alias(UNIT)


def _groups(valid: np.ndarray, *keys: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    """The valid rows that agree in all keys: the keys and the rows' numbers, ascending."""
    index = np.flatnonzero(valid)
    if len(index):
        found, of = np.unique(np.stack([k[index] for k in keys], axis=1), axis=0, return_inverse=True)
        order = np.argsort(of.reshape(-1), kind="stable")
        yield from zip(found.tolist(), np.split(index[order], np.cumsum(np.bincount(of.reshape(-1)))[:-1]), strict=True)


def _ints(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


@F.arrow_udf(returnType=ArrayType(LongType()))
def numbers_of(data: pa.Array, size: pa.Array) -> pa.Array:
    """Bytes as little-endian numbers of 1 to 8 bytes (of 8 bytes signed); null where they are not whole numbers.

    Values of one length and size are read together."""
    if not len(data):
        return pa.array([], pa.list_(pa.int64()))
    starts, raw = _binary(data)
    lengths, sizes = np.diff(starts), _ints(size)
    valid = pc.is_valid(data).to_numpy(zero_copy_only=False) & (sizes > 0)
    valid[valid] = lengths[valid] % sizes[valid] == 0
    counts = np.zeros(len(data), np.int64)
    counts[valid] = lengths[valid] // sizes[valid]
    ends = np.concatenate([[0], np.cumsum(counts)])
    values = np.zeros(ends[-1], np.int64)
    for (length, n), rows in _groups(valid & (lengths > 0), lengths, sizes):
        each = length // n
        step = max(1, UNITS // each)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            table = np.zeros((len(part) * each, 8), np.uint8)
            table[:, :n] = _bytes_of(starts[part], raw, length).reshape(-1, n)
            values[ends[part][:, None] + np.arange(each)] = table.view("<i8").reshape(len(part), each)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), mask=pa.array(~valid))


def with_bytes(frame: DataFrame, numbers: str, size: str, name: str) -> DataFrame:
    """The inverse of `numbers_of`: `numbers` and `size` give way to `name`, the low bytes of each number, little-endian."""
    own = [c for c in frame.columns if c not in (numbers, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column(numbers), _ints(batch.column(size))
            valid = pc.is_valid(lists).to_numpy(zero_copy_only=False)
            counts = np.where(valid, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            given = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")  # of the valid lists only
            starts, ends = np.cumsum(counts) - counts, np.concatenate([[0], np.cumsum(counts * sizes)])
            out = np.zeros(ends[-1], np.uint8)
            for (count, n), rows in _groups(valid & (counts * sizes > 0), counts, sizes):
                step = max(1, UNITS // count)
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    low = given[starts[part][:, None] + np.arange(count)].view(np.uint8).reshape(len(part), count, 8)[:, :, :n]
                    out[ends[part][:, None] + np.arange(count * n)] = low.reshape(len(part), count * n)
            if ends[-1] < 1 << 31:
                made = pa.Array.from_buffers(pa.binary(), len(lists), [pa.array(valid).buffers()[1], pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
            else:
                made = pa.array([out[ends[i] : ends[i + 1]].tobytes() if valid[i] else None for i in range(len(lists))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), made], [*own, name])

    return frame.mapInArrow(run, StructType([*(frame.schema[c] for c in own), StructField(name, BinaryType())]))
