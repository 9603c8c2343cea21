"""Encoding strips of pixels: Columns for packed, sub-sampled and bi-planar formats (operators/packing), NumPy kernels over Arrow
batches for block formats. No shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from texloom.functions import kernels
from texloom.functions.formats import pixel_info
from texloom.operators import packing

#: Pixels encoded at once.
STACK = 1 << 16


def strips(frame: DataFrame, names: list[str], channels: str = "rgba", precision: str = "u8") -> DataFrame:
    """A row for each strip and format: the other columns of `frame`, format, and data encoded in it.

    `frame` has columns data (pixels row by row, in the given channels and precision), width and rows. What does not hold
    exactly width x rows pixels becomes null; so does an odd size in a bi-planar format, whose chroma needs whole cells."""
    plain = [n for n in names if n in packing.NAMES]
    rest = [n for n in names if n not in packing.NAMES]
    if plain and rest:
        return packing.strips(frame, plain, channels, precision).unionByName(_blocks(frame, rest, channels, precision))
    return packing.strips(frame, plain, channels, precision) if plain else _blocks(frame, rest, channels, precision)


def _blocks(frame: DataFrame, names: list[str], channels: str, precision: str) -> DataFrame:
    """Block formats: equal strips of a batch are encoded as one raster."""
    own = [c for c in frame.columns if c not in ("data", "width", "rows", "format")]
    dtype, n = np.dtype(kernels.TYPES[precision]), {"grayscale": 1, "alpha": 1, "rgb": 3, "rgba": 4}[channels]

    def encoded(name: str, rows: list[tuple[bytes, int, int] | None]) -> list[bytes | None]:
        one = lambda r: kernels.encode(name, np.frombuffer(r[0], dtype).reshape(r[2], r[1], n), channels)
        # strips of one size lie below each other as one raster, where each ends with whole blocks
        result: list[bytes | None] = [None] * len(rows)
        sizes: dict[tuple[int, int], list[int]] = {}
        for i, r in enumerate(rows):
            if r:
                sizes.setdefault(r[1:], []).append(i)
        for (width, height), at in sizes.items():
            step = max(1, STACK // (width * height)) if height % pixel_info(name)[3] == 0 else 1
            for start in range(0, len(at), step):
                some = at[start : start + step]
                out = one((b"".join(rows[i][0] for i in some), width, height * len(some)))
                each = len(out) // len(some)
                for k, i in enumerate(some):
                    result[i] = out[k * each : (k + 1) * each]
        return result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("data", "width", "rows"))
            rows = [(d, w, h) if d is not None and w and h and len(d) == w * h * n * dtype.itemsize else None for d, w, h in zip(*columns, strict=True)]
            for name in names:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array([name] * len(rows)), pa.array(encoded(name, rows), pa.binary())], [*own, "format", "data"])

    return frame.mapInArrow(run, StructType([*(frame.schema[c] for c in own), StructField("format", StringType()), StructField("data", BinaryType())]))
