"""Pixel-level operators: packing, cropping, strips, chroma, mip levels, dithering, cube maps and quality metrics.

`pixels` tables have x, y and 8-bit channels; everything is DataFrame functions but the global error diffusion, which is a
recurrence over the surface and so runs as one vectorised group a surface.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.functions import bc_tables
from texloom.functions import scalar as S
from texloom.functions.local import local_table

# Channels of packed formats from the lowest bit up: (channel, bits).
PACKED = {
    "b5g6r5": [("b", 5), ("g", 6), ("r", 5)],
    "b5g5r5a1": [("b", 5), ("g", 5), ("r", 5), ("a", 1)],
    "b4g4r4a4": [("b", 4), ("g", 4), ("r", 4), ("a", 4)],
    "r10g10b10a2": [("r", 10), ("g", 10), ("b", 10), ("a", 2)],
}


def narrow(c: Column, width: int) -> Column:
    """An 8-bit number in `width` bits, rounded."""
    top = (1 << width) - 1
    return F.floor((c.cast("long") * (2 * top) + 255) / F.lit(510.0)).cast("long")


def pack(channels: dict[str, Column], spec: list[tuple[str, int]]) -> Column:
    out, at = F.lit(0).cast("long"), 0
    for name, width in spec:
        out = out.bitwiseOR(S.shl(narrow(channels[name], width), at))
        at += width
    return out


def pack_565(r: Column, g: Column, b: Column) -> Column:
    return pack({"r": r, "g": g, "b": b}, PACKED["b5g6r5"])


def unpack_565(df: DataFrame) -> DataFrame:
    """Adds r2, g2, b2 from the word w."""
    w = F.col("w")
    return df.withColumns({"r2": S.unorm(S.bits(w, 11, 5), 5, 8), "g2": S.unorm(S.bits(w, 5, 6), 6, 8), "b2": S.unorm(S.bits(w, 0, 5), 5, 8)})


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The rectangle, moved to the origin; a filter, so it reaches the scan where x and y are columns of it."""
    inside = (F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)
    return pixels.filter(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def strip_rows(width: int, preferred_pixels: int, multiple: int) -> int:
    """Rows of a strip: the preferred pixels by width, rounded down to a multiple, one multiple at least."""
    return max(multiple, preferred_pixels // max(width, 1) // multiple * multiple)


def fragments(pixels: DataFrame, rows: int) -> DataFrame:
    return pixels.withColumn("strip_id", F.floor(F.col("y") / rows).cast("long"))


def gather(parts: DataFrame, keys: list[str], order: str, data: Column) -> DataFrame:
    """Pieces of binary laid end to end in order, by key."""
    held = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), data.alias("d")))).alias("all"))
    return held.select(*keys, F.aggregate("all", F.lit(b""), lambda a, s: F.concat(a, s["d"])).alias("data"))


def chroma_420(yuv: DataFrame) -> DataFrame:
    """Chroma plane: truncated means of 2 x 2 pixels."""
    half = [F.floor(F.col(c) / 2).cast("long") for c in "xy"]
    return yuv.groupBy(half[0].alias("cx"), half[1].alias("cy")).agg(*(F.floor(F.avg(c)).cast("long").alias(c) for c in "uv"))


def upsampled_420(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """RGB of luma pixels with the chroma sample of their 2 x 2 cell: an equi-join on derived keys."""
    cell = luma.select("x", "y", "yy", F.floor(F.col("x") / 2).cast("long").alias("cx"), F.floor(F.col("y") / 2).cast("long").alias("cy"))
    r, g, b = S.yuv8_to_rgb(F.col("yy"), F.col("u"), F.col("v"))
    return cell.join(chroma, ["cx", "cy"]).select("x", "y", r.alias("r2"), g.alias("g2"), b.alias("b2"))


def mip_box(pixels: DataFrame, straight_alpha: bool = False, keys: list[str] | None = None) -> DataFrame:
    """The next mip level by 2 x 2 means, rounded; with straight alpha, colours are weighted by it (0 where it is 0)."""
    cell = [F.floor(F.col(c) / 2).cast("long").alias(c) for c in "xy"]
    n = F.count("*")
    mean = lambda s, w: F.floor((s * 2 + w) / (w * 2.0)).cast("long")
    if straight_alpha:
        total = F.sum("a")
        colours = [F.when(total == 0, 0).otherwise(mean(F.sum(F.col(c) * F.col("a")), F.greatest(total, F.lit(1)))).cast("long").alias(c) for c in "rgb"]
    else:
        colours = [mean(F.sum(c), n).alias(c) for c in "rgb"]
    return pixels.groupBy(*(keys or []), *cell).agg(*colours, mean(F.sum("a"), n).alias("a"))


def _bayer(n: int) -> list[list[int]]:
    """The ordered-dither matrix of size 2^n, by doubling."""
    m = [[0]]
    for _ in range(n):
        m = [[4 * v for v in row] + [4 * v + 2 for v in row] for row in m] + [[4 * v + 3 for v in row] + [4 * v + 1 for v in row] for row in m]
    return m


def pack_r1(pixels: DataFrame, channel: str) -> DataFrame:
    """One bit a pixel, eight a byte from the high bit, by an 8 x 8 ordered dither: on from v + m / 64 - 1/2 >= 1/2 on."""
    matrix = F.array(*(F.lit(v) for row in _bayer(3) for v in row))
    at = (F.pmod("y", F.lit(8)) * 8 + F.pmod("x", F.lit(8))).cast("int")
    on = F.col(channel) * 64 >= (64 - F.get(matrix, at)) * 255
    bit = F.when(on, F.call_function("shiftleft", F.lit(1), (7 - F.pmod("x", F.lit(8))).cast("int"))).otherwise(0)
    return pixels.groupBy("y", F.floor(F.col("x") / 8).cast("long").alias("byte_x")).agg(F.sum(bit).cast("long").alias("packed"))


def floyd_steinberg(pixels: DataFrame, channel: str, width: int) -> DataFrame:
    """Global error diffusion of one channel to `width` bits: surface, x, y, code.

    A recurrence over the whole surface: one group a surface, worked along anti-diagonals (x + 2y), each a vector."""

    def spread(frame: pd.DataFrame) -> pd.DataFrame:
        w, h = int(frame.x.max()) + 1, int(frame.y.max()) + 1
        image = np.zeros((h + 1, w + 2), np.float32)
        image[frame.y, frame.x + 1] = frame["v"] / np.float32(255)
        codes = np.zeros((h, w), np.int64)
        top = np.float32((1 << width) - 1)
        for d in range(w + 2 * (h - 1)):
            y = np.arange(max(0, (d - w + 2) // 2), min(h - 1, d // 2) + 1)
            x = d - 2 * y
            keep = (x >= 0) & (x < w)
            y, x = y[keep], x[keep]
            value = image[y, x + 1]
            code = np.floor(np.clip(value, 0, 1) * top + np.float32(0.5)).astype(np.int64)
            codes[y, x] = code
            error = value - code / top
            # of the pixels of one diagonal no two share a neighbour below or to the right
            image[y, x + 2] += error * np.float32(7 / 16)
            image[y + 1, x] += error * np.float32(3 / 16)
            image[y + 1, x + 1] += error * np.float32(5 / 16)
            image[y + 1, x + 2] += error * np.float32(1 / 16)
        return pd.DataFrame({"surface": frame.surface.iloc[0], "x": frame.x, "y": frame.y, "code": codes[frame.y, frame.x]})

    rows = pixels.select("surface", "x", "y", F.col(channel).alias("v"))
    return rows.groupBy("surface").applyInPandas(spread, "surface long, x long, y long, code long")


def psnr(a: Column, b: Column) -> Column:
    """An aggregate: dB of the mean squared error of 8-bit channels."""
    return F.round(F.log10(F.avg((a - b) * (a - b)) / 65025.0) * -10, 6)


def region_error(pixels: DataFrame, a: str, b: str) -> DataFrame:
    """Mean over the whole 4 x 4 regions of the absolute difference of means; the count of regions is width / 4 * height / 4
    in integers from the left, as the published quality tables have it."""
    size = pixels.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    cell = [F.floor(F.col(c) / 4).cast("long") for c in "xy"]
    each = pixels.groupBy(cell[0].alias("bx"), cell[1].alias("by")).agg(F.sum(a).alias("s1"), F.sum(b).alias("s2"))
    whole = each.join(F.broadcast(size), (F.col("bx") * 4 + 4 <= F.col("w")) & (F.col("by") * 4 + 4 <= F.col("h")))  # one row
    total = whole.agg(F.sum(F.abs(F.col("s1") - F.col("s2")) / 16).alias("e"), F.max("w").alias("w"), F.max("h").alias("h"))
    return total.select(F.round(F.col("e") / F.floor(F.floor(F.col("w") / 4) * F.col("h") / 4), 6).alias("region_error"))


def blur_row(pixels: DataFrame, channel: str) -> DataFrame:
    """16 times the 1-4-6-4-1 blur along rows, edges clamped."""
    w = Window.partitionBy("y").orderBy("x")
    c = F.col(channel)
    left = F.coalesce(F.lag(c).over(w), c)
    right = F.coalesce(F.lead(c).over(w), c)
    blur = F.coalesce(F.lag(c, 2).over(w), left) + left * 4 + c * 6 + right * 4 + F.coalesce(F.lead(c, 2).over(w), right)
    return pixels.withColumn(f"blur16", blur.cast("long"))


# Place of each cube face on a canvas of 4 x 3 cells.
CUBE_CELLS = [("+X", 2, 1), ("-X", 0, 1), ("+Y", 1, 0), ("-Y", 1, 2), ("+Z", 1, 1), ("-Z", 3, 1)]


def cube_canvas(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of faces moved to their cells; faces that are missing leave their cells empty."""
    cells = local_table(pixels.sparkSession, CUBE_CELLS, "face string, gx long, gy long")
    return pixels.join(F.broadcast(cells), "face").withColumns({"x": F.col("x") + F.col("gx") * width, "y": F.col("y") + F.col("gy") * height}).drop("gx", "gy")


def byte_histogram(data: DataFrame) -> DataFrame:
    """Counts of byte values over binary column data, pre-aggregated in each task."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    total += np.bincount(np.frombuffer(value.as_buffer(), np.uint8), minlength=256)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["byte", "n"])

    return data.select("data").mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").cast("long").alias("n"))


def block_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Extremes, opacity and distinct colours of each block."""
    return pixels.groupBy(*keys).agg(F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.min("a").alias("min_a"), F.every(F.col("a") == 255).alias("opaque"), F.count_distinct(F.struct("r", "g", "b")).cast("long").alias("n_colors"))


def top_partitions(pixels: DataFrame, block: str, k: int) -> DataFrame:
    """block, part, rank, error: of the 64 partitions into two subsets the k with the least squared distance of the colours
    (r, g, b) from the mean of their subset; ties go to the smaller number. `pixels` has block, i (0 to 15), r, g, b."""
    spark = pixels.sparkSession
    table = spark.createDataFrame([(i, [int(row[i]) for row in bc_tables.TWO]) for i in range(16)], "i long, subs array<int>")
    each = pixels.join(F.broadcast(table), "i").select(block, "r", "g", "b", F.posexplode("subs").alias("part", "sub"))
    square = sum(F.col(c) * F.col(c) for c in "rgb")
    sums = each.groupBy(block, "part", "sub").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "rgb"), F.sum(square).alias("q"))
    error = F.col("q") - sum(F.col(c) * F.col(c) for c in "rgb") / F.col("n")
    errors = sums.groupBy(block, "part").agg(F.round(F.sum(error), 6).alias("error"))
    rank = F.row_number().over(Window.partitionBy(block).orderBy("error", "part"))
    return errors.select(block, F.col("part").cast("long").alias("part"), rank.cast("long").alias("rank"), "error").filter(F.col("rank") <= k)
