"""Decoding encoded strips and blocks: units read as longs, all else Column arithmetic, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.functions.formats import pixel_info
from texloom.functions.units import strip_units, unit_of
from texloom.operators import blocks, packed

#: Channels of a native raster, by number of channels.
CHANNELS = {"grayscale": ["gray"], "alpha": ["a"], "rgb": ["r", "g", "b"], "rgba": ["r", "g", "b", "a"]}

_FORMAT, _WIDTH, _ROWS = "texloom format", "texloom width", "texloom rows"


def native_channels(name: str) -> list[str]:
    return CHANNELS[packed.NATIVE[name][0]]


def block_size(name: str) -> int:
    """Bytes of a 4 x 4 block of a format that is decoded here; raises for the others."""
    if name not in blocks.NAMES:
        raise NotImplementedError(f"{name} is not decoded")
    return pixel_info(name)[1]


def _own(frame: DataFrame, used: list[str], made: list[str]) -> list[str]:
    """The columns that stay; none may be named like one that is made."""
    own = [c for c in frame.columns if c not in used]
    if clash := sorted(set(own) & set(made)):
        raise ValueError(f"columns are in the way of the result: {', '.join(clash)}")
    return own


def block_pixels(found: DataFrame, name: str) -> DataFrame:
    """A row for each pixel of each block: the other columns of `found`, pixel (0 to 15, row by row) and the channels.

    `found` has a column data with the bytes of one 4 x 4 block; a null or a block of another length gives no rows."""
    channels, size = native_channels(name), block_size(name)
    own = _own(found, ["data"], ["pixel", *channels])
    units = strip_units(found.select(*own, "data", F.lit(4).alias(_WIDTH), F.lit(4).alias(_ROWS), unit_of(size, 4, 4)), _WIDTH, _ROWS)
    return blocks.pixels(units, name).select(*own, "pixel", *channels)


def strip_pixels(strips: DataFrame, name: str) -> DataFrame:
    """x, y and the channels in the format's native precision (integers, or floats as their 32 bits) of each pixel.

    `strips` has columns data, width and rows; what does not hold exactly width x rows pixels gives no rows."""
    channels = native_channels(name)
    own = _own(strips, ["data", "width", "rows"], ["x", "y", *channels])
    if name in packed.NAMES:
        found = packed.strip_pixels(strips.select(*own, "data", "width", "rows").withColumn(_FORMAT, F.lit(name)), _FORMAT)
        first = F.col("r").alias("gray") if channels == ["gray"] else None
        return found.select(*own, "x", "y", *([first] if first is not None else channels))
    units = strip_units(strips.select(*own, "data", "width", "rows", unit_of(block_size(name), 4, 4)))
    pixels = blocks.pixels(units, name)
    placed = pixels.withColumns({"x": F.col("unit_x") * 4 + F.col("pixel") % 4, "y": F.col("unit_y") * 4 + F.call_function("div", F.col("pixel"), F.lit(4))})
    return placed.filter("x < width and y < rows").select(*own, "x", "y", *channels)


def region_pixels(ranges: DataFrame, name: str) -> DataFrame:
    """The pixels of a rectangle from its byte ranges (sources/files.py: `with_bytes` of `region`): x and y are the surface's."""
    own = [c for c in ranges.columns if c not in ("data", "width", "height", "x", "y", "span", "lines", "rows")]
    rect = [F.col("x").alias("_left"), F.col("y").alias("_top"), F.col("span").alias("width"), F.col("lines").alias("rows")]
    pixels = strip_pixels(ranges.select(*own, *rect, "data"), name)
    x, y = F.col("x") + F.col("first_x"), F.col("y") + F.col("first_y")
    placed = pixels.withColumns({"x": x, "y": y})
    inside = (F.col("x") >= F.col("_left")) & (F.col("x") < F.col("_left") + F.col("rect_width")) & (F.col("y") >= F.col("_top")) & (F.col("y") < F.col("_top") + F.col("rect_height"))
    return placed.filter(inside).drop("_left", "_top")


def rgba(pixels: DataFrame) -> DataFrame:
    """Decoded 8-bit pixels with all four channels: grey is repeated, missing colour is 0, missing alpha is 255."""
    own = [c for c in pixels.columns if c not in ("gray", "r", "g", "b", "a")]
    colour = [F.col("gray") if "gray" in pixels.columns else F.col(c) if c in pixels.columns else F.lit(0).cast("long") for c in "rgb"]
    alpha = F.col("a") if "a" in pixels.columns else F.lit(255).cast("long")
    return pixels.select(*own, *(v.alias(c) for v, c in zip(colour, "rgb", strict=True)), alpha.alias("a"))
