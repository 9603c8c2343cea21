"""Block compression as Column expressions: BC1 to BC5 decoded, BC7's modes told apart, palette search.

`pixels` works on units (functions/units.py): a block is its first and second 64 bits, lo and hi. Palettes are columns of a
first projection, once a block; the 16 pixels of the block then pick their entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions.scalar import shl
from texloom.operators import bc6, bc7


def byte(block: Column, i: int) -> Column:
    return F.get(block, i).cast("long")


def word(block: Column, at: int, n: int) -> Column:
    """n bytes at an offset, little-endian (n up to 6)."""
    out = byte(block, at)
    for i in range(1, n):
        out = out + shl(byte(block, at + i), 8 * i)
    return out


def bc2_alpha(block: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.call_function("shiftright", F.when(p < 8, word(block, 0, 4)).otherwise(word(block, 4, 4)), F.pmod(p, F.lit(8)) * 4).bitwiseAND(15) * 17)


def bc7_mode(block: Column) -> Column:
    """Trailing zeros of the first byte; 8 for the reserved mode."""
    first = byte(block, 0)
    out = F.lit(8)
    for mode in range(7, -1, -1):
        out = F.when(first.bitwiseAND(1 << mode) != 0, F.lit(mode)).otherwise(out)
    return out


def nearest(value: Column, palette: Column) -> Column:
    """(error, index) of the nearest palette entry; the first wins a tie."""
    squared = F.transform(palette, lambda q, i: F.struct(((q - value) * (q - value)).alias("error"), i.alias("index")))
    return F.array_min(squared)


# -- decoding over lo and hi -------------------------------------------------------------------------------------------

NAMES = [
    "BC1_UNORM", "BC2_UNORM", "BC2_UNORM_PREMULTIPLIED_ALPHA", "BC3_UNORM", "BC3_UNORM_PREMULTIPLIED_ALPHA", "BC3_UNORM_RXGB", "BC3_UNORM_NORMAL",
    "BC4_UNORM", "BC4_SNORM", "BC5_UNORM", "BC5_SNORM", "BC6H_UF16", "BC6H_SF16", "BC7_UNORM",
]


def field(x: Column, at: int, n: int) -> Column:
    return F.call_function("shiftrightunsigned", x, F.lit(at)).bitwiseAND((1 << n) - 1)


def _picked(x: Column, at: int, n: int) -> Column:
    """The n-bit index of the row's pixel, of those that begin at a bit of x."""
    return F.call_function("shiftrightunsigned", x, (F.col("pixel") * n + at).cast("int")).bitwiseAND((1 << n) - 1)


def _over(x: Column, d: int) -> Column:
    return F.call_function("div", x * 2 + d, F.lit(2 * d))


def colour_palette(x: Column, four_only: bool) -> dict[str, Column]:
    """Arrays of the four reds, greens, blues and alphas: mixed from the 5- and 6-bit end points, rounded once."""
    c0, c1 = field(x, 0, 16), field(x, 16, 16)
    four = F.lit(True) if four_only else c0 > c1
    out = {}
    for name, at, n in (("r", 11, 5), ("g", 5, 6), ("b", 0, 5)):
        a, b, top = field(c0, at, n) * 255, field(c1, at, n) * 255, (1 << n) - 1
        out[name] = F.array(_over(a, top), _over(b, top), F.when(four, _over(a * 2 + b, 3 * top)).otherwise(_over(a + b, 2 * top)), F.when(four, _over(a + b * 2, 3 * top)).otherwise(0).cast("long"))
    out["a"] = F.array(*[F.lit(255).cast("long")] * 3, F.when(four, 255).otherwise(0).cast("long"))
    return out


def value_palette(x: Column, signed: bool) -> Column:
    """Eight 8-bit values: six between the end points, or four and the extremes. Signed ones are mixed as codes 0 to 254."""
    a, b, top = field(x, 0, 8), field(x, 8, 8), 255
    if signed:
        a, b = (F.when(v > 127, v - 256).otherwise(v) for v in (a, b))
        six, top = a > b, 254
        a, b = (F.greatest(v + 127, F.lit(0).cast("long")) for v in (a, b))
    else:
        six = a > b
    mixed = lambda i, d: _over((a * (d - i) + b * i) * 255, top * d)
    wide = [mixed(0, 7), mixed(7, 7), *(mixed(i, 7) for i in range(1, 7))]
    narrow = [mixed(0, 5), mixed(5, 5), *(mixed(i, 5) for i in range(1, 5)), F.lit(0).cast("long"), F.lit(255).cast("long")]
    return F.when(six, F.array(*wide)).otherwise(F.array(*narrow))


def pixels(units: DataFrame, name: str) -> DataFrame:
    """The rows of `units` sixteen times, with pixel (0 to 15, row by row) and the channels of the format."""
    if name == "BC7_UNORM":
        return bc7.pixels(units)
    if name.startswith("BC6H"):
        return bc6.pixels(units, name == "BC6H_SF16")
    lo, hi, signed = F.col("lo"), F.col("hi"), "SNORM" in name
    own = [c for c in units.columns if c not in ("lo", "hi")]
    colours = lo if name == "BC1_UNORM" else hi
    palettes: dict[str, Column] = {}
    if name.startswith(("BC4", "BC5")):
        palettes = {"p0": value_palette(lo, signed)} | ({"p1": value_palette(hi, signed)} if name.startswith("BC5") else {})
    else:
        palettes = {f"p{c}": p for c, p in colour_palette(colours, name.startswith("BC2")).items()} | ({"p0": value_palette(lo, False)} if name.startswith("BC3") else {})
    spread = units.withColumns(palettes).withColumn("pixel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    pick = lambda p, index: F.get(p, index.cast("int"))
    colour = {c: pick(f"p{c}", _picked(colours, 32, 2)) for c in "rgba"}
    if name.startswith("BC4"):
        colour = {"gray": pick("p0", _picked(lo, 16, 3))}
    elif name.startswith("BC5"):
        colour = {"r": pick("p0", _picked(lo, 16, 3)), "g": pick("p1", _picked(hi, 16, 3)), "b": F.lit(128 if signed else 0).cast("long")}
    elif name.startswith("BC2"):
        colour["a"] = _picked(lo, 0, 4) * 17
    elif name.startswith("BC3"):
        colour["a"] = pick("p0", _picked(lo, 16, 3))
    if name in ("BC3_UNORM_RXGB", "BC3_UNORM_NORMAL"):
        colour["r"] = colour.pop("a")
    out = spread.select(*own, "pixel", *(v.alias(c) for c, v in colour.items()))
    if "PREMULTIPLIED" in name:
        plain = lambda c: F.least(F.lit(255).cast("long"), F.call_function("div", F.col(c) * 255, F.when(F.col("a") == 0, 255).otherwise(F.col("a"))))
        out = out.withColumns({c: plain(c) for c in "rgb"})
    if name == "BC3_UNORM_NORMAL":
        out = out.withColumn("b", F.floor((F.sqrt(F.greatest(1 - F.pow(F.col("r") / 127.5 - 1, F.lit(2)) - F.pow(F.col("g") / 127.5 - 1, F.lit(2)), F.lit(0.0))) / 2 + 0.5) * 255 + 0.5).cast("long"))
    return out
