"""Decoding of packed, sub-sampled and bi-planar formats: one plan for all of them, Column arithmetic over a table of fields.

A format is a row of the table: how many pixels share a unit, where each channel's bits lie for each of them, and how the
number there is read. Strips of any mix of formats are decoded in one pass: the table is joined by name (it has a row a
format), units are read as longs, and every channel is a shift, a mask and a conversion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions.formats import FORMATS, pixel_info
from texloom.functions.local import local_table
from texloom.functions.units import GEOMETRY, UNIT, strip_units

TOP = {"u8": 255, "u16": 65535, "f32": 0x3F800000}
HALF = {"u8": 128, "u16": 32768, "f32": 0x3F000000}
NATIVE = {f[0]: (f[1].lower(), f[2].lower()) for f in FORMATS}
#: Ways to read a number: UNORM, SNORM, float, biased fixed point and its alpha, shared exponent, luma and chroma, constant.
UNORM, SNORM, FLOAT, BIASED, BIASED_ALPHA, SHARED, YUV, CONSTANT = "unorm", "snorm", "float", "biased", "biased alpha", "shared", "yuv", "constant"

# Bit places of formats whose names do not say them (fixed values): pixels of a unit, and for Y, U, V, A the places for each
# pixel, bits, and bits dropped below.
YUV_FIELDS = {
    "AYUV": (1, [[16], [8], [0], [24]], 8, 0), "Y410": (1, [[10], [0], [20], [30]], 10, 0), "Y416": (1, [[16], [0], [32], [48]], 16, 0),
    "UYVY": (2, [[8, 24], [0, 0], [16, 16], None], 8, 0), "YUY2": (2, [[0, 16], [8, 8], [24, 24], None], 8, 0),
    "Y210": (2, [[0, 32], [16, 16], [48, 48], None], 10, 6), "Y216": (2, [[0, 32], [16, 16], [48, 48], None], 16, 0),
    "NV12": (1, [[0], [64], [72], None], 8, 0), "P010": (1, [[0], [64], [80], None], 10, 6), "P016": (1, [[0], [64], [80], None], 16, 0),
}
# Red, green and blue for each of two pixels.
PAIR_FIELDS = {"R8G8_B8G8_UNORM": [[0, 0], [8, 24], [16, 16]], "G8R8_G8B8_UNORM": [[8, 8], [0, 16], [24, 24]]}


@dataclass(frozen=True)
class Field:
    at: list[int]
    bits: int
    way: str
    value: int = 0  # of a constant


def named_fields(name: str) -> dict[str, Field]:
    """Channels of a packed format by its name, from the lowest bit up; X is no channel."""
    out, at = {}, 0
    for channel, bits in re.findall(r"([RGBAXE])(\d+)", name.replace("_XR_BIAS_", "")):
        way = UNORM
        if "XR_BIAS" in name:
            way = BIASED_ALPHA if channel == "A" else BIASED
        elif "FLOAT" in name:
            way = FLOAT
        elif "SHAREDEXP" in name:
            way = SHARED
        elif "SNORM" in name:
            way = SNORM
        out[channel] = Field([at], int(bits), way)
        at += int(bits)
    out.pop("X", None)
    out.pop("E", None)
    return out


def format_fields(name: str) -> tuple[int, int, list[Field]] | None:
    """Pixels of a unit, dropped bits, and the fields of red, green, blue and alpha; None for block formats."""
    channels, precision = NATIVE[name]
    kind, _, across, high, *_ = pixel_info(name)
    full, none = Field([0], 0, CONSTANT, TOP[precision]), Field([0], 0, CONSTANT, 0)
    if name in YUV_FIELDS:
        across, places, bits, dropped = YUV_FIELDS[name]
        alpha = full if places[3] is None else Field(places[3], 2 if name == "Y410" else bits, UNORM)
        return across, dropped, [*(Field(p, bits + dropped, YUV) for p in places[:3]), alpha]
    if name in PAIR_FIELDS:
        return 2, 0, [*(Field(p, 8, UNORM) for p in PAIR_FIELDS[name]), full]
    if name == "R1_UNORM":
        grey = Field(list(range(7, -1, -1)), 1, UNORM)
        return 8, 0, [grey, grey, grey, full]
    if kind != "fixed":
        return None
    found = named_fields(name)
    if channels == "grayscale":
        return 1, 0, [found["R"]] * 3 + [full]
    if channels == "alpha":
        return 1, 0, [none] * 3 + [found["A"]]
    blank = Field([0], 0, CONSTANT, HALF[precision]) if "SNORM" in name else none
    return 1, 0, [*(found.get(c, blank) for c in "RGB"), found.get("A", full)]


#: Formats that are decoded here.
NAMES = [name for name in NATIVE if format_fields(name) is not None]
_SPEC = "texloom spec"
_FIELD = "struct<at:array<int>,bits:int,way:string,value:bigint>"
SCHEMA = f"format string, size int, across int, high int, plane1 int, plane2 int, dropped int, precision string, fr {_FIELD}, fg {_FIELD}, fb {_FIELD}, fa {_FIELD}"


def fields_table(spark: SparkSession) -> DataFrame:
    rows = []
    for name in NAMES:
        across, dropped, fields = format_fields(name)
        kind, size, _, _, plane1, plane2, *_ = pixel_info(name)
        planes = (plane1, plane2) if kind == "biplanar" else (0, 0)
        rows.append((name, size or plane1, across, 1, *planes, dropped, NATIVE[name][1], *({"at": f.at, "bits": f.bits, "way": f.way, "value": f.value} for f in fields)))
    return local_table(spark, rows, SCHEMA)


def _shift(x: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n.cast("int"))


def _mask(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def whole_bits(m: Column, exponent: Column) -> Column:
    """The 32 bits of m * 2^exponent, for a whole number m below 2^24 and a result that is a normal number."""
    k = F.length(F.bin(m)) - 1
    mantissa = F.call_function("shiftleft", m, (23 - k).cast("int")) - (1 << 23)
    return F.when(m == 0, F.lit(0).cast("long")).otherwise((k + exponent + 127).cast("long") * (1 << 23) + mantissa)


def real_bits(x: Column) -> Column:
    """The 32 bits of a single-precision number, given as a double, that is zero or normal."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    k = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    mantissa = (size / F.pow(F.lit(2.0), k) * float(1 << 23)).cast("long") - (1 << 23)
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0)) + (k + 127) * (1 << 23) + mantissa)


def small_float_bits(v: Column, bits: Column) -> Column:
    """The 32 bits of a float of 5 exponent bits: a half with its sign, or an unsigned one of 11 or 10 bits."""
    m = F.when(bits == 16, 10).otherwise(bits - 5)
    mantissa, exponent = v.bitwiseAND(_mask(m)), _shift(v, m).bitwiseAND(31)
    sign = F.when((bits == 16) & (v >= 1 << 15), F.lit(1 << 31)).otherwise(F.lit(0)).cast("long")
    high = F.when(exponent == 31, 255).otherwise(exponent + 112).cast("long") * (1 << 23) + F.call_function("shiftleft", mantissa, (23 - m).cast("int"))
    return sign + F.when(exponent == 0, whole_bits(mantissa, -14 - m)).otherwise(high)


def channel(field: Column, v: Column, top: Column, exponent: Column) -> Column:
    """A stored number in the format's native precision (floats as their 32 bits); `exponent` is the shared one."""
    most = _mask(field.bits)
    single = v.cast("float")
    code = F.greatest(F.pmod(v + _div(most + 1, F.lit(2)), most + 1) - 1, F.lit(0))
    return (
        F.when(field.way == CONSTANT, field.value)
        .when(field.way == UNORM, _div(v * 2 * top + most, 2 * most))
        .when(field.way == SNORM, _div(code * 2 * top + most - 1, 2 * (most - 1)))
        .when(field.way == FLOAT, F.when(field.bits == 32, v).otherwise(small_float_bits(v, field.bits)))
        .when(field.way == SHARED, whole_bits(v, exponent - 24))
        .when(field.way == BIASED, real_bits(((single - F.lit(384).cast("float")) * F.lit(1 / 510).cast("float")).cast("double")))
        .when(field.way == BIASED_ALPHA, real_bits((single / 3).cast("float").cast("double")))
    )


def rgb_of(y: Column, u: Column, v: Column, bits: Column) -> list[Column]:
    """Limited-range YUV codes as RGB codes of 8 or 16 bits: in single precision, by the published coefficients."""
    single = lambda x: F.lit(x).cast("float")
    step = F.call_function("shiftleft", F.lit(1), (bits - 8).cast("int"))
    y, u, v = (y - step * 16).cast("float"), (u - step * 128).cast("float"), (v - step * 128).cast("float")
    luma, share = y * single(1.164383), (1 / _mask(bits)).cast("float")
    held = lambda x, top: F.least(F.greatest(x, single(0.0)), single(top))
    eight = lambda x: held(F.floor(x + single(0.5)).cast("float"), 255.0)
    sixteen = lambda x: F.floor(held(x * share, 1.0) * single(65535.0) + single(0.5))
    mixed = [luma + v * single(1.596027), luma - u * single(0.391762) - v * single(0.812968), luma + u * single(2.017232)]
    return [F.when(bits == 8, eight(x).cast("long")).otherwise(sixteen(x).cast("long")) for x in mixed]


def strip_pixels(strips: DataFrame, format: str = "format") -> DataFrame:
    """x, y, r, g, b, a in native precision (integers, or floats as their 32 bits) of each pixel of strips of any formats.

    `strips` has data, width, rows and the column `format`; what does not hold exactly width x rows pixels, or has a format that is not
    among `NAMES`, gives no rows. Grey is repeated; missing colour is 0 (half for SNORM), missing alpha is one."""
    table = fields_table(strips.sparkSession)
    spec = [c for c in table.columns if c not in ("format", *GEOMETRY)]
    geometry = table.select(F.col("format").alias(format), F.struct(*GEOMETRY).alias(UNIT))
    fields = table.select(F.col("format").alias(format), F.struct("across", *spec).alias(_SPEC))
    # a row for each format; the fields are joined behind the units, so that they are not sent through Python
    units = strip_units(strips.join(F.broadcast(geometry), format)).join(F.broadcast(fields), format)
    own = [c for c in strips.columns if c not in ("data", "rows", "width")]
    across = F.col(_SPEC)["across"]
    pixels = units.withColumn("_i", F.explode(F.sequence(F.lit(0), across - 1)))
    pixels = pixels.withColumn("_x", F.col("unit_x") * across + F.col("_i")).filter("_x < width")
    pixels = pixels.select(*own, F.col("_x").alias("x"), F.col("unit_y").alias("y"), "lo", "hi", "_i", *(F.col(_SPEC)[c].alias(f"_{c}") for c in spec))

    def stored(f: str) -> Column:
        at = F.element_at(f"{f}.at", F.least(F.col("_i") + 1, F.size(f"{f}.at")))
        return _shift(F.when(at < 64, F.col("lo")).otherwise(F.col("hi")), F.pmod(at, F.lit(64))).bitwiseAND(_mask(F.col(f"{f}.bits")))

    raw = pixels.withColumns({f"_v{c}": stored(f"_f{c}") for c in "rgba"} | {"_e": _shift(F.col("lo"), F.lit(27)).bitwiseAND(31)})
    top, dropped = F.when(F.col("_precision") == "u8", 255).otherwise(65535).cast("long"), F.col("_dropped")
    mixed = rgb_of(*(_shift(F.col(f"_v{c}"), dropped) for c in "rgb"), F.col("_fr.bits") - dropped)
    one = lambda c: channel(F.col(f"_f{c}"), F.col(f"_v{c}"), top, F.col("_e"))
    colour = [F.when(F.col("_fr.way") == YUV, m).otherwise(one(c)).cast("long").alias(c) for c, m in zip("rgb", mixed, strict=True)]
    return raw.select(*own, "x", "y", *colour, one("a").cast("long").alias("a"))
