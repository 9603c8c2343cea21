"""Encoding into packed, sub-sampled and bi-planar formats: the inverse of operators/packed, one pass for all formats asked for.

A strip is an array of samples. A format says how many pixels share a unit, of how many numbers a unit is made, and for each
field the sample it comes from, its bit places and how it is coded. All coding is Column arithmetic over the samples, in
integers wherever source and target are integers; nothing leaves the row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions.formats import pixel_info
from texloom.functions.scalar import clamp01
from texloom.functions.units import numbers_of, with_bytes
from texloom.operators import packed
from texloom.operators.packed import BIASED, CONSTANT, FLOAT, SHARED, SNORM, UNORM, YUV

SAMPLE_BYTES = {"u8": 1, "u16": 2, "f32": 4}
CHANNELS = {"grayscale": 1, "alpha": 1, "rgb": 3, "rgba": 4}
EXPONENT = "exponent"
# The published six-digit coefficients (fixed values): luma, blue and red chroma of each colour, and what zero is coded as.
TO_YUV = ((0.256788, 0.504129, 0.097906, 16), (-0.148223, -0.290993, 0.439216, 128), (0.439216, -0.367788, -0.071427, 128))
#: The largest number of the format with a shared exponent, as the bits of a single, and the smallest exponent's lower bound.
SHARED_MOST, SHARED_LEAST = 0x477F8000, 0x33800000



class Field(NamedTuple):
    """Where a number comes from, the word of the unit it goes to, its place there for each pixel, and how it is coded."""

    sample: int
    word: int
    at: list[int]
    bits: int
    way: str
    mean: bool = False  # one number for all pixels of the unit
    keep: int = -1  # bits that stay of the code


class Packing(NamedTuple):
    word_bytes: int
    words: int
    across: int
    planes: bool
    fields: list[Field]


def packing_of(name: str) -> Packing:
    kind, size, _, _, plane1, *_ = pixel_info(name)
    across, _, decoded = packed.format_fields(name)
    if name in packed.YUV_FIELDS:
        _, places, bits, dropped = packed.YUV_FIELDS[name]
        if kind == "biplanar":
            # luma and chroma lie in planes of their own, so only the dropped bits move them
            return Packing(plane1, 1, 1, True, [Field(i, 0, [dropped], bits, YUV, i > 0) for i in range(3)])
        keep = (1 << 16) - (1 << dropped) if dropped else -1  # coded with all bits, then cut
        fields = [Field(i, 0, places[i], bits + dropped, YUV, across == 2 and i > 0, keep) for i in range(3)]
        if places[3] is not None:
            fields.append(Field(3, 0, places[3], 2 if name == "Y410" else bits, UNORM))
        return Packing(size, 1, across, False, fields)
    if name in packed.PAIR_FIELDS:
        return Packing(size, 1, 2, False, [Field(i, 0, at, 8, UNORM, at[0] == at[1]) for i, at in enumerate(packed.PAIR_FIELDS[name])])
    if name == "R1_UNORM":
        return Packing(1, 1, across, False, [Field(0, 0, decoded[0].at, 1, UNORM)])
    named = packed.named_fields(name)
    full = max(f.bits for f in named.values()) == 32  # numbers of 32 bits are words of their own
    fields = [Field("RGBA".index(c), f.at[0] // 32 if full else 0, [f.at[0] % 32 if full else f.at[0]], f.bits, f.way) for c, f in named.items()]
    if "X8" in name:
        fields.append(Field(3, 0, [24], 8, CONSTANT))
    if "SHAREDEXP" in name:
        fields.append(Field(0, 0, [27], 5, EXPONENT))
    return Packing(4 if full else size, size // 4 if full else 1, 1, False, fields)


#: Formats that are encoded here.
NAMES = packed.NAMES


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _left(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(n).cast("int"))


def _right(x: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n.cast("int"))


def _single(x: float) -> Column:
    return F.lit(x).cast("float")


def _let(x: Column, of: Callable[[Column], Column]) -> Column:
    """`of` a value that is computed once, however often `of` names it."""
    return F.get(F.transform(F.array(x), of), 0)


def bits_to_double(b: Column) -> Column:
    """The number whose single-precision bits are given as a long; `b` should be a plain column or a bound value."""
    exponent, mantissa = _right(b, F.lit(23)).bitwiseAND(255), b.bitwiseAND(0x7FFFFF)
    special = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    size = F.when(exponent == 255, special).otherwise((mantissa + F.when(exponent > 0, 1 << 23).otherwise(0)) * F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1).cast("long")) - 150))
    return size * F.when(_right(b, F.lit(31)).bitwiseAND(1) == 1, -1.0).otherwise(1.0)


def half_code(b: Column) -> Column:
    """A single's bits as those of a half: to the nearest, ties to even, beyond the largest infinite, NaN kept."""
    sign, exponent, mantissa = _left(_right(b, F.lit(31)).bitwiseAND(1), F.lit(15)), _right(b, F.lit(23)).bitwiseAND(255), b.bitwiseAND(0x7FFFFF)
    drop = F.when(exponent > 112, 13).otherwise(F.least(126 - exponent, F.lit(26).cast("long")))
    whole = F.when(exponent > 112, mantissa).otherwise(mantissa + F.when(exponent > 0, 1 << 23).otherwise(0)).cast("long")
    base = F.when(exponent > 112, (exponent - 112) * 1024).otherwise(0)

    def finite(v: Column) -> Column:
        cut, rest, middle = _right(v["whole"], v["drop"]), v["whole"].bitwiseAND(_left(F.lit(1).cast("long"), v["drop"]) - 1), _left(F.lit(1).cast("long"), v["drop"] - 1)
        return cut + F.when((rest > middle) | ((rest == middle) & (cut.bitwiseAND(1) == 1)), 1).otherwise(0)

    special = F.when(mantissa == 0, 0x7C00).otherwise(F.greatest(0x7C00 + _right(mantissa, F.lit(13)), F.lit(0x7C01).cast("long")))
    number = _let(F.struct(whole.alias("whole"), drop.cast("int").alias("drop")), finite)
    return sign + F.when(exponent == 255, special).when(exponent >= 143, 0x7C00).otherwise(base + number).cast("long")


def small_float_code(b: Column, bits: int) -> Column:
    """A single's bits as an unsigned float of five exponent bits: the mantissa is rounded half up, then the half is cut.

    Below zero is 0, too large is infinite, NaN has all bits; what a half holds as a subnormal is cut after its rounding."""
    one, drop = 1 << (bits - 5), F.lit(28 - bits)
    cut = _right(_let(_left(_right(b + (1 << (27 - bits)), drop), drop), half_code), F.lit(15 - bits))
    nan = b.bitwiseAND(F.lit(0x7FFFFFFF)) > 0x7F800000
    return F.when(nan, one * 32 - 1).when((b >= 1 << 31) | (b < 1 << 23), 0).when(b == 0x7F800000, one * 31).otherwise(cut).cast("long")


class _Source:
    """Reads pixels of given channels and precision, row by row, from three arrays with a value for each sample: the stored
    number, the real one and, where a format of floats is asked for, the bits of the single next to that."""

    def __init__(self, channels: str, precision: str):
        self.channels = channels
        self.top = {"u8": 255, "u16": 65535}.get(precision)
        self.one = 0x3F800000 if self.top is None else self.top

    def read(self, samples: Column, floats: bool) -> dict[str, Column]:
        real = (lambda s: bits_to_double(s)) if self.top is None else (lambda s: s / float(self.top))
        single = (lambda s: s) if self.top is None else (lambda s: _let((s / float(self.top)).cast("float").cast("double"), packed.real_bits))
        return {"_real": F.transform(samples, real), "_bits": F.transform(samples, single) if floats else F.lit(None).cast("array<bigint>")}

    def at(self, array: str, pixel: Column, channel: int) -> Column:
        """Grey is red, green and blue; missing alpha is one, missing colour zero."""
        value = lambda i: F.get(F.col(array), i.cast("int"))
        kind = "double" if array == "_real" else "long"
        if channel == 3 and self.channels in ("rgb", "grayscale"):
            return F.lit({"_samples": self.one, "_real": 1, "_bits": 0x3F800000}[array]).cast(kind)
        if self.channels == "alpha":
            return value(pixel) if channel == 3 else F.lit(0).cast(kind)
        return value(pixel if self.channels == "grayscale" else pixel * CHANNELS[self.channels] + channel)

    def rounded(self, pixel: Column, channel: int, top: int, nan: float = 0.0) -> Column:
        """round(top * x), for x held in [0, 1]."""
        if self.top is None:
            held = F.least(F.greatest(F.nanvl(self.at("_real", pixel, channel), F.lit(nan)), F.lit(0.0)), F.lit(1.0))
            return F.floor(held * top + 0.5).cast("long")
        s = self.at("_samples", pixel, channel)
        return s if top == self.top else _div(s * (2 * top) + self.top, F.lit(2 * self.top).cast("long"))

    def snorm(self, pixel: Column, channel: int, bits: int) -> Column:
        """The stored number; NaN is one."""
        span = 1 << bits
        return F.pmod(self.rounded(pixel, channel, span - 2, 1.0) + (1 + span // 2), F.lit(span))

    def biased(self, pixel: Column, channel: int) -> Column:
        x = F.nanvl(self.at("_real", pixel, channel), F.lit(0.0))
        return F.floor(F.least(F.greatest(x * 510 + 384.5, F.lit(0.0)), F.lit(1023.0))).cast("long")

    def codes(self, which: int, bits: int) -> Column:
        """Luma (0) or a chroma (1, 2) of each pixel as limited-range codes, in single precision."""
        most, (x, y, z, zero) = (1 << bits) - 1, TO_YUV[which]

        def of(pixel: Column) -> Column:
            r, g, b = (clamp01(self.at("_real", pixel, i)).cast("float") * _single(float(most)) for i in range(3))
            coded = _single(x) * r + _single(y) * g + _single(z) * b + _single(zero * (1 << (bits - 8)) + 0.5)
            return F.least(F.greatest(F.floor(coded).cast("long"), F.lit(0).cast("long")), F.lit(most).cast("long"))

        return F.when(F.col("_samples").isNotNull(), F.transform(_upto(F.col("_width") * F.col("_rows")), of))

    def yuv(self, pixel: Column, which: int, bits: int) -> Column:
        return F.get(F.col(f"_yuv{bits}_{which}"), pixel.cast("int"))

    def held(self, pixel: Column, channel: int) -> Column:
        """A colour's single bits within the range of the shared exponent's format; NaN and negatives are 0."""
        hold = lambda b: F.when((b >= 1 << 31) | (b > 0x7F800000), F.lit(0).cast("long")).otherwise(F.least(b, F.lit(SHARED_MOST).cast("long")))
        return _let(self.at("_bits", pixel, channel), hold)

    def shared_exponent(self, pixel: Column) -> Column:
        """Five bits: the smallest exponent that holds the largest colour's nine bits, rounding included."""

        def of(b: Column) -> Column:
            exponent = F.greatest(_right(b, F.lit(23)) - 126, F.lit(-15).cast("long"))
            return exponent + F.when(F.floor(bits_to_double(b) / F.pow(F.lit(2.0), exponent - 9) + 0.5) == 512, 16).otherwise(15)

        return _let(F.greatest(*(self.held(pixel, i) for i in range(3)), F.lit(SHARED_LEAST).cast("long")), of)

    def code(self, f: Field, pixel: Column) -> Column:
        """A field's number for a pixel."""
        most = (1 << f.bits) - 1
        if f.way == CONSTANT:
            return F.lit(most).cast("long")
        if f.way == FLOAT:
            bits = self.at("_bits", pixel, f.sample)
            return bits if f.bits == 32 else _let(bits, half_code if f.bits == 16 else lambda b: small_float_code(b, f.bits))
        if f.way == SHARED:
            return F.floor(_let(self.held(pixel, f.sample), bits_to_double) / F.pow(F.lit(2.0), self.shared_exponent(pixel) - 24) + 0.5).cast("long")
        if f.way == EXPONENT:
            return self.shared_exponent(pixel)
        if f.way == SNORM:
            return self.snorm(pixel, f.sample, f.bits)
        if f.way == YUV:
            return self.yuv(pixel, f.sample, f.bits)
        return self.biased(pixel, f.sample) if f.way == BIASED else self.rounded(pixel, f.sample, most)

    def mean(self, f: Field, pixels: list[Column]) -> Column:
        """One number for several pixels: the mean of codes, cut, or of the two samples of a pair, rounded."""
        if f.way == YUV:
            return _div(sum((self.yuv(p, f.sample, f.bits) for p in pixels[1:]), self.yuv(pixels[0], f.sample, f.bits)), F.lit(len(pixels)).cast("long"))
        first, second = (self.at("_real", p, f.sample).cast("float") for p in pixels)
        return F.floor(clamp01((first + second) * _single(0.5)).cast("float") * _single(255.0) + _single(0.5)).cast("long")


def _moved(x: Column, f: Field, at: int) -> Column:
    x = x if f.keep < 0 else x.bitwiseAND(f.keep)
    return _left(x, at) if at else x


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)


def _numbers(source: _Source, packing: Packing, width: Column, rows: Column) -> Column:
    """The numbers of a strip in one plane: for each unit its words, each the sum of its fields at their places."""
    across = packing.across
    if across == 1 and packing.words == 1:
        return F.transform(_upto(width * rows), lambda p: sum((_moved(source.code(f, p), f, f.at[0]) for f in packing.fields[1:]), _moved(source.code(packing.fields[0], p), packing.fields[0], packing.fields[0].at[0])))
    if across == 1:
        word = lambda q: F.element_at(F.array(*(source.code(f, _div(q, F.lit(packing.words).cast("long"))) for f in packing.fields)), (q % packing.words + 1).cast("int"))
        return F.transform(_upto(width * rows * packing.words), word)
    wide = F.ceil(width / across)

    def unit(u: Column) -> Column:
        first, line = (u % wide) * across, _div(u, wide) * width
        # a pair's missing pixel is its neighbour, a byte's missing ones are zero
        places = [line + (F.least(first + i, width - 1) if across == 2 else first + i) for i in range(across)]
        parts = []
        for f in packing.fields:
            if f.mean:
                parts.append(_moved(source.mean(f, places), f, f.at[0]))
                continue
            for i, p in enumerate(places):
                part = _moved(source.code(f, p), f, f.at[i])
                parts.append(part if across == 2 else F.when(first + i < width, part).otherwise(0))
        return sum(parts[1:], parts[0])

    return F.transform(_upto(wide * rows), unit)


def _planes(source: _Source, packing: Packing, width: Column, rows: Column) -> Column:
    """The numbers of a strip in two planes: luma of each pixel, then both chroma of each 2 x 2 cell; null for odd sizes."""
    luma, *chroma = packing.fields
    half = _div(width, F.lit(2).cast("long"))

    def cell(q: Column) -> Column:
        corner = _div(q, half) * 2 * width + (q % half) * 2
        return F.array(*(_moved(source.mean(f, [corner, corner + 1, corner + width, corner + width + 1]), f, f.at[0]) for f in chroma))

    first = F.transform(_upto(width * rows), lambda p: _moved(source.code(luma, p), luma, luma.at[0]))
    return F.when((width % 2 == 0) & (rows % 2 == 0), F.concat(first, F.flatten(F.transform(_upto(half * _div(rows, F.lit(2).cast("long"))), cell))))


def strips(frame: DataFrame, names: list[str], channels: str = "rgba", precision: str = "u8") -> DataFrame:
    """A row for each strip and format: see `encode.strips`. Raises for a format that is not among `NAMES`."""
    if unknown := sorted(set(names) - set(NAMES)):
        raise NotImplementedError(f"{', '.join(unknown)} is not packed")
    own = [c for c in frame.columns if c not in ("data", "width", "rows", "format")]
    width, rows, size = F.col("width").cast("long"), F.col("rows").cast("long"), SAMPLE_BYTES[precision]
    whole = (F.length("data") == width * rows * CHANNELS[channels] * size) & (width > 0) & (rows > 0)
    read = frame.select(*own, width.alias("_width"), rows.alias("_rows"), F.when(whole, numbers_of(F.col("data"), F.lit(size))).alias("_samples"))
    source = _Source(channels, precision)
    read = read.withColumns(source.read(F.col("_samples"), any("FLOAT" in n or "SHAREDEXP" in n for n in names)))
    packings = {name: packing_of(name) for name in names}
    mixed = sorted({(f.sample, f.bits) for p in packings.values() for f in p.fields if f.way == YUV})
    read = read.withColumns({f"_yuv{bits}_{which}": source.codes(which, bits) for which, bits in mixed})  # once, for all formats
    coded = []
    for name, packing in packings.items():
        numbers = (_planes if packing.planes else _numbers)(source, packing, F.col("_width"), F.col("_rows"))
        coded.append(F.struct(F.lit(name).alias("format"), F.when(F.col("_samples").isNotNull(), numbers).alias("_numbers"), F.lit(packing.word_bytes).alias("_size")))
    # a null row of the array would be dropped, its nulls are not: every strip keeps a row for each format
    return with_bytes(read.select(*own, F.inline(F.array(*coded))), "_numbers", "_size", "data")
