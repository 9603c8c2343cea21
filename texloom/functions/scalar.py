"""Scalar number formats of pixels as Column expressions, in integer arithmetic where the formats define one.

Names read from-to: n5 is a 5-bit UNORM number, s8 an 8-bit SNORM one, f32 a float. Widening is a
rounded integer division; products need 64 bits, so columns are cast to long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _l(x: Column) -> Column:
    return x.cast("long")


def shr(x: Column, n: int) -> Column:
    return F.call_function("shiftright", _l(x), F.lit(n))


def shl(x: Column, n: int) -> Column:
    return F.call_function("shiftleft", _l(x), F.lit(n))


def bits(x: Column, at: int, n: int) -> Column:
    return shr(x, at).bitwiseAND((1 << n) - 1)


def rounded(x: Column, top: int, source: int) -> Column:
    """round(x * top / source) of integers, halves up."""
    return F.call_function("div", _l(x) * (2 * top) + source, F.lit(2 * source).cast("long"))


def unorm(x: Column, source: int, target: int) -> Column:
    """An n-bit UNORM number as 8 or 16 bits."""
    return rounded(x, (1 << target) - 1, (1 << source) - 1)


def clamp01(x: Column) -> Column:
    """To [0, 1]; NaN becomes 0."""
    d = F.nanvl(x.cast("double"), F.lit(0.0))
    return F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0))


def quantise(x: Column, width: int) -> Column:
    """A real number as an n-bit UNORM number, rounded and saturated; NaN becomes 0."""
    return F.floor(clamp01(x) * float((1 << width) - 1) + 0.5).cast("long")


def snorm_code(x: Column, width: int) -> Column:
    """The stored number as 0 .. 2^n - 2: -1 and the lowest code are 0, zero is the middle, 1 is the top."""
    half = 1 << (width - 1)
    return F.greatest(F.pmod(_l(x) + half, F.lit(2 * half)) - 1, F.lit(0).cast("long"))


def snorm8(x: Column, target: int) -> Column:
    return rounded(snorm_code(x, 8), (1 << target) - 1, 254)


def to_snorm(x: Column, width: int) -> Column:
    """A real number in [0, 1] as the stored two's-complement number of n bits."""
    top = (1 << width) - 2
    code = F.floor(clamp01(x) * float(top) + 0.5).cast("long") + 1
    half = 1 << (width - 1)
    return F.pmod(code + half, F.lit(2 * half))


# Channel conversion: what each set of channels shows of a pixel (r, g, b, a), with ONE for alpha and ZERO for colour that is missing.
def convert(source: str, target: str, px: dict[str, Column], one: Column) -> list[Column]:
    """px: r, g, b, a by what the source has (grayscale has r alone). Gray is red alone, never luma."""
    zero = F.lit(0).cast("long")
    alpha = px["a"] if source in ("alpha", "rgba") else one
    colour = [zero] * 3 if source == "alpha" else [px["r"]] * 3 if source == "grayscale" else [px["r"], px["g"], px["b"]]
    return {"grayscale": colour[:1], "alpha": [alpha], "rgb": colour, "rgba": [*colour, alpha]}[target]


def premultiply(c: Column, a: Column) -> Column:
    return F.floor((_l(c) * _l(a) * 2 + 255) / F.lit(510.0)).cast("long")


def unpremultiply(c: Column, a: Column) -> Column:
    """min(255, c * 255 div a); an alpha of 0 counts as 255."""
    d = F.when(a == 0, F.lit(255)).otherwise(a).cast("long")
    return F.least(F.floor(_l(c) * 255 / d).cast("long"), F.lit(255).cast("long"))


def normal_z(x: Column, y: Column) -> Column:
    """Blue of a normal map from red and green (8 bits each)."""
    fx, fy = _l(x) / 255.0 * 2 - 1, _l(y) / 255.0 * 2 - 1
    z = F.sqrt(F.greatest(1 - fx * fx - fy * fy, F.lit(0.0)))
    return F.floor((z / 2 + 0.5) * 255 + 0.5).cast("long")


# Limited-range BT.601 coefficients.
Y_SCALE, R_V, G_U, G_V, B_U = 1.164383561643836, 1.596026785714286, -0.391762290094914, -0.812967647237771, 2.017232142857142


def yuv8_to_rgb(y: Column, u: Column, v: Column) -> list[Column]:
    """Limited-range 8-bit YUV as 8-bit RGB, computed in doubles and rounded."""
    c, d, e = (_l(y) - 16) * Y_SCALE, _l(u) - 128, _l(v) - 128
    clip = lambda x: F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("long")
    return [clip(c + e * R_V), clip(c + d * G_U + e * G_V), clip(c + d * B_U)]


def rgb_to_yuv8(r: Column, g: Column, b: Column) -> list[Column]:
    r, g, b = _l(r), _l(g), _l(b)
    clip = lambda x: F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("long")
    return [clip(r * 0.256788235294118 + g * 0.504129411764706 + b * 0.0979058823529412 + 16), clip(r * -0.148223 + g * -0.290993 + b * 0.439216 + 128), clip(r * 0.439216 + g * -0.367788 + b * -0.0714274 + 128)]


def half_to_double(h: Column) -> Column:
    """A 16-bit float's bits as a number (NaN and infinities kept)."""
    sign = F.when(bits(h, 15, 1) == 1, -1.0).otherwise(1.0)
    e, m = bits(h, 10, 5), bits(h, 0, 10)
    return sign * F.when(e == 0, m * F.lit(2.0**-24)).when((e == 31) & (m == 0), F.lit(float("inf"))).when(e == 31, F.lit(float("nan"))).otherwise((m + 1024) * F.pow(F.lit(2.0), e - 25))


def small_float(x: Column, mantissa: int) -> Column:
    """Unsigned floats of 5 exponent bits: 11 bits have 6 of mantissa, 10 bits have 5."""
    e, m = bits(x, mantissa, 5), bits(x, 0, mantissa)
    scale = float(1 << mantissa)
    return F.when(e == 0, m * F.lit(2.0**-14 / scale)).when((e == 31) & (m == 0), F.lit(float("inf"))).when(e == 31, F.lit(float("nan"))).otherwise((m / scale + 1) * F.pow(F.lit(2.0), e - 15))


def shared_exponent(x: Column) -> list[Column]:
    """9-9-9-5: three mantissas over one exponent."""
    scale = F.pow(F.lit(2.0), bits(x, 27, 5) - 24)
    return [bits(x, at, 9) * scale for at in (0, 9, 18)]


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
