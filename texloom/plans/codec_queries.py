"""Registered queries of the float, YUV, sub-sampled and bi-planar formats, and of encoding, with independent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.functions.formats import pixel_info
from texloom.functions.units import numbers_of
from texloom.operators import encode, packed, raster
from texloom.plans import fixtures as X
from texloom.plans import bc6_queries, cell_queries, file_queries, header_queries, mip_queries  # noqa: F401  register their queries
from texloom.plans.texture_queries import NATIVE, ORACLES, QUERIES, named_bits, query

NAN = 0x7FC00000


def _word(at: int, size: int) -> str:
    """`size` bytes of the block from a fixed place, little-endian."""
    return "(" + " + ".join(f"block[{at + i + 1}] * {256**i}" for i in range(size)) + ")"


# -- floats ------------------------------------------------------------------------------------------------------------


def _power_bits(m: str, scale: str) -> str:
    """The 32 bits of m * 2^scale, m a whole number."""
    k = f"CAST(floor(log2(greatest({m}, 1))) AS BIGINT)"
    return f"(CASE WHEN {m} = 0 THEN 0 ELSE ({k} + {scale} + 127) * 8388608 + {m} * CAST(pow(2, 23 - {k}) AS BIGINT) - 8388608 END)"


def _bits(d: str) -> str:
    """The 32 bits of a single-precision number."""
    v = f"abs(CAST({d} AS DOUBLE))"
    k = f"CAST(floor(log2(greatest({v}, 1e-30))) AS BIGINT)"
    return f"(CASE WHEN {v} = 0 THEN 0 ELSE (CASE WHEN {d} < 0 THEN 2147483648 ELSE 0 END) + ({k} + 127) * 8388608 + CAST({v} * pow(2, 23 - {k}) AS BIGINT) - 8388608 END)"


def _small_bits(w: str, mantissa: int, signed: bool) -> str:
    """The 32 bits of a float of five exponent bits."""
    one = 1 << mantissa
    e, m = f"(({w} >> {mantissa}) & 31)", f"({w} & {one - 1})"
    sign = f"(({w} >> 15) & 1) * 2147483648 + " if signed else ""
    return f"(CASE WHEN {e} = 31 AND {m} > 0 THEN {NAN} ELSE {sign}(CASE {e} WHEN 31 THEN 2139095040 WHEN 0 THEN {_power_bits(m, str(-14 - mantissa))} ELSE {_power_bits(f'({m} + {one})', f'({e} - {15 + mantissa})')} END) END)"


def _full_bits(w: str) -> str:
    return f"(CASE WHEN ({w} & 2147483647) > 2139095040 THEN {NAN} ELSE {w} END)"


def _float_pixel(name: str, at: int) -> dict[str, str]:
    """Bits of each stored channel of the pixel that begins at a byte."""
    if name == "R11G11B10_FLOAT":
        w = _word(at, 4)
        return {"R": _small_bits(f"({w} & 2047)", 6, False), "G": _small_bits(f"(({w} >> 11) & 2047)", 6, False), "B": _small_bits(f"({w} >> 22)", 5, False)}
    if name == "R9G9B9E5_SHAREDEXP":
        w = _word(at, 4)
        return {c: _power_bits(f"(({w} >> {9 * i}) & 511)", f"(({w} >> 27) - 24)") for i, c in enumerate("RGB")}
    if "XR_BIAS" in name:
        w = _word(at, 4)
        out = {c: _bits(f"(CAST((({w} >> {10 * i}) & 1023) - 384 AS FLOAT) * (1::FLOAT / 510::FLOAT))") for i, c in enumerate("RGB")}
        return out | {"A": _bits(f"(CAST({w} >> 30 AS FLOAT) / 3::FLOAT)")}
    size = named_bits(name)[0][1] // 8
    return {c: _small_bits(_word(at + i * size, 2), 10, True) if size == 2 else _full_bits(_word(at + i * size, 4)) for i, (c, _, _) in enumerate(named_bits(name))}


_FLOATS = ["R16_FLOAT", "R16G16_FLOAT", "R16G16B16A16_FLOAT", "R32_FLOAT", "R32G32_FLOAT", "R32G32B32_FLOAT", "R32G32B32A32_FLOAT", "R11G11B10_FLOAT", "R9G9B9E5_SHAREDEXP", "R10G10B10_XR_BIAS_A2_UNORM"]


def _float_sql() -> str:
    parts = []
    for name in _FLOATS:
        size, kind = pixel_info(name)[1], NATIVE[name][0]
        for x in range(16 // size):
            got = _float_pixel(name, x * size)
            shown = [got["R"]] * 3 if kind == "grayscale" else [got.get(c, "0") for c in "RGB"]
            columns = [*shown, got["A"] if kind == "rgba" else "1065353216"]
            parts.append(f"SELECT doc_id, k, '{name}' AS format, CAST({x} AS BIGINT) AS x, " + ", ".join(f"CAST({v} AS BIGINT) AS {c}" for v, c in zip(columns, "rgba", strict=True)) + " FROM bl")
    return " UNION ALL ".join(parts)


@query(_float_sql(), X.BLOCKS_SQL)
def q_decode_float(spark, sf_dir):
    """Channels as the 32 bits of their single-precision numbers, every NaN as the same one."""
    sizes = {name: (n := 16 // (size := pixel_info(name)[1]), 1, n * size) for name in _FLOATS}
    pixels = packed.strip_pixels(X.strips(spark, sf_dir, sizes)).drop("y")
    nan = lambda c: F.when(F.col(c).bitwiseAND(F.lit(0x7FFFFFFF)) > 0x7F800000, F.lit(NAN)).otherwise(F.col(c))
    return pixels.withColumns({c: nan(c).cast("long") for c in "rgba"})


# -- YUV ---------------------------------------------------------------------------------------------------------------


def _f(x: float) -> str:
    return f"'{x}'::FLOAT"


def _from_yuv(y: str, u: str, v: str, bits: int) -> list[str]:
    step = 1 << (bits - 8)
    c, d, e = (f"(CAST({x} AS FLOAT) - {_f(zero * step)})" for x, zero in ((y, 16), (u, 128), (v, 128)))
    rgb = [f"({_f(1.164383)} * {c} + {_f(1.596027)} * {e})", f"({_f(1.164383)} * {c} - {_f(0.391762)} * {d} - {_f(0.812968)} * {e})", f"({_f(1.164383)} * {c} + {_f(2.017232)} * {d})"]
    if bits == 8:
        return [f"least(255, greatest(0, floor({x} + {_f(0.5)})))" for x in rgb]
    return [f"floor(least({_f(1)}, greatest({_f(0)}, {x} * ({_f(1)} / {_f((1 << bits) - 1)}))) * {_f(65535)} + {_f(0.5)})" for x in rgb]


def _yuv_pixels() -> list[tuple[str, int, int, list[str], str]]:
    """(format, x, y, the three codes, alpha) of each pixel of a block."""
    out = []
    for i in range(4):
        b = lambda j: f"block[{4 * i + j + 1}]"  # noqa: B023, E731
        out.append(("AYUV", i, 0, [b(2), b(1), b(0)], b(3)))
        w = _word(4 * i, 4)
        out.append(("Y410", i, 0, [f"(({w} >> 10) & 1023)", f"({w} & 1023)", f"(({w} >> 20) & 1023)"], f"(({w} >> 30) * 21845)"))
    for i in range(2):
        out.append(("Y416", i, 0, [_word(8 * i + 2, 2), _word(8 * i, 2), _word(8 * i + 4, 2)], _word(8 * i + 6, 2)))
    for i in range(7):  # an odd width: the last pair is cut
        pair, odd = 4 * (i // 2), i % 2
        out.append(("YUY2", i, 0, [f"block[{pair + 2 * odd + 1}]", f"block[{pair + 2}]", f"block[{pair + 4}]"], "255"))
        out.append(("UYVY", i, 0, [f"block[{pair + 2 * odd + 2}]", f"block[{pair + 1}]", f"block[{pair + 3}]"], "255"))
    for i in range(3):
        pair, odd = 8 * (i // 2), i % 2
        codes = [_word(pair + 4 * odd, 2), _word(pair + 2, 2), _word(pair + 6, 2)]
        out.append(("Y216", i, 0, codes, "65535"))
        out.append(("Y210", i, 0, [f"({c} >> 6)" for c in codes], "65535"))
    for x in range(5):
        for y in range(2):
            out.append(("NV12", x, y, [f"block[{5 * y + x + 1}]", f"block[{11 + 2 * (x // 2)}]", f"block[{12 + 2 * (x // 2)}]"], "255"))
    for x in range(2):
        for y in range(2):
            out.append(("P010", x, y, [f"({_word(2 * (2 * y + x), 2)} >> 6)", f"({_word(8, 2)} >> 6)", f"({_word(10, 2)} >> 6)"], "65535"))
            out.append(("P016", x, y, [_word(2 * (2 * y + x), 2), _word(8, 2), _word(10, 2)], "65535"))
    return out


_YUV_BITS = {"AYUV": 8, "Y410": 10, "Y416": 16, "YUY2": 8, "UYVY": 8, "Y210": 10, "Y216": 16, "NV12": 8, "P010": 10, "P016": 16}
#: Width, rows and bytes of the strip cut from a block; odd widths where the format has them.
_YUV_STRIPS = {"AYUV": (4, 1, 16), "Y410": (4, 1, 16), "Y416": (2, 1, 16), "YUY2": (7, 1, 16), "UYVY": (7, 1, 16), "Y210": (3, 1, 16), "Y216": (3, 1, 16), "NV12": (5, 2, 16), "P010": (2, 2, 12), "P016": (2, 2, 12)}


def _yuv_sql() -> str:
    parts = []
    for name, x, y, codes, alpha in _yuv_pixels():
        columns = [*_from_yuv(*codes, _YUV_BITS[name]), alpha]
        parts.append(f"SELECT doc_id, k, '{name}' AS format, CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y, " + ", ".join(f"CAST({v} AS BIGINT) AS {c}" for v, c in zip(columns, "rgba", strict=True)) + " FROM bl")
    return " UNION ALL ".join(parts)


@query(_yuv_sql(), X.BLOCKS_SQL)
def q_decode_yuv(spark, sf_dir):
    """YUV formats, whole pixels, shared chroma and two planes, in native precision."""
    return packed.strip_pixels(X.strips(spark, sf_dir, _YUV_STRIPS))


# -- encoding ----------------------------------------------------------------------------------------------------------


def _c(pixel: int, channel: str) -> str:
    """An 8-bit channel of one of the four pixels that a block's bytes are read as."""
    return "255" if channel == "X" else f"block[{4 * pixel + 'RGBA'.index(channel) + 1}]"


def _code(name: str, pixel: int, channel: str, bits: int) -> str:
    c = _c(pixel, channel)
    if "XR_BIAS" in name and channel != "A":
        return f"(2 * {c} + 384)"
    if "FLOAT" in name:
        d = f"(CAST({c} AS FLOAT) / 255::FLOAT)"
        if bits == 32:
            return _bits(d)
        m = bits - 5 if bits < 16 else 10
        k = f"greatest(floor(log2(greatest(CAST({d} AS DOUBLE), 1e-9))), -14)"
        mantissa = f"CAST({d} AS DOUBLE) * pow(2, {m} - {k})"
        return f"CAST(({k} + 14) * {1 << m} + {f'round_even({mantissa}, 0)' if m == 10 else f'floor({mantissa} + 0.5)'} AS BIGINT)"
    if "SNORM" in name:
        return f"((({c} * {2 * ((1 << bits) - 2)} + 255) // 510 + 1 + {1 << (bits - 1)}) % {1 << bits})"
    return f"(({c} * {2 * ((1 << bits) - 1)} + 255) // 510)"


def _yuv(pixel: int, bits: int) -> list[str]:
    top, step = (1 << bits) - 1, 1 << (bits - 8)
    r, g, b = (f"(CAST({_c(pixel, c)} AS FLOAT) / 255::FLOAT * {_f(top)})" for c in "RGB")
    table = ((0.256788, 0.504129, 0.097906, 16), (-0.148223, -0.290993, 0.439216, 128), (0.439216, -0.367788, -0.071427, 128))
    return [f"CAST(least({top}, greatest(0, floor({_f(i)} * {r} + {_f(j)} * {g} + {_f(n)} * {b} + {_f(zero * step + 0.5)}))) AS BIGINT)" for i, j, n, zero in table]


_PACKED = [
    "R8G8B8_UNORM", "B8G8R8_UNORM", "R8G8B8A8_UNORM", "R8G8B8A8_SNORM", "B8G8R8A8_UNORM", "B8G8R8X8_UNORM", "B5G6R5_UNORM", "B5G5R5A1_UNORM", "B4G4R4A4_UNORM", "A4B4G4R4_UNORM", "R8_UNORM", "R8_SNORM", "R8G8_UNORM", "R8G8_SNORM", "A8_UNORM",
    "R16_UNORM", "R16_SNORM", "R16G16_UNORM", "R16G16_SNORM", "R16G16B16A16_UNORM", "R16G16B16A16_SNORM", "R10G10B10A2_UNORM", "R11G11B10_FLOAT", "R16_FLOAT", "R16G16_FLOAT", "R16G16B16A16_FLOAT", "R32_FLOAT", "R32G32_FLOAT", "R32G32B32_FLOAT",
    "R32G32B32A32_FLOAT", "R10G10B10_XR_BIAS_A2_UNORM",
]


def _packed_units(name: str) -> tuple[int, list[str]]:
    """Bytes of a unit, and the units: a channel each where all are 8, 16 or 32 bits wide, otherwise a pixel each."""
    spec = named_bits(name)
    if all(bits == spec[0][1] and bits in (8, 16, 32) for _, bits, _ in spec):
        return spec[0][1] // 8, [_code(name, p, c, bits) for p in range(4) for c, bits, _ in spec]
    return pixel_info(name)[1], [" + ".join(f"{_code(name, p, c, bits)} * {1 << at}" for c, bits, at in spec) for p in range(4)]


def _shared_units() -> dict[str, tuple[int, int, int, list[str]]]:
    """Format to width, rows, bytes of a unit, and the units of four pixels."""
    out: dict[str, tuple[int, int, int, list[str]]] = {}
    eight, ten, sixteen = ([_yuv(p, bits) for p in range(4)] for bits in (8, 10, 16))
    out["AYUV"] = (4, 1, 1, [x for p in range(4) for x in (eight[p][2], eight[p][1], eight[p][0], _c(p, "A"))])
    out["Y410"] = (4, 1, 4, [f"{ten[p][1]} + {ten[p][0]} * 1024 + {ten[p][2]} * 1048576 + ({_c(p, 'A')} * 6 + 255) // 510 * 1073741824" for p in range(4)])
    out["Y416"] = (4, 1, 2, [x for p in range(4) for x in (sixteen[p][1], sixteen[p][0], sixteen[p][2], f"{_c(p, 'A')} * 257")])
    mean = lambda t, p, i: f"(({t[p][i]} + {t[min(p + 1, 3)][i]}) // 2)"
    pairs = lambda t: [[t[p][0], mean(t, p, 1), t[p + 1][0], mean(t, p, 2)] for p in (0, 2)]
    out["YUY2"] = (4, 1, 1, sum(pairs(eight), []))
    out["UYVY"] = (4, 1, 1, [x for y0, u, y1, v in pairs(eight) for x in (u, y0, v, y1)])
    out["Y216"] = (4, 1, 2, sum(pairs(sixteen), []))
    out["Y210"] = (4, 1, 2, [f"({x} & 65472)" for x in sum(pairs(sixteen), [])])
    single = lambda p, c: f"(CAST({_c(p, c)} AS FLOAT) / 255::FLOAT)"
    half = lambda p, c: f"CAST(floor(({single(p, c)} + {single(p + 1, c)}) * {_f(0.5)} * {_f(255)} + {_f(0.5)}) AS BIGINT)"
    out["R8G8_B8G8_UNORM"] = (4, 1, 1, [x for p in (0, 2) for x in (half(p, "R"), _c(p, "G"), half(p, "B"), _c(p + 1, "G"))])
    out["G8R8_G8B8_UNORM"] = (4, 1, 1, [x for p in (0, 2) for x in (_c(p, "G"), half(p, "R"), _c(p + 1, "G"), half(p, "B"))])
    out["R1_UNORM"] = (4, 1, 1, [" + ".join(f"(CASE WHEN {_c(p, 'R')} >= 128 THEN {128 >> p} ELSE 0 END)" for p in range(4))])
    for name, table, size, up in (("NV12", eight, 1, 1), ("P010", ten, 2, 64), ("P016", sixteen, 2, 1)):
        chroma = [f"(({' + '.join(table[p][i] for p in range(4))}) // 4) * {up}" for i in (1, 2)]
        out[name] = (2, 2, size, [f"{table[p][0]} * {up}" for p in range(4)] + chroma)
    return out


_SHARED = _shared_units()


def _units_sql(name: str, units: list[str]) -> str:
    return f"SELECT doc_id, k, '{name}' AS format, concat_ws(',', " + ", ".join(f"CAST({u} AS BIGINT)" for u in units) + ") AS units FROM bl"


def _encoded(spark, sf_dir, formats: dict[str, int], width: int, rows: int):
    """Four RGBA pixels of 8 bits in each format, as a list of little-endian numbers of the format's bytes a unit."""
    pixels = X.block_bytes(spark, sf_dir).withColumns({"width": F.lit(width), "rows": F.lit(rows)})
    sizes = F.create_map(*(F.lit(v) for item in formats.items() for v in item))
    data = encode.strips(pixels, list(formats)).withColumn("size", F.element_at(sizes, F.col("format")))
    return data.withColumn("units", numbers_of(F.col("data"), F.col("size"))).select("doc_id", "k", "format", F.concat_ws(",", F.col("units").cast("array<string>")).alias("units"))


@query(" UNION ALL ".join(_units_sql(name, _packed_units(name)[1]) for name in _PACKED), X.BLOCKS_SQL)
def q_encode_packed(spark, sf_dir):
    """Four RGBA pixels of 8 bits in each of the packed formats."""
    return _encoded(spark, sf_dir, {name: _packed_units(name)[0] for name in _PACKED}, 4, 1)


@query(" UNION ALL ".join(_units_sql(name, units) for name, (_, _, _, units) in _SHARED.items()), X.BLOCKS_SQL)
def q_encode_yuv(spark, sf_dir):
    """Four RGBA pixels of 8 bits in the YUV, sub-sampled and bi-planar formats, the latter as a square."""
    lines = {name: size for name, (_, rows, size, _) in _SHARED.items() if rows == 1}
    squares = {name: size for name, (_, rows, size, _) in _SHARED.items() if rows == 2}
    return _encoded(spark, sf_dir, lines, 4, 1).unionByName(_encoded(spark, sf_dir, squares, 2, 2))


_BLOCKS = ["BC1_UNORM", "BC2_UNORM", "BC2_UNORM_PREMULTIPLIED_ALPHA", "BC3_UNORM", "BC3_UNORM_PREMULTIPLIED_ALPHA", "BC3_UNORM_RXGB", "BC3_UNORM_NORMAL", "BC4_UNORM", "BC4_SNORM", "BC5_UNORM", "BC5_SNORM", "BC7_UNORM"]


@query()
def q_encode_blocks(spark, sf_dir):
    """Each embedding as 16 pixels in each block format, as hexadecimal bytes.

    Encoders are free in their choices, so there is no SQL; tests decode the blocks and bound the error by brute force."""
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    pixels = raster.gather(X.vectors(spark, sf_dir), ["vec_id"], "i", F.concat(*(byte(c) for c in "rgba")))
    blocks = encode.strips(pixels.select("vec_id", "data", F.lit(4).alias("width"), F.lit(4).alias("rows")), _BLOCKS)
    return blocks.select("vec_id", "format", F.hex("data").alias("block"))


__all__ = ["ORACLES", "QUERIES"]
